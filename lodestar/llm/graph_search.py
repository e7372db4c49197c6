"""Nearest neighbours by inner product over robust-pruned directed graphs, one for each shard.

Vectors that are equal are one node. A node's vector gets one more component, so that all have the length of the
longest one; the nearest by distance is then the largest inner product. In each shard a graph is built as follows:
greedy searches from an entry propose neighbours for every node, relaxed distance pruning keeps a few that lie in
different directions, links are made both ways and pruned again. Every query is searched in every shard with a beam,
in blocks of queries; what the beams found is scored in double precision on the original vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.session import written


@dataclass(frozen=True)
class Graph:
    """A task holds ``shard_rows`` nodes and ``block_rows`` queries; ``least_shards`` keep small inputs parallel.

    A node has up to ``degree`` links after pruning, and up to ``width`` before it is pruned again; ``considered``
    candidates, the nearest, are looked at in a pruning.
    """

    degree: int = 36
    width: int = 56
    considered: int = 96
    build_beam: int = 64
    search_beam: int = 160
    alpha: float = 1.2
    shard_rows: int = 20_000
    block_rows: int = 4_096
    least_shards: int = 6
    step_rows: int = 512
    seed: int = 8


def beam_search(points: np.ndarray, links: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Nodes and squared distances of each query's beam, nearest first (node -1: none), and all nodes that were opened.

    All queries step together: each opens its nearest node that is not open yet, until none has one.
    """
    n, q = len(points), len(queries)
    norms = (points**2).sum(axis=1)
    own = (queries**2).sum(axis=1)
    ids = np.full((q, beam), -1)
    dist = np.full((q, beam), np.inf, np.float32)
    ids[:, 0] = entry
    dist[:, 0] = norms[entry] - 2 * queries @ points[entry] + own
    opened = np.zeros((q, beam), bool)
    seen = np.zeros((q, n), bool)
    seen[:, entry] = True
    trail_q: list[np.ndarray] = []
    trail_n: list[np.ndarray] = []
    live = np.arange(q)
    while len(live):
        waiting = ~opened[live] & (ids[live] >= 0)
        live = live[waiting.any(axis=1)]
        if not len(live):
            break
        at = (~opened[live] & (ids[live] >= 0)).argmax(axis=1)
        node = ids[live, at]
        opened[live, at] = True
        trail_q.append(live)
        trail_n.append(node)
        near = links[node]
        new = (near >= 0) & ~seen[live[:, None], near]
        near = np.where(new, near, 0)
        rows = np.broadcast_to(live[:, None], near.shape)
        seen[rows[new], near[new]] = True
        cross = np.matmul(points[near], queries[live][:, :, None])[:, :, 0]
        far = np.where(new, norms[near] - 2 * cross + own[live][:, None], np.inf).astype(np.float32)
        all_dist = np.concatenate([dist[live], far], axis=1)
        all_ids = np.concatenate([ids[live], np.where(new, near, -1)], axis=1)
        all_open = np.concatenate([opened[live], np.zeros(near.shape, bool)], axis=1)
        best = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        dist[live] = np.take_along_axis(all_dist, best, axis=1)
        ids[live] = np.take_along_axis(all_ids, best, axis=1)
        opened[live] = np.take_along_axis(all_open, best, axis=1)
    return ids, dist, (np.concatenate(trail_q), np.concatenate(trail_n))


def robust_prune(points: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, how: Graph, alpha: float) -> np.ndarray:
    """At most ``degree`` of each node's candidates (-1: none), by distance, none much nearer to one kept before."""
    candidates = np.sort(candidates, axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    valid = (candidates >= 0) & (candidates != nodes[:, None])
    safe = np.where(valid, candidates, 0)
    norms = (points**2).sum(axis=1)
    cross = np.matmul(points[safe], points[nodes][:, :, None])[:, :, 0]
    far = np.where(valid, norms[safe] - 2 * cross + norms[nodes][:, None], np.inf)
    order = np.argsort(far, axis=1, kind="stable")[:, : how.considered]
    safe, far = np.take_along_axis(safe, order, axis=1), np.take_along_axis(far, order, axis=1)
    vectors = points[safe]
    between = norms[safe][:, :, None] + norms[safe][:, None, :] - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
    out = np.full((len(nodes), how.degree), -1)
    row = np.arange(len(nodes))
    for k in range(how.degree):
        at = far.argmin(axis=1)
        left = np.isfinite(far[row, at])
        if not left.any():
            break
        out[left, k] = safe[row, at][left]
        far = np.where(alpha**2 * between[row, at] <= far, np.inf, far)
        far[row, at] = np.inf
    return out


def _padded(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Values by row, -1 where a row has fewer than others."""
    order = np.argsort(rows, kind="stable")
    rows, values = rows[order], values[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    out = np.full((n, int(place.max(initial=0)) + 1), -1)
    out[rows, place] = values
    return out


def build(points: np.ndarray, how: Graph) -> tuple[np.ndarray, int]:
    """Links of all nodes (-1: none), and the node to enter at: the nearest one to the mean."""
    n = len(points)
    random = np.random.default_rng(how.seed)
    entry = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    links = np.full((n, how.width), -1)
    links[:, : how.degree // 2] = random.integers(0, n, (n, how.degree // 2))
    for alpha in (1.0, how.alpha):
        for block in np.array_split(random.permutation(n), -(-n // how.step_rows)):
            ids, _, (rows, nodes) = beam_search(points, links, entry, points[block], how.build_beam)
            proposed = np.concatenate([ids, links[block], _padded(rows, nodes, len(block))], axis=1)
            kept = robust_prune(points, block, proposed, how, alpha)
            links[block] = -1
            links[block, : how.degree] = kept
            _link_back(points, links, block, kept, how, alpha)
    return links, entry


def _link_back(points: np.ndarray, links: np.ndarray, block: np.ndarray, kept: np.ndarray, how: Graph, alpha: float) -> None:
    """Every node that is linked to links back; nodes with too many links are pruned."""
    to, place = np.unique(kept[kept >= 0], return_inverse=True)
    more = _padded(place, np.repeat(block, (kept >= 0).sum(axis=1)), len(to))
    both = np.concatenate([links[to], more], axis=1)
    fits = (both >= 0).sum(axis=1) <= how.width
    links[to[fits]] = -np.sort(-both[fits], axis=1)[:, : how.width]
    full = np.flatnonzero(~fits)
    for part in np.array_split(full, -(-len(full) // how.step_rows)) if len(full) else ():
        pruned = robust_prune(points, to[part], both[part], how, alpha)
        links[to[part]] = -1
        links[to[part], : how.degree] = pruned


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, vector`` (doubles) of the vectors that take part: not null, not zero, every component finite."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vector.alias("vector"))
    return rows.where(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def nodes_of(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors with the smallest k + 1 ids of each: no more of one vector are among k nearest."""
    first = Window.partitionBy("vector").orderBy("vec_id")
    return (
        rows.distinct()
        .withColumn("place", F.row_number().over(first))
        .where(F.col("place") <= k + 1)
        .groupBy("vector")
        .agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    )


def index(nodes: DataFrame, reach: float, how: Graph) -> DataFrame:
    """``shard, dims, place, ids, vector, links, entry``: the graph of every shard. Spaces of other dimensions are apart."""

    def linked(part: pd.DataFrame) -> pd.DataFrame:
        links, entry = build(lifted(np.stack(part["vector"].to_list()), reach), how)
        return pd.DataFrame(
            {
                "dims": part["dims"], "shard": part["shard"], "place": np.arange(len(part)), "ids": part["ids"],
                "vector": part["vector"], "links": list(links.astype(np.int32)), "entry": entry,
            }
        )

    return nodes.groupBy("dims", "shard").applyInPandas(
        linked, "dims int, shard int, place int, ids array<long>, vector array<double>, links array<int>, entry int"
    )


def lifted(vectors: np.ndarray, reach: float) -> np.ndarray:
    """Vectors with one more component that brings them to the length ``reach``; distances then order as products do."""
    rest = np.sqrt(np.maximum(reach**2 - (vectors**2).sum(axis=1), 0))
    return np.concatenate([vectors, rest[:, None]], axis=1).astype(np.float32)


def nearest(
    vectors: DataFrame, k: int = 20, every: int = 20, how: Graph = Graph(), id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest of each vector whose id is divisible by ``every``.

    Nearest first, ties to the smaller id; a query's own id is never among them, and with fewer candidates all are
    given. Repeated rows count once; vectors of different dimensions are searched apart; an empty table gives none.
    """
    rows = usable(vectors, id_col, vector_col)
    nodes = written(nodes_of(rows, k), "nodes")
    size, reach = nodes.select(F.count("*"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).first()
    shards = max(how.least_shards, -(-size // how.shard_rows))
    queries = rows.where(F.col("vec_id") % every == 0).distinct()
    blocks = max(1, -(-queries.count() // how.block_rows))
    dims = F.size("vector").alias("dims")
    placed = nodes.select("*", dims, F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int").alias("shard"))
    graph = written(index(placed, float(reach or 0.0) ** 0.5, how), "graph")
    asked = queries.select(
        F.col("vec_id").alias("query_id"), "vector", dims, F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
    )
    held = graph.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    length = float(reach or 0.0) ** 0.5
    key = ["dims", "shard", "block"]

    def search(shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        if not len(shard) or not len(block):
            return none
        shard = shard.sort_values("place")
        points = np.stack(shard["vector"].to_list())
        links, entry = np.stack(shard["links"].to_list()), int(shard["entry"].iloc[0])
        ids = shard["ids"].to_list()
        graph_points = lifted(points, length)
        out = []
        for begin in range(0, len(block), how.step_rows):
            part = block.iloc[begin : begin + how.step_rows]
            own = part["query_id"].to_numpy()
            q = np.stack(part["vector"].to_list())
            found, _, _ = beam_search(graph_points, links, entry, np.pad(q, ((0, 0), (0, 1))).astype(np.float32), max(how.search_beam, 2 * k))
            at, place = np.nonzero(found >= 0)
            node = found[at, place]
            score = (q[at] * points[node]).sum(axis=1)
            counts = np.array([len(ids[x]) for x in node])
            rows = pd.DataFrame(
                {
                    "query_id": np.repeat(own[at], counts),
                    "vec_id": np.concatenate([ids[x] for x in node]),
                    "score": np.repeat(score, counts),
                }
            )
            rows = rows[rows["query_id"] != rows["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
            out.append(rows.groupby("query_id", sort=False).head(k))
        return pd.concat(out)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        held.groupBy(*key)
        .cogroup(asked.groupBy(*key))
        .applyInPandas(search, "query_id long, vec_id long, score double")
        .groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
