"""Merkle manifest of a table of documents, with a proof for every row.

Every row is a leaf: the SHA-256 (lowercase hex) of its doc_id, source, lang, n_chars and text, each written as ``-``
if null, else as its UTF-8 byte count, ``:`` and its value. Within a source, leaves ascend by doc_id (then by leaf,
so that ties are defined); while a level has more than one node, every run of ``fanout`` consecutive nodes (the last
run shorter, even of one) becomes the hash of their hex digests. What remains is the source's subroot, and the
subroots, by source (null first, bytewise), make the root alike.

Method (checkpoint and recompute): only every ``stored``-th level is written to the shared folder. A stored level is cut
into aligned subtrees of ``fanout ** stored`` nodes; one task rebuilds the levels in between from them, emits each
member's siblings and the subtree's top, and drops the rest. A row's proof is the hex of all its siblings, level by
level up to the root, left to right. Its folded root recomputes the path with a tampered leaf (rows whose doc_id has an
even crc32 lose the newlines of their text) and the original siblings; it verifies where it equals the root.

Rows carry their path upwards one stored level at a time: they are joined with the subtree above them, which is sent
to every task where the level has few subtrees (counted first) and shuffled by subtree otherwise, so one hot source
never lands in one task. Defined results: nulls are ``-`` in a leaf and a null text stays null when tampered; repeated
rows are repeated leaves; a source of one row has that leaf as subroot; an empty table gives no rows. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lodestar.session import broadcast_within, with_ordinals, written

# Subtrees of a stored level sent whole to every task when there are at most this many of them.
BROADCAST_SUBTREES = 20_000


@dataclass(frozen=True)
class Manifest:
    fanout: int = 3
    stored: int = 3


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*(_field(c) for c in (doc_id, source, lang, n_chars, text))), 256)


def _h(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(level: list[str], count: int, at: int, value: str | None, fanout: int, most: int) -> tuple[str, str | None, str]:
    """Rebuild up to ``most`` levels above an aligned subtree.

    ``level`` holds the subtree's nodes in order, ``count`` the nodes of the whole tree at this level and ``at`` a
    member's place within the subtree (or -1). Returns the member's siblings in order, its value folded up with the
    original siblings, and the subtree's top.
    """
    siblings: list[str] = []
    done = 0
    while count > 1 and done < most:
        if at >= 0:
            first = at - at % fanout
            run = level[first : first + fanout]
            siblings.extend(h for i, h in enumerate(run) if first + i != at)
            value = _h([value if first + i == at else h for i, h in enumerate(run)])
            at //= fanout
        level = [_h(level[i : i + fanout]) for i in range(0, len(level), fanout)]
        count = -(-count // fanout)
        done += 1
    return "".join(siblings), value, level[0]


def _step(how: Manifest):
    width = how.fanout**how.stored

    @pandas_udf("struct<siblings: string, value: string>")
    def member(nodes: pd.Series, count: pd.Series, at: pd.Series, value: pd.Series) -> pd.DataFrame:
        out = [
            ("", v) if n is None else climb(list(n), int(c), int(a) % width, v, how.fanout, how.stored)[:2]
            for n, c, a, v in zip(nodes, count, at, value)
        ]
        return pd.DataFrame(out, columns=["siblings", "value"])

    @pandas_udf("string")
    def top(nodes: pd.Series, count: pd.Series) -> pd.Series:
        return pd.Series([climb(list(n), int(c), -1, None, how.fanout, how.stored)[2] for n, c in zip(nodes, count)])

    return member, top


def _trees(nodes: DataFrame, rows: DataFrame, how: Manifest) -> tuple[DataFrame, DataFrame]:
    """Fold trees of ``nodes (t, idx, h, count)`` to their roots ``(t, root)``; ``rows (t, at, proof, value, ...)`` climb along."""
    width = how.fanout**how.stored
    member, top = _step(how)
    roots = []
    while True:
        roots.append(nodes.where(F.col("count") == 1).select("t", F.col("h").alias("root")))
        open_nodes = nodes.where(F.col("count") > 1)
        subtrees = written(
            open_nodes.groupBy("t", (F.col("idx") / F.lit(width)).cast("long").alias("g")).agg(
                F.transform(F.array_sort(F.collect_list(F.struct("idx", "h"))), lambda x: x["h"]).alias("nodes"),
                F.max("count").alias("count"),
            ),
            "manifest_level",
        )
        n_subtrees = subtrees.count()
        if n_subtrees == 0:
            break
        placed = rows.withColumn("g", (F.col("at") / F.lit(width)).cast("long"))
        joined = placed.join(broadcast_within(subtrees, n_subtrees, BROADCAST_SUBTREES), ["t", "g"], "left")
        climbed = member("nodes", "count", "at", "value")
        rows = written(
            joined.select(
                *[c for c in rows.columns if c not in ("at", "proof", "value")],
                F.when(F.col("nodes").isNull(), F.col("at")).otherwise(F.col("g")).alias("at"),
                F.when(F.col("nodes").isNull(), F.col("proof")).otherwise(F.concat("proof", climbed["siblings"])).alias("proof"),
                F.when(F.col("nodes").isNull(), F.col("value")).otherwise(climbed["value"]).alias("value"),
            ),
            "manifest_rows",
        )
        nodes = subtrees.select("t", F.col("g").alias("idx"), top("nodes", "count").alias("h"), F.ceil(F.col("count") / width).alias("count"))
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return found, rows


def manifest(documents: DataFrame, how: Manifest = Manifest()) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    docs = documents.select("doc_id", "source", "lang", "n_chars", "text")
    tamper = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 2 == 0)
    leaves = docs.select(
        "doc_id",
        "source",
        leaf_of(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))).alias("leaf"),
        leaf_of(
            *(F.col(c) for c in ("doc_id", "source", "lang", "n_chars")),
            F.when(tamper, F.translate("text", "\n", "")).otherwise(F.col("text")),
        ).alias("tampered"),
    )
    ordered = with_ordinals(leaves, ["source", "doc_id", "leaf"], "r")
    sources = with_ordinals(
        ordered.groupBy("source").agg(F.min("r").alias("first"), F.count("*").alias("count")), ["source"], "t"
    )
    n_sources = sources.count()
    placed = written(
        ordered.alias("o")
        .join(broadcast_within(sources, n_sources, BROADCAST_SUBTREES).alias("s"), F.col("o.source").eqNullSafe(F.col("s.source")))
        .select("o.doc_id", "o.leaf", "o.tampered", "o.r", "s.t", (F.col("o.r") - F.col("s.first")).alias("idx"), "s.count"),
        "manifest_leaves",
    )
    nodes = placed.select("t", "idx", F.col("leaf").alias("h"), "count")
    rows = placed.select(
        "doc_id", "leaf", "r", "t", F.col("t").alias("source_rank"), F.col("idx").alias("at"),
        F.lit("").alias("proof"), F.col("tampered").alias("value"),
    )
    subroots, rows = _trees(nodes, rows, how)
    subroots = written(subroots, "manifest_subroots")
    top_nodes = subroots.select(F.lit(0).cast("long").alias("t"), F.col("t").alias("idx"), F.col("root").alias("h"), F.lit(n_sources).alias("count"))
    rows = rows.withColumn("at", F.col("t")).withColumn("t", F.lit(0).cast("long"))
    root, rows = _trees(top_nodes, rows, how)
    named = subroots.select(F.col("t").alias("source_rank"), F.col("root").alias("subroot"))
    return (
        rows.join(broadcast_within(named, n_sources, BROADCAST_SUBTREES), "source_rank")
        .join(F.broadcast(root.select("t", "root")), "t")
        .select(
            "doc_id",
            "leaf",
            "subroot",
            "root",
            F.sha2("proof", 256).alias("proof_sha256"),
            F.col("value").alias("folded_root"),
            (F.col("value") == F.col("root")).alias("verified"),
        )
    )
