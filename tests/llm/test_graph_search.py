import numpy as np

from lodestar.llm.graph_search import Graph, nearest

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int, shard int"


def rows_of(vectors):
    return [(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1.0, 1, 2) for i, v in vectors]


def brute(vectors, k, every):
    held = {}
    for i, v in vectors:
        if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            held[i] = np.array(v, np.float32).astype(float)
    out = {}
    for q in held:
        if q % every == 0:
            scores = sorted((-(held[q] @ v), i) for i, v in held.items() if i != q and len(v) == len(held[q]))
            out[q] = scores[:k]
    return out


def test_recall_with_lengths_copies_and_odd_vectors(spark):
    random = np.random.default_rng(2)
    points = random.normal(size=(3000, 16)) * random.uniform(0.5, 2, (3000, 1))
    points[500:1500] = points[500]
    vectors = list(enumerate(points.tolist()))
    vectors += [(4000, None), (4020, [0.0] * 16), (4040, [float("nan")] * 16), (4060, [1.0, None] + [0.0] * 14), (4080, [float("inf")] + [1.0] * 15)]
    vectors.append(vectors[20])
    out = nearest(spark.createDataFrame(rows_of(vectors), SCHEMA), how=Graph(shard_rows=600)).collect()
    want, got = brute(vectors, 20, 20), {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    assert all(x == sorted(x) for x in got.values())
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.95 * 20 * len(want)
    exact = dict(vectors)
    assert all(abs(r.score - np.array(exact[r.query_id], np.float32).astype(float) @ np.array(exact[r.vec_id], np.float32)) < 1e-5 for r in out)


def test_few_vectors_are_all_given(spark):
    vectors = [(20, [1.0, 0.0]), (21, [0.5, 0.5]), (22, [0.5, 0.5]), (40, [-1.0, 0.0]), (60, [1.0, 2.0, 3.0])]
    out = nearest(spark.createDataFrame(rows_of(vectors), SCHEMA))
    got = {(r.query_id, r["rank"]): r.vec_id for r in out.collect()}
    assert got == {(20, 1): 21, (20, 2): 22, (20, 3): 40, (40, 1): 21, (40, 2): 22, (40, 3): 20}


def test_empty_table(spark):
    assert nearest(spark.createDataFrame([], SCHEMA)).count() == 0
