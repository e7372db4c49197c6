import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.llm import near_dedup as nd
from lodestar.llm.graph import components
from lodestar.llm.near_dedup import MinHash, first_of_groups, near_duplicates, shingle_sets
from tests.llm.cases import odd_rows, table, words


def brute(rows, n):
    """Smallest id that links lead to, by comparing all sets."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split() if (t or "").isascii() else [x for x in (t or "").split(" ") if x.strip()]
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()})
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(doc)
    least = {r: min((d for d in docs if d is not None), default=None) for r, docs in groups.items()}
    return [(doc, len(s), least[root(i)] if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))]


def copies(seed, n, size=80):
    """A text and near copies of it, each with a few words changed, so that links form chains."""
    pick, out = random.Random(seed), []
    text = words(size, seed)
    for _ in range(n):
        text = list(text)
        for at in pick.sample(range(size), pick.randrange(0, 5)):
            text[at] = f"new{pick.randrange(10_000)}"
        out.append(" ".join(text))
    return out


def rows_with_copies():
    texts = [t for seed in range(12) for t in copies(seed, 12)] + ["One", "one two", "ONE TWO"]
    random.Random(4).shuffle(texts)
    return odd_rows() + list(enumerate(texts, 100))


def same(got, want):
    key = lambda row: tuple(-1 if x is None else x for x in row)
    return sorted(map(key, got)) == sorted(map(key, want))


def test_components_are_those_of_all_links(spark):
    rows = rows_with_copies()
    for n in (2, 5):
        got = near_duplicates(table(spark, rows), MinHash(shingle_words=n)).collect()
        assert same([(r.doc_id, r.n_shingles, r.component_id) for r in got], brute(rows, n))
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_of_each_group_stays_with_all_columns(spark):
    rows = rows_with_copies()
    docs = table(spark, rows)
    out = first_of_groups(docs)
    assert out.columns == docs.columns
    want = {(d, t) for (d, t), (_, _, c) in zip(rows, brute(rows, 5), strict=True) if d == c}
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_signatures_at_the_guaranteed_distance_share_a_key(spark):
    """Any 23 slots may differ; some chunk then has at most one."""
    import numpy as np

    from lodestar.llm.near_dedup import index_keys

    how, pick = MinHash(), np.random.default_rng(1)
    rows = []
    for pair in range(40):
        one = pick.integers(0, 1 << 8, how.slots, dtype=np.uint8)
        two = one.copy()
        two[pick.choice(how.index_slots, how.guaranteed, replace=False)] += np.uint8(1 + pair)
        rows += [(2 * pair, bytearray(one.tobytes())), (2 * pair + 1, bytearray(two.tobytes()))]
    keys = index_keys(spark.createDataFrame(rows, "node long, signature binary"), how).collect()
    by_node = {}
    for r in keys:
        by_node.setdefault(r.node, set()).add(r.key)
    assert how.guaranteed == 23 and all(by_node[2 * p] & by_node[2 * p + 1] for p in range(40))


def test_shingles_fold_ascii_case_only():
    a, b, c = shingle_sets(pa.array(["The cat", "tHE  CAT", "ÉA cat"]), 2)
    assert (a == b).all() and not set(a) & set(c) and set(shingle_sets(pa.array(["éA cat"]), 2)[0]) != set(c)


def test_components_of_a_long_path_and_a_hub(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(200, 400)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 1: 1, **{i: 1 for i in range(200, 400)}}


def test_empty_table(spark):
    assert near_duplicates(table(spark, [])).count() == 0
    assert near_duplicates(table(spark, [(1, None), (2, "")])).where("kept").count() == 2


@pytest.mark.parametrize("listed", [1024, 20])
def test_group_of_nearly_similar_texts_gives_few_rows(spark, listed):
    """Texts of which no two are similar enough, though their signatures are near, but for a few that are."""
    texts = []
    for i in range(16):
        # Each changes 12 words of 400 that no other changes, nor their neighbours.
        own = [f"own{i}x{at}" if at % 33 == 2 * i and at < 396 else f"w{at}" for at in range(400)]
        texts.append(" ".join(own))
        if i % 8 == 0:
            texts.append(" ".join([*own[:-1], "end"]))
    sets = [{*zip(t.split(), t.split()[1:])} for t in texts]
    linked = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert len(linked) == 2
    how = MinHash(listed=listed, seed=5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    signed = nd.signatures(docs, how, "doc_id", "text").withColumn("node", F.col("doc_id"))
    classes = signed.withColumn("first", F.struct("doc_id", "text_hash"))
    members = nd.index_keys(classes, how).withColumn("label", F.col("node"))
    sets_of = nd.sets_of(docs, classes.select("node"), classes, how, "doc_id", "text")
    found = nd.near_in_keys(members, classes, sets_of, how)
    pairs = {(r.a, r.b) for r in found.collect()}
    # Each is given once. Larger sets than are listed are told apart by their slots only.
    assert found.count() == len(pairs) and pairs >= linked
    assert len(pairs) < 10 if listed == 1024 else len(pairs) > 50
    assert {(r.a, r.b) for r in nd.confirmed(found, sets_of, how).collect()} == linked


def test_links_are_followed_once_a_round(spark, monkeypatch):
    """A star round makes at most one pair a class, so its pairs are confirmed and followed in one step."""
    rows, followed, kept = rows_with_copies(), [], nd.components
    monkeypatch.setattr(nd, "components", lambda links: followed.append(1) or kept(links))
    got = near_duplicates(table(spark, rows)).collect()
    assert same([(r.doc_id, r.n_shingles, r.component_id) for r in got], brute(rows, 2))
    assert len(followed) == MinHash().stars + 1
