import hashlib
import zlib

from lodestar.llm.manifest import Manifest, manifest
from tests.llm.cases import SCHEMA, odd_rows, prose


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(doc_id, source, lang, n_chars, text):
    return h([field(doc_id), field(source), field(lang), field(n_chars), field(text)])


def tree(nodes, fanout=3):
    """Root of nodes, and for every node its siblings and a function that folds a new value up."""
    paths = [[] for _ in nodes]  # per node: list of (run, place)
    level, members = list(nodes), [[i] for i in range(len(nodes))]
    while len(level) > 1:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        for r, run in enumerate(runs):
            for place in range(len(run)):
                for node in members[r * fanout + place]:
                    paths[node].append((run, place))
        members = [sum(members[i : i + fanout], []) for i in range(0, len(level), fanout)]
        level = [h(run) for run in runs]
    return level[0], paths


def fold(value, path):
    for run, place in path:
        value = h([value if i == place else x for i, x in enumerate(run)])
    return value


def brute(rows):
    by_source = {}
    for doc_id, text, lang, source, n_chars, *_ in rows:
        tampered = text.replace("\n", "") if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 else text
        item = (doc_id, leaf(doc_id, source, lang, n_chars, text), leaf(doc_id, source, lang, n_chars, tampered))
        by_source.setdefault(source, []).append(item)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in names:
        items = sorted(by_source[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        subs[s] = (items, *tree([x[1] for x in items]))
    root, top = tree([subs[s][1] for s in names])
    out = []
    for k, s in enumerate(names):
        items, sub, paths = subs[s]
        for (doc_id, lf, tl), path in zip(items, paths):
            full = path + top[k]
            proof = h([x for run, place in full for i, x in enumerate(run) if i != place])
            folded = fold(tl, full)
            out.append((doc_id, lf, sub, root, proof, folded, folded == root))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


EXTRA = (True, 1.0, 1, 5, 7, 1, "s", 3, 2, 4, 9)


def test_matches_brute_force_with_odd_rows(spark):
    rows = [(i, t, "en", None if i == 3 else f"s{(i or 0) % 3}", None if t is None else len(t), *EXTRA) for i, t in odd_rows()]
    rows += [(100 + i, f"line {i}\nnext\n" * (i % 4), None if i % 5 else "de", "big", i, *EXTRA) for i in range(200)]
    rows += [(7, "tie\n", "en", "big", 4, *EXTRA), (7, "tie\n", "en", "big", 4, *EXTRA), (8, None, None, "ünï", None, *EXTRA)]
    got = sorted((tuple(r) for r in manifest(frame(spark, rows)).collect()), key=str)
    assert got == brute(rows)
    assert any(not r[6] for r in got) and any(r[6] for r in got)


def test_one_row_and_other_fanouts(spark):
    one = [(1, "a\nb", "en", "x", 3, *EXTRA)]
    assert sorted(tuple(r) for r in manifest(frame(spark, one)).collect()) == brute(one)
    rows = [(i, prose(30, i), "en", "s", 1, *EXTRA) for i in range(40)]
    got = manifest(frame(spark, rows), Manifest(fanout=3, stored=1)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_empty_table(spark):
    assert manifest(frame(spark, [])).count() == 0
