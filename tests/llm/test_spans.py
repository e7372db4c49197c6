import re

from lodestar.llm.spans import cleaned, without_repeats
from tests.llm.cases import odd_rows, prose, table

CUT = re.compile(r"\n|(?<=[.!?])[ \t\x0b\x0c\r]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sentences(text):
    """Words of each sentence, and where it begins."""
    out, begin = [], 0
    for m in [*CUT.finditer(text), None]:
        end = m.start() if m else len(text)
        found = WORD.search(text, begin, end)
        if found:
            out.append((tuple(WORD.findall(text[begin:end].translate(LOWER))), found.start()))
        begin = m.end() if m else end
    return out


def runs(sizes):
    found = set()
    for at in range(len(sizes)):
        end = at
        while end < len(sizes) and not (end > at and sum(sizes[at : end + 1]) >= 20):
            end += 1
        begin = at
        while begin >= 0 and not (begin < at and sum(sizes[begin : at + 1]) >= 20):
            begin -= 1
        found |= {(at, end)} if end < len(sizes) else set()
        found |= {(begin, at)} if begin >= 0 else set()
        found |= {(at, at)} if sizes[at] >= 40 else set()
    return found


def brute(rows):
    """Cleaned text and number of removed sentences of every row."""
    split = [sentences(t or "") for _, t in rows]
    first = {}
    where = [(-1 if i is None else i, t or "") for i, t in rows]
    found = [runs([len(w) for w, _ in s]) for s in split]
    for k, s in enumerate(split):
        for a, b in found[k]:
            key = tuple(w for w, _ in s[a : b + 1])
            first[key] = min(first.get(key, ((1 << 62, ""), 0)), (where[k], a))
    out = []
    for k, ((_, t), s) in enumerate(zip(rows, split, strict=True)):
        gone = {i for a, b in found[k] if first[tuple(w for w, _ in s[a : b + 1])] != (where[k], a) for i in range(a, b + 1)}
        if gone:
            edges = [p for _, p in s] + [len(t)]
            t = (t[: edges[0]] + "".join(t[edges[i] : edges[i + 1]] for i in range(len(s)) if i not in gone)).rstrip(" \t\n\x0b\x0c\r")
        out.append((t, len(gone)))
    return out


PASSAGE = prose(60, 77)
ROWS = odd_rows() + [
    (40, prose(50, 40) + "\n" + PASSAGE + "\n" + prose(50, 41)), (41, PASSAGE), (42, prose(40, 42) + " " + PASSAGE.upper() + " " + prose(30, 43)),
    (43, "Yes. No. Yes. No."), (44, "Yes. No. Yes. No."), (45, " ".join(f"v{i}" for i in range(45))), (46, "Short one. " + " ".join(f"v{i}" for i in range(45))),
]


def test_later_spans_go(spark):
    docs = table(spark, ROWS)
    out = without_repeats(docs)
    extra = out.columns[-1]
    got = sorted(((r.doc_id or 0, r.text or "", r[extra].n_removed) for r in out.collect()))
    assert got == sorted((i or 0, t or "", n) for (i, _), (t, n) in zip(ROWS, brute(ROWS), strict=True))
    assert out.columns[:-1] == docs.columns and extra not in docs.columns
    by_id = {r.doc_id: r for r in out.collect()}
    assert by_id[42][extra].first_doc_ids == [40] and by_id[43][extra].n_removed == 0 and by_id[1].text is None
    assert PASSAGE[-20:] in by_id[40].text and by_id[41].text == ""


def test_documents_that_are_nothing_else_go(spark):
    docs = table(spark, ROWS)
    out = cleaned(docs)
    ids = {r.doc_id for r in out.collect()}
    assert out.columns == docs.columns and 41 not in ids and {1, 2, 3, 40, 42} <= ids


def test_empty_table(spark):
    assert without_repeats(table(spark, [])).count() == 0
