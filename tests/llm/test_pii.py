import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestar.llm.pii import masked, matches, personal_data_summary, stretches, tokens
from tests.llm.cases import odd_rows, table

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        doubled = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and doubled % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS for m in re.finditer(p, text or "") if passes(k, m.group())]


TEXTS = [
    "write to a.b@c-d.example.org, or x@y or a@b.c%d@e.f.g@h.i",
    "10.0.0.1 and 256.1.1.1 and 1.2.3.4.5.6.7.8 and 0001.02.3.255 é10.20.30.40",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112, 4111111111111111 1 2",
    "+1 (014) 555-0199 or +49 30 1234 or +1 ((((( or +123456789012345678",
    "😀 é a@b.co 😀 +1 212 555 0100",
    "1" * 3000 + " " + "a" * 3000 + "@",
]


def test_base_spans_are_those_of_the_contract(spark):
    rows = odd_rows() + [(100 + i, t) for i, t in enumerate(TEXTS)]
    got = personal_data_summary(table(spark, rows)).collect()
    want = {(i, hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest()) for i, t in rows}
    assert {(r.doc_id, r.base_sha256) for r in got} == want
    assert len(got) == len({(i, t or "") for i, t in rows})
    by_id = {r.doc_id: r for r in got if r.doc_id and r.doc_id >= 100}
    for i, t in rows[len(odd_rows()) :]:
        spans = base_spans(t)
        assert set(spans) <= set(by_id[i].spans.split(","))
        assert [by_id[i][f"n_{k}"] for k, _ in PATTERNS] == [sum(s.startswith(k) for s in spans) for k, _ in PATTERNS]


def test_contexts_of_seeds_find_other_identifiers(spark):
    seeds = [f"some words access key {hashlib.md5(str(i).encode()).hexdigest()} and more" for i in range(6)]
    rows = list(enumerate([*seeds, "now access key zz81-77QK! ends", "other words 12345 here"]))
    got = {r.doc_id: r.spans for r in personal_data_summary(table(spark, rows)).collect()}
    assert got[6] == "secret:15:24" and got[7] == ""
    texts = {r.doc_id: r.text for r in masked(table(spark, rows)).collect()}
    assert texts[6] == "now access key <SECRET>! ends" and texts[7] == rows[7][1]


def test_base_matches_of_several_words_are_seeds(spark):
    seeds = [f"some words call home +1 (212) 555-01{i:02d} or so" for i in range(6)]
    cards = [f"and bank card ({c}), paid" for c in ("4111 1111 1111 1111", "5500 0000 0000 0004", "3400 0000 0000 009")]
    rows = list(enumerate([*seeds, *cards, "now call home x7q-4410-22 please", "by bank card zz81-77QK! ends", "other words 555-0101 and 4111"]))
    got = {r.doc_id: r.spans for r in personal_data_summary(table(spark, rows)).collect()}
    assert got[9] == "phone:14:25" and got[10] == "card:13:22" and got[11] == ""
    assert got[0] == "phone:21:38" and got[6] == "card:15:34"
    assert masked(table(spark, rows)).where("doc_id = 9").first().text == "now call home <PHONE> please"


def test_seeds_that_begin_within_a_word_or_beside_marks(spark):
    texts = [f"é my \x01 mail:u{i}@b.co,v{i}@b.co; tel +1 212 555 010{i},+1 212 555 020{i}" for i in range(2)]
    found = matches(table(spark, list(enumerate(texts)))).where("kind >= 10")
    got = {(r.doc_id, r.kind - 10, r.left, r.value) for r in found.collect()}
    want = set()
    for i in range(2):
        want |= {(i, 0, "my \ufffd", f"{v}{i}@b.co") for v in "uv"}
        want |= {(i, 3, f"mail:u{i}@b.co,v{i}@b.co; tel", f"+1 212 555 010{i}"), (i, 3, "212 555", f"+1 212 555 020{i}")}
    assert got == want


def test_tokens_have_the_two_words_before_them_whatever_they_are(spark):
    texts = ["ref 4421 key ab12cd34", "x1y2 z3z3", f"{'w' * 60}  Q77\n{'é' * 50} a1b2 c\x01 \x02d e5f6", "one two", "", "😀 b c 12345  "]
    found = tokens(matches(table(spark, list(enumerate(texts)))))
    got = {(r.doc_id, r.value, r.pattern) for r in found.collect()}
    want = set()
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        for j, word in enumerate(words):
            if re.search("[0-9@]", word) and len(word) >= 4:
                before = " ".join(re.sub("[\x01\x02]", "\ufffd", re.sub("[0-9]", "0", w.lower())) for w in words[j - 2 : j]) if j >= 2 else None
                want.add((i, word, before))
    assert got == want and (0, "ab12cd34", "0000 key") in want


def test_only_stretches_are_searched(spark):
    plain = "plain words of prose, " * 5_000
    texts = [plain, plain + "ring +1 ( 555 ) - 0100 now " + plain + "a b\t c7 one two a@b.co " + plain, "7 " + plain, "x 10.0.0.1\n"]
    found = table(spark, list(enumerate(texts))).select("doc_id", F.posexplode(stretches(F.col("text"))).alias("place", "s"))
    got = {(r.doc_id, r.place): (r.s.skipped, r.s.words) for r in found.collect()}
    start = len(plain) - len("prose, ")
    first = "prose, ring +1 ( 555 ) - 0100"
    skipped = len(" now " + plain)
    assert got == {
        (0, 0): (0, ""), (1, 0): (start, first), (1, 1): (skipped, "a b\t c7 one two a@b.co"), (2, 0): (0, "7"), (3, 0): (0, "x 10.0.0.1"),
    }


def test_places_and_words_before_in_random_texts(spark):
    pick = random.Random(3)
    parts = ["a", " ", "  ", "\t", "\n", "+1", "+49 ", "4111 1111 1111 1111", "(555)", "- ", "( ", "@", "a@b.co", "10.0.0.1", "é", "😀", "\u2003", " some more words ", " w "]
    rows = [(i, "".join(pick.choice(parts) for _ in range(pick.choice((3, 8, 20, 60))))) for i in range(400)]
    docs = table(spark, rows)
    found = matches(docs).where("kind = 5 AND length(value) >= 4 OR kind = -1")
    got = {(r.doc_id, r.start, r.value, r.left) for r in found.collect()}
    want = {(i, 0, "", "") for i, _ in rows}
    for i, text in rows:
        words = [(m.start(), m.group()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        for j, (start, word) in enumerate(words):
            if re.search("[0-9@]", word) and len(word) >= 4:
                left = text[words[j - 2][0] : words[j - 1][0] + len(words[j - 1][1])] if j >= 2 else ""
                want.add((i, start, word, left))
    assert got == want
    digests = {(r.doc_id, r.base_sha256) for r in personal_data_summary(docs).collect()}
    assert digests == {(i, hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest()) for i, t in rows}


def test_masked_keeps_rows_and_columns(spark):
    docs = table(spark, [*odd_rows(), (20, "at a@b.co and 10.0.0.1 é")])
    out = masked(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("doc_id = 20").first().text == "at <EMAIL> and <IP> é"
    assert out.where("doc_id = 1").first().text is None


@pytest.mark.parametrize("job", [personal_data_summary, masked])
def test_empty_table(spark, job):
    assert job(table(spark, []).where(F.lit(False))).count() == 0
