import collections
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm.repetition import RepetitionRules, longest_repeats, maximal_spans, repetition, without_repetition
from lodestar.llm.words import VISIBLE, word_hashes
from tests.llm.cases import odd_rows, prose, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_repeats(words):
    """For each place the longest run that starts elsewhere too."""

    def common(a, b):
        n = 0
        while max(a, b) + n < len(words) and words[a + n] == words[b + n]:
            n += 1
        return n

    return [max((common(a, b) for b in range(len(words)) if b != a), default=0) for a in range(len(words))]


def base(text):
    words = WORD.findall(text or "")
    windows = list(zip(words, words[1:], words[2:]))
    count = collections.Counter(windows)
    inside = {i + d for i, w in enumerate(windows) if count[w] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside), failed


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.sampled_from("ab"), max_size=30))
def test_longest_repeats(one, two):
    texts = pa.array([" ".join(one), " ".join(two)])
    words, firsts = word_hashes(texts, VISIBLE, False)
    got = longest_repeats(words, np.repeat([0, 1], np.diff(firsts)))
    assert got.tolist() == brute_repeats(one) + brute_repeats(two)


def test_maximal_spans_cover_what_repeats():
    words = "a b c d e x a b c d e y b c d".split()
    repeats = np.array(brute_repeats(words))
    starts, lengths = maximal_spans(repeats, np.zeros(len(words), int), 3)
    assert list(zip(starts.tolist(), lengths.tolist())) == [(0, 5), (6, 5), (12, 3)]


ROWS = odd_rows() + [
    (30, prose(200, 30)), (31, "\n".join(["same line of words"] * 30) + prose(60, 31)), (32, prose(100, 32) + " ## $ <b> | &"),
    (33, " ".join([prose(120, 33)] * 2)), (34, "a b c\n \na b c\n a b c"),
]


def test_base_measures_and_verdicts(spark):
    out = repetition(table(spark, ROWS), spans=True).collect()
    got = sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
    assert got == sorted((i or 0, *base(t)) for i, t in ROWS)
    kept = {r.doc_id: r.kept for r in out}
    assert kept[30] and kept[32] and not kept[33] and not kept[1] and not kept[2]
    assert all(r.longest_repeat == max((b - a for a, b in r.repeats), default=0) for r in out)


def test_rows_that_keep_the_rules_stay_whole(spark):
    docs = table(spark, ROWS)
    rules = RepetitionRules()
    want = sorted((r.doc_id or 0) for r in repetition(docs, rules).where("kept").collect())
    out = without_repetition(docs, rules)
    assert out.columns == docs.columns and sorted((r.doc_id or 0) for r in out.collect()) == want


def test_empty_table(spark):
    assert repetition(table(spark, [])).count() == 0 and without_repetition(table(spark, [])).count() == 0
