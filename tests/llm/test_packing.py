import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestar.llm.byte_bpe import WordIds
from lodestar.llm.packing import best_fit_runs, pack, pack_documents
from tests.llm.cases import odd_rows, prose, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


ADDED = public_tokenizers.path("byte_bpe_50k.json")


def reference():
    return Tokenizer.from_file(ADDED)


TEXTS = ["", " ", "  a", "a  b ", "don't  'll \n x", "\n\na\tb ", "<|endoftext|> x", "😀 漢字 é  z", "a  b", "x \n y", "see <|endoftext|> here", "<|endoftext|><|endoftext|>", "a<|endoftext|>b  c", "<|endoftext", " <|endoftext|>"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab 1'\n\té漢 .s", max_size=30), max_size=5))
def test_ids_are_those_of_the_tokenizers_library(texts):
    global _both
    try:
        ours, theirs = _both
    except NameError:
        ours, theirs = _both = WordIds(RANKS, ADDED), reference()
    got = [np.frombuffer(x, "<u4").tolist() for x in ours.encode([*texts, *TEXTS])]
    assert got == [x.ids for x in theirs.encode_batch([*texts, *TEXTS], add_special_tokens=False)]


def check(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        places.sort()
        at = 0
        for offset, length in places:
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_documents_are_cut_and_packed(spark):
    rows = odd_rows() + [(100 + i, prose(20 + 37 * i, i)) for i in range(60)] + [(200, "see <|endoftext|> here")]
    out = pack_documents(table(spark, rows), RANKS, added_path=ADDED).collect()
    coder, want = reference(), []
    for i, t in rows:
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        rest = len(ids) % 2048
        edges = sorted({0, *range(rest, len(ids) + 1, 2048)})
        want += [(i or 0, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    assert check(out, 2048) <= -(-sum(r.length for r in out) // 2048) + 1


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=20))
def test_runs_place_every_piece_once(counts):
    used, placed = {}, {}
    for length, first, number, sequence, offset in best_fit_runs(counts, 64):
        for i in range(number):
            assert used.get(sequence + i, 0) == offset
            used[sequence + i] = offset + length
        assert first == placed.get(length, 0)
        placed[length] = first + number
    assert placed == counts and all(x <= 64 for x in used.values())
    # Best fit decreasing is within 11/9 of the least number; the sum of lengths is a bound from below.
    assert len(used) <= 11 / 9 * -(-sum(a * b for a, b in counts.items()) // 64) * 2 + 4


def test_one_length_over_many_ranges(spark):
    pieces = spark.range(5000).selectExpr("id AS doc_id", "1000L AS length", "id AS part")
    out = pack(pieces, ["doc_id"], 2048).collect()
    assert len({(r.sequence_id, r.offset) for r in out}) == 5000 and check(out, 2048) == 2500


def test_empty_table(spark):
    assert pack_documents(table(spark, []), RANKS).count() == 0
