import hashlib

import public_tokenizers
from tokenizers import Tokenizer

from lodestar.llm.queries import op12_word_bpe
from lodestar.llm.word_bpe import WordBpe, round_trip
from tests.llm.cases import odd_rows, table

PATH = public_tokenizers.path("word_bpe_49k.json")
HOSTILE = [
    "Σ ΑΣ ΣΑΣ", "a\x1cb\x1fc\x85d\xa0e f　g", "<|startoftext|>hi<|endoftext|><|endoftext|>", "İstanbul ǅ ß ﬁ",
    "Ⅻ ² ٣ 😀👍🏽", "don't it'S WE'LL", "tab\tand\r\nlines\n\n", "<|endoftext", "é Å",
]


def library():
    return Tokenizer.from_file(PATH)


def test_same_ids_and_text_as_the_library():
    own, lib = WordBpe(PATH), library()
    for _, text in odd_rows() + list(enumerate(HOSTILE)):
        want = lib.encode(text or "", add_special_tokens=False).ids
        assert own.encode(text) == want
        assert own.decode(want) == lib.decode(want, skip_special_tokens=False)


def test_stale_entries_are_skipped():
    own, lib = WordBpe(PATH), library()
    for word in ["aaaaaaa", "abababab", "mississippi", "x" * 333]:
        assert own.encode(word) == lib.encode(word, add_special_tokens=False).ids


def test_round_trip_rows(spark):
    rows = odd_rows() + [(100 + i, t) for i, t in enumerate(HOSTILE)]
    got = {r.doc_id: (r.ids, r.decoded) for r in round_trip(table(spark, rows), PATH).collect()}
    lib = library()
    assert len(got) == len({i for i, _ in rows})
    for doc_id, text in rows:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        assert got[doc_id] == (ids, lib.decode(ids, skip_special_tokens=False))


def test_query_digests(spark, tmp_path):
    rows = odd_rows()[:8] + [(50, HOSTILE[2])]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op12_word_bpe(spark, str(tmp_path)).collect()}
    lib = library()
    for doc_id, text in rows:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        row = got[doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
