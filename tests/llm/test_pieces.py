import public_tokenizers
import sentencepiece

from lodestar.llm.pieces import Coder, decode, encode, read_model
from tests.llm.cases import odd_rows, table

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  a", "a  b ", "x" + " " * 11 + "y", "\n\na\tb ", "\x00q", "<s> <unk> </s>", "😀 漢字 \U0010ffff", "The and 12,345.67 of it."]


def test_ids_are_those_of_sentencepiece_and_decode_to_the_text(spark):
    rows = odd_rows() + [(100 + i, t) for i, t in enumerate(TEXTS)]
    reference = sentencepiece.SentencePieceProcessor(model_file=PATH)
    out = encode(table(spark, rows), PATH)
    got = sorted((r.doc_id or 0, r.ids) for r in out.collect())
    assert got == sorted((i or 0, reference.encode(t or "")) for i, t in rows)
    assert out.where("NOT round_trip OR NOT parity OR n_ids <> size(ids)").count() == 0
    texts = sorted((r.doc_id or 0, r.text) for r in decode(out, PATH).collect())
    assert texts == sorted((i or 0, t or "") for i, t in rows)


def test_model_file_is_read_as_the_library_reads_it():
    model, reference = read_model(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert len(model.pieces) == reference.get_piece_size()
    assert all(p == reference.id_to_piece(i) and s == reference.get_score(i) for i, (p, s, _) in enumerate(model.pieces))


def test_words_alone_and_whole_texts_agree():
    coder = Coder(PATH)
    text = " ".join(t for _, t in odd_rows() if t and "  " not in t.strip())
    assert coder.encode([text.strip()])[0] == coder._encode([text.strip()])[0]


def test_unigram_model(tmp_path):
    """A small unigram model, put together field by field, gives SentencePiece's ids."""

    def number(value):
        out = b""
        while value > 0x7F:
            out, value = out + bytes([value & 0x7F | 0x80]), value >> 7
        return out + bytes([value])

    def part(key, raw):
        return number(key << 3 | 2) + number(len(raw)) + raw

    import struct

    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)] + [(f"<0x{b:02X}>", 0, 6) for b in range(256)]
    pieces += [("▁", -3, 1), ("▁the", -1, 1), ("t", -5, 1), ("h", -5, 1), ("e", -4, 1), ("▁he", -2.5, 1), ("at", -3.5, 1), ("a", -4.5, 1)]
    raw = b"".join(part(1, part(1, p.encode()) + number(2 << 3 | 5) + struct.pack("<f", s) + number(3 << 3) + number(k)) for p, s, k in pieces)
    trainer = number(3 << 3) + number(1) + number(35 << 3) + number(1)
    path = tmp_path / "unigram.model"
    path.write_bytes(raw + part(2, trainer) + part(3, part(1, b"identity") + number(4 << 3) + number(0)))
    texts = ["the heat", "he that the", "", "é the", "tttt"]
    reference = sentencepiece.SentencePieceProcessor(model_file=str(path))
    assert [x.ids for x in Coder(str(path)).backend.encode_batch(texts)] == reference.encode(texts)


def test_empty_table(spark):
    assert encode(table(spark, []), PATH).count() == 0
