"""SentencePiece models run by the tokenizers library.

The model file is read field by field, and its normaliser, white-space marker, merges or unigram scores, and byte
fallback are rebuilt. Where no piece of the model reaches across a marker, a text is the sequence of its words, so
every distinct word of a batch is encoded once, many threads at a time, and checked against the SentencePiece library;
texts with other spacing are encoded and checked whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm.words import chunks, documents

MARK = "▁"
#: Distinct words whose ids a worker keeps; then it starts anew.
KEPT_WORDS = 700_000

#: Words that are encoded together.
JOINED_WORDS = 64

# Numbers of the model format.
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_UNIGRAM, _BPE = 1, 2


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of every field of a protocol-buffer message; 32 and 64 bit values stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
        yield key >> 3, raw[at : at + size]
        at += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = _UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    one_space: bool = True
    mark_spaces: bool = True


def read_model(path: str) -> Model:
    with open(path, "rb") as file:
        raw = file.read()
    model = Model()
    for number, value in fields(raw):
        if number == 1:
            piece = dict(fields(value))
            score = float(np.frombuffer(piece.get(2, bytes(4)), "<f4")[0])
            model.pieces.append((piece.get(1, b"").decode(), score, piece.get(3, _NORMAL)))
        elif number == 2:
            trainer = dict(fields(value))
            model.kind = trainer.get(3, _UNIGRAM)
            model.byte_fallback = bool(trainer.get(35, 0))
        elif number == 3:
            normal = dict(fields(value))
            model.charsmap = normal.get(2, b"")
            model.dummy_prefix, model.one_space, model.mark_spaces = (bool(normal.get(n, 1)) for n in (3, 4, 5))
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """Every way to make a piece of two others, better pieces first."""
    ids = {piece: i for i, (piece, _, kind) in enumerate(model.pieces) if kind in (_NORMAL, _USER)}
    found = []
    for piece, i in ids.items():
        for cut in range(1, len(piece)):
            left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
            if left is not None and right is not None:
                found.append((-model.pieces[i][1], i, left, right, (piece[:cut], piece[cut:])))
    return [pair for *_, pair in sorted(found)]


def tokenizer(model: Model):
    """The model as a tokenizer of the tokenizers library, with normaliser and decoder."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    unknown = next(i for i, (_, _, kind) in enumerate(model.pieces) if kind == _UNKNOWN)
    if model.kind == _BPE:
        vocab = {piece: i for i, (piece, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab, merges(model), unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    elif model.kind == _UNIGRAM:
        core = models.Unigram([(piece, score) for piece, score, _ in model.pieces], unknown, model.byte_fallback)
    else:
        raise ValueError(f"neither a unigram nor a BPE model: {model.kind}")
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.one_space:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.mark_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    out = Tokenizer(core)
    out.normalizer = normalizers.Sequence(steps)
    strip = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return out


class Coder:
    """Encodes and decodes texts by one model, and tells where SentencePiece gives other ids."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        self.model = read_model(path)
        self.backend = tokenizer(self.model)
        self.reference = sentencepiece.SentencePieceProcessor(model_file=path)
        inner = any(MARK in piece.lstrip(MARK) for piece, _, kind in self.model.pieces if kind in (_NORMAL, _USER))
        self.by_word = self.model.dummy_prefix and self.model.mark_spaces and not self.model.charsmap and not inner
        self.known: dict[str, bytes] = {}
        self.odd: set[str] = set()
        raw = [
            bytes([int(piece[3:-1], 16)]) if kind == _BYTE else b"" if kind == _CONTROL else piece.replace(MARK, " ").encode()
            for piece, _, kind in self.model.pieces
        ]
        self.bytes = np.array(raw, dtype=object)
        self.opens = np.array([piece.startswith(MARK) for piece, _, _ in self.model.pieces])

    def _encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids, as bytes, and whether SentencePiece gives the same; many threads at a time."""
        ids = [x.ids for x in self.backend.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        same = [a == b for a, b in zip(ids, self.reference.encode(texts, num_threads=2), strict=True)] if texts else []
        return [np.array(x, "<i4").tobytes() for x in ids], same

    def _learn(self, words: list[str]) -> None:
        """Ids of words, many joined to one text; a piece that begins with the marker begins a word."""
        groups = [words[i : i + JOINED_WORDS] for i in range(0, len(words), JOINED_WORDS)]
        ids, same = self._encode([" ".join(group) for group in groups])
        for group, raw, ok in zip(groups, ids, same, strict=True):
            begins = (4 * np.flatnonzero(self.opens[np.frombuffer(raw, np.int32)])).tolist()
            self.known.update((w, raw[a:b]) for w, a, b in zip(group, begins, [*begins[1:], len(raw)], strict=True))
            if not ok:
                self.odd.update(word for word, fine in zip(group, self._encode(group)[1], strict=True) if not fine)

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        # A space before or behind another, or at an end, is not one between words.
        odd = [not text or "  " in text or text[0] == " " or text[-1] == " " or MARK in text for text in texts]
        cut = [None if whole or not self.by_word else text.split(" ") for text, whole in zip(texts, odd, strict=True)]
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        self._learn(list(set().union(*filter(None, cut)).difference(self.known)))
        whole = [row for row, words in enumerate(cut) if words is None]
        rest = dict(zip(whole, zip(*self._encode([texts[row] for row in whole]), strict=True), strict=True))
        out, parity = [], []
        for row, words in enumerate(cut):
            out.append(rest[row][0] if words is None else b"".join(map(self.known.__getitem__, words)))
            parity.append(rest[row][1] if words is None else not self.odd or self.odd.isdisjoint(words))
        return out, parity

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(self.bytes[ids].tolist())
        if self.model.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode(errors="replace")


@cache
def coder(path: str) -> Coder:
    """One per worker and model."""
    return Coder(path)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_ids, ids, round_trip, parity`` of every row.

    ``round_trip``: the ids decode to the text; ``parity``: SentencePiece gives the same ids. A null or empty text has
    no ids. Repeated rows are encoded one by one.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model_path)
        for batch in batches:
            for begin, texts in chunks(batch.column("text")):
                plain = texts.to_pylist()
                raw, parity = own.encode(plain)
                flat = np.frombuffer(b"".join(raw), np.int32)
                ends = np.cumsum([0, *(len(x) // 4 for x in raw)])
                same = [own.decode(flat[a:b]) == text for a, b, text in zip(ends[:-1], ends[1:], plain, strict=True)]
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(begin, len(texts)), pa.array(np.diff(ends)), ids, pa.array(same), pa.array(parity)],
                    ["doc_id", "n_ids", "ids", "round_trip", "parity"],
                )

    return documents(docs, id_col, text_col).mapInArrow(encoded, "doc_id long, n_ids long, ids array<int>, round_trip boolean, parity boolean")


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of rows of ids; null ids give a null text."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model_path)
        for batch in batches:
            texts = [None if ids is None else own.decode(np.array(ids, np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    picked = rows.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{ids_col}` as array<int>) as ids")
    return picked.mapInArrow(decoded, "doc_id long, text string")
