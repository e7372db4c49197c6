"""Encoding and decoding with a BPE vocabulary whose words end in a marker, as the tokenizers library does.

The model file is the library's JSON: its added tokens, normaliser (NFC, runs of white space to one space, lower
case), pre-tokeniser (a splitting pattern whose matches are the words, then bytes as printable characters) and BPE model
(merges in rank order, ``</w>`` on the last symbol of every word) are read from it, not assumed.

Method: every word is a doubly linked list of symbols. A heap holds (rank, place) of every adjacent pair that has a
merge; the lowest rank is merged first and, among equal ranks, the leftmost. Entries made stale by an earlier merge
(a side already merged away, or a pair that changed) are skipped when popped. Decoding concatenates the vocabulary
strings of the ids with one space between them, as the file names no decoder.

Spark runs it over Arrow batches; every executor loads the model once and keeps a bounded cache of words it has
encoded. Defined results: a null or empty text gives no ids and decodes to the empty string; added tokens in the text
are their own ids; characters that no symbol of the vocabulary holds are left out, as the library does without an
unknown token. Texts of any length are encoded whole.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Words cached per executor (some 20 MB); when it is full, the older half goes.
CACHED_WORDS = 100_000
# Bytes of text encoded at once in a task: a bound on the ids held as Python objects.
SLICE_BYTES = 2 << 20


def _byte_chars() -> list[str]:
    """The printable character that stands for every byte."""
    kept = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    extra = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(extra)) for b in range(256)]


class WordBpe:
    """A model read from a JSON file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as handle:
            spec = json.load(handle)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ", 1)
            if left in self.vocab and right in self.vocab and left + right in self.vocab:
                self.ranks.setdefault((self.vocab[left], self.vocab[right]), (rank, self.vocab[left + right]))
        self.tokens = {i: t for t, i in self.vocab.items()}
        added = sorted(spec.get("added_tokens") or [], key=lambda a: -len(a["content"]))
        for token in added:
            self.tokens[token["id"]] = token["content"]
        self.added = {a["content"]: a["id"] for a in added}
        self.added_split = regex.compile("|".join(regex.escape(a) for a in self.added)) if self.added else None
        self.normalisers = _normalisers(spec.get("normalizer"))
        self.words = _words(spec.get("pre_tokenizer"))
        self.byte_chars = _byte_chars()
        self.inner_ids = [self.vocab.get(c, -1) for c in self.byte_chars]
        self.last_ids = [self.vocab.get(c + self.suffix, -1) for c in self.byte_chars]
        if len(self.tokens) and max(self.tokens) >= 1 << 16:
            raise ValueError("pairs of ids are keyed in 32 bits")
        self.pair_ranks = {(a << 16) | b: found for (a, b), found in self.ranks.items()}
        self.token_list = [self.tokens.get(i) for i in range(max(self.tokens, default=-1) + 1)]
        self.cache: dict[str, list[int]] = {}

    def _merged(self, word: str) -> list[int]:
        """Ids of one word: symbols merged by rank through a heap of pairs over a linked list.

        A heap entry is (rank, place, pair, merged id); it is stale when the symbols at the place and after it are no
        longer that pair, which also holds for a place merged away (its symbol is -1).
        """
        data = word.encode("utf-8")
        symbols = [self.inner_ids[b] for b in data[:-1]]
        symbols.append(self.last_ids[data[-1]])
        if -1 in symbols:
            symbols = [i for i in symbols if i >= 0]
        n = len(symbols)
        if n < 2:
            return symbols
        ranks = self.pair_ranks
        prev = list(range(-1, n - 1))
        nxt = [*range(1, n), -1]
        heap = []
        for at in range(n - 1):
            pair = symbols[at] << 16 | symbols[at + 1]
            found = ranks.get(pair)
            if found is not None:
                heap.append((found[0], at, pair, found[1]))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, at, pair, new = pop(heap)
            after = nxt[at]
            if after < 0 or symbols[at] < 0 or (symbols[at] << 16 | symbols[after]) != pair:
                continue  # stale: one side was merged away or changed since this entry was made
            symbols[at], symbols[after] = new, -1
            beyond = nxt[at] = nxt[after]
            if beyond >= 0:
                prev[beyond] = at
                pair = new << 16 | symbols[beyond]
                found = ranks.get(pair)
                if found is not None:
                    push(heap, (found[0], at, pair, found[1]))
            before = prev[at]
            if before >= 0:
                pair = symbols[before] << 16 | new
                found = ranks.get(pair)
                if found is not None:
                    push(heap, (found[0], before, pair, found[1]))
        return [i for i in symbols if i >= 0]

    def _word(self, word: str) -> list[int]:
        ids = self.cache.get(word)
        if ids is None:
            if len(self.cache) >= CACHED_WORDS:
                for old in list(islice(self.cache, CACHED_WORDS // 2)):
                    del self.cache[old]  # the older half goes; words seen since stay
            ids = self.cache[word] = self._merged(word)
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text, added tokens included."""
        if not text:
            return []
        out: list[int] = []
        begin = 0
        pieces = self.added_split.finditer(text) if self.added_split else ()
        for found in [*pieces, None]:
            end = found.start() if found else len(text)
            if end > begin:
                part = text[begin:end]
                for normalise in self.normalisers:
                    part = normalise(part)
                cache = self.cache
                for word in self.words(part):
                    ids = cache.get(word)
                    out += self._word(word) if ids is None else ids
            if found:
                out.append(self.added[found.group()])
                begin = found.end()
        return out

    def decode(self, ids: list[int] | None) -> str:
        """Vocabulary strings of the ids, joined by one space; unknown ids are left out."""
        listed = self.token_list
        try:
            return " ".join([listed[i] for i in ids or ()])
        except (IndexError, TypeError):
            return " ".join(self.tokens[i] for i in ids or () if i in self.tokens)


def _lower(text: str) -> str:
    """Lower case character by character, as the library does (no rule for a final sigma)."""
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


def _normalisers(spec: dict | None) -> list:
    """The normaliser steps of the file, in order."""
    if not spec:
        return []
    if spec["type"] == "Sequence":
        return [step for part in spec["normalizers"] for step in _normalisers(part)]
    if spec["type"] in ("NFC", "NFD", "NFKC", "NFKD"):
        form = spec["type"]
        return [lambda s: s if s.isascii() else unicodedata.normalize(form, s)]
    if spec["type"] == "Lowercase":
        return [_lower]
    if spec["type"] == "Replace":
        pattern = spec["pattern"]
        found = regex.compile(pattern["Regex"]) if "Regex" in pattern else regex.compile(regex.escape(pattern["String"]))
        content = spec["content"].replace("\\", "\\\\")
        return [lambda s: found.sub(content, s)]
    raise ValueError(f"normaliser {spec['type']} is not supported")


def _words(spec: dict | None):
    """A function from a normalised text to its words, as printable byte characters are made later."""
    steps = spec["pretokenizers"] if spec and spec["type"] == "Sequence" else [spec] if spec else []
    split = None
    for step in steps:
        if step["type"] == "Split":
            if not (step.get("invert") and step.get("behavior") == "Removed"):
                raise ValueError("only a split that keeps its matches is supported")
            split = regex.compile(step["pattern"]["Regex"])
        elif step["type"] == "ByteLevel":
            if step.get("add_prefix_space") or step.get("use_regex"):
                raise ValueError("only bytes without their own pattern are supported")
        else:
            raise ValueError(f"pre-tokeniser {step['type']} is not supported")
    return (lambda s: split.findall(s)) if split else (lambda s: [s])


@lru_cache(maxsize=4)
def model(path: str) -> WordBpe:
    return WordBpe(path)


def encoded(text: Column, path: str) -> Column:
    """``array<int>`` ids of every text."""

    @pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        bpe = model(path)
        return pd.Series([bpe.encode(t) for t in texts])

    return ids(text)


def decoded(ids: Column, path: str) -> Column:
    """The text that the ids stand for."""

    @pandas_udf("string")
    def text(lists: pd.Series) -> pd.Series:
        bpe = model(path)
        return pd.Series([bpe.decode(None if i is None else list(i)) for i in lists])

    return text(ids)


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded`` of every document; null texts are empty. Each text is encoded once.

    Ids go to Arrow as one flat array with offsets per batch, not as Python lists.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in parts:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
            # Slices of about SLICE_BYTES of text, so that a worker holds few ids as Python lists at once.
            cuts = np.searchsorted(np.cumsum(sizes), np.arange(SLICE_BYTES, int(sizes.sum()) + SLICE_BYTES, SLICE_BYTES), "right")
            begin = 0
            for end in [*np.unique(np.minimum(cuts + 1, batch.num_rows)), batch.num_rows]:
                if end <= begin:
                    continue
                part = batch.slice(begin, end - begin)
                begin = end
                ids = [bpe.encode(t) for t in part.column("text").to_pylist()]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)), out=offsets[1:])
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                decoded = pa.array([bpe.decode(i) for i in ids], pa.string())
                del ids
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), listed, decoded], ["doc_id", "ids", "decoded"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(batches, "doc_id long, ids array<int>, decoded string")
