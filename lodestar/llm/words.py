"""Words of many texts at once, as hashes, by whole-array steps inside Arrow tasks.

A word is a run of bytes of one class. As every byte of a UTF-8 sequence beyond ASCII is at least 0x80, classes
of bytes decide the same words as the character classes of the contracts do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are taken at once; one longer text is taken alone. Arrays of a chunk take some eight times
#: its size each, and the tables of powers sixteen times.
CHUNK_BYTES = 1 << 20

_BYTES = np.arange(256)
#: Anything but ASCII white space.
VISIBLE = ~np.isin(_BYTES, [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
#: Digits, letters, and everything beyond ASCII.
ALNUM = (
    ((_BYTES >= 0x30) & (_BYTES <= 0x39))
    | ((_BYTES >= 0x41) & (_BYTES <= 0x5A))
    | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
    | (_BYTES >= 0x80)
)
_LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES)

_BASE = 0x9E3779B97F4A7C15
_CODES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mixed(values: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base below n, and of its inverse, modulo 2 ** 64."""
    global _tables
    if len(_tables[0]) < n:
        factors = np.full((2, max(n, CHUNK_BYTES)), [[_BASE], [_INVERSE]], np.uint64)
        factors[:, 0] = 1
        _tables = tuple(np.cumprod(factors, axis=1))
    return _tables


def chunks(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Slices of at most ``CHUNK_BYTES`` bytes of text, or of one text, with the row that each begins at."""
    sizes = np.diff(_offsets(column.cast(pa.large_binary())))
    begin = total = 0
    for row, size in enumerate(sizes.tolist()):
        if row > begin and total + size > CHUNK_BYTES:
            yield begin, column.slice(begin, row - begin)
            begin, total = row, 0
        total += size
    if begin < len(column):
        yield begin, column.slice(begin)


def _offsets(binary: pa.Array) -> np.ndarray:
    if not len(binary):
        return np.zeros(1, np.int64)
    return np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]


def word_places(texts: pa.Array, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of the texts, the first bytes of their words, the last ones, the texts' bounds, and their first words."""
    binary = texts.cast(pa.large_binary())
    bounds = _offsets(binary)
    low, high = int(bounds[0]), int(bounds[-1])
    none = np.zeros(0, np.int64)
    if high == low:
        return np.zeros(0, np.uint8), none, none, bounds - low, np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(binary.buffers()[2], np.uint8)[low:high]
    bounds = bounds - low
    inside = word_bytes[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = np.unique(bounds[:-1][np.diff(bounds) > 0])
    begins[edges] |= inside[edges]
    lasts = np.append(edges[1:], len(data)) - 1
    ends[lasts] |= inside[lasts]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends)
    return data, start, stop, bounds, np.searchsorted(start, bounds)


def hashes_at(data: np.ndarray, start: np.ndarray, stop: np.ndarray, lower: bool = True, heads: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Hashes of the words at these places, and for each length in ``heads`` of their first so many bytes.

    A head is 0 for words that are shorter. With ``lower`` A-Z count as a-z.
    """
    powers, inverse = _powers(len(data))
    sums = np.cumsum((_CODES[_LOWER] if lower else _CODES)[data] * powers[: len(data)])
    before = np.where(start > 0, sums[start - 1], np.uint64(0)) if len(start) else np.zeros(0, np.uint64)
    own = inverse[start]

    def head(length: int) -> np.ndarray:
        part = mixed((sums[np.minimum(start + length - 1, stop)] - before) * own + np.uint64(length))
        return np.where(stop - start >= length, part, np.uint64(0))

    return mixed((sums[stop] - before) * own), *map(head, heads)


def word_hashes(texts: pa.Array, word_bytes: np.ndarray, lower: bool = True, heads: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Hashes of all words in order, per text the place of its first word (one more entry at the end), then heads."""
    data, start, stop, _, firsts = word_places(texts, word_bytes)
    hashes, *more = hashes_at(data, start, stop, lower, heads)
    return hashes, firsts, *more


def runs_hash(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the runs ``values[first..last]``: equal for equal runs, wherever they are."""
    powers, inverse = _powers(len(values))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers[: len(values)])])
    return mixed((sums[last + 1] - sums[first]) * inverse[first] + (last - first).astype(np.uint64))


def per_text(values: np.ndarray, firsts: np.ndarray, how: np.ufunc = np.add) -> np.ndarray:
    """``how`` over the values of each text; 0 for a text without any."""
    out = np.zeros(len(firsts) - 1, values.dtype)
    full = np.flatnonzero(np.diff(firsts) > 0)
    if len(full):
        out[full] = how.reduceat(values, firsts[:-1][full])
    return out


def documents(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """``doc_id`` as a long and ``text`` with null as empty; other columns of ``docs`` are left behind."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        *more,
    )


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``docs`` begins with it."""
    while any(c.lower().startswith(name) for c in docs.columns):
        name = f"_{name}"
    return name
