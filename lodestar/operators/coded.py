"""Texts as blocks of coded words.

A block holds some MB of texts: their distinct words once, and the number of its word for every token. Words are
counted, paired and weighed by these numbers, so that no word is read as a string more than once a block.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from lodestar.functions.text import all_words, digit_runs

# A text with any other character is taken apart by Spark's own expressions. These have one unit in UTF-16, one lower
# case each (the capital I with a dot has two), and only 0 to 9 as decimal digits; those from U+2000 on are no words.
SIMPLE_TEXT = r"^[\x{0}-\x{12F}\x{131}-\x{24F}\x{2000}-\x{206F}]*+\z"
_LAST_LETTER = 0x24F

_WORD = np.zeros(1 << 16, bool)
_LOWER = np.arange(1 << 16, dtype=np.uint16)
for _c in range(_LAST_LETTER + 1):
    _WORD[_c] = unicodedata.category(chr(_c))[0] in "LN" or chr(_c) == "_"
    _LOWER[_c] = ord(chr(_c).lower()[0])
_BYTES = np.where(np.arange(1 << 16) < 0x80, 1, np.where(np.arange(1 << 16) < 0x800, 2, 3)).astype(np.uint8)


def _spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of true values begin and end."""
    closed = np.concatenate([[False], mask, [False]])
    edges = np.flatnonzero(closed[1:] != closed[:-1])
    return edges[::2], edges[1::2]


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in rising order and how often each occurs; faster for whole numbers than numpy's own."""
    values = np.sort(values)
    begins = np.ones(len(values), bool)
    begins[1:] = values[1:] != values[:-1]
    first = np.flatnonzero(begins)
    return values[first], np.diff(first, append=len(values))


def _taken_apart(texts: pa.Array) -> tuple[pa.Array, np.ndarray, list[str], np.ndarray]:
    """Lower-case words and digit runs of texts without other characters, and the row that each is in."""
    joined = "\n".join(texts.to_pylist())
    units = np.frombuffer(joined.encode("utf-16-le"), np.uint16)
    begins = np.cumsum(pc.utf8_length(texts).to_numpy().astype(np.int64) + 1)

    word = _WORD[units]
    starts, ends = _spans(word)
    chars = _LOWER[units[word]]
    at = np.concatenate([[0], np.cumsum(_BYTES[chars], dtype=np.int64)])
    offsets = at[np.concatenate([[0], np.cumsum(ends - starts)])].astype(np.int32)
    data = chars.tobytes().decode("utf-16-le").encode()
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))

    digits = (units >= ord("0")) & (units <= ord("9"))
    run_starts, run_ends = _spans(digits | (units == ord(".")))
    places = np.append(np.flatnonzero(digits), len(units))
    first = places[np.searchsorted(places, run_starts)]
    with_digit = first < run_ends
    first, run_ends = first[with_digit], run_ends[with_digit]
    runs = [joined[start:end] for start, end in zip(first.tolist(), run_ends.tolist())]
    return words, np.searchsorted(begins, starts, "right"), runs, np.searchsorted(begins, first, "right")


def _listed(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The strings of a column of lists, and the row that each is in."""
    lists = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return pc.list_flatten(lists), np.repeat(np.arange(len(lists)), sizes)


@dataclass(frozen=True)
class Block:
    """Texts with ``keys`` in rising order, their tokens as ``codes`` into the distinct ``words`` with the ``row`` that
    each is in, and their digit ``runs`` with the ``run_row`` of each."""

    keys: pa.Array
    words: pa.Array
    codes: np.ndarray
    row: np.ndarray
    runs: pa.Array
    run_row: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table, key: str) -> Block:
        words, row, runs, run_row = _taken_apart(rows.column("text").combine_chunks())
        runs = pa.array(runs, pa.string())
        if rows.column("words").null_count < len(rows):
            more, more_row = _listed(rows.column("words"))
            words, row = pa.concat_arrays([words, more]), np.concatenate([row, more_row])
            more, more_row = _listed(rows.column("runs"))
            runs, run_row = pa.concat_arrays([runs, more]), np.concatenate([run_row, more_row])
            order = np.argsort(row, kind="stable")
            words, row = words.take(pa.array(order)), row[order]
        coded = words.dictionary_encode()
        return cls(rows.column(key).combine_chunks(), coded.dictionary, coded.indices.to_numpy().astype(np.int64), row, runs, run_row)

    @classmethod
    def read(cls, batch: pa.RecordBatch, i: int) -> Block:
        held = {name: batch.column(name)[i].values for name in ("keys", "sizes", "words", "runs", "run_rows")}
        row = np.repeat(np.arange(len(held["keys"])), held["sizes"].to_numpy())
        codes = np.frombuffer(batch.column("codes")[i].as_buffer(), np.int32).astype(np.int64)
        return cls(held["keys"], held["words"], codes, row, held["runs"], held["run_rows"].to_numpy())

    def kept(self, stop_words: Sequence[str]) -> np.ndarray:
        """Which words ``kept_tokens`` keeps, decided once for every distinct word."""
        kept = pc.and_not(pc.greater_equal(pc.utf8_length(self.words), 2), pc.is_in(self.words, value_set=pa.array(stop_words, pa.string())))
        return kept.to_numpy(zero_copy_only=False).astype(bool)

    @cached_property
    def text(self) -> np.ndarray:
        """The number of each row's key; rows of one key are one text, and a null key is a key."""
        return self.keys.dictionary_encode("encode").indices.to_numpy().astype(np.int64)

    def words_of_rows(self) -> tuple[np.ndarray, np.ndarray]:
        """Each distinct word of a row once, as rows and codes."""
        both, _ = distinct(self.row * max(len(self.words), 1) + self.codes)
        return both // max(len(self.words), 1), both % max(len(self.words), 1)

    def record(self, stop_words: Sequence[str]) -> pa.RecordBatch:
        """The block as one row, with the counts of its kept words; those of other words are 0."""
        kept, n = self.kept(stop_words), len(self.words)
        occurs = np.where(kept, np.bincount(self.codes, minlength=n), 0)
        found = np.where(kept, np.bincount(self.words_of_rows()[1], minlength=n), 0)
        sizes = np.bincount(self.row, minlength=len(self.keys)).astype(np.int32)

        def one(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        lists = [one(v) for v in (self.keys, pa.array(sizes), self.words, pa.array(occurs, pa.int64()), pa.array(found, pa.int64()))]
        runs = [one(self.runs), one(pa.array(self.run_row.astype(np.int32)))]
        codes = pa.array([self.codes.astype(np.int32).tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays([*lists, codes, *runs], ["keys", "sizes", "words", "occurs", "found", "codes", "runs", "run_rows"])


def blocks_of(texts: DataFrame, key: str, stop_words: Sequence[str], block_bytes: int) -> DataFrame:
    """Blocks of texts ``(key, text)`` that are spread by their key; all rows of a key are in one block."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_texts(batches, key, block_bytes):
            yield Block.of(rows, key).record(stop_words)

    text = F.coalesce("text", F.lit(""))
    told = texts.select(key, text.alias("text")).withColumn("other", ~F.col("text").rlike(SIMPLE_TEXT))
    apart = told.select(
        key,
        F.when(F.col("other"), F.lit("")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("other"), all_words(F.col("text"))).alias("words"),
        F.when(F.col("other"), digit_runs(F.col("text"))).alias("runs"),
    )
    kinds = {
        "keys": ArrayType(texts.schema[key].dataType), "sizes": ArrayType(IntegerType()), "words": ArrayType(StringType()),
        "occurs": ArrayType(LongType()), "found": ArrayType(LongType()), "codes": BinaryType(),
        "runs": ArrayType(StringType()), "run_rows": ArrayType(IntegerType()),
    }
    return apart.sortWithinPartitions(key).mapInArrow(coded, StructType([StructField(name, kind) for name, kind in kinds.items()]))


def _whole_texts(batches: Iterator[pa.RecordBatch], key: str, block_bytes: int) -> Iterator[pa.Table]:
    """Rows sorted by key, in tables that hold all rows of their keys."""
    held, size = [], 0
    for batch in batches:
        # A batch may be far larger than a block.
        for at in range(0, len(batch), step := max(1, len(batch) * block_bytes // max(batch.nbytes, 1))):
            held.append(batch.slice(at, step))
            size += held[-1].nbytes
            if size < block_bytes:
                continue
            rows = pa.Table.from_batches(held)
            text = rows.column(key).combine_chunks().dictionary_encode("encode").indices.to_numpy()
            done = int(np.searchsorted(text, text[-1]))
            if done:
                yield rows.slice(0, done)
            held = rows.slice(done).to_batches()
            size = sum(part.nbytes for part in held)
    if held:
        yield pa.Table.from_batches(held)


def read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(len(batch)):
            yield Block.read(batch, i)
