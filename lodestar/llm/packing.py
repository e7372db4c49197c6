"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

Pieces are range-sorted by length and numbered within their length. All pieces of one length, and all open
sequences with one gap, are alike, so a round is a sweep over classes: the longest length that is left takes the
smallest gaps that hold it (their successors in gap order), pieces and gaps are matched by rank, the gaps shrink,
and what found no gap opens sequences. Classes are at most ``capacity`` counts, however many pieces there are;
a round writes runs of ranks, at most some tens of thousands in all. Each piece then finds its run, again as a
successor, in its own partition. No piece passes through the driver, and no length is gathered in one task.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.byte_bpe import word_ids
from lodestar.llm.words import chunks, documents, free_name
from lodestar.session import written

CAPACITY = 2048
#: Id that ends every document.
END_ID = 0

Run = tuple[int, int, int, int, int]


def cut(length: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document; only the first one may be short of the capacity."""
    rest = length % capacity
    return ([rest] if rest else []) + [capacity] * (length // capacity)


def token_pieces(
    docs: DataFrame, ranks_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", added_path: str | None = None
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece of every document.

    A null or empty text is the end id alone. Repeated rows are documents of their own.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(ranks_path, added_path)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            for begin, texts in chunks(batch.column("text")):
                ids = batch.column("doc_id").slice(begin, len(texts))
                rows = []
                for row, raw in enumerate(coder.encode(texts.to_pylist())):
                    raw += end
                    start = 0
                    for piece, length in enumerate(cut(len(raw) // 4, capacity)):
                        rows.append((row, piece, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])))
                        start += length
                row, *values = np.array(rows, np.int64).T
                columns = [ids.take(pa.array(row)), pa.array(values[0].astype(np.int32)), *map(pa.array, values[1:])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents(docs, id_col, text_col).mapInArrow(
        pieces, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def best_fit_runs(counts: dict[int, int], capacity: int) -> list[Run]:
    """Runs ``(length, first_rank, pieces, first_sequence, offset)`` that place all pieces of every length.

    Piece ``first_rank + i`` of the length goes to sequence ``first_sequence + i`` at ``offset``.
    """
    runs: list[Run] = []
    opened = 0
    gaps: list[int] = []  # in order
    open_at: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of sequences (first, number)

    def put(gap: int, first: int, number: int) -> None:
        if gap:
            if gap not in open_at:
                bisect.insort(gaps, gap)
            open_at.setdefault(gap, []).append((first, number))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, number = open_at[gap].pop()
                taken = min(number, left)
                if taken < number:
                    open_at[gap].append((first + taken, number - taken))
                elif not open_at[gap]:
                    del open_at[gap], gaps[at]
            else:
                # Full sequences of this length alone would leave nothing to shorter pieces, so as many are opened
                # as hold the rest, each with as many pieces of the length as fit.
                gap, first = capacity, opened
                taken = -(-left // (capacity // length))
                opened += taken
            runs.append((length, rank, taken, first, capacity - gap))
            rank, left = rank + taken, left - taken
            put(gap - length, first, taken)
    return runs


def ranked(pieces: DataFrame, by: list[str], length: str, own: str) -> DataFrame:
    """``pieces`` range-sorted by length and ``by``, with the range (``own_part``) and the rank within length and range.

    A length may span many ranges; what the ranges before hold of it is added to its ranks later.
    """
    parts = max(pieces.sparkSession.sparkContext.defaultParallelism, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = -1, 0
        for batch in batches:
            lengths = batch.column(length).to_numpy()
            if not len(lengths):
                continue
            begins = np.flatnonzero(np.diff(lengths, prepend=lengths[0] - 1))
            ranks = np.arange(len(lengths)) - np.repeat(begins, np.diff(np.append(begins, len(lengths))))
            if lengths[0] == last:
                ranks[: begins[1] if len(begins) > 1 else len(ranks)] += count
            last, count = lengths[-1], int(ranks[-1]) + 1
            yield batch.append_column(f"{own}_rank", pa.array(ranks.astype(np.int64)))

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in pieces.schema)}, {own}_part int, {own}_rank long"
    # Range bounds are sampled from the rows, so these are written before, or they would be made twice.
    ranges = (
        written(pieces, "pieces").repartitionByRange(parts, length, *by)
        .sortWithinPartitions(length, *by)
        .withColumn(f"{own}_part", F.spark_partition_id())
        .mapInArrow(numbered, schema)
    )
    return written(ranges, "ranked")


def pack(pieces: DataFrame, by: list[str], capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` in place of columns of these names.

    Every length is from 1 to ``capacity``. Ties of length go by the columns ``by``. An empty table gives an empty one.
    """
    pieces = pieces.drop("sequence_id", "offset")
    spark, own, kept = pieces.sparkSession, free_name(pieces, "packing"), pieces.columns
    table = ranked(pieces, by, length, own)
    # A row for each range and length in it: at most as many as ranges plus lengths.
    held = written(table.groupBy(f"{own}_part", F.col(length).alias("held_length")).agg(F.count("*").alias("held")), "held")
    counts = {row[0]: row[1] for row in held.groupBy("held_length").agg(F.sum("held")).collect()}
    runs = np.array(sorted(best_fit_runs(counts, capacity)), np.int64).reshape(-1, 5)
    before = Window.partitionBy("held_length").orderBy(f"{own}_part").rowsBetween(Window.unboundedPreceding, -1)
    moved = held.select(
        F.col(f"{own}_part").alias(f"{own}_in"), F.col("held_length").alias(f"{own}_length"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias(f"{own}_moved")
    )
    at_range = (table[f"{own}_part"] == moved[f"{own}_in"]) & (table[length] == moved[f"{own}_length"])
    joined = table.join(F.broadcast(moved), at_range).select(*[f"`{c}`" for c in kept], (F.col(f"{own}_rank") + F.col(f"{own}_moved")).alias(f"{own}_rank"))
    sent = spark.sparkContext.broadcast(runs)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        span = int(table[:, 1].max(initial=0)) + 1
        keys = table[:, 0] * span + table[:, 1]
        for batch in batches:
            lengths, ranks = batch.column(length).to_numpy(), batch.column(f"{own}_rank").to_numpy()
            run = table[np.searchsorted(keys, lengths * span + np.minimum(ranks, span - 1), side="right") - 1]
            columns = [*(batch.column(c) for c in kept), pa.array(run[:, 3] + ranks - run[:, 1]), pa.array(run[:, 4])]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return joined.mapInArrow(placed, f"{schema}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, ranks_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", added_path: str | None = None
) -> DataFrame:
    """The pieces of all documents with their places; ``offset`` leaves no gap within a sequence."""
    pieces = token_pieces(docs, ranks_path, capacity, id_col, text_col, added_path)
    return pack(pieces, ["doc_id", "piece", "ids_crc32"], capacity)
