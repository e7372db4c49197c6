"""Records of delimited files whose quoted fields may hold line breaks, read in many tasks per file.

Files are read as lines, which Spark splits into blocks of bytes. A line begins inside a quoted field exactly when
the quotes before it in its file are odd in number (a doubled quote counts twice). Each block adds up its quotes; a
prefix sum over the small table of blocks gives the parity at every block's start, and a running sum within each block,
as it is read, the parity at every line. Lines that begin and end outside quotes are whole records where they are read; only the lines of
records that span lines are brought together, by the first line of their record, which may lie in an earlier block.
No list of paths goes through the driver: every file below the root is one scan, and headers are the first record of
each file, joined by path.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.session import broadcast_within, written

# Blocks (counted) whose table is sent to every task; more are joined by shuffle.
BLOCKS_BROADCAST = 100_000
LINES_SCHEMA = "uri string, block long, seq long, line string, quotes long"


def physical_lines(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """Lines ``(uri, block, seq, line, quotes)`` of all files below the paths, split at ``\\n`` only.

    ``seq`` rises with the lines of a block, and blocks of a file rise with their byte offset.
    """
    meta = F.col("_metadata")
    text = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(paths)
    return text.select(
        meta["file_path"].alias("uri"),
        meta["file_block_start"].alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("line"),
        (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).cast("long").alias("quotes"),
    )


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a scan, each with the quotes before it in its block (``passed``), and the last line at or before it that
    begins outside quotes if the block begins outside (``if_outside``), and if it begins inside (``if_inside``).

    A task reads a block from its first line to its last, so nothing is shuffled for this.
    """
    at, quotes, last = None, 0, (-1, -1)
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        uri = batch.column("uri").dictionary_encode().indices.to_numpy()
        block, seq, own = (batch.column(c).to_numpy() for c in ("block", "seq", "quotes"))
        new = np.ones(n, bool)
        new[1:] = (uri[1:] != uri[:-1]) | (block[1:] != block[:-1])
        here, goes_on = (batch.column("uri")[0].as_py(), int(block[0])), False
        if here == at:
            new[0], goes_on = False, True
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        before = np.cumsum(own) - own
        passed = before - before[first]
        begun = goes_on & (np.cumsum(new) == 0)
        passed[begun] += quotes
        starts = []
        for odd, held in ((0, last[0]), (1, last[1])):
            begins = np.maximum.accumulate(np.where(passed % 2 == odd, np.arange(n), -1))
            known = begins >= first
            starts.append(np.where(known, seq[begins], np.where(begun, held, -1)))
        at = (batch.column("uri")[n - 1].as_py(), int(block[-1]))
        quotes, last = int(passed[-1] + own[-1]), (int(starts[0][-1]), int(starts[1][-1]))
        columns = [batch.column(c) for c in ("uri", "block", "seq", "line", "quotes")]
        places = [pa.array(x.astype(np.int64), mask=x < 0) for x in starts]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(passed.astype(np.int64)), *places], ["uri", "block", "seq", "line", "quotes", "passed", "if_outside", "if_inside"])


def quoted_records(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """Records ``(uri, seq, record)``: ``seq`` is that of the record's first line; one trailing ``\\r`` goes."""
    # Lines are written once, as they are read and before the parity of their block's start is known.
    found = physical_lines(spark, paths)
    lines = written(found.mapInArrow(_placed, f"{LINES_SCHEMA}, passed long, if_outside long, if_inside long"), "lines")
    blocks = lines.groupBy("uri", "block").agg(F.sum("quotes").alias("quotes"))
    earlier = Window.partitionBy("uri").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = written(blocks.select("uri", "block", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)).alias("before")), "blocks")
    n_blocks = blocks.count()
    passed = F.col("before") + F.col("passed")
    marked = (
        lines.join(broadcast_within(blocks, n_blocks, BLOCKS_BROADCAST), ["uri", "block"])
        .withColumn("inside", passed % 2 == 1)
        .withColumn("open", (passed + F.col("quotes")) % 2 == 1)
        .withColumn("start", F.when(F.col("before") % 2 == 0, F.col("if_outside")).otherwise(F.col("if_inside")))
    )
    whole = marked.where(~F.col("inside") & ~F.col("open")).select("uri", "seq", F.col("line").alias("record"))
    # Lines before a block's first record start belong to the last record begun in an earlier block.
    last = marked.groupBy("uri", "block").agg(F.max(F.when(~F.col("inside"), F.col("seq"))).alias("last"))
    carried = last.select(
        "uri", "block", F.last("last", ignorenulls=True).over(Window.partitionBy("uri").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried")
    )
    spanning = (
        marked.where(F.col("inside") | F.col("open"))
        .join(broadcast_within(carried, n_blocks, BLOCKS_BROADCAST), ["uri", "block"])
        .select("uri", F.coalesce("start", "carried").alias("first"), "seq", "line")
        .groupBy("uri", "first")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("record"))
        .select("uri", F.col("first").alias("seq"), "record")
    )
    records = whole.unionByName(spanning)
    return records.select("uri", "seq", F.regexp_replace("record", "\r$", "").alias("record"))
