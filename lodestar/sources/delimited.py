"""Delimited study files as one table of cells, whatever their headers are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.text import head, null_missing
from lodestar.session import broadcast_within, ordered_join, written
from lodestar.settings import BROADCAST_ROWS, HEAD_CHARS, PREVIEW_ROWS
from lodestar.sources.catalog import local_path
from lodestar.sources.quoted import quoted_records

CELLS_SCHEMA = "path STRING, row_pos BIGINT, col_pos BIGINT, column STRING, value STRING"
HEADERS_SCHEMA = "path STRING, separator STRING, names ARRAY<STRING>"


def _mangled(names: Column) -> Column:
    """Header names made unique: ``x, x`` becomes ``x, x.1``; a name already taken is skipped."""
    filled = F.transform(
        names, lambda name, i: F.when(name == "", F.concat(F.lit("Unnamed: "), i.cast("string"))).otherwise(name)
    )

    def unique(name: Column, i: Column) -> Column:
        earlier = F.size(F.filter(F.slice(filled, F.lit(1), i), lambda other: other == name))
        numbered = F.transform(F.sequence(F.lit(1), F.size(filled)), lambda n: F.concat(name, F.lit("."), n.cast("string")))
        free = F.filter(numbered, lambda candidate: ~F.array_contains(filled, candidate))
        return F.when(earlier == 0, name).otherwise(F.element_at(free, F.greatest(earlier, F.lit(1))))

    return F.transform(filled, unique)


def _header_fields(line: Column, separator: Column) -> Column:
    """Fields of a header line, outer quotes removed."""
    pattern = F.concat(
        F.lit('(?:^|'), separator, F.lit(')("(?:[^"]|"")*"|[^'), separator, F.lit("]*)")
    )
    fields = F.regexp_extract_all(line, pattern, F.lit(1))
    return F.transform(
        fields, lambda f: F.regexp_replace(F.regexp_replace(f, '^"(.*)"$', "$1"), '""', '"')
    )


def file_headers(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """Per file its separator and unique column names.

    The separator is the tab if the header line has one, else the comma if it has one, else NULL:
    such a file is text, not a table.
    """
    meta = F.col("_metadata")
    text = spark.read.option("recursiveFileLookup", "true").text(paths)
    line = F.regexp_replace(F.regexp_replace("value", "\r$", ""), "^﻿", "")
    # The header is in the first block of a file. Sequence numbers rise within it, so every task keeps one line a file.
    order = Window.partitionBy("uri").orderBy("seq")
    first = (
        text.where(meta["file_block_start"] == 0)
        .select(meta["file_path"].alias("uri"), F.monotonically_increasing_id().alias("seq"), line.alias("line"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= 1)
    )
    separator = F.when(F.contains("line", F.lit("\t")), F.lit("\t")).when(F.contains("line", F.lit(",")), F.lit(","))
    return first.withColumn("separator", separator).select(
        local_path(F.col("uri")).alias("path"),
        "separator",
        F.when(F.col("separator").isNotNull(), _mangled(_header_fields(F.col("line"), F.col("separator")))).alias("names"),
    )


def read_delimited(
    spark: SparkSession, paths: Sequence[str] | str, analysis_rows: int | None = None, multi_line: bool = True
) -> DataFrame:
    """Cells ``(path, row_pos, col_pos, column, value)`` of all delimited files below the paths.

    Every cell is text, NULL where missing. ``row_pos`` rises with the order of the rows in a file; it counts from
    0 only if ``analysis_rows`` is given, which keeps that many rows of each file. By default quoted fields may hold
    line breaks, and every file is still read in many tasks (``sources.quoted``), in one scan below the root and
    without a list of paths. With ``multi_line=False`` every line is a row and Spark's CSV reader takes the files of
    each separator. A file whose first data row is wider than its header is text and gives no cell.
    """
    if multi_line:
        return _quoted_cells(spark, paths, analysis_rows)
    headers = written(file_headers(spark, paths), "headers")
    # The driver's file index holds every path anyway, so their list is no larger burden.
    tables = headers.where(F.col("separator").isNotNull())
    widths = tables.groupBy("separator").agg(F.max(F.size("names")).alias("width"), F.collect_list("path").alias("paths"))
    parts = [_cells(spark, tables, row, analysis_rows, multi_line) for row in widths.collect()]
    if not parts:
        return spark.createDataFrame([], CELLS_SCHEMA)
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _quoted_cells(spark: SparkSession, paths: Sequence[str] | str, analysis_rows: int | None) -> DataFrame:
    """Cells of records that quoted line breaks may span; the first record of a file is its header."""
    records = written(quoted_records(spark, paths).where(F.col("record") != ""), "records")
    firsts = records.groupBy("uri").agg(F.min_by("record", "seq").alias("header"), F.min("seq").alias("header_seq"))
    line = F.regexp_replace("header", "^\ufeff", "")
    separator = F.when(F.contains(line, F.lit("\t")), F.lit("\t")).when(F.contains(line, F.lit(",")), F.lit(","))
    headers = written(
        firsts.withColumn("separator", separator)
        .where(F.col("separator").isNotNull())
        .select("uri", "header_seq", "separator", _mangled(_header_fields(line, F.col("separator"))).alias("names")),
        "headers",
    )
    widest = headers.agg(F.max(F.size("names"))).first()[0]
    if widest is None:
        return spark.createDataFrame([], CELLS_SCHEMA)
    fields = [f"c{i}" for i in range(widest + 1)]
    schema = ", ".join(f"{name} STRING" for name in fields)

    def parsed(sep: str):
        return F.from_csv("record", schema, {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"})

    cells = F.when(F.col("separator") == "\t", parsed("\t")).otherwise(parsed(","))
    n_files = headers.count()
    data = records.join(broadcast_within(headers, n_files, BROADCAST_ROWS), "uri").where(F.col("seq") > F.col("header_seq"))

    def listed(df: DataFrame, name: str, *keep: str) -> DataFrame:
        return df.select(*keep, cells.alias("parsed")).select(*keep, F.array(*[F.col("parsed")[f] for f in fields]).alias(name))

    # Records are parsed where they are used; of each file only the first is parsed before.
    rows = listed(data, "cells", "uri", "seq", "names")
    begins = data.groupBy("uri").agg(F.min_by("record", "seq").alias("record"), F.first("names").alias("names"), F.first("separator").alias("separator"))
    first = listed(begins, "first", "uri", "names")
    wider = F.exists(F.slice("first", F.size("names") + 1, len(fields)), lambda cell: cell.isNotNull())
    usable = written(first.where(~wider).select("uri"), "usable")
    if analysis_rows is not None:
        order = Window.partitionBy("uri").orderBy("seq")
        rows = rows.withColumn("row_pos", F.row_number().over(order) - 1).where(F.col("row_pos") < analysis_rows)
    else:
        rows = rows.withColumn("row_pos", F.col("seq"))
    return (
        rows.join(broadcast_within(usable, n_files, BROADCAST_ROWS), "uri", "left_semi")
        .select(local_path(F.col("uri")).alias("path"), F.col("row_pos").cast("long").alias("row_pos"), "names", F.posexplode("cells").alias("col_pos", "cell"))
        .where(F.col("col_pos") < F.size("names"))
        .select(
            "path",
            "row_pos",
            F.col("col_pos").cast("long").alias("col_pos"),
            F.get("names", F.col("col_pos")).alias("column"),
            null_missing(F.col("cell")).alias("value"),
        )
    )


def _cells(spark: SparkSession, tables: DataFrame, group, analysis_rows: int | None, multi_line: bool) -> DataFrame:
    fields = [f"c{i}" for i in range(group.width + 1)]
    rows = (
        spark.read.schema(", ".join(f"{name} STRING" for name in fields))
        .options(sep=group.separator, header=True, enforceSchema=True, quote='"', escape='"', multiLine=multi_line)
        .csv(group.paths)
        .select(
            local_path(F.col("_metadata.file_path")).alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"),
            F.array(*fields).alias("cells"),
        )
    )
    headers = tables.where(F.col("separator") == group.separator).select("path", "names")
    in_file = Window.partitionBy("path").orderBy("seq")
    first = (
        rows.where(F.col("block") == 0)
        .withColumn("rank", F.row_number().over(in_file))
        .where(F.col("rank") <= 1)
        .select("path", F.col("cells").alias("first"))
    )
    wider = F.exists(F.slice("first", F.size("names") + 1, len(fields)), lambda cell: cell.isNotNull())
    usable = headers.join(first, "path", "left").where(~F.coalesce(wider, F.lit(False))).select("path", "names")
    if analysis_rows is not None:
        order = Window.partitionBy("path").orderBy("block", "seq")
        rows = rows.withColumn("row_pos", F.row_number().over(order)).where(F.col("row_pos") <= analysis_rows)
        rows = rows.withColumn("row_pos", F.col("row_pos") - 1)
    else:
        # A block starts at a byte offset and a task's sequence number is its partition index
        # times 2^33 plus the row, so the two orders agree within a file.
        rows = rows.withColumn("row_pos", F.col("seq"))
    return (
        rows.join(broadcast_within(usable, len(group.paths), BROADCAST_ROWS), "path")
        .select("path", F.col("row_pos").cast("long").alias("row_pos"), "names", F.posexplode("cells").alias("col_pos", "cell"))
        .where(F.col("col_pos") < F.size("names"))
        .select(
            "path",
            "row_pos",
            F.col("col_pos").cast("long").alias("col_pos"),
            F.get("names", F.col("col_pos")).alias("column"),
            null_missing(F.col("cell")).alias("value"),
        )
    )


def first_cells(cells: DataFrame, keys: Sequence[str], rows: int = PREVIEW_ROWS) -> DataFrame:
    """Cells of the first rows of each group; cells of one row share its position."""
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy("row_pos"))
    return cells.withColumn("rank", rank).where(F.col("rank") <= rows).drop("rank")


def preview_rows(spark: SparkSession, paths: Sequence[str] | str, rows: int = PREVIEW_ROWS) -> DataFrame:
    """Cells of the first rows of each file."""
    return read_delimited(spark, paths, analysis_rows=rows)


def raw_heads(spark: SparkSession, paths: Sequence[str] | str, chars: int = HEAD_CHARS) -> DataFrame:
    """First characters ``(path, text)`` of each file below the paths, read as text.

    A line takes one character at least, so the head needs no more lines than characters; the
    other lines are dropped where they are read, and no file is held whole.
    """
    meta = F.col("_metadata")
    lines = (
        spark.read.option("recursiveFileLookup", "true")
        .text(paths)
        .where(meta["file_block_start"] == 0)
        .select(
            local_path(meta["file_path"]).alias("path"),
            F.monotonically_increasing_id().alias("seq"),
            F.substring("value", 1, chars).alias("line"),
        )
    )
    firsts = written(lines.groupBy("path").agg(F.min("seq").alias("first")), "firsts")
    return (
        lines.join(broadcast_within(firsts, firsts.count(), BROADCAST_ROWS), "path")
        .where(F.col("seq") < F.col("first") + chars)
        .groupBy("path")
        .agg(F.collect_list(F.struct("seq", "line")).alias("lines"))
        .select("path", head(ordered_join(F.col("lines"), "\n", "line"), chars).alias("text"))
    )
