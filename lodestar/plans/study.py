"""The files behind datasets: read, previewed and profiled."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.context import StudyFiles, cell_preview_texts, first_rows, preview_texts
from lodestar.operators.corpus import sample_texts
from lodestar.operators.profile import frame_cells, frequencies, named_columns, profile, profile_cells, ranged
from lodestar.session import broadcast_within, written
from lodestar.settings import BROADCAST_ROWS, HEAD_CHARS, PREVIEW_ROWS, SAMPLE_COLUMNS
from lodestar.sources.catalog import catalog_files, existing_paths, mark_missing
from lodestar.sources.delimited import CELLS_SCHEMA, first_cells, preview_rows, raw_heads, read_delimited

KEYS = ("dataset", "file_pos", "col_pos")


@dataclass(frozen=True)
class StudyTable:
    """A Spark table that is a file of datasets.

    ``df`` has a column ``dataset`` that says whose rows they are; ``order`` fixes which rows come
    first in a preview. ``dataset`` is set if the whole table belongs to one dataset.
    """

    file_pos: int
    name: str
    df: DataFrame
    order: Sequence[str]
    dataset: str | None = None

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != "dataset"]

    def keyed(self) -> DataFrame:
        return self.df.withColumn("file_pos", F.lit(self.file_pos).cast("long"))

    def owners(self) -> DataFrame:
        """Datasets and positions ``(dataset, file_pos)`` the table stands at."""
        if self.dataset is None:
            return self.keyed().select("dataset", "file_pos").distinct()
        one = self.df.sparkSession.range(1)
        return one.select(F.lit(self.dataset).alias("dataset"), F.lit(self.file_pos).cast("long").alias("file_pos"))


def table_profiles(tables: Sequence[StudyTable]) -> DataFrame:
    """Profile records ``(dataset, file_pos, col_pos, column, ...)`` of all tables in one pass."""
    keys = ["dataset", "file_pos"]
    cells = _union([frame_cells(t.keyed(), keys, t.columns) for t in tables])
    columns = _union([named_columns(t.owners(), t.columns) for t in tables])
    return profile(ranged(frequencies(cells, KEYS), KEYS), columns)


def table_previews(tables: Sequence[StudyTable]) -> DataFrame:
    keys = ["dataset", "file_pos"]
    return _union([preview_texts(first_rows(t.keyed(), keys, list(t.order)), keys, t.columns) for t in tables])


def table_study(files: DataFrame, tables: Sequence[StudyTable], wanted: DataFrame | None = None) -> StudyFiles:
    """Study files held as Spark tables; ``files`` also lists those that are missing.

    Given the datasets ``(dataset)`` that are wanted, rows of others leave before anything is
    computed on them.
    """
    if wanted is not None:
        files = files.join(wanted, "dataset", "left_semi")
        tables = [replace(t, df=t.df.join(wanted, "dataset", "left_semi")) for t in tables]
    return StudyFiles(files, table_previews(tables), table_profiles(tables))


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def file_study(
    spark: SparkSession,
    catalog: DataFrame,
    root: str,
    analysis_rows: int | None = None,
    multi_line: bool = True,
    wanted: DataFrame | None = None,
    max_files: int | None = None,
) -> StudyFiles:
    """Study files below a folder, as the catalogue names them.

    All files below the root are one scan; a file that is no table has its raw head. Given the datasets ``(dataset)``
    that are wanted, the rows of their files are kept by a join on the path with the catalogue's files, so no list
    of paths goes through the driver. ``max_files`` keeps the first files of each dataset.
    """
    if wanted is not None:
        catalog = catalog.join(wanted, "dataset", "left_semi")
    named = mark_missing(catalog_files(catalog, max_files), existing_paths(spark, root)).withColumn(
        "file_name", F.element_at(F.split("path", "/"), -1)
    )
    files = written(named, "files")
    slots = files.where(~F.col("missing")).select("dataset", "file_pos", "path")
    slots = broadcast_within(slots, files.count(), BROADCAST_ROWS)
    source = root
    empty = files.where(~F.col("missing") & (F.col("path") != "")).limit(1).count() == 0
    read = spark.createDataFrame([], CELLS_SCHEMA) if empty else read_delimited(spark, source, analysis_rows, multi_line)
    cells = written(read.join(slots, "path"), "cells")
    columns = cells.select(*KEYS, "column").distinct()
    with_rows = columns.select("dataset", "file_pos").distinct()
    raw = spark.createDataFrame([], "path STRING, text STRING") if empty else raw_heads(spark, source)
    heads = raw.join(slots, "path").join(with_rows, ["dataset", "file_pos"], "left_anti")
    return StudyFiles(
        files=files.select("dataset", "file_pos", "name", "file_name", "missing"),
        previews=cell_preview_texts(first_cells(cells, ["dataset", "file_pos"]), ["dataset", "file_pos"]),
        profiles=profile_cells(cells, KEYS, columns),
        heads=heads.select("dataset", "file_pos", "text"),
    )


def file_texts(
    spark: SparkSession,
    root: str,
    mode: str = "sample",
    max_columns: int = SAMPLE_COLUMNS,
    rows: int = PREVIEW_ROWS,
    chars: int = HEAD_CHARS,
) -> DataFrame | None:
    """Text ``(path, text)`` of each file below a folder for the search entry of its dataset.

    ``sample``: column names and first rows of tables, the raw head of other files. ``raw_head``:
    the raw head of every file. ``none``: no text.
    """
    if mode == "none":
        return None
    heads = raw_heads(spark, root, chars)
    if mode == "raw_head":
        return heads
    samples = written(sample_texts(preview_rows(spark, root, rows), max_columns, rows), "samples")
    return samples.unionByName(heads.join(samples.select("path"), "path", "left_anti"))
