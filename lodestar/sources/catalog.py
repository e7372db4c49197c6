"""Catalogue of datasets, list of publications, and the files of a dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.session import exists, with_ordinals

ENTRY_SCHEMA = (
    "organism STRING, assay_types ARRAY<STRING>, folder STRING, description STRING, files MAP<STRING, STRING>"
)
CATALOG_SCHEMA = f"pos BIGINT, dataset STRING, {ENTRY_SCHEMA}"
_FIELDS = ("organism", "assay_types", "folder", "description", "files")
PUBLICATIONS_SCHEMA = "pos BIGINT, title STRING, link STRING"


def parse_catalog(texts: DataFrame, column: str, order: Sequence[str] = ()) -> DataFrame:
    """Entries of catalogues held as JSON objects in a text column.

    Texts follow each other by the columns ``order``, entries as in the JSON; ``pos`` counts the entries of all texts
    from 0. Text that is no JSON object gives no entry. Of a repeated dataset the last entry counts, in the place of
    the first, also over several texts.
    """
    entries = F.from_json(F.col(column), f"MAP<STRING, STRUCT<{ENTRY_SCHEMA}>>")
    listed = texts.select(F.struct(*order, F.lit(0)).alias("of_text"), F.posexplode(entries).alias("in_text", "dataset", "meta"))
    place = F.struct("of_text", "in_text")
    once = (
        listed.groupBy("dataset")
        .agg(F.min(place).alias("place"), F.max_by(F.coalesce("meta", F.struct(*_no_meta())), place).alias("meta"))
        .select("dataset", "place", "meta.*")
    )
    return with_ordinals(once, ["place"], "pos").select("pos", "dataset", *_FIELDS)


def _no_meta() -> list[Column]:
    fields = {"organism": "string", "assay_types": "array<string>", "folder": "string",
              "description": "string", "files": "map<string,string>"}
    return [F.lit(None).cast(kind).alias(name) for name, kind in fields.items()]


def _json_texts(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """JSON texts ``(value, file, block, seq)``: a file each, or a line each."""
    meta = F.col("_metadata")
    return spark.read.text(path, wholetext=not lines).select(
        "value", meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("seq")
    )


def load_catalog(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Catalogue from a JSON file or a folder of them, by name; no entries if it is missing or invalid.

    With ``lines`` every line is a JSON object of its own, so that no file is held as one string.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], CATALOG_SCHEMA)
    return parse_catalog(_json_texts(spark, path, lines), "value", ["file", "block", "seq"])


def parse_publications(texts: DataFrame, column: str, order: Sequence[str] = ()) -> DataFrame:
    """Publications held as JSON lists in a text column, counted over all texts; missing fields become empty."""
    listed = F.from_json(F.col(column), "ARRAY<STRUCT<Title STRING, Link STRING>>")
    found = texts.select(F.struct(*order, F.lit(0)).alias("of_text"), F.posexplode(listed).alias("in_text", "entry"))
    return with_ordinals(found, ["of_text", "in_text"], "pos").select(
        "pos",
        F.coalesce("entry.Title", F.lit("")).alias("title"),
        F.coalesce("entry.Link", F.lit("")).alias("link"),
    )


def load_publications(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Publications from a JSON file or a folder of them, with ``lines`` from a JSON list in every line."""
    if not exists(spark, path):
        return spark.createDataFrame([], PUBLICATIONS_SCHEMA)
    return parse_publications(_json_texts(spark, path, lines), "value", ["file", "block", "seq"])


def catalog_files(catalog: DataFrame, max_files: int | None = None) -> DataFrame:
    """Files of each dataset in catalogue order, all or the first few; of a list of paths only the first counts.

    An empty list gives an empty path.
    """
    entry = F.col("entry")
    first_of_list = F.try_element_at(F.from_json(entry, "ARRAY<STRING>"), F.lit(1))
    path = F.when(F.startswith(F.ltrim(entry), F.lit("[")), first_of_list).otherwise(entry)
    return (
        catalog.select("dataset", F.posexplode("files").alias("file_pos", "name", "entry"))
        .where(F.lit(True) if max_files is None else F.col("file_pos") < max_files)
        .select("dataset", F.col("file_pos").cast("long").alias("file_pos"), "name", F.coalesce(path, F.lit("")).alias("path"))
    )


def local_path(uri: Column) -> Column:
    """Plain path of a file URI, with escaped blanks and the like put back."""
    decoded = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, r"^file:/+", "/")


def existing_paths(spark: SparkSession, root: str) -> DataFrame:
    """Paths of all files below a folder; the files are listed, not read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return listing.select(local_path(F.col("path")).alias("path"))


def mark_missing(files: DataFrame, present: DataFrame) -> DataFrame:
    """Catalogue files with a flag for those whose path is not among the present ones.

    An empty path is not missing: it stands for a file that is there but cannot be read.
    """
    known = present.select("path", F.lit(True).alias("known")).distinct()
    missing = F.col("known").isNull() & (F.col("path") != "")
    return files.join(known, "path", "left").select(*files.columns, missing.alias("missing"))
