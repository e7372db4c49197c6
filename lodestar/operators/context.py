"""Context texts: what is known of a dataset, and of all hits of a question.

Blocks of text carry order columns and are joined in that order. A dataset has at most four
files with one block per column, so its context is bounded by its width, not by its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.numbers import fixed
from lodestar.functions.text import extract_urls, strip
from lodestar.operators.profile import merge_files, rendered
from lodestar.operators.urls import first_occurrences, gathered, numbered
from lodestar.session import ordered_join
from lodestar.settings import PREVIEW_ROWS

# Sections of a dataset's blocks, in order, within a file.
PREVIEW, COLUMNS = 0, 1
# Section titles of a question's context.
PUBLICATIONS_TITLE = "--- Related Research Publications ---"


@dataclass(frozen=True)
class StudyFiles:
    """What is known of the files of datasets.

    files: ``(dataset, file_pos, name, file_name, missing)``, at most four per dataset. previews:
    ``(dataset, file_pos, text)``, absent for files that cannot be read as a table. profiles:
    records with ``(dataset, file_pos, col_pos, column)``. heads: ``(dataset, file_pos, text)``,
    the first characters of files without a table.
    """

    files: DataFrame
    previews: DataFrame
    profiles: DataFrame
    heads: DataFrame | None = None


def first_rows(df: DataFrame, keys: list[str], order: list[str], rows: int = PREVIEW_ROWS) -> DataFrame:
    """First rows of each group with their position ``row_pos`` from 0."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    # Filtered on the rank itself, so that every task keeps its first rows only.
    return df.withColumn("row_pos", rank).where(F.col("row_pos") <= rows).withColumn("row_pos", F.col("row_pos") - 1)


def preview_texts(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Preview ``(keys, text)``: a line of column names, then a line per row of ``first_rows``."""
    cells = [F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("NaN")) for name in names]
    line = F.concat_ws(" ", *cells)
    return (
        rows.groupBy(*keys)
        .agg(F.collect_list(F.struct("row_pos", line.alias("line"))).alias("lines"))
        .select(*keys, F.concat_ws("\n", F.lit(" ".join(names)), ordered_join(F.col("lines"), "\n", "line")).alias("text"))
    )


def cell_preview_texts(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Preview ``(keys, text)`` of the cells of the first rows of files."""
    value = F.coalesce("value", F.lit("NaN")).alias("value")
    lines = cells.groupBy(*keys, "row_pos").agg(
        ordered_join(F.collect_list(F.struct("col_pos", value)), " ", "value").alias("line"),
        ordered_join(F.collect_list(F.struct("col_pos", "column")), " ", "column").alias("names"),
    )
    return lines.groupBy(*keys).agg(
        F.concat_ws(
            "\n", F.min("names"), ordered_join(F.collect_list(F.struct("row_pos", "line")), "\n", "line")
        ).alias("text")
    )


def description_blocks(catalog: DataFrame) -> DataFrame:
    return catalog.where(F.coalesce("description", F.lit("")) != "").select(
        "dataset",
        F.lit(-1).cast("long").alias("file_pos"),
        F.lit(0).alias("section"),
        F.lit(0).cast("long").alias("col_pos"),
        F.concat(F.lit("Description: "), F.col("description")).alias("block"),
    )


def preview_blocks(study: StudyFiles) -> DataFrame:
    """One block per file: its preview, or that it is missing or unreadable."""
    block = (
        F.when(F.col("missing"), F.concat(F.lit("FILE: "), F.col("name"), F.lit(" - (missing)")))
        .when(F.col("text").isNotNull(), F.concat(F.lit("FILE PREVIEW: "), F.col("file_name"), F.lit("\n"), F.col("text")))
        .otherwise(F.concat(F.lit("FILE: "), F.col("file_name"), F.lit(" (preview unreadable)")))
    )
    return study.files.join(study.previews, ["dataset", "file_pos"], "left").select(
        "dataset", "file_pos", F.lit(PREVIEW).alias("section"), F.lit(0).cast("long").alias("col_pos"), block.alias("block")
    )


def column_blocks(study: StudyFiles) -> DataFrame:
    return study.profiles.select(
        "dataset", "file_pos", F.lit(COLUMNS).alias("section"), "col_pos", rendered().alias("block")
    ).where(F.col("block").isNotNull())


def context_urls(catalog: DataFrame, study: StudyFiles | None) -> DataFrame:
    """Links ``(dataset, url, place)``: of the description, then of the top values or raw heads."""

    def at(file_pos, col_pos, rank):
        return [file_pos.cast("long").alias("file_pos"), col_pos.cast("long").alias("col_pos"), rank.cast("long").alias("rank")]

    zero = F.lit(0)
    found = catalog.select("dataset", F.inline(numbered(extract_urls(F.col("description")), *at(F.lit(-1), zero, zero))))
    if study is not None:
        in_values = study.profiles.select("dataset", "file_pos", "col_pos", F.explode(F.filter("top", _has_link)).alias("v")).select(
            "dataset",
            F.inline(numbered(extract_urls(F.col("v.value")), *at(F.col("file_pos"), F.col("col_pos"), F.col("v.rank")))),
        )
        found = found.unionByName(in_values)
        if study.heads is not None:
            found = found.unionByName(
                study.heads.select("dataset", F.inline(numbered(extract_urls(F.col("text")), *at(F.col("file_pos"), zero, zero))))
            )
    return first_occurrences(found, "dataset", ["file_pos", "col_pos", "rank", "pos"])


def _has_link(value):
    return F.contains(F.lower(value["value"]), F.lit("http"))


def dataset_contexts(catalog: DataFrame, study: StudyFiles | None = None) -> DataFrame:
    """Context ``(dataset, context, urls, columns)`` of each dataset of the catalogue.

    ``columns`` holds the profile of each column, the last file's if a name occurs in several.
    """
    blocks = description_blocks(catalog)
    if study is not None:
        blocks = blocks.unionByName(preview_blocks(study)).unionByName(column_blocks(study))
    texts = blocks.groupBy("dataset").agg(
        ordered_join(F.collect_list(F.struct("file_pos", "section", "col_pos", "block")), "\n", "block").alias("context")
    )
    links = gathered(context_urls(catalog, study), "dataset")
    result = catalog.select("dataset").join(texts, "dataset", "left").join(links, "dataset", "left")
    if study is None:
        columns = F.lit(None).cast("array<struct<column:string>>")
    else:
        merged = merge_files(study.profiles).groupBy("dataset").agg(
            F.array_sort(F.collect_list(F.struct("place", "column", "summary"))).alias("listed")
        )
        result = result.join(merged, "dataset", "left")
        columns = F.transform("listed", lambda c: F.struct(c["column"].alias("column"), c["summary"].alias("summary")))
    return result.select(
        "dataset",
        F.coalesce("context", F.lit("")).alias("context"),
        F.coalesce("urls", F.array().cast("array<string>")).alias("urls"),
        columns.alias("columns"),
    )


def combined_contexts(questions: DataFrame, datasets: DataFrame, publications: DataFrame, contexts: DataFrame) -> DataFrame:
    """Context ``(query_id, context, no_context)`` of each question from its hits.

    A question has at most as many blocks as hits.
    """
    title = F.concat(F.lit("--- Dataset: "), F.col("key"), F.lit(" (score="), fixed(F.col("score"), 3), F.lit(") ---\n"))
    first = (
        datasets.select("query_id", "rank", "score", "key")
        .join(contexts.select(F.col("dataset").alias("key"), "context"), "key", "left")
        .select("query_id", F.lit(0).alias("section"), "rank", F.concat(title, F.coalesce("context", F.lit(""))).alias("block"))
    )
    heading = publications.where(F.col("rank") == 1).select(
        "query_id", F.lit(1).alias("section"), F.lit(0).alias("rank"), F.lit(PUBLICATIONS_TITLE).alias("block")
    )
    paper = F.concat(
        F.lit("Publication: "), F.col("title"), F.lit("\nLink: "), F.col("link"),
        F.lit("\nRelevance Score: "), fixed(F.col("score"), 3),
    )
    second = publications.select("query_id", F.lit(2).alias("section"), "rank", paper.alias("block"))
    blocks = first.unionByName(heading).unionByName(second)
    texts = blocks.groupBy("query_id").agg(
        strip(ordered_join(F.collect_list(F.struct("section", "rank", "block")), "\n\n", "block")).alias("context")
    )
    context = F.coalesce("context", F.lit(""))
    return questions.select("query_id").join(texts, "query_id", "left").select(
        "query_id", context.alias("context"), (context == "").alias("no_context")
    )


def dataset_details(catalog: DataFrame, dataset: str, study: StudyFiles | None = None) -> DataFrame:
    """Context of one dataset; ``study`` needs to hold that dataset's files only."""
    chosen = F.col("dataset") == dataset
    if study is not None:
        heads = None if study.heads is None else study.heads.where(chosen)
        study = StudyFiles(study.files.where(chosen), study.previews.where(chosen), study.profiles.where(chosen), heads)
    return dataset_contexts(catalog.where(chosen), study)
