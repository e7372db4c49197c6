"""Search entries: one text per dataset and per publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import extract_urls
from lodestar.session import ordered_join
from lodestar.settings import PREVIEW_ROWS, SAMPLE_COLUMNS
from lodestar.sources.delimited import first_cells

# Publications come after all datasets in entry order, without counting the datasets first.
PUBLICATION_OFFSET = 1 << 62


def entry_type_of(ord: Column) -> Column:
    return F.when(ord >= F.lit(PUBLICATION_OFFSET), F.lit("publication")).otherwise(F.lit("dataset"))


def publication_text(title: Column, link: Column) -> Column:
    return F.concat(F.lit("PUBLICATION: "), F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(link, F.lit("")))


def metadata_text(dataset: Column) -> Column:
    """Lines of a dataset's own fields; empty ones are left out."""
    fields = [F.col("organism"), F.array_join("assay_types", " "), F.col("description"), F.col("folder")]
    return F.concat_ws("\n", F.concat(F.lit("DATASET_ID: "), dataset), *[F.nullif(f, F.lit("")) for f in fields])


def sample_texts(cells: DataFrame, max_columns: int = SAMPLE_COLUMNS, rows: int = PREVIEW_ROWS) -> DataFrame:
    """Text ``(path, text)`` per file: its first column names, then the cells of its first rows.

    The rows are cut before anything is gathered, so a file's text is bounded by its width.
    """
    first = first_cells(cells, ["path"], rows)
    value = F.coalesce("value", F.lit("nan"))
    names = F.filter(F.collect_set(F.struct("col_pos", "column")), lambda c: c["col_pos"] < max_columns)
    return (
        first.groupBy("path")
        .agg(names.alias("names"), F.collect_list(F.struct("row_pos", "col_pos", value.alias("value"))).alias("cells"))
        .select(
            "path",
            F.concat_ws("\n", ordered_join(F.col("names"), " ", "column"), ordered_join(F.col("cells"), " ", "value")).alias("text"),
        )
    )


def file_parts(files: DataFrame, file_texts: DataFrame) -> DataFrame:
    """Joined file texts ``(dataset, file_text)`` in file order; a dataset has few files."""
    return (
        files.join(file_texts, "path")
        .groupBy("dataset")
        .agg(F.collect_list(F.struct("file_pos", "text")).alias("parts"))
        .select("dataset", ordered_join(F.col("parts"), "\n", "text").alias("file_text"))
    )


def dataset_texts(catalog: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """Text ``(pos, dataset, text)`` of each dataset; ``parts`` adds what its files hold."""
    text = metadata_text(F.col("dataset"))
    if parts is None:
        return catalog.select("pos", "dataset", text.alias("text"))
    return catalog.join(parts, "dataset", "left").select(
        "pos", "dataset", F.concat_ws("\n", text, "file_text").alias("text")
    )


def dataset_text_urls(catalog: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """Distinct links ``(dataset, urls)`` of the plain text fields and of the file texts."""
    fields = [F.col("organism"), F.col("description"), F.col("folder")]
    source = catalog
    if parts is not None:
        source = catalog.join(parts, "dataset", "left")
        fields.append(F.col("file_text"))
    urls = F.array_distinct(F.concat(*[extract_urls(field) for field in fields]))
    return source.select("dataset", urls.alias("urls"))


def build_corpus(dataset_text: DataFrame, publications: DataFrame) -> DataFrame:
    """All search entries ``(ord, key, entry_type, text)``, datasets before publications."""
    datasets = dataset_text.select(
        F.col("pos").alias("ord"), F.col("dataset").alias("key"), F.lit("dataset").alias("entry_type"), "text"
    )
    papers = publications.select(
        (F.col("pos") + F.lit(PUBLICATION_OFFSET)).alias("ord"),
        F.concat(F.lit("pub_"), F.col("pos").cast("string")).alias("key"),
        F.lit("publication").alias("entry_type"),
        publication_text(F.col("title"), F.col("link")).alias("text"),
    )
    return datasets.unionByName(papers)


def index_counts(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("entry_type").agg(F.count("*").alias("entries"))
