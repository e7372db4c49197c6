"""The driver tables in the roles the jobs need: catalogue, publications, questions, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.context import StudyFiles
from lodestar.operators.corpus import build_corpus, dataset_texts
from lodestar.operators.index import SearchIndex, build_index
from lodestar.plans.study import StudyTable, table_study
from lodestar.settings import IndexSettings


class Tables:
    """Readers of the tables below a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def catalog(self) -> DataFrame:
        """A dataset per document."""
        return self.read("documents").select(
            F.col("doc_id").alias("pos"),
            F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("dataset"),
            F.col("lang").alias("organism"),
            F.array("source").alias("assay_types"),
            F.lit("").alias("folder"),
            F.col("text").alias("description"),
        )

    def publications(self) -> DataFrame:
        """A publication per page."""
        return self.read("pages").select(
            F.col("page_id").alias("pos"),
            F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
            F.col("url").alias("link"),
        )

    def questions(self) -> DataFrame:
        """A question per benchmark item: its text, and its length as a number to look for."""
        return self.read("benchmark").select(
            F.col("item_id").alias("query_id"),
            F.concat_ws(" ", "text", F.length("text").cast("string")).alias("text"),
        )

    def answers(self) -> DataFrame:
        """Answers to the questions: all assistant turns of the question's conversation, in turn order, one a line.

        Turns without text add nothing; a conversation without any is no answer.
        """
        turns = self.read("conversations").where((F.col("role") == "assistant") & F.col("text").isNotNull())
        ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(1 << 63))).alias("turn"), "text")))
        first = turns.groupBy(F.col("conv_id").alias("query_id")).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))
        links = self.read("pages").select(F.col("page_id").alias("query_id"), "url")
        content = F.concat("text", F.lit("\nAs an AI language model I may err. See "), "url", F.lit("."))
        return (
            self.questions().select("query_id")
            .join(first, "query_id")
            .join(links, "query_id")
            .select("query_id", content.alias("content"), F.lit("batch").alias("model"), F.length("text").alias("usage"))
        )

    def corpus(self) -> DataFrame:
        return build_corpus(dataset_texts(self.catalog()), self.publications())

    def index(self, settings: IndexSettings = IndexSettings()) -> SearchIndex:
        return build_index(self.corpus(), settings)

    def label_study(self, wanted: DataFrame | None = None) -> StudyFiles:
        """Per document a file with its labels, missing where there are none."""
        dataset = F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("dataset")
        labels = self.read("labels").select(dataset, "quality", "toxic")
        labelled = labels.select("dataset", F.lit(True).alias("known")).distinct()
        files = self.catalog().join(labelled, "dataset", "left").select(
            "dataset",
            F.lit(0).cast("long").alias("file_pos"),
            F.lit("labels").alias("name"),
            F.lit("labels.tsv").alias("file_name"),
            F.col("known").isNull().alias("missing"),
        )
        return table_study(files, [StudyTable(0, "labels", labels, ["quality", "toxic"])], wanted)

    def warehouse_tables(self) -> list[StudyTable]:
        """Whole tables as the files of two datasets."""

        def table(dataset: str, pos: int, name: str, order: str, *columns: str) -> StudyTable:
            df = self.read(name)
            return StudyTable(pos, name, df.select(*(columns or df.columns), F.lit(dataset).alias("dataset")), [order], dataset)

        return [
            table("sales", 0, "customer", "c_custkey"),
            table("sales", 1, "orders", "o_orderkey"),
            table("sales", 2, "part", "p_partkey"),
            table("web", 0, "events", "event_id"),
            table("web", 1, "pages", "page_id"),
            table("web", 2, "labels", "doc_id"),
        ]

    def warehouse_catalog(self) -> DataFrame:
        """Two datasets; their descriptions name the first region and page."""
        region = self.read("region").agg(F.min("r_name").alias("region"))
        page = self.read("pages").agg(F.min_by("url", "page_id").alias("url"))
        sales = region.select(F.lit(0).alias("pos"), F.lit("sales").alias("dataset"), F.concat(F.lit("Sales from "), "region").alias("description"))
        web = page.select(F.lit(1).alias("pos"), F.lit("web").alias("dataset"), F.concat(F.lit("Events of (see "), "url", F.lit(")")).alias("description"))
        return sales.unionByName(web)

    def warehouse_study(self, dataset: str | None = None) -> StudyFiles:
        """Study files of both datasets or of one; one file of ``web`` is missing."""
        tables = [t for t in self.warehouse_tables() if dataset in (None, t.dataset)]
        rows = [(t.dataset, t.file_pos, t.name, f"{t.name}.tsv", False) for t in tables]
        rows.append(("web", 3, "archive", "archive.tsv", True))
        schema = "dataset STRING, file_pos BIGINT, name STRING, file_name STRING, missing BOOLEAN"
        return table_study(self.spark.createDataFrame(rows, schema), tables)
