"""A table of questions to a table of answer records."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.answers import (
    cleaned,
    gathered_dataset_urls,
    parse_answers,
    prompt,
    recommended_urls,
    summary,
    summary_lines,
)
from lodestar.operators.context import StudyFiles, combined_contexts, dataset_contexts
from lodestar.operators.index import SearchIndex
from lodestar.operators.ranking import dataset_hits, only_hit, publication_hits, search
from lodestar.operators.urls import gathered
from lodestar.session import broadcast_within, written
from lodestar.settings import BROADCAST_ROWS, RankSettings
from lodestar.sources.export import data_link, json_text


@dataclass(frozen=True)
class Hits:
    """Ranked hits, written once as many steps read them, with the fields of what was hit."""

    datasets: DataFrame
    publications: DataFrame
    rows: int


def hits_of(
    index: SearchIndex,
    questions: DataFrame,
    catalog: DataFrame,
    publications: DataFrame,
    settings: RankSettings = RankSettings(),
) -> Hits:
    hits = written(search(index, questions, settings), "hits")
    rows = hits.count()
    # With their fields the hits are still few rows; written, the catalogue is read for them once.
    return Hits(
        written(dataset_hits(hits, catalog, rows), "dataset-hits"),
        written(publication_hits(hits, publications, rows), "publication-hits"),
        rows,
    )


# Gives the study files of the datasets in a table ``(dataset)``.
StudySource = Callable[[DataFrame], StudyFiles]


def contexts_of_hits(hits: Hits, catalog: DataFrame, study: StudySource | None) -> DataFrame:
    """Contexts of the datasets that were hit, written; the others are left out before any work."""
    wanted = written(hits.datasets.select(F.col("key").alias("dataset")).distinct(), "wanted")
    study_files = None if study is None else study(broadcast_within(wanted, hits.rows, BROADCAST_ROWS))
    return written(dataset_contexts(only_hit(catalog, wanted, hits.rows), study_files), "contexts")


def prompt_table(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """Prompts ``(query_id, prompt)`` from questions and their combined contexts."""
    return questions.join(contexts, "query_id").select(
        "query_id", prompt(F.col("text"), F.col("context"), F.col("no_context")).alias("prompt")
    )


def used_lists(questions: DataFrame, datasets: DataFrame, publications: DataFrame) -> DataFrame:
    """Hits as arrays of structs ``(query_id, used_datasets, used_publications)``, best first."""
    of_datasets = datasets.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("key").alias("dataset"), "score", "sim", "overlap"))).alias("used_datasets")
    )
    of_papers = publications.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "title", "link", "score", "sim", "overlap"))).alias("used_publications")
    )
    joined = questions.select("query_id").join(of_datasets, "query_id", "left").join(of_papers, "query_id", "left")
    return joined.select("query_id", _or_empty(joined, "used_datasets"), _or_empty(joined, "used_publications"))


def _or_empty(df: DataFrame, name: str) -> Column:
    """An array column with an empty list in place of NULL."""
    return F.coalesce(F.col(name), F.array().cast(df.schema[name].dataType)).alias(name)


def local_summaries(
    questions: DataFrame, combined: DataFrame, used: DataFrame, urls: DataFrame
) -> DataFrame:
    """Rule-based answers ``(query_id, summary)``."""
    joined = questions.join(combined, "query_id").join(used, "query_id").join(urls, "query_id", "left")
    shown = joined.withColumn("shown", summary_lines(F.col("context")))
    no_papers = F.array().cast("array<struct<title:string,link:string>>")
    papers = F.coalesce(F.transform("used_publications", lambda p: F.struct(p["title"].alias("title"), p["link"].alias("link"))), no_papers)
    return shown.select(
        "query_id",
        summary(F.col("text"), F.col("shown"), papers, F.coalesce("urls", F.array().cast("array<string>"))).alias("summary"),
    )


def ask(
    index: SearchIndex,
    questions: DataFrame,
    catalog: DataFrame,
    publications: DataFrame,
    answers: DataFrame,
    study: StudySource | None = None,
    datasets_first: bool = True,
    settings: RankSettings = RankSettings(),
) -> DataFrame:
    """Answer records of all questions.

    ``answers`` ``(query_id, content, model, usage)`` holds the texts a model gave, made by any
    batch consumer of the prompt table. A question without one gets the rule-based summary; its
    recommended links are then those of its datasets.
    """
    hits = hits_of(index, questions, catalog, publications, settings)
    datasets, papers = hits.datasets, hits.publications
    contexts = contexts_of_hits(hits, catalog, study)
    combined = combined_contexts(questions, datasets, papers, contexts)
    given = parse_answers(answers)
    used = used_lists(questions, datasets, papers)
    own_urls = gathered_dataset_urls(datasets, contexts)
    all_urls = gathered(recommended_urls(datasets, papers, contexts, given, datasets_first), "query_id")
    structured = (
        datasets.join(contexts.select(F.col("dataset").alias("key"), "columns"), "key")
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", F.col("key").alias("dataset"), "description", "columns"))).alias("structured"))
    )
    none = F.array().cast("array<string>")
    fallback = F.col("content").isNull()
    meta = F.struct(fallback.alias("fallback"), "model", "usage")
    records = (
        questions.select("query_id")
        .join(cleaned(given).drop("urls"), "query_id", "left")
        .join(local_summaries(questions, combined, used, own_urls), "query_id")
        .join(all_urls.withColumnRenamed("urls", "all_urls"), "query_id", "left")
        .join(own_urls.withColumnRenamed("urls", "own_urls"), "query_id", "left")
        .join(used, "query_id")
        .join(structured, "query_id", "left")
        .select(
            "query_id",
            F.coalesce("content", "summary").alias("answer"),
            F.coalesce(F.when(fallback, F.col("own_urls")).otherwise(F.col("all_urls")), none).alias("recommended_urls"),
            "used_datasets",
            "used_publications",
            meta.alias("meta"),
            "structured",
        )
    )
    return records.withColumn("structured", _or_empty(records, "structured"))


def metadata_bundles(records: DataFrame) -> DataFrame:
    """Per answer record ``(query_id, bundle, link)``: what it was made of, as indented JSON and as a data link."""
    bundle = json_text(F.struct("meta", "used_datasets", "used_publications", "structured"), pretty=True)
    return records.select("query_id", bundle.alias("bundle")).withColumn("link", data_link(F.col("bundle")))
