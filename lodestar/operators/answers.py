"""Answers: parsed from supplied texts, or summed up from the context by rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import KEYWORDS, clean_answer, extract_urls, has_keyword, lines
from lodestar.operators.urls import first_occurrences, gathered, numbered
from lodestar.settings import SUMMARY_LINES, SUMMARY_LINES_WITHOUT_KEYWORD, SUMMARY_PUBLICATIONS, SUMMARY_URLS

# Texts of an answer record.
NO_CONTENT = "No content returned from API."
SUMMARY_TITLE = "Local fallback summary for: "
NO_LOCAL_DATA = "No local data available."
PUBLICATIONS_TITLE = "\n\nRelated Research Publications:\n"
URLS_TITLE = "\n\nLocal dataset URLs:\n"
SUGGESTIONS_TITLE = "\n\nSuggested NASA data sources to search:\n"
SUGGESTION = ("- Search Google for: '", " dataset NASA Open Science'\n")
SEARCH_PHRASES = (
    "NASA space biology",
    "microgravity research",
    "spaceflight transcriptomics",
    "NASA gene expression data",
)

# The instructions of a prompt are a parameter; these say the same in other words.
INSTRUCTIONS = (
    "Answer the question from the context below. Name the datasets and publications you used and the "
    "most useful links. If the context does not suffice, say which public sources to search."
)
NO_CONTEXT_MARK = "[no matching dataset or publication]"
NO_CONTEXT_NOTE = "\n\nNote: nothing was found locally; answer from general knowledge and point to public sources."


def parse_answers(answers: DataFrame) -> DataFrame:
    """Answer rows ``(query_id, content, model, usage)`` with their links in ``urls``.

    An empty text is replaced by a notice; a missing model is ``unknown``.
    """
    content = F.coalesce(F.nullif(F.col("content"), F.lit("")), F.lit(NO_CONTENT))
    return answers.select(
        "query_id",
        content.alias("content"),
        extract_urls(content).alias("urls"),
        F.coalesce("model", F.lit("unknown")).alias("model"),
        "usage",
    )


def cleaned(answers: DataFrame) -> DataFrame:
    return answers.withColumn("content", clean_answer(F.col("content")))


def suggestions(question: Column, phrases: Sequence[str] = SEARCH_PHRASES) -> Column:
    """Phrases of which a word is part of the lower-cased question, words taken as written."""
    lowered = F.lower(question)

    def kept(phrase: str) -> Column:
        found = F.lit(False)
        for word in phrase.split():
            found = found | F.contains(lowered, F.lit(word))
        return F.when(found, F.lit(phrase))

    return F.array_compact(F.array(*[kept(phrase) for phrase in phrases]))


def summary_lines(context: Column, keywords: Sequence[str] = KEYWORDS) -> Column:
    """First lines with a keyword, else the first lines."""
    all_lines = lines(context)
    important = F.filter(all_lines, lambda line: has_keyword(line, keywords))
    return F.when(F.size(important) > 0, F.slice(important, 1, SUMMARY_LINES)).otherwise(
        F.slice(all_lines, 1, SUMMARY_LINES_WITHOUT_KEYWORD)
    )


def summary(question: Column, shown: Column, publications: Column, urls: Column, phrases: Sequence[str] = SEARCH_PHRASES) -> Column:
    """Rule-based answer text from lines, publications (structs of title and link) and links."""
    listed = F.array_join(F.transform(shown, lambda line: F.concat(F.lit("- "), line)), "\n")
    papers = F.transform(
        F.slice(publications, 1, SUMMARY_PUBLICATIONS),
        lambda p: F.concat(F.lit("- "), p["title"], F.lit("\n  "), p["link"], F.lit("\n")),
    )
    searches = F.transform(
        suggestions(question, phrases), lambda p: F.concat(F.lit(SUGGESTION[0]), p, F.lit(SUGGESTION[1]))
    )

    def section(title: str, parts: Column, separator: str) -> Column:
        return F.when(F.size(parts) > 0, F.concat(F.lit(title), F.array_join(parts, separator))).otherwise(F.lit(""))

    return F.concat(
        F.lit(SUMMARY_TITLE),
        question,
        F.lit("\n"),
        F.when(F.size(shown) > 0, listed).otherwise(F.lit(NO_LOCAL_DATA)),
        section(PUBLICATIONS_TITLE, papers, ""),
        section(URLS_TITLE, F.slice(urls, 1, SUMMARY_URLS), "\n"),
        F.lit(SUGGESTIONS_TITLE),
        F.array_join(searches, ""),
    )


def prompt(question: Column, context: Column, no_context: Column, instructions: str = INSTRUCTIONS) -> Column:
    """Instructions, context and question as one text."""
    return F.concat(
        F.lit(instructions + "\n\nCONTEXT:\n"),
        F.when(no_context, F.lit(NO_CONTEXT_MARK)).otherwise(context),
        F.lit("\n\nQUESTION:\n"),
        question,
        F.when(no_context, F.lit(NO_CONTEXT_NOTE)).otherwise(F.lit("")),
    )


def recommended_urls(
    datasets: DataFrame,
    publications: DataFrame,
    contexts: DataFrame,
    answers: DataFrame,
    datasets_first: bool = True,
) -> DataFrame:
    """Distinct links ``(query_id, url, place)`` of hits and answers, in order of their source.

    The order is datasets, publications, answer, or the reverse of it.
    """
    source = {"datasets": 0, "publications": 1, "answer": 2} if datasets_first else {"answer": 0, "publications": 1, "datasets": 2}

    def at(name: str, rank: Column) -> list[Column]:
        return [F.lit(source[name]).alias("source"), rank.cast("long").alias("rank")]

    of_datasets = dataset_urls(datasets, contexts).select("query_id", *at("datasets", F.col("rank")), "pos", "url")
    of_papers = publications.where(F.col("link") != "").select(
        "query_id", *at("publications", F.col("rank")), F.lit(0).alias("pos"), F.col("link").alias("url")
    )
    of_answers = answers.select("query_id", F.inline(numbered(F.col("urls"), *at("answer", F.lit(0)))))
    found = of_datasets.unionByName(of_papers).unionByName(of_answers)
    return first_occurrences(found, "query_id", ["source", "rank", "pos"])


def dataset_urls(datasets: DataFrame, contexts: DataFrame) -> DataFrame:
    """Links ``(query_id, rank, pos, url)`` of the datasets hit."""
    with_links = contexts.where(F.size("urls") > 0).select(F.col("dataset").alias("key"), "urls")
    return (
        datasets.select("query_id", "rank", "key")
        .join(with_links, "key")
        .select("query_id", "rank", F.posexplode("urls").alias("pos", "url"))
    )


def gathered_dataset_urls(datasets: DataFrame, contexts: DataFrame) -> DataFrame:
    """Distinct dataset links ``(query_id, urls)`` per question, by rank and position."""
    return gathered(first_occurrences(dataset_urls(datasets, contexts), "query_id", ["rank", "pos"]), "query_id")
