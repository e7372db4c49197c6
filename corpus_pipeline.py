"""Prepares documents for training: rules, near-duplicates, repeated passages, personal data, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns rows that are written and read again as the next one's
``docs``. All but the last return the columns of ``documents``; the last returns the places of token pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.near_dedup import first_of_groups
from lodestar.llm.packing import pack_documents
from lodestar.llm.pii import masked
from lodestar.llm.queries import vocabulary
from lodestar.llm.repetition import without_repetition
from lodestar.llm.spans import cleaned
from lodestar.session import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _with_size(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep the repetition rules; a null or empty text doesn't."""
    return without_repetition(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group that five-word shingles link at a similarity of 0.8 or more."""
    return first_of_groups(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that another one has first; documents that are nothing else go."""
    return _with_size(cleaned(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked."""
    return _with_size(masked(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences of 2048 tokens."""
    return pack_documents(docs, vocabulary("byte_bpe_50k.tiktoken"), added_path=vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("personal data", personal_data),
    ("packing", packing),
]

#: SQL has no suffix arrays, MinHash or tokenizer; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
