"""Labelled rows for the classifiers, and the fold that stays out of training."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.words import documents

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Whether labels of the document are kept from training: crc32 of the id as text, modulo the folds, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, rows: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """At most ``rows`` rows ``text, label`` of the training folds, in one partition and in an order by hash.

    The bound is the only limit on what a model is fitted on; it is the same at every size of the input. Rows
    without an id or a label, or whose document is missing, are not used.
    """
    known = labels.select(
        F.col("`doc_id`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")
    ).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit(7))
    first = known.orderBy(order, "doc_id", "label").limit(rows)
    # At most `rows` pairs of numbers are sent.
    found = documents(docs, id_col, text_col).join(F.broadcast(first), "doc_id")
    return found.orderBy(order, "doc_id", "label", F.xxhash64("text")).limit(rows).select("text", "label")


def rows_of(batches: Iterable[pa.RecordBatch]) -> tuple[list[str], list[int]]:
    """Texts and labels of all rows of a sample."""
    texts: list[str] = []
    labels: list[int] = []
    for batch in batches:
        texts += batch.column("text").to_pylist()
        labels += batch.column("label").to_pylist()
    return texts, labels
