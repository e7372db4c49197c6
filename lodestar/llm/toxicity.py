"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, their heads (so that words of one stem are known from each other), pairs of
neighbours, and pairs with one word between them, of digits, letters and characters beyond ASCII, lower-cased. Each coordinate has its own rate; L1 leaves few weights that are not zero,
so the model is sent to all tasks whole: at most ``2 ** bits`` numbers, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.training import held_out, labelled_sample, rows_of
from lodestar.llm.words import ALNUM, chunks, documents, mixed, word_hashes


#: Bytes of the heads of words that are features, of longer words only.
HEADS = (5, 6, 7, 8)


@dataclass(frozen=True)
class Ftrl:
    """``max_rows`` bounds the labelled rows that the model is fitted on."""

    bits: int = 22
    max_rows: int = 16_384
    passes: int = 2
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 1.5
    l2: float = 1.0


def features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts, repeats included, and the text of each."""
    words, firsts, *heads = word_hashes(texts, ALNUM, heads=HEADS)
    text = np.repeat(np.arange(len(texts)), np.diff(firsts))
    parts, owners = [mixed(words)], [text]
    for head in heads:
        parts.append(head[head != 0])
        owners.append(text[head != 0])
    for step, salt in ((1, np.uint64(0x5851F42D4C957F2D)), (2, np.uint64(0x14057B7EF767814F))):
        same = text[:-step] == text[step:]
        parts.append(mixed(words[:-step] * salt + words[step:])[same])
        owners.append(text[:-step][same])
    return (np.concatenate(parts) & np.uint64((1 << bits) - 1)).astype(np.int64), np.concatenate(owners)


def fit(texts: list[str], labels: list[int], how: Ftrl) -> np.ndarray:
    """Weights of all features and, last, of the intercept, which has no L1."""
    size = (1 << how.bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    l1 = np.full(size, how.l1)
    l1[-1] = 0.0
    rows = []
    for _, part in chunks(pa.array(texts, pa.large_string())):
        index, owner = features(part, how.bits)
        for pair in np.split(index[order := np.argsort(owner, kind="stable")], np.searchsorted(owner[order], np.arange(1, len(part)))):
            rows.append(np.append(np.unique(pair), size - 1))

    def weights(at: np.ndarray) -> np.ndarray:
        small = np.abs(z[at]) <= l1[at]
        return np.where(small, 0.0, (np.sign(z[at]) * l1[at] - z[at]) / ((how.beta + np.sqrt(n[at])) / how.alpha + how.l2))

    for _ in range(how.passes):
        for at, label in zip(rows, labels, strict=True):
            w = weights(at)
            gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            squares = n[at]
            z[at] += gradient - (np.sqrt(squares + gradient**2) - np.sqrt(squares)) / how.alpha * w
            n[at] += gradient**2
    return weights(np.arange(size))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", how: Ftrl = Ftrl(), id_col: str = "doc_id", text_col: str = "text") -> dict[int, float]:
    """The weights that are not zero; feature ``2 ** bits`` is the intercept. Without labelled rows, none."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, known = rows_of(batches)
        if texts:
            w = fit(texts, known, how)
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], ["feature", "weight"])

    sample = labelled_sample(docs, labels, label_col, how.max_rows, id_col, text_col)
    return dict(map(tuple, sample.mapInArrow(learn, "feature long, weight double").collect()))


def score(docs: DataFrame, weights: dict[int, float], bits: int = Ftrl.bits, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row; a null or empty text has the score of the intercept alone."""
    sent = docs.sparkSession.sparkContext.broadcast((np.array(list(weights), np.int64), np.array(list(weights.values()))))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values = sent.value
        w = np.zeros((1 << bits) + 1, np.float32)
        w[at] = values
        counts = w != 0
        for batch in batches:
            for begin, texts in chunks(batch.column("text")):
                index, owner = features(texts, bits)
                hit = counts[index]
                pair = np.unique(owner[hit] << (bits + 1) | index[hit])
                total = np.bincount(pair >> (bits + 1), w[pair & ((2 << bits) - 1)], len(texts)) + float(w[-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(begin, len(texts)), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))],
                    ["doc_id", "score"],
                )

    return documents(docs, id_col, text_col).mapInArrow(scored, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, how: Ftrl = Ftrl(), threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; repeated rows are scored one by one."""
    scores = score(docs, train(docs, labels, how=how), how.bits)
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
