"""Quality by a factorisation machine over hashed words, structure statistics and metadata of the text.

The score of a text is linear in its features plus all pairwise interactions through low-rank factors. With
``s = sum(v * x)`` the interactions are ``(s * s - sum(v * v * x * x)) / 2`` by factor, so a text is scored in one
pass over its features. The model has a fixed size, whatever the input, and is sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.training import held_out, labelled_sample, rows_of
from lodestar.llm.words import VISIBLE, _offsets, chunks, documents, per_text, word_hashes


@dataclass(frozen=True)
class Machine:
    """``max_rows`` bounds the labelled rows that the model is fitted on."""

    bits: int = 14
    factors: int = 8
    max_rows: int = 8_192
    # Passes go on until the log loss over the sample falls by less than ``tolerance`` of itself in a pass, or
    # ``steps`` batches have been taken in all: the cost of a fit is bounded whatever the size of the sample.
    steps: int = 2_000
    tolerance: float = 1e-3
    batch: int = 64
    rate: float = 0.1
    l2: float = 1e-5
    seed: int = 9


def _class(text: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(text.encode())] = True
    return table


_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _class("abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 0x80)
_CLASSES = (_UPPER, _LETTER, _class("0123456789"), _class("#*$%&|<>=_{}[]\\^~@"), _class(".,;:"), _class("!?"), _class("\n"), _class(" "))
#: Statistics of structure, then of metadata (sizes).
STATISTICS = len(_CLASSES) + 7


def statistics(texts: pa.Array, words: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """A row for each text, every value between 0 and about 3."""
    binary = texts.cast(pa.large_binary())
    bounds = _offsets(binary)
    data = np.frombuffer(binary.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    size = np.maximum(np.diff(bounds), 1)
    counts = np.maximum(np.diff(firsts), 1)
    shares = [per_text(kind[data].astype(np.int64), bounds) / size for kind in _CLASSES]
    owner = np.repeat(np.arange(len(texts)), np.diff(firsts))
    order = np.lexsort((words, owner))
    new = np.append(True, (words[order][1:] != words[order][:-1]) | (owner[order][1:] != owner[order][:-1]))[: len(words)]
    distinct = np.bincount(owner[order][new], minlength=len(texts))
    runs = np.diff(np.append(np.flatnonzero(new), len(words)))
    largest = np.zeros(len(texts))
    np.maximum.at(largest, owner[order][new], runs)
    same = np.append(False, (words[1:] == words[:-1]) & (owner[1:] == owner[:-1]))[: len(words)]
    return np.stack(
        [
            *shares,
            np.minimum(size / counts / 10, 3),
            distinct / counts,
            distinct / np.sqrt(counts) / 20,
            largest / counts,
            per_text(same.astype(np.int64), firsts) / counts,
            np.log1p(counts) / 5,
            np.log1p(size) / 5,
        ],
        axis=1,
    )


def features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, feature and value, in order of the texts: statistics first, then words of unit length together."""
    words, firsts = word_hashes(texts, VISIBLE)
    n = len(texts)
    owner = np.repeat(np.arange(n), np.diff(firsts))
    pair, count = np.unique(owner << bits | (words & np.uint64((1 << bits) - 1)).astype(np.int64), return_counts=True)
    of = pair >> bits
    norm = np.sqrt(np.bincount(of, count.astype(float) ** 2, n))
    rows = np.concatenate([np.repeat(np.arange(n), STATISTICS), of])
    index = np.concatenate([np.tile(np.arange(STATISTICS) + (1 << bits), n), pair & ((1 << bits) - 1)])
    values = np.concatenate([statistics(texts, words, firsts).ravel(), count / norm[of]])
    order = np.argsort(rows, kind="stable")
    return rows[order], index[order], values[order]


def raw_scores(rows: np.ndarray, index: np.ndarray, values: np.ndarray, n: int, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores before the logistic function, and the sums over factors; every text has features."""
    firsts = np.searchsorted(rows, np.arange(n))
    products = v[index] * values[:, None]
    sums = np.add.reduceat(products, firsts, axis=0)
    squares = np.add.reduceat(products**2, firsts, axis=0)
    linear = np.add.reduceat(w[index] * values, firsts)
    return w[-1] + linear + 0.5 * (sums**2 - squares).sum(axis=1), sums


def fit(texts: list[str], labels: list[int], how: Machine) -> tuple[np.ndarray, np.ndarray]:
    """Weights (the intercept last) and factors, by AdaGrad over batches."""
    size = (1 << how.bits) + STATISTICS
    random = np.random.default_rng(how.seed)
    w, v = np.zeros(size + 1), random.normal(0, 0.05, (size, how.factors))
    seen_w, seen_v = np.full(size + 1, 1e-2), np.full((size, how.factors), 1e-2)
    target = np.array(labels, float)
    w[-1] = np.log((target.sum() + 1) / (len(target) - target.sum() + 1))
    parts = [features(part, how.bits) for _, part in chunks(pa.array(texts, pa.large_string()))]
    by_text = []
    for rows, index, values in parts:
        cuts = np.flatnonzero(np.diff(rows)) + 1
        by_text += zip(np.split(index, cuts), np.split(values, cuts), strict=True)
    every = np.arange(len(target))

    def loss() -> float:
        index, values = (np.concatenate([by_text[i][k] for i in every]) for k in (0, 1))
        rows = np.repeat(every, [len(by_text[i][0]) for i in every])
        raw, _ = raw_scores(rows, index, values, len(every), w, v)
        return float(np.mean(np.logaddexp(0, raw) - target * raw))

    last = loss() if len(target) else 0.0
    per_pass = max(1, len(target) // how.batch)
    for _ in range(-(-how.steps // per_pass) if len(target) else 0):
        for at in np.array_split(random.permutation(len(target)), max(1, len(target) // how.batch)):
            index, values = (np.concatenate([by_text[i][k] for i in at]) for k in (0, 1))
            rows = np.repeat(np.arange(len(at)), [len(by_text[i][0]) for i in at])
            raw, sums = raw_scores(rows, index, values, len(at), w, v)
            error = (1 / (1 + np.exp(-np.clip(raw, -35, 35))) - target[at]) / len(at)
            step = error[rows] * values
            used, place = np.unique(index, return_inverse=True)
            slope_w = np.bincount(place, step) + how.l2 * w[used]
            terms = step[:, None] * (sums[rows] - v[index] * values[:, None])
            slope_v = np.stack([np.bincount(place, terms[:, f]) for f in range(how.factors)], axis=1) + how.l2 * v[used]
            seen_w[used] += slope_w**2
            seen_v[used] += slope_v**2
            w[used] -= how.rate * slope_w / np.sqrt(seen_w[used])
            v[used] -= how.rate * slope_v / np.sqrt(seen_v[used])
            seen_w[-1] += error.sum() ** 2
            w[-1] -= how.rate * error.sum() / np.sqrt(seen_w[-1])
        now = loss()
        if last - now < how.tolerance * last:
            break
        last = now
    return w, v


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", how: Machine = Machine(), id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Weights and factors; without labelled rows all zero, which scores every text 0.5."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, known = rows_of(batches)
        if texts:
            w, v = fit(texts, known, how)
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()]), pa.array([v.tobytes()])], ["w", "v"])

    sample = labelled_sample(docs, labels, label_col, how.max_rows, id_col, text_col)
    model = sample.mapInArrow(learn, "w binary, v binary").collect()
    size = (1 << how.bits) + STATISTICS
    if not model:
        return np.zeros(size + 1), np.zeros((size, how.factors))
    return np.frombuffer(model[0].w), np.frombuffer(model[0].v).reshape(size, how.factors)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int = Machine.bits, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row; a null text is an empty one, whose statistics are all 0."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, v = sent.value
        for batch in batches:
            for begin, texts in chunks(batch.column("text")):
                raw, _ = raw_scores(*features(texts, bits), len(texts), w, v)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(begin, len(texts)), pa.array(1 / (1 + np.exp(-np.clip(raw, -35, 35))))],
                    ["doc_id", "score"],
                )

    return documents(docs, id_col, text_col).mapInArrow(scored, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, how: Machine = Machine(), threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; repeated rows are scored one by one."""
    scores = score(docs, train(docs, labels, how=how), how.bits)
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
