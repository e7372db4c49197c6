"""Substring dedup by sliding spans of sentences.

A sentence ends with ``.``, ``!`` or ``?`` before white space, or with its line. From every sentence the shortest run of
consecutive sentences that is long enough is hashed, and also the shortest one up to every sentence, so that a
passage is covered to both its ends by runs within it. All runs are joined over the whole table by hash; the first
one, by document and place, stays, and every sentence of any other one goes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.words import VISIBLE, chunks, documents, free_name, hashes_at, mixed, runs_hash, word_places


@dataclass(frozen=True)
class SentenceSpans:
    """A run has at least ``sentences`` and ``words``; one sentence of ``alone`` words is a run by itself."""

    sentences: int = 2
    words: int = 20
    alone: int = 40


_SPACE = ~VISIBLE
_END = np.isin(np.arange(256), list(b".!?"))


def sentences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all sentences in order: hash, number of words, text, and first byte within the text."""
    data, start, stop, bounds, firsts = word_places(texts, VISIBLE)
    if not len(start):
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    cut = data == 0x0A
    cut[1:] |= _SPACE[data[1:]] & _END[data[:-1]]
    text = np.repeat(np.arange(len(texts)), np.diff(firsts))
    passed = np.cumsum(cut)[start]
    new = np.append(True, (passed[1:] != passed[:-1]) | (text[1:] != text[:-1]))
    first = np.flatnonzero(new)
    number = np.diff(np.append(first, len(start)))
    (words,) = hashes_at(data, start, stop)
    place = np.arange(len(start)) - np.repeat(first, number)
    hashes = mixed(np.add.reduceat(mixed(words + mixed(place.astype(np.uint64))), first))
    return hashes, number, text[first], start[first] - bounds[text[first]]


def runs(number: np.ndarray, text: np.ndarray, how: SentenceSpans) -> tuple[np.ndarray, np.ndarray]:
    """First and last sentence of every run, each once."""
    n = len(number)
    at = np.arange(n)
    total = np.concatenate([[0], np.cumsum(number)])
    edges = np.append(np.flatnonzero(np.append(True, text[1:] != text[:-1])), n) if n else np.zeros(1, np.int64)
    group = np.searchsorted(edges, at, side="right") - 1
    low, high = edges[group], edges[np.minimum(group + 1, len(edges) - 1)] - 1
    last = np.maximum(np.searchsorted(total, total[at] + how.words) - 1, at + how.sentences - 1)
    first = np.minimum(np.searchsorted(total, total[at + 1] - how.words, side="right") - 1, at - how.sentences + 1)
    forward, backward, single = last <= high, first >= low, number >= how.alone
    pairs = np.concatenate([np.stack([at, last], 1)[forward], np.stack([first, at], 1)[backward], np.stack([at, at], 1)[single]])
    pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
    return pairs[:, 0], pairs[:, 1]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents(docs, id_col, text_col).withColumn("text_hash", F.hash("text"))


def hashed_runs(docs: DataFrame, how: SentenceSpans, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``run, doc_id, text_hash, first, last``: every run of sentences of every text."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in chunks(batch.column("text")):
                hashes, number, text, _ = sentences(texts)
                first, last = runs(number, text, how)
                run = runs_hash(hashes, first, last).view(np.int64)
                row = text[first]
                base = np.searchsorted(text, row)
                at = pa.array(begin + row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(run), batch.column("doc_id").take(at), batch.column("text_hash").take(at), pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32))],
                    ["run", "doc_id", "text_hash", "first", "last"],
                )

    return _rows(docs, id_col, text_col).mapInArrow(hashed, "run long, doc_id long, text_hash int, first int, last int")


def repeated_runs(docs: DataFrame, how: SentenceSpans = SentenceSpans(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, first, last, first_doc_id`` of every run that stands earlier too."""
    found = hashed_runs(docs, how, id_col, text_col)
    earliest = found.groupBy("run").agg(F.min(F.struct("doc_id", "text_hash", "first")).alias("earliest"), F.count("*").alias("places")).where("places > 1")
    here = F.struct("doc_id", "text_hash", "first")
    return (
        found.join(earliest.select("run", "earliest"), "run")
        .where(~here.eqNullSafe(F.col("earliest")))
        .select("doc_id", "text_hash", "first", "last", F.col("earliest.doc_id").alias("first_doc_id"))
    )


def without_repeats(docs: DataFrame, how: SentenceSpans = SentenceSpans(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with the cleaned text in place of the text, and a struct of what went.

    The struct, whose name is of no column of ``docs`` and comes last, has ``n_sentences``, ``n_removed``, ``spans``
    (first and last sentence) and ``first_doc_ids``. A text without a repeat stays as it is, byte for byte; null stays null.
    Rows with the same id and text stand at one place, so none is a repeat of the other.
    """
    gone = (
        repeated_runs(docs, how, id_col, text_col)
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set(F.struct("first", "last")).alias("spans"), F.collect_set("first_doc_id").alias("first_doc_ids"))
    )
    extra = free_name(docs, "repeats")
    text = F.col(f"`{text_col}`")
    same = docs[f"`{id_col}`"].cast("long").eqNullSafe(gone["doc_id"]) & (F.hash(F.coalesce(text, F.lit(""))) == gone["text_hash"])
    names = docs.columns
    joined = docs.join(gone.withColumnsRenamed({"spans": f"{extra}_spans", "first_doc_ids": f"{extra}_ids"}), same, "left").select(
        *[docs[f"`{c}`"] for c in names], f"{extra}_spans", f"{extra}_ids"
    )
    at = names.index(text_col)
    kind = pa.struct(
        [("n_sentences", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), ("first_doc_ids", pa.list_(pa.int64()))]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, told = [], []
            for begin, texts in chunks(batch.column(at).fill_null("")):
                _, _, text, start = sentences(texts)
                bounds = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
                spans = batch.column(len(names)).slice(begin, len(texts)).to_pylist()
                ids = batch.column(len(names) + 1).slice(begin, len(texts)).to_pylist()
                raw = texts.cast(pa.large_binary())
                for row, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    marks = np.zeros(b - a + 1, np.int64)
                    for span in spans[row] or ():
                        marks[span["first"]] += 1
                        marks[span["last"] + 1] -= 1
                    removed = np.cumsum(marks)[:-1] > 0
                    kept.append(None)
                    if removed.any():
                        data = raw[row].as_py()
                        edges = [*start[a:b].tolist(), len(data)]
                        parts = [data[: edges[0]], *(data[edges[i] : edges[i + 1]] for i in np.flatnonzero(~removed).tolist())]
                        kept[-1] = b"".join(parts).decode().rstrip(" \t\n\x0b\x0c\r")
                    found = sorted(((s["first"], s["last"]) for s in spans[row] or ()))
                    told.append({"n_sentences": b - a, "n_removed": int(removed.sum()), "spans": [{"first": x, "last": y} for x, y in found], "first_doc_ids": sorted(x for x in ids[row] or () if x is not None)})
            new = pa.array(kept, pa.string())
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pc.coalesce(new, columns[at].cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(told, kind)], [*names, extra])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(cut, f"{schema}, `{extra}` struct<n_sentences:bigint,n_removed:bigint,spans:array<struct<first:int,last:int>>,first_doc_ids:array<bigint>>")


def cleaned(docs: DataFrame, how: SentenceSpans = SentenceSpans(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without repeated sentences; rows that lose all their text go."""
    out = without_repeats(docs, how, id_col, text_col)
    extra = out.columns[-1]
    return out.where((F.col(f"`{extra}`.n_removed") == 0) | (F.trim(F.col(f"`{text_col}`")) != "")).drop(extra)
