"""Quality rules on a text's repetition of itself, from suffix arrays of its words.

The suffixes of all texts of a chunk are sorted together by doubling the compared length; as the first comparison
holds the text's number, suffixes of different texts never agree. Neighbours in that order give the longest common
prefixes. The deepest interval that a suffix lies in has as its length the longer of its two common prefixes: the
longest substring at this place that the text has elsewhere too. A span is maximal if it is not the span of the
place before it without its first word. The union of the maximal spans is the repeated part of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm.words import VISIBLE, chunks, documents, per_text, word_hashes

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
#: Words of the windows that the base rule counts.
WINDOW = 3


@dataclass(frozen=True)
class RepetitionRules:
    """A text fails if a rule is broken. Repeats shorter than ``least_words`` words don't count."""

    min_words: int = 50
    max_window_percent: int = 50
    least_words: int = 8
    max_covered: float = 0.4
    max_longest: float = 0.3


def suffix_order(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in suffix order, and the common prefix (in words) of each with the one before it in that order.

    ``words`` are hashes, ``text`` the number of the text of each; suffixes end with their text.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = np.append(text[1:] != text[:-1], True)
    end = np.flatnonzero(last)[np.searchsorted(np.flatnonzero(last), np.arange(n))] + 1
    order = np.lexsort((words, text))
    new = np.append(True, (words[order][1:] != words[order][:-1]) | (text[order][1:] != text[order][:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, length = [rank], 1
    while True:
        # Only suffixes that agree with another so far are compared further.
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            break
        places = order[tied]
        ahead = places + length
        second = np.where(ahead < end[places], rank[np.minimum(ahead, n - 1)], -1)
        inner = np.lexsort((second, rank[places]))
        order[tied] = places[inner]
        key, group = second[inner], rank[places][inner]
        new = new.copy()
        new[tied] = np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1]))
        rank = rank.copy()
        rank[order[tied]] = np.maximum.accumulate(np.where(new[tied], tied, 0))
        levels.append(rank)
        length *= 2
    # The common prefix of neighbours, from the longest compared length down.
    left, right = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        step = 1 << level
        inside = (left < n) & (right < n)
        same = inside & (levels[level][np.minimum(left, n - 1)] == levels[level][np.minimum(right, n - 1)])
        # Equal ranks at a text's end mean equal short suffixes, which different places cannot be.
        common += same * step
        left += same * step
        right += same * step
    return order, np.append(0, common)


def longest_repeats(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each place the words of the longest run from there on that the text has elsewhere too."""
    order, common = suffix_order(words, text)
    out = np.zeros(len(words), np.int64)
    out[order] = np.maximum(common, np.append(common[1:], 0))
    return out


def maximal_spans(repeats: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the maximal repeated spans of at least ``least`` words."""
    inner = np.append(False, (repeats[1:] + 1 == repeats[:-1]) & (text[1:] == text[:-1]))
    starts = np.flatnonzero((repeats >= least) & ~inner)
    return starts, repeats[starts]


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Marks of the places that a span covers."""
    edges = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(edges)[:n] > 0


def _repeated_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    return len(lines) - len(set(lines))


def measured(texts: pa.Array, rules: RepetitionRules, spans: bool) -> dict[str, np.ndarray | list]:
    words, firsts = word_hashes(texts, VISIBLE, lower=False)
    counts = np.diff(firsts)
    text = np.repeat(np.arange(len(counts)), counts)
    repeats = longest_repeats(words, text)
    in_windows = _covered(at := np.flatnonzero(repeats >= WINDOW), np.full(len(at), WINDOW), len(words))
    starts, lengths = maximal_spans(repeats, text, rules.least_words)
    covered = per_text(_covered(starts, lengths, len(words)).astype(np.int64), firsts)
    longest = per_text(np.where(repeats >= rules.least_words, repeats, 0), firsts, np.maximum)
    plain = texts.to_pylist()
    out = {
        "n_words": counts,
        "word_chars": np.array([len(t) - sum(map(t.count, _SPACES)) for t in plain], np.int64),
        "n_symbols": np.array([sum(map(t.count, _SYMBOLS)) for t in plain], np.int64),
        "n_dup_lines": np.array([_repeated_lines(t) if "\n" in t else 0 for t in plain], np.int64),
        "n_repeat_words": per_text(in_windows.astype(np.int64), firsts),
        "covered_words": covered,
        "longest_repeat": longest,
    }
    out["base_failed"] = (counts < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_window_percent * counts)
    broken = (covered > rules.max_covered * counts) | (longest > rules.max_longest * counts)
    out["kept"] = ~out["base_failed"] & ~broken
    if spans:
        of = text[starts]
        local = np.stack([starts - firsts[of], starts - firsts[of] + lengths], axis=1).tolist()
        bounds = np.searchsorted(of, np.arange(len(counts) + 1)).tolist()
        out["repeats"] = [local[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


_FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, "
    "longest_repeat long, base_failed boolean, kept boolean"
)


def repetition(
    docs: DataFrame, rules: RepetitionRules = RepetitionRules(), spans: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the measures, ``base_failed`` and ``kept``.

    With ``spans`` also ``repeats``, the maximal repeated spans as [first word, word after the last]. A null text is
    an empty one: no words, so it fails. Repeated rows are judged one by one; other columns are left out.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in chunks(batch.column("text")):
                values = measured(texts, rules, spans)
                ids = batch.column("doc_id").slice(begin, len(texts))
                kinds = {"repeats": pa.list_(pa.list_(pa.int64()))}
                columns = [ids, *(pa.array(v, kinds.get(k)) for k, v in values.items())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *values])

    more = ", repeats array<array<long>>" if spans else ""
    return documents(docs, id_col, text_col).mapInArrow(judge, f"doc_id long, {_FIELDS}{more}")


def without_repetition(docs: DataFrame, rules: RepetitionRules = RepetitionRules(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that keep the rules, all columns as they are. No row is moved."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).fill_null("")
            kept = [pa.array(measured(part, rules, False)["kept"]) for _, part in chunks(texts)]
            yield batch.filter(pa.concat_arrays(kept)) if kept else batch

    return docs.mapInArrow(keep, docs.schema)
