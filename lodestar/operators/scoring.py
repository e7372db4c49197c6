"""Scores of few questions in blocks of coded texts: pairs are added up where the texts are, and only a block's best leave it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lodestar.operators.coded import Block, distinct
from lodestar.operators.corpus import PUBLICATION_OFFSET
from lodestar.operators.index import Weigher
from lodestar.settings import SCORE_DIGITS, RankSettings

# Pairs of an entry and a question whose scores are held at once.
HELD_PAIRS = 200_000


@dataclass(frozen=True)
class Asked:
    """Features of one kind, and for each the questions that ask for it, from ``start`` on."""

    features: pa.Array
    start: np.ndarray
    count: np.ndarray
    question: np.ndarray
    value: np.ndarray
    words: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, question: np.ndarray, kind: int) -> Asked:
        mine = pc.equal(table.column("kind"), kind).to_numpy().astype(bool)
        coded = table.column("feature").combine_chunks().filter(pa.array(mine)).dictionary_encode()
        feature = coded.indices.to_numpy()
        order = np.argsort(feature, kind="stable")
        count = np.bincount(feature, minlength=len(coded.dictionary))
        value, words = (table.column(name).to_numpy()[mine][order] for name in ("asked", "words"))
        return cls(coded.dictionary, np.cumsum(count) - count, count, question[mine][order], value, words)

    def met(self, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every feature found each question that asks for it: the places of the finding and of the question."""
        count = self.count[feature]
        found = np.repeat(np.arange(len(feature)), count)
        return found, np.arange(len(found)) + np.repeat(self.start[feature] - (np.cumsum(count) - count), count)


@dataclass(frozen=True)
class Scorer:
    """Scores of the texts of a block for all questions."""

    ids: pa.Array
    words: Asked
    terms: Asked
    numbers: Asked
    lengths: Sequence[int]
    weigher: Weigher | None
    settings: RankSettings

    @classmethod
    def of(cls, table: pa.Table, kinds: Sequence[int], lengths: Sequence[int], weigher: Weigher | None, settings: RankSettings) -> Scorer:
        coded = table.column("query_id").combine_chunks().dictionary_encode("encode")
        question = coded.indices.to_numpy().astype(np.int64)
        return cls(coded.dictionary, *[Asked.of(table, question, kind) for kind in kinds], lengths, weigher, settings)

    def _found(self, block: Block) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Words, terms and numbers asked for, as rows in rising order, features and weights."""
        row, code = block.words_of_rows()
        word = pc.fill_null(pc.index_in(block.words, value_set=self.words.features), -1).to_numpy()[code]
        found = [(row[word >= 0], word[word >= 0], np.zeros(0))]
        row, term, weight = self.weigher.weights(block) if self.weigher and len(self.weigher.terms) else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        if len(term):
            feature = pc.fill_null(pc.index_in(self.weigher.terms, value_set=self.terms.features), -1).to_numpy()[term]
            row, term, weight = row[feature >= 0], feature[feature >= 0], weight[feature >= 0]
        return [*found, (row, term, weight), (*self._numbers(block), np.zeros(0))]

    def _numbers(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """A number is in a text if it is a substring of one of its runs of digits."""
        place = {number: i for i, number in enumerate(self.numbers.features.to_pylist())}
        coded, n = block.runs.dictionary_encode(), max(len(place), 1)
        held = []
        for run in coded.dictionary.to_pylist() if place else []:
            parts = {run[at : at + size] for size in self.lengths for at in range(len(run) - size + 1)}
            held.append(sorted(place[part] for part in parts if part in place))
        if not any(held):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes, run = np.array([len(h) for h in held]), coded.indices.to_numpy()
        at = np.repeat(np.cumsum(sizes)[run] - sizes[run], sizes[run])
        count = sizes[run]
        within = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        number = np.concatenate([np.array(h, np.int64) for h in held])[at + within]
        both, _ = distinct(np.repeat(block.run_row.astype(np.int64), count) * n + number)
        return both // n, both % n

    def best(self, block: Block) -> Iterator[pa.RecordBatch]:
        """Pairs ``(query_id, ord, sim, overlap, boost, score)`` that can be among a question's best of either type."""
        n, s = len(self.ids), self.settings
        if not n:
            return
        found, step = self._found(block), max(1, HELD_PAIRS // n)
        valid = pc.is_valid(block.keys).to_numpy(zero_copy_only=False).astype(bool)
        ords = pc.fill_null(block.keys, 0).to_numpy().astype(np.int64)
        kept = []
        for begin in range(0, len(ords), step):
            end = min(begin + step, len(ords))
            sim, shared, boost, words = self._scores(found, begin, end)
            # The question's count of words where a word is shared; elsewhere the overlap is 0 anyway.
            overlap = shared / (words + 1)
            boost = boost * s.number_boost
            score = s.similarity_weight * sim + s.overlap_weight * overlap + boost
            rank = np.round(score, SCORE_DIGITS)
            open_pairs = (score >= s.threshold) & ((sim != 0) | (shared > 0) | (boost != 0)) & valid[begin:end, None]
            for papers, limit in ((False, s.top_datasets), (True, s.top_publications)):
                of_type = np.flatnonzero((ords[begin:end] >= PUBLICATION_OFFSET) == papers)
                if limit and len(of_type):
                    mine = np.where(open_pairs[of_type], rank[of_type], -np.inf)
                    bar = np.partition(mine, len(mine) - limit, axis=0)[len(mine) - limit] if limit < len(mine) else np.full(n, -np.inf)
                    at, q = np.nonzero((mine >= bar) & (mine > -np.inf))
                    of = of_type[at]
                    kept.append((np.full(len(q), papers), q, rank[of, q], of + begin, sim[of, q], overlap[of, q], boost[of, q], score[of, q]))
        if not kept:
            return
        papers, q, rank, row, *parts = map(np.concatenate, zip(*kept))
        order = np.lexsort((ords[row], -rank, q, papers))
        group = (papers * n + q)[order]
        first = np.flatnonzero(np.diff(group, prepend=-1))
        place = np.arange(len(group)) - np.repeat(first, np.diff(first, append=len(group)))
        best = order[place < np.where(papers[order], s.top_publications, s.top_datasets)]
        keys = block.keys.take(pa.array(row[best]))
        yield pa.RecordBatch.from_arrays(
            [self.ids.take(pa.array(q[best])), keys, *[pa.array(part[best]) for part in parts]], ["query_id", "ord", "sim", "overlap", "boost", "score"]
        )

    def _scores(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], begin: int, end: int) -> list[np.ndarray]:
        """Similarity, shared words, numbers found and words of the question, by row from ``begin`` to ``end`` and question."""
        n, sums, shape = len(self.ids), [], (end - begin, len(self.ids))
        # Rows of one question may differ in their words; the most of those met counts.
        words = np.zeros(shape) if self.most is None else self.most
        for asked, (row, feature, weight) in zip((self.words, self.terms, self.numbers), found):
            part = slice(*np.searchsorted(row, [begin, end]))
            of, question = asked.met(feature[part])
            cell = (row[part][of] - begin) * n + asked.question[question]
            by = weight[part][of] * asked.value[question] if asked is self.terms else None
            sums.append(np.bincount(cell, by, minlength=shape[0] * n).reshape(shape).astype(np.float64))
            if asked is self.words and self.most is None:
                np.maximum.at(words.reshape(-1), cell, asked.words[question])
        shared, sim, numbers = sums
        return [sim, shared, numbers, words]

    @cached_property
    def most(self) -> np.ndarray | None:
        """The words of each question, if all its rows have as many."""
        most = np.zeros(len(self.ids))
        most[self.words.question] = self.words.words
        return most if (most[self.words.question] == self.words.words).all() else None
