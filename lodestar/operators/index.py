"""TF-IDF index over the search entries, as tables.

The text is shuffled once, by entry, and taken apart once, into written blocks of coded words: the vocabulary,
the weights and the words of entries are made of them. Tasks have a bounded amount of text, so their
number grows with the input and their memory does not.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lodestar.functions.text import digit_runs, kept_tokens, with_bigrams
from lodestar.operators.coded import Block, blocks_of, distinct, read_blocks
from lodestar.session import written
from lodestar.settings import IndexSettings

FEATURE_BUCKETS = 64
# Bytes of text that a task takes apart.
TASK_BYTES = 8 << 20
# Tokens that are counted and weighed together in a task, of 4 bytes of text each.
CHUNK_TOKENS = 2_000_000
# What of a block says which words its texts hold.
BLOCK_WORDS = ("keys", "sizes", "words", "codes", "runs", "run_rows")
# Terms that are sent to every task that weighs; a larger vocabulary is joined.
SENT_TERMS = 100_000


@dataclass(frozen=True)
class SearchIndex:
    """Tables of an index.

    entries: ``(ord, key, entry_type)``. vocabulary: ``(term, df, total, idf)``. terms:
    ``(ord, term, weight)``. words: ``(ord, word)``, each word of an entry once. runs:
    ``(ord, runs)``, the digit runs of each entry. blocks: the texts as blocks of coded words, if the
    index was built in this session.
    """

    entries: DataFrame
    vocabulary: DataFrame
    terms: DataFrame
    words: DataFrame
    runs: DataFrame
    settings: IndexSettings
    blocks: DataFrame | None = None


def by_entry(corpus: DataFrame) -> DataFrame:
    """Entries spread by ``ord`` over tasks of ``TASK_BYTES`` of text, or more and smaller ones.

    The number is given, so that adaptive execution does not merge partitions that are small in
    bytes: taking a text apart costs far more than reading it.
    """
    return corpus.repartition(_tasks(corpus, "text"), "ord")


def _tasks(texts: DataFrame, column: str) -> int:
    return _least_tasks(texts.sparkSession, texts.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0)


def _least_tasks(spark: SparkSession, size: int) -> int:
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(least, -(-size // TASK_BYTES))


# Each array is a column of its own step: an array that a later expression uses twice is then
# computed once.


def _tokens(texts: DataFrame, key: str, settings: IndexSettings) -> DataFrame:
    return texts.select(key, kept_tokens(F.col("text"), settings.stop_words).alias("tokens"))


def terms(texts: DataFrame, key: str, settings: IndexSettings) -> DataFrame:
    """Every term occurrence ``(key, term)``: kept words and pairs of neighbours."""
    return _tokens(texts, key, settings).select(key, F.explode(with_bigrams(F.col("tokens"))).alias("term"))


def term_frequencies(texts: DataFrame, key: str, settings: IndexSettings) -> DataFrame:
    return terms(texts, key, settings).groupBy(key, "term").agg(F.count("*").alias("tf"))


def entry_blocks(corpus: DataFrame, settings: IndexSettings) -> DataFrame:
    """The entries' texts taken apart, as blocks of coded words; written."""
    return written(blocks_of(by_entry(corpus), "ord", settings.stop_words, 4 * CHUNK_TOKENS), "blocks")


def word_counts(blocks: DataFrame) -> DataFrame:
    """``(term, df, total)`` of all kept words, added up in each block before the shuffle."""
    parts = blocks.select(F.inline(F.arrays_zip("words", "occurs", "found"))).where(F.col("found") > 0)
    return parts.groupBy(F.col("words").alias("term")).agg(F.sum("found").alias("df"), F.sum("occurs").alias("total"))


def _pairs(block: Block, number: np.ndarray, n: int, stop_words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of neighbours among a block's kept words, for words by their ``number`` below ``n`` (-1: in no pair), as
    ``first * n + second``; how often each occurs and in how many rows."""
    of_kept = block.kept(stop_words)[block.codes]
    word, row = number[block.codes[of_kept]], block.row[of_kept]
    known = (row[1:] == row[:-1]) & (word[1:] >= 0) & (word[:-1] >= 0)
    rows = max(len(block.keys), 1)
    found = np.sort((word[:-1] * n + word[1:])[known] * rows + row[1:][known])
    pair = found // rows
    begins = np.ones(len(pair), bool)
    begins[1:] = pair[1:] != pair[:-1]
    first = np.flatnonzero(begins)
    begins[1:] |= found[1:] != found[:-1]
    new = np.add.reduceat(begins.astype(np.int64), first) if len(first) else first
    return pair[first], np.diff(first, append=len(pair)), new


def pair_counts(blocks: DataFrame, stop_words: Sequence[str], known: DataFrame, floor: int, tasks: int) -> DataFrame:
    """``(term, df, total)`` of the pairs of neighbours among kept words that are both ``known`` words and that occur
    ``floor`` times or more.

    Up to ``SENT_TERMS`` known words go to every task, and pairs are shuffled as two numbers in one.
    """
    sums = [F.sum("new").alias("df"), F.sum("occurs").alias("total")]
    reached = F.col("total") >= floor
    if known.count() <= SENT_TERMS:
        words = known.select("term").orderBy("term").toArrow().column("term").combine_chunks()
        n = max(len(words), 1)

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in read_blocks(batches):
                number = pc.fill_null(pc.index_in(block.words, value_set=words), -1).to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays([*map(pa.array, _pairs(block, number, n, stop_words))], ["pair", "occurs", "new"])

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pair = batch.column("pair").to_numpy()
                sides = [words.take(pa.array(side)) for side in (pair // n, pair % n)]
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(*sides, " "), batch.column("df"), batch.column("total")], ["term", "df", "total"])

        pairs = blocks.select(*BLOCK_WORDS).mapInArrow(counted, "pair long, occurs long, new long")
        return pairs.repartition(tasks, "pair").groupBy("pair").agg(*sums).where(reached).mapInArrow(named, "term string, df long, total long")

    def as_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in read_blocks(batches):
            n = max(len(block.words), 1)
            pair, occurs, new = _pairs(block, np.arange(len(block.words)), n, stop_words)
            sides = [block.words.take(pa.array(side)) for side in (pair // n, pair % n)]
            yield pa.RecordBatch.from_arrays([*sides, pa.array(occurs), pa.array(new)], ["first", "second", "occurs", "new"])

    pairs = blocks.select(*BLOCK_WORDS).mapInArrow(as_words, "first string, second string, occurs long, new long")
    for side in ("first", "second"):
        pairs = pairs.join(known.select(F.col("term").alias(side)), side, "left_semi")
    term = F.concat("first", F.lit(" "), "second").alias("term")
    # Tasks have added up their own pairs, so what is shuffled is what has to be grouped; more input has more tasks.
    return pairs.select(term, "occurs", "new").repartition(tasks, "term").groupBy("term").agg(*sums).where(reached)


def vocabulary(corpus: DataFrame, settings: IndexSettings) -> DataFrame:
    """Most frequent terms ``(term, df, total, idf)`` of all entries, ties by term; written."""
    if settings.max_features == 0:
        return _no_vocabulary(corpus.sparkSession)
    return vocabulary_of(entry_blocks(corpus, settings), settings)


def _no_vocabulary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "term STRING, df BIGINT, total BIGINT, idf DOUBLE")


def vocabulary_of(blocks: DataFrame, settings: IndexSettings) -> DataFrame:
    """``vocabulary`` of the entries in blocks.

    A pair of words is at most as frequent as either word. So words are counted first, and pairs
    only of words that reach the count of the last word that would make the vocabulary; the many
    pairs of rare words are not shuffled.
    """
    words = written(word_counts(blocks), "words")
    frequent, floor = words, 1
    if settings.max_features is not None:
        best = words.orderBy(F.desc("total")).limit(settings.max_features)
        reached = best.agg(F.count("*").alias("n"), F.min("total").alias("total")).first()
        floor = reached.total if reached.n == settings.max_features else 1
        frequent = words.where(F.col("total") >= floor)
    occurrences = frequent.agg(F.sum("total")).first()[0] or 0
    # Pairs of frequent words are no more than occurrences of frequent words.
    pairs = pair_counts(blocks, settings.stop_words, frequent, floor, _least_tasks(blocks.sparkSession, occurrences * 8))
    entries = blocks.agg(F.sum(F.size("keys"))).first()[0] or 0
    idf = F.log((F.lit(1.0) + entries) / (F.lit(1.0) + F.col("df"))) + 1.0
    vocab = frequent.unionByName(pairs)
    if settings.max_features is not None:
        vocab = vocab.orderBy(F.desc("total"), "term").limit(settings.max_features)
    return written(vocab.select("term", "df", "total", idf.alias("idf")), "vocabulary")


def weights(texts: DataFrame, key: str, vocab: DataFrame, settings: IndexSettings) -> DataFrame:
    """Weights ``(key, term, weight)`` of the known terms of each text, of norm 1 per key."""
    return weights_of(blocks_of(texts.select(key, "text").repartition(key), key, settings.stop_words, 4 * CHUNK_TOKENS), key, vocab, settings)


def weights_of(blocks: DataFrame, key: str, vocab: DataFrame, settings: IndexSettings) -> DataFrame:
    """``weights`` of the texts in blocks; rows of one key are one text.

    A capped vocabulary goes to every task, as a broadcast would; without a cap that is low enough terms are joined.
    """
    kind, stop_words = blocks.schema["keys"].dataType.elementType, settings.stop_words
    if settings.max_features is None or settings.max_features > SENT_TERMS:

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in read_blocks(batches):
                codes = block.codes[block.kept(stop_words)[block.codes]]
                row = block.row[block.kept(stop_words)[block.codes]]
                together = row[1:] == row[:-1]
                words = block.words.take(pa.array(codes))
                # Neighbours are neighbours in one row.
                at = np.flatnonzero(together)
                pairs = pc.binary_join_element_wise(words.take(pa.array(at)), words.take(pa.array(at + 1)), " ")
                keys = block.keys.take(pa.array(np.concatenate([row, row[1:][together]])))
                yield pa.RecordBatch.from_arrays([keys, pa.concat_arrays([words, pairs])], [key, "term"])

        raw = (
            blocks.select(*BLOCK_WORDS)
            .mapInArrow(listed, StructType([StructField(key, kind), StructField("term", StringType())]))
            .join(vocab.select("term", "idf"), "term")
            .groupBy(key, "term")
            .agg((F.count("*") * F.max("idf")).alias("raw"))
        )
        norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
        return raw.select(key, "term", (F.col("raw") / norm).alias("weight"))
    weigher = Weigher.of(vocab, stop_words)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in read_blocks(batches):
            row, term, weight = weigher.weights(block)
            yield pa.RecordBatch.from_arrays([block.keys.take(pa.array(row)), weigher.terms.take(pa.array(term)), pa.array(weight)], [key, "term", "weight"])

    schema = StructType([StructField(key, kind), StructField("term", StringType()), StructField("weight", DoubleType())])
    return blocks.select(*BLOCK_WORDS).mapInArrow(weighed, schema)


class Weigher:
    """Weights by a small vocabulary: terms are numbered by their place, pairs are found by the numbers of their words."""

    def __init__(self, known: pa.Table, stop_words: Sequence[str]):
        self.stop_words = stop_words
        self.terms = known.column("term").combine_chunks()
        self.idf = known.column("idf").to_numpy()
        parts = [term.split(" ") for term in self.terms.to_pylist()]
        words = sorted({word for part in parts for word in part})
        place = {word: i for i, word in enumerate(words)}
        self.words = pa.array(words, pa.string())
        self.alone = np.full(len(words) + 1, -1, np.int64)
        pairs = []
        for term, part in enumerate(parts):
            if len(part) == 1:
                self.alone[place[part[0]]] = term
            else:
                pairs.append((place[part[0]] * len(words) + place[part[1]], term))
        pairs = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.pairs, self.pair_terms = pairs[:, 0], pairs[:, 1]

    @classmethod
    def of(cls, vocab: DataFrame, stop_words: Sequence[str]) -> Weigher:
        return cls(vocab.select("term", "idf").orderBy("term").toArrow(), stop_words)

    def weights(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text of a block its terms: a row of the text, the number of the term and its weight, in order of texts and terms."""
        n, n_terms = len(self.words), max(len(self.terms), 1)
        of_kept = block.kept(self.stop_words)[block.codes]
        # A word that is in no term has the number ``n``.
        word = pc.fill_null(pc.index_in(block.words, value_set=self.words), n).to_numpy().astype(np.int64)[block.codes[of_kept]]
        row = block.row[of_kept]
        of = block.text[row]
        term = self.alone[word]
        found = [(of * n_terms + term)[term >= 0]]
        if len(self.pairs) and len(word) > 1:
            pair = word[:-1] * n + word[1:]
            both = np.flatnonzero((row[1:] == row[:-1]) & (word[:-1] < n) & (word[1:] < n))
            at = np.minimum(np.searchsorted(self.pairs, pair[both]), len(self.pairs) - 1)
            both, at = both[same := self.pairs[at] == pair[both]], at[same]
            found.append(of[both + 1] * n_terms + self.pair_terms[at])
        codes, count = distinct(np.concatenate(found))
        of, term = codes // n_terms, codes % n_terms
        raw = count * self.idf[term]
        norm = np.sqrt(np.bincount(of, raw * raw))
        return np.searchsorted(block.text, of), term, raw / norm[of]


def block_words(blocks: DataFrame) -> DataFrame:
    """Words ``(ord, word)``, each word of an entry's row once."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in read_blocks(batches):
            row, code = block.words_of_rows()
            yield pa.RecordBatch.from_arrays([block.keys.take(pa.array(row)), block.words.take(pa.array(code))], ["ord", "word"])

    schema = StructType([StructField("ord", blocks.schema["keys"].dataType.elementType), StructField("word", StringType())])
    return blocks.select(*BLOCK_WORDS).mapInArrow(listed, schema)


def entry_runs(corpus: DataFrame) -> DataFrame:
    return corpus.select("ord", digit_runs(F.col("text")).alias("runs"))


def build_index(corpus: DataFrame, settings: IndexSettings = IndexSettings()) -> SearchIndex:
    blocks = entry_blocks(corpus, settings)
    if settings.max_features == 0:
        vocab = _no_vocabulary(corpus.sparkSession)
        ord_type = corpus.schema["ord"].dataType.simpleString()
        weighed = corpus.sparkSession.createDataFrame([], f"ord {ord_type}, term STRING, weight DOUBLE")
    else:
        vocab = vocabulary_of(blocks, settings)
        weighed = weights_of(blocks, "ord", vocab, settings)
    return SearchIndex(
        entries=corpus.select("ord", "key", "entry_type"),
        vocabulary=vocab,
        terms=weighed,
        words=block_words(blocks),
        runs=entry_runs(corpus),
        settings=settings,
        blocks=blocks,
    )


def write_index(index: SearchIndex, path: str) -> None:
    """Write the tables below a path, replacing what an earlier build left there.

    Terms and words are split into folders by their hash, so that ranking for few questions opens
    only the folders of their features. The rebalance keeps the folders in files of even size,
    also where one word occurs in most entries.
    """
    kept = [(list(index.settings.stop_words), index.settings.max_features)]
    spark = index.entries.sparkSession
    spark.createDataFrame(kept, "stop_words ARRAY<STRING>, max_features INT").write.mode("overwrite").parquet(f"{path}/settings")
    index.entries.write.mode("overwrite").parquet(f"{path}/entries")
    index.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
    index.runs.where(F.size("runs") > 0).write.mode("overwrite").parquet(f"{path}/runs")
    for name, table, feature in (("terms", index.terms, "term"), ("words", index.words, "word")):
        bucketed = table.withColumn("bucket", feature_bucket(F.col(feature))).hint("rebalance", "bucket")
        bucketed.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")


def feature_bucket(feature: Column) -> Column:
    return F.pmod(F.hash(feature), F.lit(FEATURE_BUCKETS))


def read_index(spark: SparkSession, path: str) -> SearchIndex:
    """Tables of a written index, with the settings that it was built by."""
    kept = spark.read.parquet(f"{path}/settings").first()
    settings = IndexSettings(tuple(kept.stop_words), kept.max_features)
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("entries", "vocabulary", "terms", "words", "runs")}
    return SearchIndex(**tables, settings=settings)
