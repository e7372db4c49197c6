"""Near-duplicates by MinHash signatures and a multi-index Hamming join.

A signature has ``slots`` values of 8 bits; its distance to another is the number of slots that differ. The first
``index_slots`` are split into chunks. Of two signatures no further apart than ``errors_per_chunk * chunks + chunks - 1`` one chunk
has at most ``errors_per_chunk`` differing slots (pigeonhole), so a key is made for every chunk and every choice of
that many slots left out of it: such a pair always shares a key. Pairs are confirmed on the full shingle sets.

Texts with equal sets are one class, found by a 128-bit fingerprint. A key's classes are not paired with each other:
each is compared with the one that shares most keys with others (a star), and only while the two are in different
components. What still lies in different components under one key after these rounds is compared in
full where it lies, and only pairs that full lists of short hashes allow become rows. So a group of n near copies gives
about n rows, and no link between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.graph import components
from lodestar.llm.words import VISIBLE, chunks, documents, mixed, word_hashes
from lodestar.session import written


@dataclass(frozen=True)
class MinHash:
    """Documents are linked if ``100 * shared >= percent * all`` of their distinct shingles.

    With one error to a chunk, all pairs are found of which up to ``2 * chunks - 1`` = 23 of the 64 indexed slots
    differ, where 12.8 are expected at a similarity of 0.8 and 23 are exceeded by less than one in a thousand pairs;
    of pairs further apart nearly all are found too. They are confirmed unless more than ``far`` of all 768 slots
    differ, where 154 are expected at 0.8 with a deviation of 11. A task compares ``block`` members of a key with as many.
    Those with up to ``listed`` shingles are compared by their first ``first_slots`` slots (leaving out what lies six
    deviations beyond the expected) and then by 16 bits of every shingle, which no similar pair fails.
    """

    shingle_words: int = 2
    percent: int = 80
    slots: int = 768
    index_slots: int = 64
    chunks: int = 12
    errors_per_chunk: int = 1
    far: int = 200
    stars: int = 2
    block: int = 2048
    listed: int = 1024
    first_slots: int = 192
    seed: int = 3

    @property
    def guaranteed(self) -> int:
        return self.errors_per_chunk * self.chunks + self.chunks - 1

    @property
    def first_far(self) -> float:
        """How many of the first slots may differ."""
        differing = 1 - self.percent / 100
        return self.first_slots * differing + 6 * (self.first_slots * differing * (1 - differing)) ** 0.5

    def is_listed(self, size: int) -> bool:
        """Whether a set's shingles are listed; of two sets that may be similar both are, or both have over ``listed``."""
        return self.percent * size <= 100 * self.listed


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """For each text its distinct shingles, as sorted hashes; fewer words are one shingle, none are none."""
    hashes, firsts = word_hashes(texts, VISIBLE)
    n = max(len(hashes) - words + 1, 0)
    runs = np.zeros(n, np.uint64)
    for i in range(words):
        runs = mixed(runs + hashes[i : i + n] + np.uint64(i + 1))
    out = []
    for begin, end in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if end - begin >= words:
            out.append(np.unique(runs[begin : end - words + 1]))
        elif end > begin:
            one = np.uint64(0)
            for i in range(begin, end):
                one = mixed(np.array([one + hashes[i] + np.uint64(101)]))[0]
            out.append(np.array([one]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signature(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> bytes:
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), np.iinfo(np.uint32).max, np.uint32)
    for begin in range(0, len(values), 512):
        least = np.minimum(least, (values[begin : begin + 512, None] * factors + shifts).min(axis=0))
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, how: MinHash, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text_hash, n_shingles, fingerprint, signature`` of every row; no fingerprint without words."""
    random = np.random.default_rng(how.seed)
    factors = random.integers(1, 1 << 31, how.slots, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = random.integers(0, 1 << 32, how.slots, dtype=np.uint32)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in chunks(batch.column("text")):
                sets = shingle_sets(texts, how.shingle_words)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(begin, len(texts)),
                        batch.column("text_hash").slice(begin, len(texts)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([_signature(s, factors, shifts) if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "text_hash", "n_shingles", "fingerprint", "signature"],
                )

    rows = documents(docs, id_col, text_col, F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("text_hash"))
    return rows.mapInArrow(signed, "doc_id long, text_hash long, n_shingles long, fingerprint binary, signature binary")


def _left_in(how: MinHash) -> list[list[int]]:
    """Slots of every key: those of a chunk but for the left-out ones."""
    parts = np.array_split(np.arange(how.index_slots), how.chunks)
    return [[s for s in part.tolist() if s not in out] for part in parts for out in combinations(part.tolist(), how.errors_per_chunk)]


def _slots(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def index_keys(classes: DataFrame, how: MinHash) -> DataFrame:
    """``key, part, node``: for every chunk and every choice (``part``) of left-out slots a hash of its other slots."""
    left = _left_in(how)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            slots = _slots(batch.column("signature")).astype(np.uint64)
            keys = np.empty((len(batch), len(left)), np.uint64)
            for i, kept in enumerate(left):
                key = np.full(len(batch), i, np.uint64)
                for slot in kept:
                    key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + slots[:, slot])
                keys[:, i] = key
            nodes = np.repeat(batch.column("node").to_numpy(), len(left))
            parts = np.tile(np.arange(len(left), dtype=np.int32), len(batch))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(parts), pa.array(nodes)], ["key", "part", "node"])

    return classes.select("node", "signature").mapInArrow(keyed, "key long, part int, node long")


def near_enough(pairs: DataFrame, classes: DataFrame, how: MinHash) -> DataFrame:
    """``a, b, distance`` of the pairs no further apart than ``far`` and with sizes that allow the similarity."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            distance = (_slots(batch.column("one")) != _slots(batch.column("two"))).sum(axis=1)
            rows = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(distance.astype(np.int32))], ["a", "b", "distance"])
            yield rows.filter(pa.array(distance <= how.far))

    def side(node: str, signature: str, size: str) -> DataFrame:
        return classes.select(F.col("node").alias(node), F.col("signature").alias(signature), F.col("n_shingles").alias(size))

    return (
        pairs.join(side("a", "one", "size_a"), "a")
        .join(side("b", "two", "size_b"), "b")
        .where(100 * F.least("size_a", "size_b") >= how.percent * F.greatest("size_a", "size_b"))
        .select("a", "b", "one", "two")
        .mapInArrow(measured, "a long, b long, distance int")
    )


def near_in_keys(member: DataFrame, classes: DataFrame, sets: DataFrame, how: MinHash) -> DataFrame:
    """``a, b`` of all pairs of different components that share a key and may be similar enough, each once.

    The members of a key are compared where they lie, in blocks, and only pairs that pass become rows; a pair is given
    by the first of its keys. A key with many members is split into pairs of blocks. Sets of up to ``listed`` shingles
    bring 16 bits of each: the shingles of one whose bits the other has too are at least those that both share, so of a
    group of texts that are nearly similar enough hardly a pair is given that is not. Larger ones bring all slots.
    """
    left, width = _left_in(how), how.first_slots
    blocks = member.groupBy("key").agg(F.ceil(F.count("*") / how.block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    slots = F.when(F.col("n_shingles") > how.listed, F.col("signature")).otherwise(F.substring("signature", 1, width))
    brought = classes.select("node", "n_shingles", slots.alias("signature")).join(sets.select("node", "bits"), "node")
    rows = (
        member.join(blocks, "key")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .join(brought, "node")
        .select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "part", "node", "label", "n_shingles", "signature", "bits")
    )
    group = ["key", "low", "high"]

    def compared(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        node, label, size, own = (part.column(c).to_numpy() for c in ("node", "label", "n_shingles", "own"))
        low, high, choice = part.column("low")[0].as_py(), part.column("high")[0].as_py(), part.column("part")[0].as_py()
        signature = part.column("signature").to_pylist()
        first = np.frombuffer(b"".join(s[:width] for s in signature), np.uint8).reshape(len(node), -1)
        large = np.flatnonzero(size > how.listed)
        whole = np.zeros((len(node) if len(large) else 0, how.slots), np.uint8)
        for i in large.tolist():
            whole[i] = np.frombuffer(signature[i], np.uint8)
        listed = how.is_listed(size)
        # The bits of a set's shingles in a row, filled up with 0, which is no shingle's.
        sizes = np.where(listed, size, 0)
        bits = np.zeros((len(node), sizes.max()), np.uint16)
        bits[np.arange(bits.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(part.column("bits").to_pylist()), np.uint16)

        def similar(i: int, rest: np.ndarray) -> np.ndarray:
            if not len(rest):
                return rest
            # With one listed, both are, or their sizes differ too much.
            both = listed[rest] & listed[i]
            passed = np.zeros(len(rest), bool)
            if both.any():
                mine = np.zeros(1 << 16, bool)
                mine[bits[i, : size[i]]] = True
                others = rest[both]
                shared = mine[bits[others, : size[others].max()]].sum(axis=1)
                passed[both] = 100 * shared >= how.percent * (size[others] + size[i] - shared)
            if not both.all():
                passed[~both] = (whole[rest[~both]] != whole[i]).sum(axis=1) <= how.far
            return rest[passed]

        found_a, found_b = [], []
        for i in range(len(node) - 1):
            rest = np.arange(i + 1, len(node))
            fits = (label[rest] != label[i]) & (node[rest] != node[i]) & (100 * np.minimum(size[rest], size[i]) >= how.percent * np.maximum(size[rest], size[i]))
            if low != high:
                fits &= own[rest] != own[i]
            rest = rest[fits]
            differ = first[rest] != first[i]
            near = differ.sum(axis=1) <= how.first_far
            rest, differ = rest[near], differ[near]
            for earlier in left[:choice]:
                if not len(rest):
                    break
                again = ~differ[:, earlier].any(axis=1)
                rest, differ = rest[~again], differ[~again]
            rest = similar(i, rest)
            found_a.append(np.full(len(rest), node[i]))
            found_b.append(node[rest])
        return np.concatenate(found_a), np.concatenate(found_b)

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in chain(batches, (None,)):
            if batch is not None:
                new = pa.Table.from_batches([batch])
                held = new if held is None else pa.concat_tables([held, new])
            if held is None or not len(held):
                continue
            columns = [held.column(c).to_numpy() for c in group]
            change = np.zeros(len(held) - 1, bool)
            for c in columns:
                change |= c[1:] != c[:-1]
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(held)]
            # The last group may go on in the next batch.
            done = edges if batch is None else edges[:-1]
            pairs = [compared(held.slice(x, y - x)) for x, y in zip(done[:-1], done[1:], strict=True) if y - x > 1]
            held = held.slice(done[-1])
            if pairs:
                a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(paired, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, how: MinHash) -> DataFrame:
    """``a, b`` of the pairs whose full sets are similar enough.

    The sets are arrays of 64-bit hashes, intersected row by row in the JVM, so a set that many pairs share is
    never copied into a batch for each of them.
    """
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("one")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("set").alias("two")), "b"
    )
    both = F.size(F.array_intersect("one", "two"))
    union = F.size("one") + F.size("two") - both
    return joined.where(F.lit(100) * both >= F.lit(how.percent) * union).select("a", "b")


def sets_of(docs: DataFrame, wanted: DataFrame, classes: DataFrame, how: MinHash, id_col: str, text_col: str) -> DataFrame:
    """``node, set, bits`` of the wanted classes, from the text of their first document; ``bits`` are the upper 16 of
    every shingle (1 for 0), empty for sets too large to be listed."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in chunks(batch.column("text")):
                sets = shingle_sets(texts, how.shingle_words)
                offsets = np.zeros(len(sets) + 1, np.int32)
                np.cumsum([len(one) for one in sets], out=offsets[1:])
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))
                bits = [np.maximum(one >> np.uint64(48), 1).astype(np.uint16).tobytes() if how.is_listed(len(one)) else b"" for one in sets]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(begin, len(texts)), listed, pa.array(bits, pa.binary())], ["node", "set", "bits"])

    first = classes.join(wanted, "node").select("node", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"))
    rows = documents(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    same = rows["doc_id"].eqNullSafe(first["doc_id"]) & (rows["text_hash"] == first["text_hash"])
    # Repeated rows have the same text, so one of them serves.
    return rows.join(first, same).select("node", "text").dropDuplicates(["node"]).mapInArrow(made, "node long, set array<long>, bits binary")


def near_duplicates(docs: DataFrame, how: MinHash = MinHash(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_hash`` of every row.

    ``component_id`` is the smallest id that links lead to, the own one included; ``kept`` says they are equal. A
    null or empty text has no shingles and is linked with nothing. Rows with the same id are one document to the
    caller, but each text is compared; a row without an id is never the smallest of its component.
    """
    spark = docs.sparkSession
    rows = written(signatures(docs, how, id_col, text_col), "signatures")
    full = rows.where("fingerprint IS NOT NULL")
    classes = written(
        full.groupBy("fingerprint", "n_shingles", "signature")
        .agg(F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_hash")).alias("first"))
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    entries = index_keys(classes, how)
    shared = entries.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    members = written(entries.join(shared, "key"), "members")
    # The class that shares most keys with others lies in the middle of its group, so it is what others are compared with.
    weight = members.groupBy("node").agg(F.sum("members").alias("weight"))
    weighed = written(members.select("key", "part", "node").join(weight, "node"), "weighed")
    labels = classes.select("node", F.col("node").alias("label"))
    links = spark.createDataFrame([], "a long, b long")
    for round_ in range(how.stars):
        # One pair a class, so there is nothing to choose among.
        pairs = near_enough(starred(weighed, labels, round_), classes, how)
        links, labels = joined_by(docs, pairs, links, classes, how, id_col, text_col)
    # What shares a key but is still in different components.
    member = open_members(weighed, labels)
    sets = written(sets_of(docs, member.select("node").distinct(), classes, how, id_col, text_col), "sets")
    rest = near_in_keys(member, classes, sets, how).distinct()
    links, labels = joined_by(docs, rest, links, classes, how, id_col, text_col, sets)

    labelled = classes.select("fingerprint", "least_id", "node").join(labels, "node")
    smallest = labelled.groupBy("label").agg(F.min("least_id").alias("component_id"))
    of_class = labelled.join(smallest, "label").select("fingerprint", "component_id")
    joined = full.join(of_class, "fingerprint").select("doc_id", "n_shingles", "component_id", "text_hash")
    empty = rows.where("fingerprint IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_hash")
    return joined.union(empty).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash")


def open_members(weighed: DataFrame, labels: DataFrame) -> DataFrame:
    """``key, part, node, weight, label`` of the keys whose classes are in more than one component."""
    member = weighed.join(labels, "node")
    keys = member.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    return written(member.join(keys, "key"), "open_members")


def starred(weighed: DataFrame, labels: DataFrame, round_: int = 0) -> DataFrame:
    """Pairs ``a, b``: every class ``b`` of an open key proposes to one centre of its keys that lies in another
    component: the weightiest in the first round, one picked by a hash of the pair and the round later, so that a
    proposal that failed is not made again. A round makes at most one pair a class, however large its group; what
    stays apart is left to the next round and to the exact pass over the open keys."""
    member = open_members(weighed, labels)
    center = member.groupBy("key").agg(F.max(F.struct("weight", "node", "label")).alias("c")).select(
        "key", F.col("c.weight").alias("pull"), F.col("c.node").alias("a"), F.col("c.label").alias("of")
    )
    offers = member.join(center, "key").where("label <> of").select(F.col("node").alias("b"), "pull", "a")
    if round_ > 0:
        offers = offers.withColumn("pull", F.xxhash64("a", "b", F.lit(round_)))
    return offers.groupBy("b").agg(F.max(F.struct("pull", "a")).alias("c")).select(F.col("c.a").alias("a"), "b")


def joined_by(
    docs: DataFrame, pairs: DataFrame, links: DataFrame, classes: DataFrame, how: MinHash, id_col: str, text_col: str, sets: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """All links with those of the pairs that are confirmed, and the label ``node, label`` of every class; ``sets`` are
    those of the pairs' classes, if they are there already."""
    pairs = written(pairs.select("a", "b"), "candidates")
    if sets is None:
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        sets = written(sets_of(docs, wanted, classes, how, id_col, text_col).select("node", "set"), "sets")
    links = links.union(written(confirmed(pairs, sets, how), "links"))
    labels = classes.select("node").join(components(links), "node", "left")
    return links, written(labels.select("node", F.coalesce("label", "node").alias("label")), "labels")


def first_of_groups(docs: DataFrame, how: MinHash = MinHash(shingle_words=5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the first of their group, once each, with all columns."""
    kept = near_duplicates(docs, how, id_col, text_col).where("kept").select("doc_id", "text_hash").distinct()
    text_hash = F.xxhash64(F.coalesce(docs[f"`{text_col}`"], F.lit("")))
    same = docs[f"`{id_col}`"].cast("long").eqNullSafe(kept["doc_id"]) & (text_hash == kept["text_hash"])
    return docs.join(kept, same, "left_semi").dropDuplicates([id_col, text_col])
