"""Prefix trie of conversations, with totals of every subtree.

Every conversation is rebuilt: the first ``h`` turns of its family's head (``c - c % 100``), then its own turns after
its first ``h``, where ``h`` is the unsigned crc32 of its decimal id modulo 6. Each distinct sequence of the first ``d``
rebuilt turns (role, text) is a node of depth ``d``; the textless root has depth 0, and every rebuilt conversation,
even one without turns, is a member of the nodes of all its prefixes.

Method (time-forward processing, re-expressed for Spark). A node is named by its depth and two sums of 64-bit hashes
of (place, role, text) over its turns, so that a turn's node follows from the one before it by a running sum within
the conversation. Rows of (conversation, depth) are the conversation's path through the trie, in reverse level order
when read from the end of each conversation. Subtree totals pass to parents along these paths: every distinct node
is counted once, by its smallest member, and a node's total is the sum over its members of their running totals from
its depth downwards (a window over the members' own short rows, then a partially aggregated sum per node). No level
loop and no queue through the driver: the whole trie takes a fixed number of shuffles.

Defined results for odd input: rows with a null ``conv_id`` belong to no conversation and are left out; a null turn
comes first, a null role or text is empty; turns with equal numbers are ordered by role and text, so repeated rows
are repeated turns. A conversation that is its family's head, or whose head is absent, is rebuilt from its own turns
(and the head's first ``h``, where there is one). An empty table gives no nodes. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.session import written

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class Rebuild:
    """Conversations are rebuilt on the head of their family of ``family`` ids, sharing ``h`` (crc32 mod ``share``) turns."""

    family: int = 100
    share: int = 6


def turns(conversations: DataFrame) -> DataFrame:
    """``(c, p, role, text)``: every turn with its place from 1 within its conversation."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").alias("c"),
        F.col("turn").alias("_turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("c").orderBy(F.col("_turn").asc_nulls_first(), "role", "text")
    return rows.withColumn("p", F.row_number().over(order)).drop("_turn")


def rebuilt(conversations: DataFrame, how: Rebuild = Rebuild()) -> DataFrame:
    """``(c, e, role, text)``: the turns of every rebuilt conversation with their places ``e`` from 1, and ``n`` turns in all.

    Conversations without any turn (possible only where a head shares none) have no rows here.
    """
    own = turns(conversations)
    ids = own.select("c").distinct().select(
        "c",
        (F.col("c") - F.col("c") % how.family).alias("b"),
        (F.crc32(F.col("c").cast("string")) % how.share).cast("int").alias("h"),
    )
    # A head lends at most ``share - 1`` turns to each of at most ``family`` ids: a bounded fan-out per key.
    head = own.where(F.col("p") < how.share).select(F.col("c").alias("b"), F.col("p").alias("q"), "role", "text")
    lent = ids.join(head, "b").where(F.col("q") <= F.col("h"))
    lent_count = lent.groupBy("c").agg(F.count("*").alias("m"))
    shared = lent.select("c", F.col("q").alias("e"), "role", "text")
    after = (
        own.join(ids.select("c", "h"), "c")
        .where(F.col("p") > F.col("h"))
        .join(lent_count, "c", "left")
        .select("c", (F.coalesce("m", F.lit(0)) + F.col("p") - F.col("h")).alias("e"), "role", "text")
    )
    return shared.unionByName(after)


def _node_columns(rows: DataFrame) -> DataFrame:
    """Rows of ``(c, e)`` with the name ``(e, s1, s2)`` of the node they reach, the conversation's length ``n`` and ``size``."""
    exact = T.DecimalType(38, 0)
    path = Window.partitionBy("c").orderBy("e").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("c")
    return rows.select(
        "c",
        "e",
        F.sum(F.xxhash64(F.lit(1), "e", "role", "text").cast(exact)).over(path).alias("s1"),
        F.sum(F.xxhash64(F.lit(2), "e", "role", "text").cast(exact)).over(path).alias("s2"),
        F.max("e").over(whole).alias("n"),
        F.length("text").cast("long").alias("size"),
    )


def _ends_sha256(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending decimal ids that end at each node, streamed through rows sorted within partitions."""

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, out = None, None, []
        for batch in batches:
            for rep, e, c in zip(batch["rep"].tolist(), batch["e"].tolist(), batch["c"].tolist()):
                if (rep, e) != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (rep, e), hashlib.sha256(str(c).encode())
                else:
                    state.update(b"," + str(c).encode())
            if len(out) >= 4096:
                yield pd.DataFrame(out, columns=["rep", "e", "ends_sha256"])
                out = []
        if key is not None:
            out.append((*key, state.hexdigest()))
        yield pd.DataFrame(out, columns=["rep", "e", "ends_sha256"])

    # One node's ids may be many: they are streamed in order, never held as one list.
    ordered = ends.repartition("rep", "e").sortWithinPartitions("rep", "e", "c")
    return ordered.mapInPandas(digests, "rep long, e long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, how: Rebuild = Rebuild()) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    members = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").alias("c")).distinct()
    paths = _node_columns(rebuilt(conversations, how))
    lengths = paths.select("c", "n").distinct()
    exact = T.DecimalType(38, 0)
    root = members.join(lengths, "c", "left").select(
        "c",
        F.lit(0).cast("int").alias("e"),
        F.lit(0).cast(exact).alias("s1"),
        F.lit(0).cast(exact).alias("s2"),
        F.coalesce("n", F.lit(0)).cast("int").alias("n"),
        F.lit(0).cast("long").alias("size"),
    )
    rows = root.unionByName(paths.withColumn("e", F.col("e").cast("int")).withColumn("n", F.col("n").cast("int")))
    nodes = rows.groupBy("e", "s1", "s2").agg(
        F.min("c").alias("rep"), F.count("*").alias("n_convs"), F.max("n").alias("deepest")
    )
    # A very common node is one key with many rows: adaptive execution splits that side of the join.
    placed = rows.join(nodes, ["e", "s1", "s2"]).select(
        "c",
        "e",
        "n",
        "rep",
        "n_convs",
        (F.col("rep") == F.col("c")).cast("long").alias("own"),
        ((F.col("rep") == F.col("c")) & (F.col("deepest") == F.col("e"))).cast("long").alias("leaf"),
        F.when(F.col("rep") == F.col("c"), 0).otherwise(F.col("size")).cast("long").alias("saved"),
    )
    down = Window.partitionBy("c").orderBy(F.col("e").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = Window.partitionBy("c").orderBy("e")
    walked = written(placed.select(
        "c",
        "e",
        "n",
        "rep",
        "n_convs",
        F.lag("rep").over(step).alias("parent"),
        F.coalesce(F.lead("own").over(step), F.lit(0)).alias("child"),
        F.sum("leaf").over(down).alias("leaves"),
        F.sum("saved").over(down).alias("saved"),
    ), "trie_paths")
    totals = walked.groupBy("rep", "e").agg(
        F.max("parent").alias("parent_conv_id"),
        F.max("n_convs").alias("n_convs"),
        F.sum("child").alias("n_children"),
        F.sum("leaves").alias("n_leaves"),
        F.sum("saved").alias("saved_tokens"),
    )
    ends = _ends_sha256(walked.where(F.col("e") == F.col("n")).select("rep", F.col("e").cast("long").alias("e"), "c"))
    return (
        totals.withColumn("e", F.col("e").cast("long"))
        .join(ends, ["rep", "e"], "left")
        .select(
            F.col("rep").alias("conv_id"),
            F.col("e").alias("depth"),
            F.col("parent_conv_id").cast("long").alias("parent_conv_id"),
            F.col("n_convs").cast("long").alias("n_convs"),
            F.col("n_children").cast("long").alias("n_children"),
            F.col("n_leaves").cast("long").alias("n_leaves"),
            F.col("saved_tokens").cast("long").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
        )
    )
