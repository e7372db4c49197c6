"""License scans by diagonal voting.

The hash of every rolling k-gram of words of every text is joined with the places of the same k-gram in the templates. A hit votes for a diagonal: its place in the text less its place in the template. Votes are added up
by diagonal before anything is shuffled further; neighbouring diagonals are merged (words put in or left out move a
copy from one to the next), and a merged span stands if it holds enough of the template's k-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.words import ALNUM, chunks, documents, mixed, word_hashes
from lodestar.session import written

# The phrases of the contract and their labels.
BASE_PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Further names and well-known notices of licenses, with labels.
MORE_PHRASES = (
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("bsd license", "bsd"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nc", "cc-by-nc"),
    ("cc by nd", "cc-by-nd"),
    ("creative commons attribution", "cc-by"),
)
NOTICES = (
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    (
        "cc-by",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ),
)

#: Words of a k-gram: those of the shortest phrase.
K = 2
#: Diagonals no further apart are merged.
NEIGHBOURS = 3
#: Share of a notice's k-grams that a span must hold.
MIN_COVER = 0.6

_NONE = -1
_NO_GRAM = 0


def grams(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every run of k words of the texts its hash, text and first word; and how many words each text has.

    Words are of digits, letters and characters beyond ASCII, with A-Z lower-cased. Then one empty run per text.
    """
    words, firsts = word_hashes(texts, ALNUM)
    n = max(len(words) - k + 1, 0)
    runs = np.zeros(n, np.uint64)
    for i in range(k):
        runs = mixed(runs + words[i : i + n] + np.uint64(i + 1))
    text = np.repeat(np.arange(len(texts)), np.diff(firsts))
    whole = text[:n] == text[k - 1 : k - 1 + n]
    every = np.arange(len(texts))
    return (
        np.concatenate([runs[whole].view(np.int64), np.full(len(texts), _NO_GRAM)]),
        np.concatenate([text[:n][whole], every]),
        np.concatenate([(np.arange(n) - firsts[text[:n]])[whole], 0 * every]),
        np.diff(firsts),
    )


def templates(spark: SparkSession, k: int) -> DataFrame:
    """``gram, template, kind, label, n_grams, template_pos``: some hundred fixed rows.

    The empty run stands for "no template": one such hit per text keeps texts without any other.
    """
    listed = [("base", label, phrase) for phrase, label in BASE_PHRASES]
    listed += [("phrase", label, phrase) for phrase, label in MORE_PHRASES]
    listed += [("notice", label, text) for label, text in NOTICES]
    gram, text, place, n_words = (x.tolist() for x in grams(pa.array([x[2] for x in listed]), k))
    rows = [(g, t, *listed[t][:2], n_words[t] - k + 1, p) for g, t, p in zip(gram, text, place, strict=True) if g != _NO_GRAM]
    return spark.createDataFrame(
        [*rows, (_NO_GRAM, _NONE, "none", "", 0, 0)], "gram long, template int, kind string, label string, n_grams int, template_pos int"
    )


def rolling(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text_hash, n_words, pos, gram`` of every run of k words of every text."""

    def rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in chunks(batch.column("text")):
                gram, text, pos, n_words = grams(texts, k)
                at = pa.array(begin + text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at), batch.column("text_hash").take(at), pa.array(n_words[text]), pa.array(pos.astype(np.int32)), pa.array(gram)],
                    ["doc_id", "text_hash", "n_words", "pos", "gram"],
                )

    rows = documents(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(rolled, "doc_id long, text_hash long, n_words long, pos int, gram long")


def license_spans(docs: DataFrame, k: int = K, min_cover: float = MIN_COVER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every phrase and notice found, and for each text one row of ``kind`` none.

    Columns ``doc_id, text_hash, n_words, kind, label, first_word, end_word, cover``: the span's words (the end
    exclusive) and the share of the template's k-grams in it. A null text is an empty one. Rows with the same
    doc_id and text are one document. Phrases stand only as a whole; notices with ``cover`` below ``min_cover``
    are kept, for their score, as kind ``part``.
    """
    # The templates are fixed values of this module, whatever the input.
    hits = rolling(docs, k, id_col, text_col).join(F.broadcast(templates(docs.sparkSession, k)), "gram")
    text = ["doc_id", "text_hash", "n_words"]
    template = [*text, "template", "kind", "label", "n_grams"]
    votes = hits.groupBy(*template, (F.col("pos") - F.col("template_pos")).alias("diagonal")).agg(
        F.collect_set("template_pos").alias("at")
    )
    diagonals = written(votes, "diagonals")
    whole = diagonals.where(F.col("kind").isin("base", "phrase") & (F.size("at") == F.col("n_grams"))).select(
        *text, "kind", "label", F.col("diagonal").cast("long").alias("first_word"),
        (F.col("diagonal") + F.col("n_grams") + (k - 1)).cast("long").alias("end_word"), F.lit(1.0).alias("cover"),
    )
    # Marks go with a text's hits of one template, at most one for each of its words.
    by_place = Window.partitionBy(*template).orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(by_place) > NEIGHBOURS).cast("int")
    merged = (
        diagonals.where(F.col("kind") == "notice")
        .withColumn("span", F.sum(F.coalesce(apart, F.lit(0))).over(by_place))
        .groupBy(*template, "span")
        .agg(
            F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"),
            F.min(F.col("diagonal") + F.array_min("at")).cast("long").alias("first_word"),
            F.max(F.col("diagonal") + F.array_max("at") + k).cast("long").alias("end_word"),
        )
        .withColumn("cover", F.size("at") / F.col("n_grams"))
        .select(*text, F.when(F.col("cover") >= min_cover, "notice").otherwise("part").alias("kind"), "label", "first_word", "end_word", "cover")
    )
    none = diagonals.where(F.col("kind") == "none").select(
        *text, "kind", "label", F.lit(None).cast("long").alias("first_word"), F.lit(None).cast("long").alias("end_word"), F.lit(0.0).alias("cover")
    )
    return whole.unionByName(merged).unionByName(none)


def license_summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and places of base phrases, labels, and ``score``, the best cover of any."""
    kind = F.col("kind")
    base = kind == "base"

    def listed(which: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")

    return (
        license_spans(docs, id_col=id_col, text_col=text_col)
        .groupBy("doc_id", "text_hash", "n_words")
        .agg(
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("first_word"))).alias("first_word"),
            F.max(F.when(base, F.col("first_word"))).alias("last_word"),
            listed(base).alias("base_labels"),
            listed(kind.isin("base", "phrase", "notice")).alias("labels"),
            F.max("cover").alias("score"),
        )
        .drop("text_hash")
    )
