"""Stop words of the search index."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Spark ML's English stop words, without the contracted forms, which no
# token can equal as tokens hold no apostrophe.
ENGLISH: tuple[str, ...] = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his
    himself she her hers herself it its itself they them their theirs themselves what which
    who whom this that these those am is are was were be been being have has had having do
    does did doing a an the and but if or because as until while of at by for with about
    against between into through during before after above below to from up down in out on
    off over under again further then once here there when where why how all any both each
    few more most other some such no nor not only own same so than too very s t can will
    just don should now cannot could ought would
    """.split()
)


def read_stop_words(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Stop words from a text file with one word per line, for ``IndexSettings``.

    The list is a parameter of the job, so it is small by nature and held by the driver.
    """
    lines = spark.read.text(path).collect()
    return tuple(word for word in (row.value.strip().lower() for row in lines) if word)
