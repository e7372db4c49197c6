"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.session import written


def components(links: DataFrame) -> DataFrame:
    """``node, label`` of every node of ``links`` (``a, b``): the smallest node that it is connected with.

    In each round every node hands its label to the node that the label names and to its neighbours, all take the
    smallest that they get, and then the label of their label; rounds grow with the logarithm of the longest path.
    Each round is written, so that a lost executor costs one round.
    """
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
    edges = written(both, "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        handed = edges.join(labels.select(F.col("node").alias("a"), "label"), "a")
        # To the neighbour and to the node that its label names.
        to = handed.join(labels.select(F.col("node").alias("b"), F.col("label").alias("root")), "b")
        offered = to.select(F.explode(F.array("b", "root")).alias("node"), "label", F.lit(None).cast("long").alias("old"))
        own = labels.select("node", "label", F.col("label").alias("old"))
        least = offered.union(own).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        jump = least.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = written(least.join(jump, "label").select("node", F.col("next").alias("label"), "old"), "labels")
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels
