"""Session settings and tables written between the stages of a job."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def _workspace(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    # The warehouse is shared by all executors too.
    return shared or spark.conf.get("spark.sql.warehouse.dir")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path of its own under the shared folder, removed by Hadoop when the session ends."""
    app = spark.sparkContext.applicationId
    path = f"{_workspace(spark).rstrip('/')}/lodestar/{app}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder.

    Later stages read the table, so a lost executor costs no more than the current stage, and
    several readers do not compute the rows again.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.exists(target)


def broadcast_within(df: DataFrame, rows: int, bound: int) -> DataFrame:
    """Mark ``df`` for broadcast if its counted (or otherwise proven) rows are within the bound."""
    return F.broadcast(df) if rows <= bound else df


def with_ordinals(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with its place in the order of the columns ``order``, from 0 and without gaps.

    Rows are range-sorted and written with their place in their range, and counted in each range; a range's rows follow
    those of the ranges before it. What is added up in one place is one count per range, and these few go to every task,
    so that the rows are shuffled once, however wide they are.
    """
    sorted_ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    table = written(sorted_ranges.withColumn("_id", F.monotonically_increasing_id()), "ranges")
    # The id holds the number of the range above its 33 lower bits, and below them the place there.
    table = table.withColumn("_range", F.shiftright("_id", 33)).withColumn("_place", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = table.groupBy("_range").agg(F.count("*").alias("_rows"))
    moved = sizes.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    placed = table.join(F.broadcast(moved), "_range")
    return placed.withColumn(name, F.col("_place") + F.col("_before")).drop("_range", "_place", "_before")


def drop_tables(spark: SparkSession) -> None:
    """Delete all tables that jobs of this session have written between their stages.

    To be called when the results of the jobs have been taken; otherwise it happens when the session ends.
    """
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{_workspace(spark).rstrip('/')}/lodestar/{spark.sparkContext.applicationId}")
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def ordered_join(items: Column, separator: str, field: str) -> Column:
    """Texts of an array of structs, joined in the order of the structs' leading fields."""
    return F.array_join(F.transform(F.array_sort(items), lambda item: item[field]), separator)
