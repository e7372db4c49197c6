"""Column profiles: counts, distinct values, statistics and most frequent values.

Everything comes from one table of value frequencies. Equal values are added up before they are
shuffled, so a value that fills a third of a column is one row per task; numbers are then sorted
over the cluster by column and value, so that a median is found by running totals and a look into
one range. No step gathers a column in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.numbers import FALSE_WORDS, NUMERIC, TRUE_WORDS, fixed, float_text, round_binary
from lodestar.session import broadcast_within, written
from lodestar.settings import BROADCAST_ROWS, RENDERED_NUMBERS, TOP_VALUES

TEXT, NUMBER, BOOLEAN = 0, 1, 2

# Fixed value: whole numbers from here on are not all doubles; they are told apart by their digits.
EXACT_DOUBLES = float(1 << 53)


def frame_cells(df: DataFrame, keys: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """Cells ``(keys, col_pos, kind, num, txt)`` of a typed table: one row per row and column."""
    fields = [df.schema[name] for name in (columns or df.columns)]
    return df.select(*keys, F.inline(F.array(*[_cell(i, field) for i, field in enumerate(fields)])))


def named_columns(owners: DataFrame, names: Sequence[str]) -> DataFrame:
    """Owners, each with all columns of a table by position: ``(owner, col_pos, column)``."""
    listed = F.array(*[F.struct(F.lit(i).cast("long").alias("col_pos"), F.lit(n).alias("column")) for i, n in enumerate(names)])
    return owners.select("*", F.inline(listed))


def _cell(position: int, field: T.StructField) -> Column:
    value = F.col(f"`{field.name}`")
    kind, num, txt = TEXT, F.lit(None).cast("double"), F.lit(None).cast("string")
    if isinstance(field.dataType, T.BooleanType):
        kind, num = BOOLEAN, value.cast("double")
    elif isinstance(field.dataType, T.NumericType):
        kind, num = NUMBER, F.nanvl(value.cast("double"), F.lit(None).cast("double"))
        if isinstance(field.dataType, (T.LongType, T.DecimalType)):
            txt = F.when(F.abs(num) >= EXACT_DOUBLES, value.cast("string"))
    elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        txt = F.to_json(value)
    else:
        txt = value.cast("string")
    return F.struct(
        F.lit(position).cast("long").alias("col_pos"), F.lit(kind).alias("kind"), num.alias("num"), txt.alias("txt")
    )


def frequencies(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Value frequencies ``(keys, kind, num, txt, n)`` of typed cells; a missing cell has no value."""
    return cells.groupBy(*keys, "kind", "num", "txt").agg(F.count("*").alias("n"))


def text_frequencies(cells: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Value frequencies of text cells; columns that hold only numbers get numeric values.

    Types are decided on the distinct values. Their table has one row per column and is joined by
    broadcast within the bound, so that a column with most of the values is not sent to one task.
    """
    raw = cells.groupBy(*keys, F.col(value).alias("raw")).agg(F.count("*").alias("n"))
    kinds = written(column_kinds(raw, keys), "kinds")
    typed = raw.join(broadcast_within(kinds, kinds.count(), BROADCAST_ROWS), list(keys))
    is_text = F.col("kind") == TEXT
    number = F.when(F.col("kind") == BOOLEAN, F.col("raw").isin(*TRUE_WORDS).cast("double")).otherwise(as_number(F.col("raw")))
    return (
        typed.select(
            *keys, "kind", F.when(~is_text, number).alias("num"),
            F.when(is_text, F.col("raw")).when(F.col("kind") == NUMBER, _digits(F.col("raw"))).alias("txt"), "n",
        )
        .groupBy(*keys, "kind", "num", "txt")
        .agg(F.sum("n").alias("n"))
    )


def as_number(raw: Column) -> Column:
    """Number in a text cell, NULL if it is none; no value can fail the job."""
    return F.when(F.rlike(raw, F.lit(NUMERIC)), F.trim(raw).try_cast("double"))


def _digits(raw: Column) -> Column:
    """Digits of a whole number too large for doubles, NULL for others."""
    whole = F.when(F.rlike(raw, F.lit(r"^\s*[+-]?[0-9]{16,38}\s*$")), F.trim(raw).try_cast("decimal(38,0)"))
    return F.when(F.abs(whole) >= 1 << 53, whole.cast("string"))


def column_kinds(raw: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Kind ``(keys, kind)`` of each column of text cells ``(keys, raw, n)``.

    A column of booleans with a missing cell is text; numbers may have missing cells. (In typed
    tables the same is decided when the ranges are added up.)
    """
    present = F.col("raw").isNotNull()
    numeric = F.bool_and(F.when(present, F.rlike("raw", F.lit(NUMERIC))))
    boolean = F.bool_and(F.coalesce(F.col("raw").isin(*TRUE_WORDS, *FALSE_WORDS), F.lit(False)))
    kind = F.when(F.max("raw").isNull(), TEXT).when(numeric, NUMBER).when(boolean, BOOLEAN).otherwise(TEXT)
    return raw.groupBy(*keys).agg(kind.alias("kind"))


@dataclass(frozen=True)
class Frequencies:
    """Written frequencies, with what each range of each column adds up to.

    table: ``(keys, kind, num, txt, n, bucket)``; ranges: one row per column and bucket.
    """

    table: DataFrame
    ranges: DataFrame
    range_rows: int
    keys: tuple[str, ...]


def ranged(freq: DataFrame, keys: Sequence[str]) -> Frequencies:
    """Write frequencies once, numbers sorted into ranges of even size over all columns."""
    # Written first: both halves and the sample of the range bounds read it.
    freq = written(freq, "values")
    numbers = freq.where(F.col("num").isNotNull()).repartitionByRange(*keys, "num")
    others = freq.where(F.col("num").isNull()).withColumn("bucket", F.lit(-1))
    table = written(numbers.withColumn("bucket", F.spark_partition_id()).unionByName(others), "frequencies")
    present = F.col("num").isNotNull() | F.col("txt").isNotNull()
    count = F.when(present, F.col("n"))
    ranges = written(
        table.groupBy(*keys, "bucket").agg(
            F.max("kind").alias("kind"),
            F.coalesce(F.sum(count), F.lit(0)).alias("count"),
            F.max(~present).alias("missing"),
            F.count(count).alias("unique"),
            F.sum(F.col("num") * F.col("n")).alias("total"),
            F.min("num").alias("min"),
            F.max("num").alias("max"),
        ),
        "ranges",
    )
    return Frequencies(table, ranges, ranges.count(), tuple(keys))


def _kind() -> Column:
    """Kind of a column from its ranges: booleans with a missing cell are text."""
    return F.when((F.max("kind") == BOOLEAN) & F.max("missing"), TEXT).otherwise(F.max("kind"))


def counts(f: Frequencies) -> DataFrame:
    """Per column ``(keys, kind, count, unique, mean, min, max)``."""
    return (
        f.ranges.groupBy(*f.keys)
        .agg(
            _kind().alias("kind"),
            F.sum("count").alias("count"),
            F.sum("unique").alias("unique"),
            F.sum("total").alias("total"),
            F.min("min").alias("min"),
            F.max("max").alias("max"),
        )
        .withColumn("mean", F.col("total") / F.col("count"))
        .drop("total")
    )


def medians(f: Frequencies) -> DataFrame:
    """Exact median ``(keys, median)``: the mean of the two middle values."""
    keys = list(f.keys)
    numbers = f.ranges.where(F.col("bucket") >= 0)
    running = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    middle = (
        numbers.select(
            *keys,
            "bucket",
            "count",
            F.coalesce(F.sum("count").over(running), F.lit(0)).alias("before"),
            F.ceil(F.sum("count").over(whole) / 2).alias("lower"),
            F.floor(F.sum("count").over(whole) / 2 + 1).alias("upper"),
        )
        .where((F.col("before") < F.col("upper")) & (F.col("before") + F.col("count") >= F.col("lower")))
        .drop("count")
    )
    inside = Window.partitionBy(*keys, "bucket").orderBy("num").rowsBetween(Window.unboundedPreceding, 0)
    values = (
        f.table.where(F.col("num").isNotNull())
        .select(*keys, "bucket", "num", "n")
        .join(broadcast_within(middle, f.range_rows, BROADCAST_ROWS), [*keys, "bucket"])
        .withColumn("reached", F.col("before") + F.sum("n").over(inside))
    )
    return values.groupBy(*keys).agg(
        (
            (
                F.min(F.when(F.col("reached") >= F.col("lower"), F.col("num")))
                + F.min(F.when(F.col("reached") >= F.col("upper"), F.col("num")))
            )
            / 2
        ).alias("median")
    )


def deviations(f: Frequencies) -> DataFrame:
    """Sample standard deviation ``(keys, std)``, 0 for a single value, taken around the mean.

    The mean is joined by column and range, so that also a shuffled join has parts of even size.
    """
    keys = list(f.keys)
    whole = Window.partitionBy(*keys)
    means = f.ranges.where(F.col("bucket") >= 0).select(
        *keys, "bucket", (F.sum("total").over(whole) / F.sum("count").over(whole)).alias("mean")
    )
    squares = F.sum(F.col("n") * F.pow(F.col("num") - F.col("mean"), 2))
    total = F.sum("n")
    return (
        f.table.where(F.col("num").isNotNull())
        .select(*keys, "bucket", "num", "n")
        .join(broadcast_within(means, f.range_rows, BROADCAST_ROWS), [*keys, "bucket"])
        .groupBy(*keys)
        .agg(F.when(total > 1, F.sqrt(squares / (total - 1))).otherwise(0.0).alias("std"))
    )


def numeric_stats(f: Frequencies) -> DataFrame:
    """Statistics ``(keys, mean, median, std, min, max)`` of the numeric columns."""
    keys = list(f.keys)
    base = counts(f).where((F.col("kind") != TEXT) & (F.col("count") > 0)).select(*keys, "mean", "min", "max")
    return base.join(medians(f), keys).join(deviations(f), keys).select(*keys, "mean", "median", "std", "min", "max")


def top_values(f: Frequencies, top_n: int = TOP_VALUES) -> DataFrame:
    """Most frequent values ``(keys, rank, value, num, count, pct)``, ties by value."""
    keys = list(f.keys)
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "num", "txt")
    totals = f.ranges.groupBy(*keys).agg(F.sum("count").alias("total"), _kind().alias("column_kind"))
    number = F.when(F.col("kind") == BOOLEAN, F.when(F.col("num") == 1, F.lit("True")).otherwise(F.lit("False"))).otherwise(
        float_text(F.col("num"))
    )
    return (
        f.table.where(F.col("num").isNotNull() | F.col("txt").isNotNull())
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top_n)
        .join(broadcast_within(totals, f.range_rows, BROADCAST_ROWS), keys)
        .select(
            *keys,
            "rank",
            F.coalesce(F.col("txt"), number).alias("value"),
            F.when(F.col("column_kind") != TEXT, F.col("num")).alias("num"),
            F.col("n").alias("count"),
            round_binary(F.lit(100.0) * F.col("n") / F.col("total"), 2).alias("pct"),
        )
    )


def profile(f: Frequencies, columns: DataFrame, top_n: int = TOP_VALUES) -> DataFrame:
    """One record per column of ``columns`` ``(keys, column, ...)``.

    ``note`` is ``empty`` for a column without a value, whose other fields are NULL but the count.
    ``top`` holds at most ``top_n`` values, in order.
    """
    keys = list(f.keys)
    top = (
        top_values(f, top_n)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "value", "num", "count", "pct"))).alias("top"))
    )
    filled = counts(f).where(F.col("count") > 0).drop("mean", "min", "max")
    return (
        columns.join(filled, keys, "left")
        .join(numeric_stats(f), keys, "left")
        .join(top, keys, "left")
        .select(
            *columns.columns,
            F.when(F.col("count").isNull(), F.lit("empty")).alias("note"),
            F.coalesce("count", F.lit(0)).cast("long").alias("count"),
            "unique",
            F.when(F.col("count").isNotNull(), F.col("kind") != TEXT).alias("numeric"),
            "mean",
            "median",
            "std",
            "min",
            "max",
            "top",
        )
    )


def profile_frame(df: DataFrame, top_n: int = TOP_VALUES) -> DataFrame:
    """Profile of a typed table."""
    one = df.sparkSession.range(1).select()
    return profile(ranged(frequencies(frame_cells(df), ["col_pos"]), ["col_pos"]), named_columns(one, df.columns), top_n)


def profile_cells(cells: DataFrame, keys: Sequence[str], columns: DataFrame, top_n: int = TOP_VALUES) -> DataFrame:
    """Profile of text cells ``(keys, value)``, types found from the text."""
    return profile(ranged(text_frequencies(cells, keys), keys), columns, top_n)


def merge_files(profiles: DataFrame) -> DataFrame:
    """One record ``(dataset, column, summary)`` per column name: the last file's counts.

    ``file_pos`` and ``col_pos`` are of the first file that has the column, which fixes its place.
    """
    fields = [c for c in profiles.columns if c not in ("dataset", "column", "file_pos", "col_pos")]
    return profiles.groupBy("dataset", "column").agg(
        F.min(F.struct("file_pos", "col_pos")).alias("place"),
        F.max_by(F.struct(*fields), "file_pos").alias("summary"),
    )


def rendered() -> Column:
    """Text line of a profile record, NULL for an empty column."""

    def values(limit: int, quote: str) -> Column:
        parts = F.transform(
            F.slice("top", 1, limit),
            lambda v: F.concat(F.lit(quote), v["value"], F.lit(f"{quote} ("), float_text(v["pct"]), F.lit("%)")),
        )
        return F.array_join(parts, ", ")

    numeric = F.concat(
        F.lit("Column: "), F.col("column"), F.lit(" [numeric] count="), F.col("count").cast("string"),
        F.lit(" mean="), fixed(F.col("mean"), 3), F.lit(" median="), fixed(F.col("median"), 3),
        F.lit(" std="), fixed(F.col("std"), 3), F.lit(" top="), values(RENDERED_NUMBERS, ""),
    )
    categorical = F.concat(
        F.lit("Column: "), F.col("column"), F.lit(" [categorical] count="), F.col("count").cast("string"),
        F.lit(" unique="), F.col("unique").cast("string"), F.lit(" top="), values(TOP_VALUES, "'"),
    )
    return F.when(F.col("count") > 0, F.when(F.col("numeric"), numeric).otherwise(categorical))

