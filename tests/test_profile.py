import pytest
from pyspark.sql import functions as F

from lodestar.operators import profile as pr
from lodestar.operators.profile import merge_files, rendered

def cells_of(spark, columns):
    rows = [(name, value) for name, values in columns.items() for value in values]
    cells = spark.createDataFrame(rows, "column STRING, value STRING")
    return pr.profile_cells(cells, ["column"], spark.createDataFrame([(c,) for c in columns], "column STRING"))


def record(r):
    top = [(v["value"], v["count"], v["pct"]) for v in r.top or ()]
    stats = tuple(None if r[s] is None else round(r[s], 6) for s in ("mean", "median", "std", "min", "max"))
    return r.note, r["count"], r.unique, r.numeric, stats, top


NO_STATS = (None,) * 5


def test_text_cells(spark):
    got = {r.column: record(r) for r in cells_of(spark, {
        "num": ["1", "2", "2", "9", "4"],
        "mixed": ["1", "x", "3", None, "1d"],
        "flag": ["True", "False", "True", "True", "False"],
        "flag_gap": ["True", None, "False", "True", "True"],
        "one": ["5", None, None, None, None],
        "none": [None] * 5,
        "odd": ["1.0", " 2 ", ".5", "1e3", None],
        "hex": ["1", "0x10"],
    }).collect()}
    assert got == {
        "num": (None, 5, 4, True, (3.6, 2.0, 3.209361, 1.0, 9.0), [("2.0", 2, 40.0), ("1.0", 1, 20.0), ("4.0", 1, 20.0), ("9.0", 1, 20.0)]),
        "mixed": (None, 4, 4, False, NO_STATS, [("1", 1, 25.0), ("1d", 1, 25.0), ("3", 1, 25.0), ("x", 1, 25.0)]),
        "flag": (None, 5, 2, True, (0.6, 1.0, 0.547723, 0.0, 1.0), [("True", 3, 60.0), ("False", 2, 40.0)]),
        "flag_gap": (None, 4, 2, False, NO_STATS, [("True", 3, 75.0), ("False", 1, 25.0)]),
        "one": (None, 1, 1, True, (5.0, 5.0, 0.0, 5.0, 5.0), [("5.0", 1, 100.0)]),
        "none": ("empty", 0, None, None, NO_STATS, []),
        "odd": (None, 4, 4, True, (250.875, 1.5, 499.417056, 0.5, 1000.0), [("0.5", 1, 25.0), ("1.0", 1, 25.0), ("2.0", 1, 25.0), ("1000.0", 1, 25.0)]),
        "hex": (None, 2, 2, False, NO_STATS, [("0x10", 1, 50.0), ("1", 1, 50.0)]),
    }


def test_typed_table(spark):
    rows = [(1.5, "x", 1, True, True), (2.5, None, 2, False, None), (None, "x", 3, True, True), (2.5, "y", 4, True, False)]
    df = spark.createDataFrame(rows, "a DOUBLE, b STRING, c LONG, d BOOLEAN, e BOOLEAN")
    got = {r.column: record(r) for r in pr.profile_frame(df).collect()}
    assert got == {
        "a": (None, 3, 2, True, (2.166667, 2.5, 0.57735, 1.5, 2.5), [("2.5", 2, 66.67), ("1.5", 1, 33.33)]),
        "b": (None, 3, 2, False, NO_STATS, [("x", 2, 66.67), ("y", 1, 33.33)]),
        "c": (None, 4, 4, True, (2.5, 2.5, 1.290994, 1.0, 4.0), [(f"{i}.0", 1, 25.0) for i in (1, 2, 3, 4)]),
        "d": (None, 4, 2, True, (0.75, 1.0, 0.5, 0.0, 1.0), [("True", 3, 75.0), ("False", 1, 25.0)]),
        "e": (None, 3, 2, False, NO_STATS, [("True", 2, 66.67), ("False", 1, 33.33)]),
    }
    empty = pr.profile_frame(df.where("a > 100")).collect()
    assert [(r.column, r.note, r["count"]) for r in empty] == [(c, "empty", 0) for c in "abcde"]


def test_whole_numbers_beyond_doubles_are_told_apart(spark):
    ids = [(1 << 53) + i for i in (0, 1, 1, 2, 3)]
    typed = pr.profile_frame(spark.createDataFrame([(i,) for i in ids], "id LONG")).first()
    text = cells_of(spark, {"id": [f" {i}" for i in ids]}).first()
    for r in (typed, text):
        assert r.unique == 4 and (r.top[0]["value"], r.top[0]["count"]) == (str(ids[1]), 2)


@pytest.fixture
def many_ranges(spark):
    """Keeps small ranges apart, as large ones are."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_hot_value_and_many_values_in_many_ranges(spark, many_ranges):
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") * 0.37).alias("hot"), (F.col("id") % 5).alias("few")
    )
    few = {r.column: record(r) for r in pr.profile_frame(df).collect()}
    assert few["few"] == (None, 30000, 5, True, (2.0, 2.0, 1.414237, 0.0, 4.0), [(f"{i}.0", 6000, 20.0) for i in range(5)])
    hot = few["hot"]
    assert hot[1:4] == (30000, 20001, True) and hot[5][0] == ("7.0", 10000, 33.33) and hot[4][3:] == (0.37, round(29999 * 0.37, 6))
    f = pr.ranged(pr.frequencies(pr.frame_cells(df), ["col_pos"]), ["col_pos"])
    assert f.table.where("num IS NOT NULL").select("bucket").distinct().count() > 4


@pytest.mark.parametrize("rows", [1, 2, 3, 10, 11])
def test_median_between_ranges(spark, many_ranges, rows):
    df = spark.range(rows).select((F.col("id") * F.col("id")).alias("a"), F.lit(5).alias("b"))
    middle = {1: 0.0, 2: 0.5, 3: 1.0, 10: 20.5, 11: 25.0}
    assert [(r.median, r.min, r.max) for r in pr.profile_frame(df).orderBy("col_pos").collect()] == [(middle[rows], 0.0, (rows - 1.0) ** 2), (5.0, 5.0, 5.0)]


def test_last_file_wins(spark):
    rows = [("d", 0, 0, "x", 1), ("d", 0, 1, "y", 2), ("d", 1, 0, "x", 3)]
    records = spark.createDataFrame(rows, "dataset STRING, file_pos LONG, col_pos LONG, column STRING, count LONG")
    got = {r.column: (r.place.file_pos, r.summary["count"]) for r in merge_files(records).collect()}
    assert got == {"x": (0, 3), "y": (0, 2)}


def test_rendered_lines(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (2.0, None)], "n DOUBLE, t STRING")
    lines = [r.line for r in pr.profile_frame(df).orderBy("col_pos").select(rendered().alias("line")).collect()]
    assert lines == [
        "Column: n [numeric] count=3 mean=1.667 median=2.000 std=0.577 top=2.0 (66.67%), 1.0 (33.33%)",
        "Column: t [categorical] count=2 unique=1 top='a' (100.0%)",
    ]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_hold_no_whole_column_in_one_task(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("a"), F.col("id").alias("b"))
    f = pr.ranged(pr.frequencies(pr.frame_cells(df), ["col_pos"]), ["col_pos"])
    assert "WindowGroupLimit" in plan_of(pr.top_values(f))
    assert "SortMergeJoin" not in plan_of(pr.medians(f)) and "SortMergeJoin" not in plan_of(pr.deviations(f))
