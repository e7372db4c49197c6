import random

from pyspark.sql import functions as F

from lodestar.functions.numbers import fixed, float_text, round_binary


def numbers():
    rng = random.Random(7)
    values = [0.025, 2.675, 0.125, 3.125, 1.005, 2.0005, -0.025, 0.0, 1e7, 12345678.9, 1e15, 1e16, 1.5e16, 1e-4, 1.5e-5]
    values += [-2.5e9, 123456.789, 99.995, 0.0625, 33.335, 1e22, 7.0, 0.001, 9999999.5]
    values += [100.0 * rng.randint(1, 5000) / rng.choice([800, 4000, 2000, 1600, 7, 640]) for _ in range(400)]
    return values


def test_rounding_and_text_as_in_python(spark):
    values = numbers()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v DOUBLE").orderBy("i")
    v = F.col("v")
    rows = df.select(round_binary(v, 2).alias("r"), fixed(v, 3).alias("f"), float_text(v).alias("t")).collect()
    for value, row in zip(values, rows):
        assert row.r == round(value, 2), value
        assert row.f == "%.3f" % value, value
        assert row.t == str(value), value
