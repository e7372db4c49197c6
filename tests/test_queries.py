"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodestar.workload.queries import REGISTRY

FOLDER = "/root/testdata/sf0.001"
NAMES = [name for name in entry.queries() if name in entry.oracle_sql()]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_of_the_library_has_sql():
    assert set(REGISTRY) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(row[c] for c in columns) for row in df.collect()), key=repr)
    relation = duck.sql(entry.oracle_sql()[name])
    places = [relation.columns.index(c) for c in columns]
    want = sorted((tuple(row[i] for i in places) for row in relation.fetchall()), key=repr)
    assert got and got == want
