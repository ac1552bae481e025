"""Every registered query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
# The whole lake runs in tests/test_jobs.py.
SLOW = {"bronze_silver_gold"}
NAMES = sorted(set(entry_module.queries()) - SLOW)


@pytest.fixture(scope="session")
def duck(small):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{small}/{name}.parquet'")
    return connection


def text(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return repr(value)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, small, name):
    frame = entry_module.queries()[name](spark, small)
    columns = sorted(frame.columns)
    got = sorted(tuple(text(row[c]) for c in columns) for row in frame.collect())
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = duck.execute(sql)
    found = [d[0] for d in result.description]
    assert sorted(found) == columns
    order = [found.index(c) for c in columns]
    assert got == sorted(tuple(text(row[i]) for i in order) for row in result.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_check_belongs_to_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
