"""Every query with SQL gives what DuckDB gives on the same tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from lindero.plans import cleaning, runs, segments, tables, texts, training, values, verification  # noqa: F401
from lindero.plans.registry import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path).split('.')[0]} as select * from '{path}'")
    return connection


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float | decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def compare(spark, duck, query, sql):
    frame = query(spark, DIR)
    columns = sorted(frame.columns)
    mine = sorted(str([plain(row[c]) for c in columns]) for row in frame.collect())
    cursor = duck.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    theirs = sorted(str([plain(dict(zip(names, row, strict=True))[c]) for c in columns]) for row in cursor.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    compare(spark, duck, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, name):
    # no answer of the smallest tables nests a value; test_operators has some
    assert QUERIES[name](spark, DIR).count() > 0 or name == "answer_nested"


@pytest.mark.parametrize("name", sorted(training.oracle_sql()))
def test_flat_tables_same_as_sql(spark, duck, name):
    compare(spark, duck, training.queries()[name], training.oracle_sql()[name])
