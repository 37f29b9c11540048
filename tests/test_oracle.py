"""Every checked query against its SQL in DuckDB, on whole tables."""

import datetime
import math
import os

import duckdb
import pytest

from catalog import QUERIES, SQL

from conftest import DATA

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
FOLDER = DATA / os.environ.get("TABFLOW_SF", "sf0.01")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def kind(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def ordered(values, order):
    picked = ([kind(r[i]) for i in order] for r in values)
    return sorted(picked, key=lambda r: [(v is not None, str(type(v)), v) for v in r])


def test_each_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, duck, name):
    result = QUERIES[name](spark, str(FOLDER))
    expected = duck.execute(SQL[name])
    names = [d[0] for d in expected.description]
    assert sorted(result.columns) == sorted(names)
    got = ordered(result.collect(), [result.columns.index(c) for c in sorted(names)])
    want = ordered(expected.fetchall(), [names.index(c) for c in sorted(names)])
    assert len(got) == len(want)
    assert got == want
