"""Every registered query against its SQL in DuckDB, over whole tables."""

import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__ as contract
from conftest import DATA
from firmgauge.plans import catalog, oracles
from firmgauge.plans.views import BASE

QUERIES = {name: catalog.bind(fn) for name, fn in catalog.QUERIES.items()}
SQL = oracles.oracle_sql()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
         "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in BASE:
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, dt.datetime) and value.time() == dt.time():
        return value.date()
    return value


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    expected = found.fetchall()
    assert sorted(names) == columns
    kinds = {r[0]: r[1] for r in duck.execute(f"describe {SQL[name]}").fetchall()}
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    places = [names.index(c) for c in columns]
    got = ordered(tuple(plain(r[c]) for c in columns) for r in df.collect())
    want = ordered(tuple(plain(r[i]) for i in places) for r in expected)
    assert got == want


def test_all_queries_have_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


def test_flagship_runs(spark):
    df = contract.entry(spark)
    assert df.count() > 0
    assert "cy_change" in df.columns
