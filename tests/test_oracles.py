"""Every registered query with SQL of its own, held against DuckDB on the smallest tables."""

import datetime as dt
import decimal
import glob
import math
import os

import pytest

import __spark_entry__ as contract

duckdb = pytest.importorskip("duckdb")
TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


def plain(value):
    if isinstance(value, (int, decimal.Decimal)) and not isinstance(value, bool):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value.isoformat() if isinstance(value, dt.date) else value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(str([plain(r[i]) for i in order]) for r in found)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", [n for n in contract.oracle_sql() if not n.startswith("op")])
def test_query(spark, duck, name):
    own = contract.queries()[name](spark, TABLES)
    result = duck.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert rows(own.columns, own.collect()) == rows(columns, result.fetchall())


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert contract.oracle_sql().keys() <= contract.queries().keys()
