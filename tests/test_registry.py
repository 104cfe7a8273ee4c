"""Every query with SQL against DuckDB on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from metricloom.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    return c


def plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (decimal.Decimal, float)):
        v = float(v)
        return None if math.isnan(v) else float(f"{v:.7g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v.isoformat() if isinstance(v, datetime.date) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    if name in SQL:
        got = duck.sql(SQL[name])
        assert sorted(got.columns) == sorted(df.columns)
        assert rows == sorted(repr([plain(dict(zip(got.columns, x, strict=True))[c]) for c in sorted(got.columns)]) for x in got.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() == 20 and df.columns[:2] == ["nation", "order_month"]
    assert set(e.oracle_sql()) <= set(e.queries())
