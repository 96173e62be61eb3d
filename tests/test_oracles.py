"""Every query with SQL gives the rows that DuckDB gives for it, on the smallest tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from wayfold.plans import registry

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return None if math.isnan(v) else float(f"{float(v):.9g}") + 0.0
    if isinstance(v, datetime.datetime | datetime.date):
        return str(v)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = registry.queries()[name](spark, str(DATA))
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = lambda columns: sorted(range(len(columns)), key=lambda i: columns[i])
    mine, theirs = order(df.columns), order(want.columns)
    got = sorted((tuple(plain(r[i]) for i in mine) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in theirs) for r in want.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
