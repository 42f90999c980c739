"""Every query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lexmill.plans import queries


def plain(v):
    if v is None or v != v:
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6)) if v != int(v) else str(int(v))
    return str(v).split("+00:00")[0]


def compared(frame):
    rows = frame.astype(object)
    return sorted(tuple(plain(None if str(v) in ("<NA>", "NaT") else v) for v in r) for r in rows[sorted(rows.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for p in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, small, duck, name):
    got = queries.QUERIES[name](spark, small).toPandas()
    want = duck.execute(queries.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert compared(got) == compared(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_others_give_rows(spark, small, name):
    assert queries.QUERIES[name](spark, small).count() > 0


def test_entry(spark, small):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
