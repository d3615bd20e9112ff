"""Every query with SQL against DuckDB on the smallest tables; those of the text operators have tests of their own."""

import glob
import os

import duckdb
import pytest

from lumispan.plans import clouds, graphs

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(clouds.SQL | graphs.SQL))
def test_against_sql(spark, duck, name):
    got = (clouds.QUERIES | graphs.QUERIES)[name](spark, DIR).toPandas()
    want = duck.sql((clouds.SQL | graphs.SQL)[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda d: sorted(map(tuple, d[columns].astype(str).to_numpy().tolist()))
    assert key(got) == key(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
