"""Every query of the core library against its DuckDB twin on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as driver
from leafmill import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    try:
        return repr(round(float(value), 9))
    except (TypeError, ValueError):
        return str(value)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_oracle(spark, con, name):
    df = driver.queries()[name](spark, SF)
    done = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in done.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(plain(r[names.index(c)]) for c in df.columns) for r in done.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_rows_only(spark, name):
    assert driver.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert driver.entry(spark).count() > 0
