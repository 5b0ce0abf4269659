"""The driver's contract, and every query held against its SQL over the smallest tables."""

import math
import os

import pytest

import __spark_entry__
from tallyforge.plans import catalog, oracle

SMALL = "/root/testdata/sf0.001"
needs = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(oracle.oracle_sql())


@needs
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 11


@needs
@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    made = __spark_entry__.queries()[name](spark, SMALL)
    names = sorted(made.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in made.collect())
    wanted = duck.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(wanted.columns) == names
    at = [wanted.columns.index(c) for c in names]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in wanted.fetchall())
