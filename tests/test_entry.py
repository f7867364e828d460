"""Registered queries of the phase operators against their SQL at the smallest size."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from unfurl.plans import queries as Q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
SOME = sorted(Q.QUERIES)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.split('.')[0]} as from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(set(SOME)))
def test_query(spark, db, name):
    got, want = Q.QUERIES[name](spark, DATA).toPandas(), db.sql(Q.SQL[name]).df()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns) and len(got) == len(want)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert (a.astype(str) == b.astype(str)).all().all()


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(Q.QUERIES) == set(Q.SQL)
    assert entry.entry(spark).limit(1).count() == 1
