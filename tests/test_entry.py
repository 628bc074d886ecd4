"""The driver contract, and every statement of the core against its query on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from weftmatch.plans import keys, lookups, lookups_sql

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(show(r[i]) for i in order) for r in data)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["probe_id", "collection", "mongo_id", "score"]


@pytest.mark.parametrize("name", sorted({**keys.SQL, **lookups_sql.SQL}))
def test_query_equals_statement(spark, con, name):
    df = {**keys.QUERIES, **lookups.QUERIES}[name](spark, DATA)
    cur = con.execute({**keys.SQL, **lookups_sql.SQL}[name])
    assert plain(df.columns, [tuple(r) for r in df.collect()]) == plain([d[0] for d in cur.description], cur.fetchall())
