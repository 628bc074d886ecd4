"""The statements of this package against their queries, and the columns of every found query."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from weftmatch.llm import queries, sql, survivors

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")

COLUMNS = {
    "p2_found": ["mongo_id_a", "mongo_id_b"], "p3_found": ["item_key", "mongo_id"], "p4_found": ["mongo_id_a", "mongo_id_b"], "p5_found": ["mongo_id", "field_name"],
    "p6_found": ["mongo_id", "group_mongo_id"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "reading_level"],
}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_query_equals_statement(spark, con, rows, name):
    df = queries.QUERIES[name](spark, DATA)
    cur = con.execute(sql.SQL[name])
    names = [d[0] for d in cur.description]
    assert rows(df, *names) == sorted(cur.fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(sql.SQL)))
def test_query_runs(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert df.columns == COLUMNS.get(name, df.columns)
    assert df.count() > 0 or name.startswith("p8_")  # the smallest corpus has no leak


def test_p3_found_comes_through_the_vote_on_fields(spark, rows, monkeypatch):
    """Sources and values are weighed in turn before a base record is named, and the rows are its dominant ones."""
    voted = []
    monkeypatch.setattr(survivors, "discover", lambda claims, f=survivors.discover: voted.append(set(claims.columns)) or f(claims))
    found = rows(queries.p3_found(spark, DATA))
    assert voted == [{"g", "f", "v", "s", "n"}]
    assert found == rows(queries.p3_representatives(spark, DATA).filter("dominant"), "item_key", "mongo_id") and found


def test_p3_puts_together_items_of_shared_keys_only(spark, rows, monkeypatch):
    given = []
    monkeypatch.setattr(queries, "representatives", lambda items, trust, f=queries.representatives: given.append(rows(items, "item_key", "mongo_id")) or f(items, trust))
    found = queries.p3_representatives(spark, DATA)
    counts = Counter(key for key, _ in given[0])
    assert counts and min(counts.values()) > 1 and all(key.strip() for key in counts)
    assert rows(found, "item_key", "n_records") == sorted(counts.items(), key=repr)
