"""Shapes of plans: pushed filters, narrow scans, no nested loops, no row-at-a-time Python."""

import os
import re

import pytest

from weftmatch.plans import keys, lookups

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted({**keys.QUERIES, **lookups.QUERIES}))
def test_no_nested_loops_and_no_row_udfs(spark, name):
    text = plan({**keys.QUERIES, **lookups.QUERIES}[name](spark, DATA))
    assert "CartesianProduct" not in text and "BatchEvalPython" not in text
    loops = text.count("BroadcastNestedLoopJoin")
    assert loops <= (2 if name == "p1_found" else 0)  # there, each side is the single row of a total


def test_delta_filter_reaches_the_scan(spark):
    text = plan(lookups.delta_scan(spark, DATA))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(updated_at[^\]]*LessThanOrEqual\(updated_at", text)
    assert "ReadSchema: struct<mongo_id:string,updated_at:timestamp,batch_no:int>" in text


def test_scans_read_only_what_is_used(spark):
    assert "ReadSchema: struct<collection:string>" in plan(lookups.build_counts(spark, DATA))
    assert "text:string" not in plan(lookups.hit_miss_counters(spark, DATA))
    assert "ReadSchema: struct<mongo_id:string,duration_ms:bigint>" in plan(lookups.duration_buckets(spark, DATA)).replace("collection:string,", "").replace("updated_at:timestamp,batch_no:int", "").replace(",>", ">")


def test_counts_are_combined_before_the_shuffle(spark):
    text = plan(lookups.build_counts(spark, DATA))
    assert text.index("HashAggregate") < text.index("Exchange hashpartitioning") < text.rindex("HashAggregate")
