import collections
import random

import pytest
from pyspark.sql import functions as F

from weftmatch.operators.skew import heavy_keys, skew_aggregate, skew_counts, skew_join, skew_pairs
from weftmatch.plans.keys import key_profile


def keyed(spark, n=6000):
    r = random.Random(3)
    data = [("hot" if r.random() < 0.4 else None if r.random() < 0.02 else f"k{r.randrange(900)}", f"m{r.randrange(300)}", 1) for _ in range(n)]
    return data, spark.createDataFrame(data, "k string, mongo_id string, extra int")


def test_heavy_keys_finds_what_is_heavy(spark):
    _, df = keyed(spark)
    assert heavy_keys(df, "k", 0.02) == ["hot"]
    assert heavy_keys(df.limit(0), "k") == []
    with pytest.raises(ValueError):
        heavy_keys(df, "k", 1e-6)


def test_counts_are_exact(spark, rows):
    data, df = keyed(spark)
    assert rows(skew_counts(df, "k"), "k", "n_rows") == sorted(((k, n) for k, n in collections.Counter(x[0] for x in data if x[0]).items()), key=repr)
    assert rows(skew_counts(df.limit(0), "k")) == []


def test_distinct_members_of_a_heavy_key(spark, rows):
    data, df = keyed(spark)
    want = collections.defaultdict(list)
    for k, m, _ in data:
        if k:
            want[k].append(m)
    got = rows(key_profile(df, "k", "mongo_id"))
    assert got == sorted(((k, len(v), len(set(v)), min(v), max(v)) for k, v in want.items()), key=repr)


def test_join_keeps_null_keys_on_the_left(spark, rows):
    data, df = keyed(spark)
    side = df.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("k is not null")
    n = collections.Counter(x[0] for x in data)
    out = rows(skew_join(df.select("k", "mongo_id"), side, "k", "left"), "k", "n")
    assert out == sorted(((k, n[k] if k else None) for k, _, _ in data), key=repr)
    assert skew_join(df, side, "k").count() == sum(1 for x in data if x[0])
    with pytest.raises(ValueError):
        skew_join(df, df, "k")


def test_empty_table_and_name_with_a_dot(spark, rows):
    df = spark.createDataFrame([("a",)], "`odd.key` string").toDF("odd_key")
    one = lambda d, by: d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    add = lambda d, by: d.groupBy(*by).agg(F.sum("n").alias("n"))
    assert rows(skew_aggregate(df, "odd_key", one, add, one, F.lit(0))) == [("a", 1)]


def test_pairs_of_two_skewed_sides(spark, rows):
    left = spark.createDataFrame([("hot", i) for i in range(40)] + [("cold", 1), (None, 2), ("left", 3)], "k string, a int")
    right = spark.createDataFrame([("hot", i) for i in range(30)] + [("cold", 7), ("cold", 8), (None, 9)], "k string, b int")
    want = sorted([("hot", i, j) for i in range(40) for j in range(30)] + [("cold", 1, 7), ("cold", 1, 8)], key=repr)
    assert rows(skew_pairs(left, right, "k")) == want
    assert rows(skew_pairs(left, right, "k", keys=[])) == want == rows(skew_pairs(left, right, "k", keys=["hot", "cold"], grid=3))
    assert skew_pairs(left.limit(0), right, "k").count() == skew_pairs(left, right.limit(0), "k").count() == 0


def test_a_hot_chunk_is_spread_over_tasks(spark):
    """One chunk holds a tenth of all rows: no partition of its pairs is above twice the median."""
    items = spark.range(20_000).selectExpr("'c' as collection", "cast(id as string) as mongo_id", "if(id % 10 = 0, 7, id) as key")
    probes = spark.range(200).selectExpr("cast(id as string) as probe_id", "7 as key")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [r[0] for r in skew_pairs(probes, items, "key").groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 200 * 2001 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
