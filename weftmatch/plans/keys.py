"""Problem 1: per-key results over tables in which a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import heavy_keys, skew_aggregate, skew_counts, skew_join
from ..sources.tables import table

#: (table, key) pairs whose keys are profiled.
KEYED = (("hash_chunks", "chunk_value"), ("fingerprint_items", "duration_bucket"))
#: A key is reported when it holds at least 1 / REPORT of all rows.
REPORT = 50


def _keyed(spark: SparkSession, sf: str, name: str, key: str) -> DataFrame:
    return table(spark, sf, name).withColumn("key_value", F.col(key).cast("string"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """``table_name``, ``key_value`` of every key with at least a fiftieth of its table's rows. Repeated rows count,
    rows with a null key count in the total only, and an empty table reports nothing."""
    out = None
    for name, key in KEYED:
        rows = _keyed(spark, sf, name, key).select("key_value")
        counts = skew_counts(rows, "key_value")
        total = rows.agg(F.count(F.lit(1)).alias("total"))
        part = counts.join(F.broadcast(total), F.col("n_rows") * REPORT >= F.col("total")).select(F.lit(name).alias("table_name"), "key_value")
        out = part if out is None else out.unionByName(part)
    return out


def key_profile(rows: DataFrame, key: str, member: str) -> DataFrame:
    """``key``, ``n_rows``, ``n_members``, ``first_member``, ``last_member`` of every non-null key.

    The distinct count of a heavy key is taken per salt, where the salt hashes the member, and summed."""

    def whole(d: DataFrame, by: list[str]) -> DataFrame:
        once = d.groupBy(*by, member).agg(F.count(F.lit(1)).alias("__n"))
        return once.groupBy(*by).agg(F.sum("__n").alias("n_rows"), F.count(member).alias("n_members"), F.min(member).alias("first_member"), F.max(member).alias("last_member"))

    def merge(d: DataFrame, by: list[str]) -> DataFrame:
        return d.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_members").alias("n_members"), F.min("first_member").alias("first_member"), F.max("last_member").alias("last_member"))

    salt: Column = F.xxhash64(member)
    return skew_aggregate(rows.select(key, member), key, whole, merge, whole, salt)


def p1_key_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The profile of every key of both tables."""
    out = None
    for name, key in KEYED:
        part = key_profile(_keyed(spark, sf, name, key), "key_value", "mongo_id").select(F.lit(name).alias("table_name"), "key_value", "n_rows", "n_members", "first_member", "last_member")
        out = part if out is None else out.unionByName(part)
    return out


def p1_rows_with_key_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Per collection and bucket size class: how many index rows lie in buckets of that size (log2), found by joining
    each row of ``hash_chunks`` to its key's count; rows of heavy keys meet a broadcast."""
    rows = table(spark, sf, "hash_chunks").select("collection", "chunk_value")
    keys = heavy_keys(rows, "chunk_value")
    joined = skew_join(rows, skew_counts(rows, "chunk_value"), "chunk_value", keys=keys)
    return joined.groupBy("collection", F.floor(F.log2(F.col("n_rows"))).cast("int").alias("size_class")).agg(F.count(F.lit(1)).alias("n_index_rows"))


QUERIES = {"p1_found": p1_found, "p1_key_profile": p1_key_profile, "p1_rows_with_key_counts": p1_rows_with_key_counts}

_PROFILE = "select '{t}' as table_name, cast({k} as varchar) as key_value, count(*) as n_rows, count(distinct mongo_id) as n_members, min(mongo_id) as first_member, max(mongo_id) as last_member from {t} where {k} is not null group by {k}"
_FOUND = "select '{t}' as table_name, cast({k} as varchar) as key_value from {t} where {k} is not null group by {k} having count(*) * 50 >= (select count(*) from {t})"

SQL = {
    "p1_found": " union all ".join(_FOUND.format(t=t, k=k) for t, k in KEYED),
    "p1_key_profile": " union all ".join(_PROFILE.format(t=t, k=k) for t, k in KEYED),
    "p1_rows_with_key_counts": "with c as (select chunk_value, count(*) as n from hash_chunks group by 1) select collection, cast(floor(log2(n)) as integer) as size_class, count(*) as n_index_rows from hash_chunks join c using (chunk_value) group by 1, 2",
}
