"""Hamming search by multi-index hashing: chunk keys, candidates, verification.

A 64-bit hash is cut into ``n`` chunks. Two hashes at most ``t`` bits apart share a chunk whenever n > t, so an equi-join
on (position, chunk) finds every pair and the distance is verified inside that join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hexbits import bits64, chunks64, hamming64
from ..session import small
from .cells import in_cells, union_cell
from .skew import skew_pairs

#: Chunk counts kept by the persisted index.
COUNTS = (9, 13, 17)
#: Chunks of probes and of items of one cell in which candidates are counted, about.
CELL = (1 << 18, 1 << 19)


def chunk_count(t: int, compat: bool = False) -> int:
    """The number of chunks for distance ``t``: the least of ``COUNTS`` above it, else t + 1. With ``compat`` the one
    nearest to t + 1, smaller first, which may miss pairs."""
    if compat:
        return min(COUNTS, key=lambda n: (abs(n - t - 1), n))
    return next((n for n in COUNTS if n > t), t + 1)


def chunk_rows(items: DataFrame, field: str, n: int) -> DataFrame:
    """(collection, mongo_id, bits, position, chunk) of every item whose ``field`` is a 64-bit hash."""
    rows = items.select("collection", "mongo_id", bits64(F.col(field)).alias("bits")).filter("bits is not null")
    return rows.select("*", F.inline(chunks64(F.col("bits"), n)))


def index_rows(items: DataFrame, fields: tuple[str, ...] = ("phash", "dhash"), counts: tuple[int, ...] = COUNTS) -> DataFrame:
    """The chunk index: collection, field, chunk_count, position, chunk_value (a decimal number), mongo_id, bits."""
    out = None
    for field in fields:
        for n in counts:
            part = chunk_rows(items, field, n).select("collection", F.lit(field).alias("field"), F.lit(n).alias("chunk_count"), "position", F.col("chunk").cast("string").alias("chunk_value"), "mongo_id", "bits")
            out = part if out is None else out.unionByName(part)
    return out


def write_index(items: DataFrame, path: str, fields: tuple[str, ...] = ("phash", "dhash"), counts: tuple[int, ...] = COUNTS) -> None:
    """Persist the chunk index by field and chunk count: a search reads the part that it needs."""
    rows = index_rows(items, fields, counts)
    rows.hint("rebalance", "field", "chunk_count").sortWithinPartitions("position", "chunk_value").write.mode("overwrite").partitionBy("field", "chunk_count").parquet(path)


def updated_index(index: DataFrame, changed: DataFrame, fields: tuple[str, ...] = ("phash", "dhash"), counts: tuple[int, ...] = COUNTS) -> DataFrame:
    """The index after items changed: all their old rows go, their new ones come."""
    new = index_rows(changed, fields, counts)
    return index.join(changed.select("collection", "mongo_id").distinct(), ["collection", "mongo_id"], "left_anti").unionByName(new)


def _chunk_key(position: Column, chunk: Column) -> Column:
    return position.cast("bigint") * F.lit(1 << 40) + chunk.cast("bigint")


def hamming_search(probes: DataFrame, items: DataFrame, field: str, t: int, compat: bool = False, index: DataFrame | None = None) -> DataFrame:
    """(probe_id, collection, mongo_id, distance) of every item within ``t`` bits of a probe.

    ``probes`` has probe_id and ``field``. Malformed and null hashes match nothing; only hashes of 64 bits are searched.
    A persisted ``index`` is read where it has the chunk count that ``t`` needs; chunks that crowd are split."""
    n = chunk_count(t, compat)
    asked = probes.select("probe_id", bits64(F.col(field)).alias("pb")).filter("pb is not null").select("*", F.inline(chunks64(F.col("pb"), n)))
    if index is None:
        held = chunk_rows(items, field, n).select("collection", "mongo_id", "bits", _chunk_key(F.col("position"), F.col("chunk")).alias("key"))
    else:
        if n not in COUNTS:
            raise ValueError(f"the index has no {n} chunks")
        held = index.filter((F.col("field") == field) & (F.col("chunk_count") == n)).select("collection", "mongo_id", "bits", _chunk_key(F.col("position"), F.col("chunk_value")).alias("key"))
    pairs = skew_pairs(asked.select("probe_id", "pb", _chunk_key(F.col("position"), F.col("chunk")).alias("key")), held, "key")
    near = pairs.withColumn("distance", hamming64(F.col("pb"), F.col("bits"))).filter(F.col("distance") <= t)
    return near.select("probe_id", "collection", "mongo_id", "distance").distinct()


def candidate_counts(asked: DataFrame, held: DataFrame) -> DataFrame:
    """``probe_id``, ``n_candidates``: how many different items of ``held`` (position, chunk_value, mongo_id) share a
    chunk with each probe of ``asked`` (probe_id, position, chunk_value). Every item is in one cell, where a probe's
    candidates are marked and counted, so they are never rows. Nulls match nothing; repeated rows count once."""
    whole = "position is not null and chunk_value is not null"
    found = in_cells(asked.filter(whole).filter("probe_id is not null"), held.filter(whole).filter("mongo_id is not null"), union_cell, "probe_id string, n bigint", block=CELL)
    return found.filter("n > 0").groupBy("probe_id").agg(F.sum("n").alias("n_candidates"))


def capped(candidates: DataFrame, order: DataFrame, most: int) -> DataFrame:
    """At most ``most`` candidates of each probe, by collection order and id: the limit is part of this operator's
    meaning, and the order makes it repeatable."""
    ranked = candidates.join(small(order.select("collection", "ord")), "collection", "left")
    w = W.partitionBy("probe_id").orderBy(F.col("ord").asc_nulls_last(), "mongo_id")
    return ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).drop("ord")
