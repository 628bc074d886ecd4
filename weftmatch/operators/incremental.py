"""Keeping tables current: upserts, deltas, throttles, ordered folds."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one that comes last in ``order`` (nulls first). Aggregates before it shuffles."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*rows.columns)


def upsert(stored: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``stored`` with ``changes`` applied, last write by ``order`` winning. Applying the same changes again, or in
    other pieces, gives the same table."""
    return latest(stored.unionByName(changes), keys, order)


def merge_seen(rows: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Per key the first and last time seen: created_at is kept from the first write, updated_at follows the last."""
    return rows.groupBy(*keys).agg(F.min(at).alias("created_at"), F.max(at).alias("updated_at"))


def apply_log(log: DataFrame, keys: Sequence[str], order: Sequence[str], op: str, removed: str) -> DataFrame:
    """The state after a log of additions and removals: the last entry of each key, unless it is a removal."""
    return latest(log, keys, order).filter(F.col(op) != removed)


def insert_missing(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet."""
    return new.join(stored.select(*keys), list(keys), "left_anti")


def advance_watermark(current: Column, batch_end: Column, failed: Column) -> Column:
    """The next high-water mark: unchanged when any part of the batch failed, and never backwards."""
    return F.when(failed, current).otherwise(F.greatest(current, batch_end))


def _pieces(once: DataFrame, keys: Sequence[str], at: str, ttl_s: float, slot: str) -> DataFrame:
    """``once`` with ``__piece``, the start of its run of events with gaps of at most ``ttl_s``.

    Windows run over (key, ``slot`` of time) and, for what one slot hands to the next, over the slots of a key, so no
    task sees all events of a hot key."""
    span = int(ttl_s * 1_000_000)
    rows = once.withColumn("__t", F.unix_micros(at)).withColumn("__slot", F.date_trunc(slot, F.col(at)))
    ends = rows.groupBy(*keys, "__slot").agg(F.max("__t").alias("__end"))
    over = W.partitionBy(*keys).orderBy("__slot")
    ends = ends.withColumn("__before", F.lag("__end").over(over)).drop("__end")
    inside = W.partitionBy(*keys, "__slot").orderBy("__t")
    rows = rows.join(ends, [*keys, "__slot"])
    gap = F.col("__t") - F.coalesce(F.lag("__t").over(inside), "__before")
    rows = rows.withColumn("__start", F.when(gap.isNull() | (gap > span), F.col("__t")))
    rows = rows.withColumn("__own", F.max("__start").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    starts = rows.groupBy(*keys, "__slot").agg(F.max("__start").alias("__last"))
    starts = starts.withColumn("__carried", F.max("__last").over(over.rowsBetween(W.unboundedPreceding, -1))).drop("__last")
    return rows.join(starts, [*keys, "__slot"]).select(*keys, at, "__t", F.coalesce("__own", "__carried").alias("__piece"))


def ttl_dedupe(events: DataFrame, keys: Sequence[str], at: str, ttl_s: float, slot: str = "day") -> DataFrame:
    """Events let through by a per-key window of ``ttl_s`` seconds that repetitions don't extend: keys and time, once.

    The rule is sequential. A key's events are cut where a gap of more than ``ttl_s`` makes the past irrelevant, and
    each piece is streamed in order of time, keeping one number. Keys and times must not be null; such rows drop out."""
    span = int(ttl_s * 1_000_000)
    once = events.select(*keys, at).dropna().distinct()
    pieces = _pieces(once, keys, at, ttl_s, slot)
    names = [*keys, "__piece"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, 0
        for frame in frames:
            marks, times = frame[names].to_numpy(), frame["__t"].to_numpy()
            fresh = np.append(True, (marks[1:] != marks[:-1]).any(1)) if len(frame) else np.zeros(0, bool)
            bounds = [*np.flatnonzero(fresh), len(frame)]
            keep = np.zeros(len(frame), bool)
            for lo, hi in itertools.pairwise(bounds):
                mark = tuple(marks[lo])
                i = lo if mark != now else lo + int(np.searchsorted(times[lo:hi], last + span, "right"))
                while i < hi:
                    keep[i], last = True, int(times[i])
                    i = lo + int(np.searchsorted(times[lo:hi], last + span, "right"))
                now = mark
            yield frame.loc[keep, [*keys, at]]

    schema = ", ".join(f"`{n}` {t}" for n, t in once.dtypes)
    return pieces.repartition(*names).sortWithinPartitions(*names, "__t").mapInPandas(run, schema)


def ttl_lookup(reads: DataFrame, writes: DataFrame, keys: Sequence[str], at: str, ttl_s: float, value: str = "value") -> DataFrame:
    """``reads`` with ``value`` of the last write of their key before them that has not expired: a write lives ``ttl_s``
    seconds, reading does not prolong it, and it is gone at its very end. A write at the time of a read comes first; of
    writes at one time the largest value holds. Null keys or times find nothing.

    Time is cut into slots of one lifetime, so that a read needs the last write of the slot before and those of its own."""
    span = int(ttl_s * 1_000_000)
    slot = F.floor(F.unix_micros(at) / F.lit(span))
    made = writes.select(*keys, F.unix_micros(at).alias("__at"), F.col(value).alias("__v"), slot.alias("__slot")).dropna(subset=[*keys, "__at"])
    last = made.groupBy(*keys, "__slot").agg(F.max(F.struct("__at", "__v")).alias("__last")).withColumn("__slot", F.col("__slot") + 1)
    none = F.lit(None).cast(made.schema["__v"].dataType)
    asked = reads.withColumns({"__at": F.unix_micros(at), "__slot": slot, "__set": F.lit(1), "__v": none})
    both = asked.unionByName(made.select(*keys, "__at", "__slot", F.lit(0).alias("__set"), "__v"), allowMissingColumns=True)
    order = W.partitionBy(*keys, "__slot").orderBy("__at", "__set", "__v").rowsBetween(W.unboundedPreceding, 0)
    own = F.last(F.when(F.col("__set") == 0, F.struct("__at", "__v")), ignorenulls=True).over(order)
    seen = both.withColumn("__own", own).filter("__set = 1").join(last, [*keys, "__slot"], "left")
    hit = F.coalesce("__own", "__last")
    alive = hit["__at"] + span > F.col("__at")
    return seen.withColumn(value, F.when(alive, hit["__v"])).select(*[c for c in reads.columns if c != value], value)


def parsed_mark(text: Column) -> Column:
    """A high-water mark from ISO text: without a zone it is UTC (the session's zone), unreadable text gives null."""
    return F.trim(text).try_cast("timestamp")


def ema(values: Column, alpha: float = 0.15) -> Column:
    """Exponential moving average of an ordered array; 0 counts as "nothing yet", so the next value replaces it."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: F.when(a == 0, x).otherwise(F.lit(alpha) * x + F.lit(1 - alpha) * a))


def ordered_ema(events: DataFrame, keys: Sequence[str], at: str, tie: str, value: str, alpha: float = 0.15, slot: str = "hour") -> DataFrame:
    """``keys`` and ``ema`` of ``value`` in order of ``at`` and ``tie``, without bringing a long key into one task.

    The average is linear in its start, so each ``slot`` of time is folded alone to (weight of the start, rest), and
    a key's slot results are chained. Exact for positive values; rows without time or value are skipped."""
    rows = events.filter(F.col(value).isNotNull() & F.col(at).isNotNull())
    group = [*keys, F.date_trunc(slot, F.col(at)).alias("__b")]
    runs = rows.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at), F.col(tie), F.col(value).cast("double").alias("v")))), lambda x: x["v"]).alias("__x"))
    step = lambda a, x: F.lit(alpha) * x + F.lit(1 - alpha) * a
    parts = runs.select(*keys, "__b", F.pow(F.lit(1 - alpha), F.size("__x")).alias("__k"), F.aggregate("__x", F.lit(0.0), step).alias("__r"), F.aggregate(F.slice("__x", 2, 1 << 30), F.col("__x")[0], step).alias("__s"))
    chain = F.array_sort(F.collect_list(F.struct("__b", "__k", "__r", "__s")))
    out = parts.groupBy(*keys).agg(chain.alias("__c"))
    return out.select(*keys, F.aggregate(F.slice("__c", 2, 1 << 30), F.try_element_at("__c", F.lit(1))["__s"], lambda a, x: x["__k"] * a + x["__r"]).alias("ema"))
