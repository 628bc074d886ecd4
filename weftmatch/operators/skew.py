"""Per-key work where a few keys hold most rows.

Method: a mergeable frequent-items sketch finds the heavy keys in one pass; rows of heavy keys are handled by a
broadcast join and salted aggregation, all other rows by an ordinary shuffle; the two results are united.

The sketch keeps ``MAP_SIZE`` counters, so every key with at least 3.5 / MAP_SIZE of the rows is found whatever the
data's size; the heavy set has at most 1 / share keys, which bounds what is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counters of the frequent-items sketch. Keys below 3.5 / MAP_SIZE of the rows may be missed, which only means that
#: they go through the ordinary shuffle.
MAP_SIZE = 16_384
#: The least share of all rows at which a key counts as heavy.
HEAVY_SHARE = 0.002
#: Tasks over which one heavy key's rows are spread.
SALTS = 64


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE) -> list:
    """The values of ``key`` that may hold at least ``share`` of all rows, at most 2 / share of them.

    Null is no key. An empty table has no heavy keys. Only the sketch's answer reaches the driver; counts are upper
    estimates, so a key just below ``share`` can be among the result, while none at or above it is missing."""
    if share < 4 / MAP_SIZE:
        raise ValueError(f"share {share} is below what {MAP_SIZE} counters can tell")
    name = "`" + key.replace("`", "``") + "`"
    most = int(2 / share)
    row = df.agg(F.expr(f"approx_top_k({name}, {most}, {MAP_SIZE})").alias("top"), F.count(F.lit(1)).alias("n")).head()
    floor = max(2, share * (row["n"] or 0))
    return [x["item"] for x in (row["top"] or []) if x["item"] is not None and x["count"] >= floor]


def _is_heavy(key: str, keys: list) -> Column:
    return F.coalesce(F.col(key).isin(keys), F.lit(False)) if keys else F.lit(False)


def _broadcast_keys(df: DataFrame, key: str, keys: list) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame([(k,) for k in keys], f"__hk {df.schema[key].dataType.simpleString()}"))


def skew_aggregate(df: DataFrame, key: str, partial: Callable[[DataFrame, Sequence[str]], DataFrame], merge: Callable[[DataFrame, Sequence[str]], DataFrame], whole: Callable[[DataFrame, Sequence[str]], DataFrame], salt: Column, share: float = HEAVY_SHARE) -> DataFrame:
    """One row per non-null value of ``key``, heavy keys in two steps over ``SALTS`` tasks each.

    ``whole(df, by)`` aggregates in one step and serves the light keys; ``partial`` and ``merge`` are its two-step
    form for the heavy ones: ``partial`` sees rows grouped by key and ``salt``, ``merge`` sees its results. All rows
    that must meet in ``partial`` (the same value of a distinct count, say) must have one ``salt``. Repeated rows
    count as often as they occur; an empty table gives an empty result."""
    rows = df.filter(F.col(key).isNotNull())
    keys = heavy_keys(rows, key, share)
    if not keys:
        return whole(rows, [key])
    heavy = rows.join(_broadcast_keys(rows, key, keys), F.col(key) == F.col("__hk"), "left_semi")
    light = rows.join(_broadcast_keys(rows, key, keys), F.col(key) == F.col("__hk"), "left_anti")
    first = partial(heavy.withColumn("__salt", F.pmod(salt, F.lit(SALTS))), [key, "__salt"])
    return merge(first, [key]).unionByName(whole(light, [key]))


def skew_counts(df: DataFrame, key: str, share: float = HEAVY_SHARE) -> DataFrame:
    """``key``, ``n_rows``: the exact number of rows of every non-null key."""
    count = lambda d, by: d.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))
    add = lambda d, by: d.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"))
    return skew_aggregate(df, key, count, add, count, F.monotonically_increasing_id(), share)


def skew_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner", share: float = HEAVY_SHARE, keys: list | None = None) -> DataFrame:
    """``left`` joined to ``right`` (``inner`` or ``left``), where ``right`` holds at most one row per key.

    Rows of ``left`` with heavy keys meet a broadcast of the right rows of those keys (at most 2 / share of them);
    all others are shuffled. Null keys match nothing and, under ``left``, stay. Columns of ``right`` other than the
    key must not occur in ``left``."""
    if how not in ("inner", "left"):
        raise ValueError(how)
    clash = (set(left.columns) & set(right.columns)) - {on}
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    keys = heavy_keys(left, on, share) if keys is None else keys
    if not keys:
        return left.join(right, on, how)
    hot = _is_heavy(on, keys)
    a = left.filter(hot).join(F.broadcast(right.filter(hot)), on, how)
    b = left.filter(~hot).join(right.filter(~hot), on, how)
    return a.unionByName(b)


#: Cells per side into which the pairs of one heavy key are split: 8 x 8 tasks, each row sent to 8 of them.
GRID = 8


def skew_pairs(left: DataFrame, right: DataFrame, on: str, share: float = HEAVY_SHARE, keys: list | None = None, grid: int = GRID) -> DataFrame:
    """The inner join of ``left`` and ``right`` on ``on`` where both sides may hold many rows of one key.

    Rows of heavy keys (by a sketch of ``right``, the larger side, unless ``keys`` names them) meet in a grid: a row of
    ``left`` has one of ``grid`` lines by a hash of its content and goes to every column of it, a row of ``right`` the
    other way round, so each pair meets once and no task holds more than a cell. All other rows are shuffled once.
    Null keys match nothing. Columns other than the key must not occur on both sides."""
    clash = (set(left.columns) & set(right.columns)) - {on}
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    keys = heavy_keys(right, on, share) if keys is None else keys
    if not keys:
        return left.join(right, on)
    hot, lines = _is_heavy(on, keys), F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))
    cell = lambda d: F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in d.columns]), F.lit(grid)).cast("int")
    a = left.filter(hot).withColumn("__line", cell(left)).withColumn("__column", lines)
    b = right.filter(hot).withColumn("__column", cell(right)).withColumn("__line", lines)
    met = a.join(b, [on, "__line", "__column"]).drop("__line", "__column")
    return met.unionByName(left.filter(~hot).join(right.filter(~hot), on))
