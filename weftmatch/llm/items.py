"""Common views of the item table: one row per item, real values, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small
from ..sources.tables import table

# Words that stand for "no value".
STAND_INS = ("-", "--", "?", "??", "???", "n/a", "na", "null", "none", "nil", "unknown", "tbd", "untitled", "no name", "noname", "undefined", "nan", ".", "...", "_")


def real(column: Column) -> Column:
    """Whether a value is neither null, blank nor a stand-in for "no value"."""
    text = F.lower(F.trim(column.cast("string")))
    return F.coalesce((text != "") & ~text.isin(*STAND_INS), F.lit(False))


def items(spark: SparkSession, sf: str, *columns: str, among: DataFrame | None = None) -> DataFrame:
    """One row per ``mongo_id`` with its lowest ``batch_no``, its latest ``updated_at`` and ``columns``, which are the
    same in all of an item's rows. Rows without a ``mongo_id`` name no item. ``among``: a table of ``mongo_id``, written
    out; other items are left out before their rows are put together."""
    rows = table(spark, sf, "item_snapshots").filter("mongo_id is not null")
    if among is not None:
        rows = rows.join(small(among), "mongo_id", "left_semi")
    return rows.groupBy("mongo_id").agg(F.min("batch_no").alias("batch_no"), F.max("updated_at").alias("updated_at"), *[F.first(c, ignorenulls=True).alias(c) for c in columns])
