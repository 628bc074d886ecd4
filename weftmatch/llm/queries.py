"""The queries of the training-data problems that live in this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, materialize
from ..sources.tables import table
from .groups import item_keys, shared_key_groups
from .history import new_against_history
from .items import items
from .leaks import RUN, leaks
from .names import characters, name_links
from .packing import pack, token_sizes
from .plaintext import not_plain_fields, plain_fields
from .reading import reading_levels
from .survivors import ALIASES, VOTED, repeated, representatives


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of items of different batches that show the same media."""
    return new_against_history(items(spark, sf, "phash", "dhash", "video_signature"))


def p3_representatives(spark: SparkSession, sf: str) -> DataFrame:
    """The surviving record of every item key with two items or more. Items alone in their key are told by the keys, so
    that no other field of theirs is put together."""
    keys = materialize(items(spark, sf, "item_key").select("mongo_id", "item_key"), "keys")
    among = materialize(repeated(keys), "among")
    rows = materialize(items(spark, sf, "item_key", *VOTED, *ALIASES, among=among), "items")
    out = representatives(rows, table(spark, sf, "collection_dim"))
    for done in (keys, among, rows):
        discard(done)
    return out


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """The base record of each surviving record, both rounds of truth discovery made, where it dominates all others."""
    return p3_representatives(spark, sf).filter("dominant").select("item_key", "mongo_id")


def _named(spark: SparkSession, sf: str) -> DataFrame:
    """Names of every delivery; an item's deliveries have the same ones."""
    return table(spark, sf, "item_snapshots").filter("mongo_id is not null").select("mongo_id", "name", "name_aliases", "anime_name")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of items whose differing names mean the same character of the same series."""
    return name_links(_named(spark, sf))


def p4_characters(spark: SparkSession, sf: str) -> DataFrame:
    """Every item with a usable name and the character it was placed with."""
    return characters(_named(spark, sf))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of ``item_snapshots`` that are not in plain form."""
    return not_plain_fields(table(spark, sf, "item_snapshots"), "mongo_id", ["name", "anime_name"])


def p5_plain_names(spark: SparkSession, sf: str) -> DataFrame:
    """Every item's ``name`` and ``anime_name`` with their plain forms."""
    return plain_fields(table(spark, sf, "item_snapshots").select("mongo_id", "name", "anime_name").distinct(), ["name", "anime_name"])


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every item of a linked group of two or more with the group's smallest item."""
    keys = item_keys(table(spark, sf, "item_snapshots"))
    return shared_key_groups(keys, "mongo_id", "k")


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Every piece of every document's text with its container, for each kind of container."""
    return pack(token_sizes(table(spark, sf, "documents")), table(spark, sf, "container_specs"))


def p8_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Affected documents and held-out items with the figures of their tiling, reordered passages included."""
    return leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with ``RUN`` consecutive words of a held-out item, or all of a shorter one."""
    return p8_leaks(spark, sf).filter(F.col("longest_run") >= F.least(F.lit(RUN), "item_words")).select("doc_id", "item_id")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its reading level."""
    return reading_levels(table(spark, sf, "documents"), table(spark, sf, "reading_labels")).select("doc_id", "reading_level")


QUERIES = {
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_representatives": p3_representatives,
    "p4_found": p4_found,
    "p4_characters": p4_characters,
    "p5_found": p5_found,
    "p5_plain_names": p5_plain_names,
    "p6_found": p6_found,
    "p7_containers": p7_containers,
    "p8_found": p8_found,
    "p8_leaks": p8_leaks,
    "p9_found": p9_found,
}
