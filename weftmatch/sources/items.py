"""Reading raw documents into the canonical item schema, and storing items.

Raw documents carry many names for one field; ``ALIASES`` lists them in order of preference. A document without a name
gives no item. Unreadable numbers become 0 or null instead of failing the whole read; ``is_bad`` marks such rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import normalize as N
from ..session import small

# The names that one field goes by in raw documents, in order.
ALIASES = {
    "name": ("name", "character_name", "char_name", "item_name", "card_name", "display_name", "title", "media.name", "character.name"),
    "anime_name": ("anime_name", "anime", "series", "movie", "category", "media.series", "character.series"),
    "card_id": ("card_id", "id", "item_id", "char_id", "character_id", "media.id", "character.id"),
    "rarity": ("rarity", "rank", "tier", "class", "media.rarity", "character.rarity"),
    "file_unique_id": ("file_unique_id", "photo_file_unique_id", "video_file_unique_id", "media.file_unique_id", "file.unique_id"),
    "sha256": ("sha256", "media_sha256", "hash", "file_hash", "media.sha256", "file.sha256"),
    "phash": ("photo_fingerprint.phash", "phash", "photo_phash", "image_phash", "media.phash", "file.phash"),
    "frame_hashes": ("frame_hashes", "video_frame_hashes", "frames", "media.frame_hashes", "file.frame_hashes"),
    "media_type": ("media_type", "type", "media.type"),
}


def _has(df: DataFrame, path: str) -> bool:
    kind = df.schema
    for part in path.split("."):
        if not hasattr(kind, "fieldNames") or part not in kind.fieldNames():
            return False
        kind = kind[part].dataType
    return True


def _present(df: DataFrame, field: str) -> list[Column]:
    return [F.col(p) for p in ALIASES[field] if _has(df, p)] or [F.lit(None).cast("string")]


def _at(df: DataFrame, path: str, kind: str = "string") -> Column:
    return F.col(path) if _has(df, path) else F.lit(None).cast(kind)


def _type(df: DataFrame, path: str) -> T.DataType:
    kind = df.schema
    for part in path.split("."):
        kind = kind[part].dataType
    return kind


def frame_list(df: DataFrame, path: str) -> Column:
    """The frame hashes at ``path`` as a list, null where there are none: of a list, of a map's values, of a text with
    commas, or of structs, which may call the hash by either of three names."""
    kind, value = _type(df, path), F.col(path)
    if isinstance(kind, T.StringType):
        return F.when(value != "", F.split(value, ","))
    if isinstance(kind, T.MapType):
        kind, value = T.ArrayType(kind.valueType), F.map_values(value)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        names = [n for n in ("hash", "phash", "value") if n in kind.elementType.fieldNames()]
        one = lambda x: F.coalesce(*[F.nullif(x[n].cast("string"), F.lit("")) for n in names]) if names else F.lit(None).cast("string")
        value = F.transform(value, one)
    return F.when(F.size(value) > 0, value.cast(N.STRINGS))


def parse_items(raw: DataFrame, collections: DataFrame | None = None) -> DataFrame:
    """Canonical items of raw documents with ``_id`` and ``collection``; any of the aliases may be missing.

    ``collections`` (``collection``, ``default_command``) gives the command of documents without one."""
    have = lambda f: N.first_present(*[c.cast("string") for c in _present(raw, f)])
    frames = N.frame_hashes(F.coalesce(*[frame_list(raw, p) for p in ALIASES["frame_hashes"] if _has(raw, p)], F.array().cast(N.STRINGS)))
    vf, pf = _at(raw, "video_fingerprint"), _at(raw, "photo_fingerprint")
    phash = have("phash")
    measure = lambda f: N.nonzero_first(_at(raw, f"video_fingerprint.{f}").cast("string"), _at(raw, f"media_geometry.{f}").cast("string"))
    bad = lambda f: F.coalesce(_at(raw, f"video_fingerprint.{f}").cast("string").isNotNull() & _at(raw, f"video_fingerprint.{f}").cast("string").try_cast("double").isNull(), F.lit(False))
    out = raw.select(
        F.col("_id").cast("string").alias("mongo_id"),
        F.lower(F.trim("collection")).alias("collection"),
        N.clean(_at(raw, "command_name")).alias("command"),
        N.normalize_name(F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in _present(raw, "name")])).alias("name"),
        *[have(f).alias(f) for f in ("card_id", "rarity", "anime_name")],
        N.media_type(F.coalesce(*[F.nullif(c, F.lit("")) for c in _present(raw, "media_type")]), (F.size(frames) > 0) | vf.isNotNull(), phash.isNotNull() | pf.isNotNull()).alias("media_type"),
        N.clean(_at(raw, "item_key")).alias("item_key"),
        N.string_list(_at(raw, "name_aliases", N.STRINGS)).alias("name_aliases"),
        have("file_unique_id").alias("file_unique_id"),
        N.string_list(_at(raw, "file_unique_ids", N.STRINGS)).alias("file_unique_ids"),
        have("sha256").alias("sha256"),
        N.string_list(_at(raw, "sha256_aliases", N.STRINGS)).alias("sha256_aliases"),
        phash.alias("phash"),
        *[N.clean(_at(raw, f"photo_fingerprint.{f}")).alias(f) for f in ("pixel_sha256", "phash_large", "dhash", "whash", "colorhash", "crop_hash")],
        frames.alias("frame_hashes"),
        N.video_samples(_at(raw, "video_fingerprint.sample_hashes", N.SAMPLES)).alias("video_samples"),
        N.clean(_at(raw, "video_fingerprint.video_signature")).alias("video_signature"),
        N.clean(_at(raw, "fingerprint_version")).alias("fingerprint_version"),
        *[measure(f).alias(f) for f in ("duration_ms", "frame_count", "width", "height")],
        F.coalesce(_at(raw, "video_fingerprint.fps").try_cast("double"), _at(raw, "media_geometry.fps").try_cast("double"), F.lit(0.0)).alias("fps"),
        *[N.int_or_null(_at(raw, f"source_origin.{f}")).alias(f"origin_{f}") for f in ("chat_id", "message_id")],
        *[F.coalesce(F.nullif(N.int_or_null(_at(raw, f"archive.{f}")), F.lit(0).cast("bigint")), N.int_or_null(_at(raw, f"archive_{f}"))).alias(f"archive_{f}") for f in ("chat_id", "message_id")],
        _at(raw, "updated_at", "timestamp").alias("updated_at"),
        (bad("duration_ms") | bad("frame_count")).alias("is_bad"),
    ).filter("name is not null")
    if collections is None:
        return out
    return out.join(small(collections.select("collection", "default_command")), "collection", "left").withColumn("command", F.coalesce("command", "default_command")).drop("default_command")


def delta(items: DataFrame, after: Column, until: Column, at: str = "updated_at") -> DataFrame:
    """Rows with ``after`` < time <= ``until``; rows without a time are only in full scans."""
    return items.filter((F.col(at) > after) & (F.col(at) <= until))


def by_ids(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Items whose (collection, mongo_id) is among ``ids``, once each however often they are asked for."""
    return items.join(ids.select("collection", "mongo_id"), ["collection", "mongo_id"], "left_semi")


def write_items(items: DataFrame, path: str) -> None:
    """Store items by collection; collections that are not in ``items`` keep what they have."""
    items.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(path)


def read_items(spark: SparkSession, path: str, collections: list[str] | None = None) -> DataFrame:
    """Stored items, of some collections only where given (their folders alone are read)."""
    out = spark.read.parquet(path)
    return out if not collections else out.filter(F.col("collection").isin(collections))


def to_payload(items: DataFrame, column: str = "item_json") -> DataFrame:
    """Items as (collection, mongo_id, JSON text)."""
    return items.select("collection", "mongo_id", F.to_json(F.struct(*items.columns)).alias(column))


def from_payload(rows: DataFrame, schema: str, column: str = "item_json") -> DataFrame:
    """Items of JSON texts; unreadable text gives no item, unknown keys are ignored."""
    return rows.select(F.from_json(column, schema).alias("item")).filter("item is not null and item.mongo_id is not null").select("item.*")
