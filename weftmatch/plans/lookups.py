"""Queries of the lookup engine over whole tables, with their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions.hexbits import hamming_hex, normalized_hamming
from ..operators import attribution, bands, exact, incremental, messages, mih, score, stats
from ..operators.lookup import lookup, photo_lookup, video_lookup
from ..session import materialize
from ..sources.items import by_ids, delta, from_payload, to_payload
from ..sources.tables import table

#: Probes of searches: items whose number is divisible by this, looked up against all items.
EVERY = 50
LIMITS = score.Limits(special="items_stray_album")
CONTENT_RULES = (("took\\s+\\d+\\s+ms", "log"), ("\\bID\\b\\s*\\d+", "card"), ("please\\s+read", "notice"), ("build\\s+\\d", "release"))
CUSTOM_RULES = (("seen:|wanted:", "trade"), ("# |chat", "heading_chat"), ("/", "command"))
CUSTOM_COMMANDS = (("@feed_19", "/ember"), ("seen:|wanted:", "/moon"), ("# |chat", "/paper"), ("/", "/lookup"))
HIDDEN = ("/amber", "/copper")


def catalogue(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Items as they are now, one row each, with ``collection`` in one spelling."""
    rows = table(spark, sf, "item_snapshots").filter("mongo_id is not null")
    picked = [F.first(c, ignorenulls=True).alias(c) for c in columns]
    out = rows.groupBy("mongo_id").agg(F.min("batch_no").alias("batch_no"), F.max("updated_at").alias("updated_at"), F.first("collection", ignorenulls=True).alias("collection"), *picked)
    return out.withColumn("collection", F.lower(F.trim("collection")))


def order(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "collection_dim").select("collection", "ord")


def is_probe(number: Column) -> Column:
    return number % EVERY == 0


def item_probes(items: DataFrame) -> DataFrame:
    return items.filter(is_probe(F.conv(F.substring("mongo_id", -8, 8), 16, 10).cast("bigint"))).withColumn("probe_id", F.col("mongo_id"))


def without_own(probes: DataFrame) -> DataFrame:
    """Probes that don't match the item they were made from."""
    return probes.withColumn("not_id", F.col("mongo_id"))


KEYS = ("file_unique_id", "file_unique_ids", "sha256", "sha256_aliases", "pixel_sha256", "video_signature", "origin_chat_id", "origin_message_id")


def exact_sha_lookup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    first = docs.groupBy("sha256").agg(F.min("doc_id").alias("first_doc_id"), F.count(F.lit(1)).alias("n_copies"))
    return docs.join(first, "sha256").select("doc_id", "first_doc_id", "n_copies")


def _delta_probes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    items = catalogue(spark, sf, *KEYS)
    probes = items.filter("batch_no > 0").withColumn("probe_id", F.col("mongo_id")).withColumn("scope", F.array("collection"))
    return probes, items.filter("batch_no = 0")


def exact_cascade_ranked(spark: SparkSession, sf: str) -> DataFrame:
    probes, items = _delta_probes(spark, sf)
    return exact.exact_lookup(probes, items, order(spark, sf))


def exact_scoped_only(spark: SparkSession, sf: str) -> DataFrame:
    probes, items = _delta_probes(spark, sf)
    return exact.exact_lookup(probes, items, order(spark, sf), global_fallback=False).select("probe_id", "collection", "mongo_id", "reason")


def unresolved_probes(spark: SparkSession, sf: str) -> DataFrame:
    probes, items = _delta_probes(spark, sf)
    return exact.unresolved(probes, exact.exact_lookup(probes, items, order(spark, sf))).select("probe_id", "collection")


def writers_by_key(spark: SparkSession, sf: str) -> DataFrame:
    keys = exact.item_keys(catalogue(spark, sf, *KEYS))
    first = exact.global_index(keys, order(spark, sf)).select("kind", "value", F.col("collection").alias("first_collection"), F.col("mongo_id").alias("first_id"))
    return exact.scoped_index(keys).withColumnRenamed("mongo_id", "last_id").join(first, ["kind", "value"])


def items_that_were_hit(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "lookup_events").filter("hit and mongo_id is not null").select("collection", "mongo_id")
    return by_ids(catalogue(spark, sf), hits).select("collection", "mongo_id")


def _hashes(items: DataFrame) -> DataFrame:
    return items.select("collection", "mongo_id", *[N.clean(h).alias(h) for h in score.WEIGHTS])


def hamming_search_phash(spark: SparkSession, sf: str) -> DataFrame:
    items = catalogue(spark, sf, "phash")
    return mih.hamming_search(item_probes(items), items, "phash", 8)


def hamming_search_dhash(spark: SparkSession, sf: str) -> DataFrame:
    items = catalogue(spark, sf, "dhash")
    return mih.hamming_search(item_probes(items), items, "dhash", 12)


def mih_candidate_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "hash_chunks").filter("field = 'phash' and chunk_count = 9").select("position", "chunk_value", "mongo_id")
    return mih.candidate_counts(item_probes(rows).select("probe_id", "position", "chunk_value").distinct(), rows)


def hash_chunk_index(spark: SparkSession, sf: str) -> DataFrame:
    index = mih.index_rows(catalogue(spark, sf, "phash", "dhash"))
    return index.groupBy("field", "chunk_count", "position").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("chunk_value").alias("n_values"), F.sum(F.col("chunk_value").cast("bigint")).alias("total"))


def hash_distances(spark: SparkSession, sf: str) -> DataFrame:
    items = catalogue(spark, sf, "phash", "dhash")
    return items.select("mongo_id", hamming_hex(F.col("phash"), F.col("dhash")).cast("int").alias("distance"), F.round(normalized_hamming(F.col("phash"), F.col("dhash")), 6).alias("share")).filter("distance is not null")


def _photos(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    items = _hashes(catalogue(spark, sf, *score.WEIGHTS))
    return item_probes(items).withColumn("scope", F.lit(None).cast("array<string>")), items


def photo_weighted_top1(spark: SparkSession, sf: str) -> DataFrame:
    probes, items = _photos(spark, sf)
    return photo_lookup(without_own(probes), items, order(spark, sf), LIMITS)


def photo_strict_top1(spark: SparkSession, sf: str) -> DataFrame:
    probes, items = _photos(spark, sf)
    return photo_lookup(without_own(probes), items, order(spark, sf), LIMITS, global_mode=True)


def photo_single_hash_top1(spark: SparkSession, sf: str) -> DataFrame:
    probes, items = _photos(spark, sf)
    return photo_lookup(probes, items.filter("dhash is null"), order(spark, sf), LIMITS)


def _videos(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    items = stats.with_media_type(catalogue(spark, sf, "video_samples", "frame_hashes", "duration_ms", "media_type", "phash"))
    return item_probes(items).withColumn("scope", F.lit(None).cast("array<string>")), items


def video_multiframe_top1(spark: SparkSession, sf: str) -> DataFrame:
    probes, items = _videos(spark, sf)
    return video_lookup(probes, items, order(spark, sf), LIMITS)


def video_strict_top1(spark: SparkSession, sf: str) -> DataFrame:
    probes, items = _videos(spark, sf)
    return video_lookup(probes, items, order(spark, sf), LIMITS, global_mode=True)


def video_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest other video in the band, else of all, however far it is, so that every comparable probe has one."""
    probes, items = _videos(spark, sf)
    return video_lookup(without_own(probes), items, order(spark, sf), score.Limits(video_min=64, video_avg=64))


def full_lookup(spark: SparkSession, sf: str) -> DataFrame:
    items = materialize(stats.with_media_type(catalogue(spark, sf, *KEYS, *score.WEIGHTS, "video_samples", "frame_hashes", "duration_ms", "media_type")), "items")
    probes = items.filter("batch_no > 0").withColumn("probe_id", F.col("mongo_id")).withColumn("scope", F.array("collection"))
    return lookup(probes, items.filter("batch_no = 0"), order(spark, sf), LIMITS).withColumn("confidence", F.round("confidence", 6))


def duration_buckets(spark: SparkSession, sf: str) -> DataFrame:
    items = catalogue(spark, sf, "duration_ms")
    return items.groupBy(bands.duration_bucket(F.col("duration_ms")).alias("bucket")).agg(F.count(F.lit(1)).alias("n_items"))


def duration_band_counts(spark: SparkSession, sf: str) -> DataFrame:
    items = catalogue(spark, sf, "duration_ms").filter("duration_ms > 0").withColumn("bucket", bands.duration_bucket(F.col("duration_ms")))
    probes = item_probes(items).select("probe_id", F.col("bucket").alias("probe_bucket"))
    return bands.band_join(probes, items.select("mongo_id", "bucket"), 4).groupBy("probe_id").agg(F.count(F.lit(1)).alias("n_near"))


def candidate_cap(spark: SparkSession, sf: str) -> DataFrame:
    items = catalogue(spark, sf, "duration_ms").filter("duration_ms > 0").withColumn("bucket", bands.duration_bucket(F.col("duration_ms")))
    probes = item_probes(items).select("probe_id", F.col("bucket").alias("probe_bucket"))
    near = bands.band_join(probes, items.select("collection", "mongo_id", "bucket"), 1)
    return mih.capped(near.select("probe_id", "collection", "mongo_id"), order(spark, sf), 5).select("probe_id", "mongo_id", "rank")


def first_present_alias(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue(spark, sf, "card_id", "rarity", "command").select("mongo_id", N.first_present("card_id", "rarity", "command").alias("label"))


def string_lists(spark: SparkSession, sf: str) -> DataFrame:
    items = catalogue(spark, sf, "name_aliases", "file_unique_ids", "file_unique_id")
    return items.select("mongo_id", F.array_join(N.string_list("name_aliases"), "|").alias("aliases"), F.array_join(N.with_main("file_unique_ids", "file_unique_id"), "|").alias("uids"))


def media_type_canonical(spark: SparkSession, sf: str) -> DataFrame:
    items = stats.with_media_type(catalogue(spark, sf, "media_type", "phash", "frame_hashes", "video_samples"))
    return items.groupBy("collection", "media_type").agg(F.count(F.lit(1)).alias("n_items"))


def name_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit(" - : "), "c_name", F.lit("  x ")).alias("n"))
    return names.select("c_custkey", N.strip_noise("n").alias("name"), N.first_token("n").alias("first_token"))


def normalized_names(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue(spark, sf, "name").select("mongo_id", N.normalize_name("name").alias("name"), N.clean_title(N.stylised_fold("name")).alias("title")).filter("name is not null")


def text_scalars(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.sha2(N.html_escape("text"), 256).alias("escaped_sha"), N.username("source").alias("account"), N.clean_title("source").alias("title"), F.sha2(N.joined_text("kind", "text", "lang"), 256).alias("joined_sha"))


def content_rule_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    rule = F.coalesce(attribution.first_rule(CONTENT_RULES, F.col("text")), attribution.custom_rule(CUSTOM_RULES, F.col("text")), F.lit("none"))
    return docs.groupBy(rule.alias("rule"), "source").agg(F.count(F.lit(1)).alias("n_docs"))


def _known(spark: SparkSession, sf: str) -> list[str]:
    return attribution.known_commands(table(spark, sf, "collection_dim"), "default_command")


def commands_in_texts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", attribution.command_in(F.col("text"), _known(spark, sf)).alias("command"))
    known = table(spark, sf, "collection_dim").select(F.col("default_command").alias("command"), "collection")
    return docs.filter("command is not null").join(attribution.small(known), "command", "left").select("doc_id", "command", "collection")


def lookup_scopes(spark: SparkSession, sf: str) -> DataFrame:
    """Scope of every document as a probe: its collection, else the collections of the same trust as its command's."""
    dim = table(spark, sf, "collection_dim")
    pairs = dim.select(F.col("default_command").alias("command"), "trust_rank").join(attribution.small(dim.select("collection", "ord", "trust_rank")), "trust_rank")
    scopes = attribution.command_scopes(pairs).withColumnRenamed("scope", "command_scope")
    docs = table(spark, sf, "documents").select("doc_id", "source", N.clean("collection").alias("from_collection"), attribution.command_in(F.col("text"), _known(spark, sf)).alias("command"))
    docs = docs.join(attribution.small(scopes), "command", "left")
    scope = attribution.lookup_scope(F.col("source") == "relay_main", F.col("from_collection"), F.col("command"), F.col("command_scope"))
    return docs.select("doc_id", scope.alias("s")).select("doc_id", "s.mode", F.array_join("s.collections", "|").alias("collections"))


def title_sources(spark: SparkSession, sf: str) -> DataFrame:
    dim = table(spark, sf, "collection_dim").select(F.regexp_replace("collection", "^items_", "").alias("title"), "collection", "ord")
    items = catalogue(spark, sf).select("mongo_id", F.concat(F.lit("The "), F.regexp_replace("collection", "^items_", ""), F.lit(" Bot")).alias("heard"))
    return attribution.title_match(items, dim, "heard").select("mongo_id", "title_collection")


def message_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as messages from a chat named by their source, attributed by account, title and text rules."""
    dim = table(spark, sf, "collection_dim")
    accounts = dim.select(F.lit("username").alias("kind"), F.format_string("@feed_%02d", "ord").alias("key"), "collection")
    titles = dim.select(F.regexp_replace("collection", "^items_", "").alias("title"), "collection", "ord")
    chat = F.struct(F.lit(None).cast("bigint").alias("id"), F.col("source").alias("username"), F.concat_ws(" ", "kind", "collection").alias("title"))
    docs = table(spark, sf, "documents").select("doc_id", "text", chat.alias("sender_chat"))
    commands = {r["default_command"]: [r["collection"]] for r in attribution.small(dim).limit(1000).collect()}
    banned = attribution.Blocked(usernames=frozenset(["@relay_main"]), titles=frozenset(["Bio items_paper_heroes"]))
    found = messages.attribute(docs, accounts, titles, CONTENT_RULES, CUSTOM_COMMANDS, commands, banned)
    return found.select("doc_id", "source_username", "source_collection", "text_command", "is_blocked")


def blocked_filter(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "lookup_events")
    banned = events.filter("reason = 'blocked_source'").select("chat_id").distinct()
    return attribution.blocked(events, banned, "chat_id").select("id", "chat_id").distinct()


def formatted_results(spark: SparkSession, sf: str) -> DataFrame:
    items = catalogue(spark, sf, "name", "card_id", "rarity", "command")
    command = N.clean("command")
    return items.select("mongo_id", N.format_result(N.clean("name"), N.clean("card_id"), N.clean("rarity"), command, HIDDEN).alias("text"), F.concat_ws(" ", command, N.clean("name")).alias("full"))


def final_commands(spark: SparkSession, sf: str) -> DataFrame:
    """The command that each hit of a lookup is shown with: of its chat, of the probe's text where the collection has it,
    else of the collection."""
    events = table(spark, sf, "lookup_events").filter("hit").select(F.col("id").alias("probe_id"), "collection", "chat_id").distinct()
    dim = table(spark, sf, "collection_dim")
    hints = events.select("probe_id", F.when(F.col("chat_id") % 7 == 0, "/chat").alias("account_command"), F.when(F.col("chat_id") % 2 == 0, "/amber").alias("text_command"))
    allowed = dim.select(F.col("default_command").alias("command"), "collection").unionByName(dim.filter("ord <= 8").select(F.lit("/amber").alias("command"), "collection"))
    return messages.with_final_command(events.select("probe_id", "collection"), hints, allowed, dim)


def manual_commands(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    said = F.concat(F.element_at(F.array(*map(F.lit, ("/Moon", "/amber@Card_Bot", "/amber@other", " /moon", "moon"))), F.col("doc_id").cast("int") % 5 + 1), F.lit(" "), F.left("text", F.lit(40)))
    return docs.select("doc_id", attribution.manual_command(said, ("/amber", "/moon"), "@card_bot").alias("command"))


def folded_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles in full-width, stylised and Burmese letters, one of each kind in turn, cleaned alike."""
    heard = F.array(*map(F.lit, ("Ｌａｎｔｅｒｎ_Ｈｕｎｔ", "ʟᴀɴᴛᴇʀɴ ʜᴜɴᴛ!", "မြန်မာ Lantern", "Lantern -- Hunt", "𝐋antern Hunt")))
    dim = spark.createDataFrame([("lantern hunt", "items_lantern_hunt", 3), ("မြန်မာ", "items_amber_catcher", 1)], "title string, collection string, ord int")
    rows = table(spark, sf, "customer").select("c_custkey", F.element_at(heard, F.col("c_custkey").cast("int") % 5 + 1).alias("heard"))
    return attribution.title_match(rows, dim, "heard").select("c_custkey", N.clean_title("heard").alias("title"), "title_collection")


def media_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Media types by file ending and MIME type, over names with every ending in turn."""
    ending = F.element_at(F.array(*map(F.lit, ("jpg", "JPEG", "gif", "bmp", "avi", "mp4", "mov", "txt"))), F.col("p_partkey").cast("int") % 8 + 1)
    mime = F.when(F.col("p_size") % 5 == 0, "image/x").when(F.col("p_size") % 7 == 0, "video/mp4")
    return table(spark, sf, "part").select("p_partkey", N.document_media_type(mime, F.concat("p_name", F.lit("."), ending)).alias("media_type"))


def status_texts(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    n = F.col("o_orderkey")
    return orders.select("o_orderkey", N.count_text(n * 997).alias("count"), N.ms_text(F.col("o_totalprice")).alias("ms"), N.uptime_text(n * 61).alias("uptime"), N.age_text(n * 7 - 10).alias("age"))


def cached_results(spark: SparkSession, sf: str) -> DataFrame:
    """Each lookup with the item that a cache of one hour, filled by the hits of its chat, would have given it."""
    events = table(spark, sf, "lookup_events").select("id", "ts", "chat_id", "hit", "mongo_id").distinct().filter("ts is not null")
    writes = events.filter("hit and mongo_id is not null").select("chat_id", (F.col("ts") + F.expr("interval 1 microsecond")).alias("ts"), F.col("mongo_id").alias("value"))
    return incremental.ttl_lookup(events.select("id", "ts", "chat_id"), writes, ["chat_id"], "ts", 3600.0).select("id", F.unix_micros("ts").alias("ts_us"), "value")


def parsed_marks(spark: SparkSession, sf: str) -> DataFrame:
    """The high-water mark of each collection in the search index, whose times are ISO texts."""
    rows = table(spark, sf, "fingerprint_items").select(F.lower(F.trim("collection")).alias("collection"), incremental.parsed_mark(F.col("updated_at")).alias("at"))
    return rows.groupBy("collection").agg(F.unix_micros(F.max("at")).alias("mark_us"), F.count("at").alias("n_read"))


def build_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stats.collection_counts(table(spark, sf, "item_snapshots"))


def media_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stats.media_counts(table(spark, sf, "fingerprint_items"))


def filtered_count(spark: SparkSession, sf: str) -> DataFrame:
    return stats.key_matches(table(spark, sf, "lookup_events"), "reason", "_global$", "hit")


def distinct_union_count(spark: SparkSession, sf: str) -> DataFrame:
    return stats.distinct_union(table(spark, sf, "hash_chunks"), table(spark, sf, "fingerprint_items"), "mongo_id")


def delta_window(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per sync batch by its own window, open on the left; windows come from the small table of batches."""
    windows = attribution.small(table(spark, sf, "sync_batches").withColumnRenamed("batch_no", "window_no"))
    rows = table(spark, sf, "item_snapshots").select("mongo_id", "updated_at").withColumn("day", F.to_date("updated_at"))
    days = windows.withColumn("day", F.explode(F.sequence(F.to_date("window_start"), F.to_date("window_end"))))
    hit = rows.join(days, "day").filter("updated_at > window_start and updated_at <= window_end")
    return hit.groupBy("window_no").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("mongo_id").alias("n_items"))


def delta_scan(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda s: F.to_timestamp(F.lit(s))
    return delta(table(spark, sf, "item_snapshots"), at("2031-03-03 00:00:00"), at("2031-03-05 00:00:00")).select("mongo_id", "batch_no")


def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "item_snapshots").select("mongo_id", "batch_no", "updated_at")
    return incremental.upsert(rows.filter("batch_no = 0"), rows.filter("batch_no > 0"), ["mongo_id"], ["updated_at", "batch_no"]).select("mongo_id", "batch_no", F.coalesce(F.unix_micros("updated_at"), F.lit(-1)).alias("updated_us"))


def first_and_last_seen(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.merge_seen(table(spark, sf, "lookup_events"), ["chat_id"], "ts").select("chat_id", F.unix_micros("created_at").alias("created_us"), F.coalesce(F.unix_micros("updated_at"), F.lit(-1)).alias("updated_us"))


def inserted_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "item_snapshots").select("mongo_id", "batch_no")
    return incremental.insert_missing(rows.filter("batch_no = 0"), rows.filter("batch_no > 0"), ["mongo_id"]).select("mongo_id").distinct()


def chat_state(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "lookup_events").select("chat_id", "ts", "id", "reason").distinct()
    return incremental.apply_log(log, ["chat_id"], ["ts", "id", "reason"], "reason", "blocked_source").select("chat_id", "id", "reason")


def watermark(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "lookup_events")
    per = events.groupBy(F.to_date("received_at").alias("day")).agg(F.max("ts").alias("high"), F.bool_or("error").alias("failed"))
    start = F.to_timestamp(F.lit("2031-03-01 00:00:00"))
    return per.select(F.col("day").cast("string").alias("day"), F.unix_micros(incremental.advance_watermark(start, F.col("high"), F.coalesce("failed", F.lit(False)))).alias("mark_us"))


def ttl_greedy_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.ttl_dedupe(table(spark, sf, "lookup_events"), ["chat_id"], "ts", 3600.0).select("chat_id", F.unix_micros("ts").alias("ts_us"))


def latency_ema(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "lookup_events").select("id", "ts", "chat_id", "ms").distinct()
    return incremental.ordered_ema(events, ["chat_id"], "ts", "id", "ms").withColumn("ema", F.round(F.col("ema") + 1e-9, 6))


def latency_ema_total(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "lookup_events").select("id", "ts", "ms").distinct()
    return incremental.ordered_ema(events, [], "ts", "id", "ms").withColumn("ema", F.round(F.col("ema") + 1e-9, 6))


def hit_miss_counters(spark: SparkSession, sf: str) -> DataFrame:
    once = table(spark, sf, "lookup_events").groupBy("id").agg(F.first("chat_id").alias("chat_id"), F.bool_or("hit").alias("hit"), F.bool_or("error").alias("error"))
    return stats.outcome_counters(once, ["chat_id"])


def payload_codec(spark: SparkSession, sf: str) -> DataFrame:
    items = catalogue(spark, sf, "name", "duration_ms").select("collection", "mongo_id", "name", "duration_ms")
    return from_payload(to_payload(items), "collection string, mongo_id string, name string, duration_ms bigint")


def stored_payloads(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "fingerprint_items").select("mongo_id", F.from_json("item_json", "name string, rarity string, duration_ms bigint").alias("j"))
    return rows.filter("j is not null").select("mongo_id", "j.rarity", "j.duration_ms").distinct()


_FNS = (
    exact_sha_lookup, exact_cascade_ranked, exact_scoped_only, unresolved_probes, writers_by_key, items_that_were_hit, hamming_search_phash, hamming_search_dhash, mih_candidate_counts, hash_chunk_index,
    hash_distances, photo_weighted_top1, photo_strict_top1, photo_single_hash_top1, video_multiframe_top1, video_strict_top1, video_nearest, full_lookup, duration_buckets, duration_band_counts, candidate_cap, first_present_alias,
    string_lists, media_type_canonical, name_cleanup, normalized_names, text_scalars, content_rule_counts, commands_in_texts, lookup_scopes, title_sources, message_attribution, blocked_filter, formatted_results,
    final_commands, manual_commands, folded_titles, media_of_documents, status_texts, cached_results, parsed_marks, build_counts,
    media_type_counts, filtered_count, distinct_union_count, delta_window, delta_scan, upsert_latest, first_and_last_seen, inserted_ids, chat_state, watermark, ttl_greedy_dedupe, latency_ema, latency_ema_total,
    hit_miss_counters, payload_codec, stored_payloads,
)

QUERIES = {f.__name__: f for f in _FNS}
