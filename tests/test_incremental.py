import datetime as dt
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from weftmatch.functions import media
from weftmatch.operators import incremental as inc
from weftmatch.operators import stats
from weftmatch.sources.items import delta
from weftmatch.streaming import sync

T0 = dt.datetime(2031, 3, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_upsert_equals_any_split(spark, rows):
    r = random.Random(5)
    log = [("c", f"m{r.randrange(20)}", at(i) if i % 7 else None, i) for i in range(200)]
    df = spark.createDataFrame(log, "collection string, mongo_id string, updated_at timestamp, v int")
    keys, order = ["collection", "mongo_id"], ["updated_at", "v"]
    whole = rows(inc.latest(df, keys, order))
    for cut in (0, 60, 140, 200):
        a, b = df.filter(F.col("v") < cut), df.filter(F.col("v") >= cut)
        once = inc.upsert(inc.latest(a, keys, order), b, keys, order)
        assert rows(once) == whole
        assert rows(inc.upsert(once, b, keys, order)) == whole
    assert inc.latest(df.limit(0), keys, order).count() == 0


def test_delta_is_open_on_the_left(spark, rows):
    df = spark.createDataFrame([(1, at(0)), (2, at(5)), (3, at(10)), (4, None)], "i int, updated_at timestamp")
    assert rows(delta(df, F.lit(at(0)), F.lit(at(10))), "i") == [(2,), (3,)]


def greedy(times, ttl):
    out = []
    for t in sorted(set(times)):
        if not out or (t - out[-1]).total_seconds() > ttl:
            out.append(t)
    return out


@pytest.mark.parametrize("slot", ["minute", "hour", "day"])
def test_ttl_window_is_not_extended(spark, rows, slot):
    r = random.Random(9)
    data = [(k, at(r.randrange(4000))) for k in ("a", "b") for _ in range(300)] + [("c", at(0)), ("c", at(15)), ("c", at(20)), ("c", at(21)), ("c", at(21)), (None, at(3)), ("d", None)]
    got = rows(inc.ttl_dedupe(spark.createDataFrame(data, "k string, ts timestamp"), ["k"], "ts", 20.0, slot))
    want = [(k, t) for k in "abc" for t in greedy([t for x, t in data if x == k], 20)]
    assert got == sorted(want, key=repr)
    assert [t for k, t in got if k == "c"] == [at(0), at(21)]


def test_ema_matches_a_plain_fold(spark, rows):
    r = random.Random(1)
    data = [(k, at(r.randrange(20000)), i, r.random() * 90 + 1) for i, k in enumerate("ab" * 150)] + [("a", at(1), 999, None)]
    df = spark.createDataFrame(data, "k string, ts timestamp, id bigint, ms double")
    want = {}
    for k, _, _, x in sorted((d for d in data if d[3] is not None), key=lambda d: (d[1], d[2])):
        want[k] = x if k not in want else 0.15 * x + 0.85 * want[k]
    assert dict(rows(inc.ordered_ema(df, ["k"], "ts", "id", "ms"))) == pytest.approx(want)
    assert inc.ordered_ema(df.limit(0), ["k"], "ts", "id", "ms").count() == 0


def test_logs_merges_and_marks(spark, rows):
    log = spark.createDataFrame([(1, at(0), "add"), (1, at(5), "remove"), (2, at(1), "add")], "id int, ts timestamp, op string")
    assert rows(inc.apply_log(log, ["id"], ["ts"], "op", "remove"), "id") == [(2,)]
    assert rows(inc.merge_seen(log, ["id"], "ts")) == [(1, at(0), at(5)), (2, at(1), at(1))]
    assert rows(inc.insert_missing(log, spark.createDataFrame([(2, at(1), "x"), (3, at(1), "x")], log.schema), ["id"]), "id") == [(3,)]
    marks = spark.createDataFrame([(at(5), at(9), False), (at(5), at(9), True), (at(9), at(5), False)], "a timestamp, b timestamp, f boolean")
    assert [r[0] for r in marks.select(inc.advance_watermark(F.col("a"), F.col("b"), F.col("f"))).collect()] == [at(9), at(5), at(9)]


def test_counters(spark, rows):
    e = spark.createDataFrame([(1, True, False), (1, False, False), (1, None, None), (1, True, True), (2, False, True)], "c int, hit boolean, error boolean")
    assert rows(stats.outcome_counters(e, ["c"])) == [(1, 4, 1, 2, 1), (2, 1, 0, 0, 1)]
    assert rows(stats.media_counts(spark.createDataFrame([("Photo ",), ("video",), (None,)], "media_type string"))) == [(3, 1, 1)]
    assert rows(stats.key_matches(spark.createDataFrame([("g:1", True), ("g:2", None), ("x", True)], "k string, on boolean"), "k", "^g:", "on")) == [(1,)]
    a, b = spark.createDataFrame([(1,), (None,)], "x int"), spark.createDataFrame([(1,), (2,)], "x int")
    assert rows(stats.distinct_union(a, b, "x")) == [(2,)]


def test_streams_agree_with_batch(spark, tmp_path, rows):
    src, target, log = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "log")
    schema = "collection string, mongo_id string, updated_at timestamp, v int"
    data = [("a", "1", at(0), 1), ("a", "2", at(1), 2), ("b", "3", at(2), 3), ("a", "1", at(9), 4), ("a", "1", at(4), 5)]
    for i, row in enumerate(data):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(src)
        if i == 2:
            sync.sync_items(sync.read_stream(spark, src, schema, 1), target, log).awaitTermination()
    sync.sync_items(sync.read_stream(spark, src, schema, 1), target, log).awaitTermination()
    assert rows(spark.read.parquet(target), "collection", "mongo_id", "v") == [("a", "1", 4), ("a", "2", 2), ("b", "3", 3)]


def test_stream_dedupe_and_counters(spark, tmp_path):
    src = str(tmp_path / "ev")
    schema = "id bigint, ts timestamp, hit boolean, error boolean"
    spark.createDataFrame([(1, at(0), True, False), (1, at(5), True, False), (2, at(61), False, False), (3, at(400), True, False)], schema).coalesce(1).write.parquet(src)
    once = sync.dedupe_stream(sync.read_stream(spark, src, schema), ["id"], "ts", "1 minute")
    sync.run_available(once, str(tmp_path / "once"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "once")).count() == 3
    sync.run_available(sync.counters_stream(sync.read_stream(spark, src, schema), "ts", "30 seconds", "1 minute"), str(tmp_path / "cnt"), str(tmp_path / "c2"))
    got = spark.read.parquet(str(tmp_path / "cnt")).orderBy("window.start").select("total", "hits").collect()
    assert [tuple(r) for r in got][:2] == [(2, 2), (1, 0)]


def png(path, w, h, pixel):
    raw = b"".join(b"\x00" + bytes(v for x in range(w) for v in pixel(x, y)) for y in range(h))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_hashes_survive_scaling(spark, tmp_path):
    wave = lambda s: lambda x, y: ((x * 7 // s * 3 + y // s) % 256, (x // s * y // s) % 256, (x // s * 2) % 256)
    png(tmp_path / "a.png", 64, 64, wave(1))
    png(tmp_path / "b.png", 128, 128, wave(2))
    png(tmp_path / "c.png", 64, 64, lambda x, y: ((y * 4) % 256, (255 - x * 4) % 256, 9))
    (tmp_path / "bad.png").write_bytes(b"no image")
    got = {r["path"].rsplit("/", 1)[1]: r for r in media.hash_images(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.png", "b.png", "c.png", "bad.png"} and got["bad.png"]["phash"] is None
    assert {len(r["sha256"]) for r in got.values()} == {64}
    far = lambda x, y, h: (int(got[x][h], 16) ^ int(got[y][h], 16)).bit_count()
    assert far("a.png", "b.png", "phash") <= 10 < far("a.png", "c.png", "phash")
    assert len(got["a.png"]["phash_large"]) == 64 and got["a.png"]["pixel_sha256"] != got["b.png"]["pixel_sha256"]


def test_video_signature_and_frames(spark):
    df = spark.createDataFrame([([(0.05, 1, "p", "d"), (0.5, 2, "q", "e")],), ([],)], "s array<struct<position double, frame_index int, phash string, dhash string>>")
    import hashlib

    assert [r[0] for r in df.select(media.video_signature(F.col("s"))).collect()] == [hashlib.sha256(b"0.05:p:d|0.5:q:e").hexdigest(), None]
    idx = spark.range(1).select(*[media.frame_index(F.lit(10), F.lit(p)) for p in (0.0, 0.55, 1.0)]).head()
    assert tuple(idx) == (0, 5, 9)


def test_a_cache_that_forgets(spark, rows):
    at = lambda s: dt.datetime(2031, 1, 1) + dt.timedelta(seconds=s)
    writes = spark.createDataFrame([("k", at(0), "a"), ("k", at(15), "b"), ("j", at(3), "c"), (None, at(0), "n")], "k string, ts timestamp, value string")
    reads = spark.createDataFrame([("k", at(t)) for t in (0, 9, 10, 15, 24, 25, 40)] + [("j", at(2)), ("j", at(12)), ("j", at(13)), (None, at(1)), ("k", None)], "k string, ts timestamp")
    got = {(r["k"], r["ts"] and int((r["ts"] - at(0)).total_seconds())): r["value"] for r in inc.ttl_lookup(reads, writes, ["k"], "ts", 10).collect()}
    assert got == {("k", 0): "a", ("k", 9): "a", ("k", 10): None, ("k", 15): "b", ("k", 24): "b", ("k", 25): None, ("k", 40): None, ("j", 2): None, ("j", 12): "c", ("j", 13): None, (None, 1): None, ("k", None): None}


def test_marks_are_read_tolerantly(spark):
    df = spark.createDataFrame([(t,) for t in ("2031-03-01T00:00:00", "2031-03-01T02:00:00+02:00", " 2031-03-01 00:00:00Z ", "bad", "", None)], "t string")
    got = [r[0] for r in df.select(F.unix_micros(inc.parsed_mark(F.col("t")))).collect()]
    assert got[0] == got[1] == got[2] is not None and got[3:] == [None, None, None]
