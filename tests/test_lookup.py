"""Exact tiers, Hamming search, scores and the whole lookup on the documented cases."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftmatch.functions.hexbits import bits64, chunk_widths, chunks64, hamming_hex, normalized_hamming, usable_hash
from weftmatch.operators import bands, exact, mih, score
from weftmatch.operators.lookup import lookup, photo_lookup, video_lookup

ITEM = "collection string, mongo_id string, file_unique_id string, file_unique_ids array<string>, sha256 string, sha256_aliases array<string>, pixel_sha256 string, video_signature string, origin_chat_id bigint, origin_message_id bigint, phash string, dhash string, whash string, phash_large string, colorhash string, media_type string, frame_hashes array<string>, video_samples array<struct<position double, frame_index int, phash string, dhash string>>, duration_ms bigint"
NAMES = [c.split()[0] for c in ITEM.replace("struct<position double, frame_index int, phash string, dhash string>", "x").split(", ")]
PROBE = "probe_id string, scope array<string>, " + ITEM.split("mongo_id string, ")[1]


def item(**kw):
    return tuple(kw.get(c) for c in NAMES)


def probe(probe_id, scope=None, **kw):
    return (probe_id, scope, *(kw.get(c) for c in NAMES[2:]))


def flip(text, n):
    return f"{int(text, 16) ^ ((1 << n) - 1):0{len(text)}x}"


@pytest.fixture(scope="module")
def order(spark):
    return spark.createDataFrame([("a", 1), ("b", 2)], "collection string, ord int")


P, D = "0123456789abcdef", "fedcba9876543210"


def test_hex_guards(spark, rows):
    df = spark.createDataFrame([("00000000000000ff", " 00000000000000FE "), ("zz", "00"), ("0x12", "12"), ("f" * 17, "0"), (None, "1"), ("", "1"), ("f" * 64, "0" * 64)], "a string, b string")
    assert [r[0] for r in df.select(hamming_hex(F.col("a"), F.col("b"))).collect()] == [1, None, None, 68, None, None, 256]
    assert df.select(normalized_hamming(F.col("a"), F.col("b"))).head()[0] == 1 / 64
    odd = spark.createDataFrame([("f" * 16,), ("0" * 16,), (" 00000000000000FF",), ("12",)], "h string")
    assert [r[0] for r in odd.select(usable_hash(F.col("h"))).collect()] == [None, None, 255, None]
    assert [r[0] for r in odd.select(bits64(F.col("h"))).collect()] == [-1, 0, 255, None]


@given(st.integers(1, 256), st.integers(1, 64))
def test_chunk_widths_cover_all_bits(bits, n):
    widths = chunk_widths(bits, n)
    assert sum(widths) == bits and len(widths) == n and max(widths) - min(widths) <= 1


def test_documented_widths():
    assert chunk_widths(64, 9) == [8] + [7] * 8
    assert chunk_widths(64, 13) == [5] * 12 + [4]
    assert chunk_widths(64, 17) == [4] * 13 + [3] * 4
    assert [mih.chunk_count(t) for t in (8, 10, 12, 16, 20)] == [9, 13, 13, 17, 21]
    assert mih.chunk_count(10, compat=True) == 9


def test_chunks_put_together_give_the_hash(spark):
    got = spark.createDataFrame([(P,)], "h string").select(chunks64(bits64(F.col("h")), 9).alias("c")).head()["c"]
    value = 0
    for c, w in zip(got, chunk_widths(64, 9), strict=True):
        value = value << w | c["chunk"]
    assert value == int(P, 16)


@pytest.mark.parametrize("t", [4, 8, 12])
def test_hamming_search_finds_every_pair(spark, t):
    r = random.Random(t)
    base = [r.getrandbits(64) for _ in range(25)]
    every = base + [b ^ sum(1 << x for x in r.sample(range(64), r.randrange(0, 15))) for b in base for _ in range(4)]
    data = [("a", f"m{i}", f"{x:016x}") for i, x in enumerate(every)] + [("a", "bad", "xyz"), ("a", "none", None)]
    items = spark.createDataFrame(data, "collection string, mongo_id string, phash string")
    got = {(x[0], x[2], x[3]) for x in mih.hamming_search(items.withColumnRenamed("mongo_id", "probe_id"), items, "phash", t).collect()}
    want = {(f"m{i}", f"m{j}", (a ^ b).bit_count()) for (i, a), (j, b) in itertools.product(enumerate(every), repeat=2) if (a ^ b).bit_count() <= t}
    assert got == want


def test_a_persisted_index_is_read_and_kept_up(spark, tmp_path, rows, capsys):
    data = [("a", f"m{i}", f"{int(P, 16) ^ (1 << i):016x}", None) for i in range(20)]
    items = spark.createDataFrame(data, "collection string, mongo_id string, phash string, dhash string")
    probes = spark.createDataFrame([("p", P)], "probe_id string, phash string")
    mih.write_index(items, str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    found = mih.hamming_search(probes, None, "phash", 8, index=index)
    assert rows(found) == rows(mih.hamming_search(probes, items, "phash", 8))
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(field" in plan and "chunk_count" in plan.split("PartitionFilters:")[1].split("\n")[0]
    changed = spark.createDataFrame([("a", "m0", "f" * 16, None), ("a", "new", P, None)], items.schema)
    after = rows(mih.hamming_search(probes, None, "phash", 8, index=mih.updated_index(index, changed)), "mongo_id")
    assert ("m0",) not in after and ("new",) in after and len(after) == 20
    with pytest.raises(ValueError):
        mih.hamming_search(probes, None, "phash", 20, index=index)


def test_a_probe_may_leave_out_one_item(spark, rows, order):
    items = spark.createDataFrame([item(collection="a", mongo_id=m, phash=P, duration_ms=5000, frame_hashes=[P]) for m in ("1", "2")], ITEM)
    asked = spark.createDataFrame([probe("1", None, phash=P, duration_ms=5000, frame_hashes=[P])], PROBE)
    for search in (photo_lookup, video_lookup):
        assert rows(search(asked, items, order), "mongo_id") == [("1",)]
        assert rows(search(asked.withColumn("not_id", F.lit("1")), items, order), "mongo_id") == [("2",)]


def test_kinds_that_belong_to_a_media_type(spark, order):
    items = spark.createDataFrame([item(collection="a", mongo_id="1", pixel_sha256="x", video_signature="s")], ITEM)
    asked = spark.createDataFrame([probe(f"{m} {k}", None, media_type=m, **{k: v}) for m in ("photo", "video") for k, v in (("pixel_sha256", "X"), ("video_signature", "S"))], PROBE)
    assert {r["probe_id"] for r in exact.exact_lookup(asked, items, order).collect()} == {"photo pixel_sha256", "video video_signature"}


def test_exact_tiers(spark, rows, order):
    items = spark.createDataFrame(
        [
            item(collection="a", mongo_id="1", file_unique_id="u1", sha256="S1"),
            item(collection="a", mongo_id="2", file_unique_ids=["u1", None, " "], sha256_aliases=["s2"]),
            item(collection="b", mongo_id="0", file_unique_id="u1", origin_chat_id=5, origin_message_id=6),
        ],
        ITEM,
    )
    probes = spark.createDataFrame(
        [
            probe("scoped", ["a"], file_unique_id="u1"),
            probe("free", None, file_unique_id="u1"),
            probe("empty", [], file_unique_id="u1"),
            probe("order", ["b", "a"], file_unique_id="u1"),
            probe("tier", ["a"], file_unique_id="u1", origin_chat_id=5, origin_message_id=6),
            probe("away", ["b"], sha256="s1"),
            probe("alias", None, sha256="S2"),
            probe("nothing", None, sha256="no"),
            probe("half", None, origin_chat_id=5),
        ],
        PROBE,
    )
    found = exact.exact_lookup(probes, items, order)
    assert {r["probe_id"]: (r["mongo_id"], r["reason"]) for r in found.collect()} == {
        "scoped": ("2", "uid"), "free": ("1", "uid"), "empty": ("1", "uid"), "order": ("0", "uid"), "tier": ("0", "origin_global"), "away": ("1", "sha_global"), "alias": ("2", "sha"),
    }
    assert [r[0] for r in rows(exact.unresolved(probes, found), "probe_id")] == ["half", "nothing"]
    assert exact.exact_lookup(probes, items.limit(0), order).count() == 0


@pytest.mark.parametrize(
    ("case", "thing", "asked", "strict", "want"),
    [
        ("alone within 8", {"phash": flip(P, 8)}, {"phash": P}, False, 0.875),
        ("alone beyond 8", {"phash": flip(P, 9)}, {"phash": P}, False, None),
        ("alone strict 8", {"phash": flip(P, 8)}, {"phash": P}, True, None),
        ("alone strict 7", {"phash": flip(P, 7)}, {"phash": P}, True, 0.890625),
        ("structure opens", {"phash": flip(P, 9), "dhash": flip(D, 12)}, {"phash": P, "dhash": D}, False, 0.839844),
        ("structure strict", {"phash": flip(P, 9), "dhash": flip(D, 12)}, {"phash": P, "dhash": D}, True, None),
        ("equal", {"phash": P, "dhash": D, "whash": P}, {"phash": P, "dhash": D}, False, 1.0),
        ("unusable", {"phash": "zz"}, {"phash": P}, False, None),
    ],
)
def test_photo_cases(spark, order, case, thing, asked, strict, want):
    items = spark.createDataFrame([item(collection="a", mongo_id="m", **thing)], ITEM)
    got = photo_lookup(spark.createDataFrame([probe("p", ["a"], **asked)], PROBE), items, order, global_mode=strict).collect()
    assert ([r["score"] for r in got] or [None]) == [want], case


def test_ties_go_to_order_then_id(spark, order):
    items = spark.createDataFrame([item(collection=c, mongo_id=m, phash=P) for c, m in (("b", "0"), ("a", "2"), ("a", "1"), ("z", "9"))], ITEM)
    got = photo_lookup(spark.createDataFrame([probe("p", None, phash=P)], PROBE), items, order).head()
    assert (got["collection"], got["mongo_id"]) == ("a", "1")


def samples(*xs):
    return [(pos, 1, p, d) for pos, p, d in xs]


@pytest.mark.parametrize(
    ("theirs", "ours", "strict", "want"),
    [
        (dict(video_samples=samples((0.5, flip(P, 10), flip(D, 14)))), dict(video_samples=samples((0.5, P, D))), False, 0.8125),
        (dict(video_samples=samples((0.5, flip(P, 10), flip(D, 14)))), dict(video_samples=samples((0.5, P, D))), True, None),
        (dict(video_samples=samples((0.4, P, D)), frame_hashes=[P]), dict(video_samples=samples((0.5, P, D)), frame_hashes=[P]), False, None),
        (dict(frame_hashes=[P, flip(P, 4)]), dict(frame_hashes=[P, P, D]), False, 0.96875),
        (dict(video_samples=samples((0.5, D, P), (0.5, P, D))), dict(video_samples=samples((0.5, P, D))), False, 1.0),
        (dict(), dict(frame_hashes=[P]), False, None),
    ],
)
def test_video_cases(spark, order, theirs, ours, strict, want):
    items = spark.createDataFrame([item(collection="a", mongo_id="m", duration_ms=5000, **theirs)], ITEM)
    got = video_lookup(spark.createDataFrame([probe("p", ["a"], duration_ms=8000, **ours)], PROBE), items, order, global_mode=strict).collect()
    assert ([r["score"] for r in got] or [None]) == [want]


def test_videos_outside_every_band(spark, rows, order):
    """Probes of unknown duration or with an empty band are compared with all videos of their scope."""
    frames = dict(frame_hashes=[P], media_type="video")
    items = spark.createDataFrame([item(collection="a", mongo_id="none", **frames), item(collection="a", mongo_id="zero", duration_ms=0, frame_hashes=[flip(P, 1)]), item(collection="b", mongo_id="far", duration_ms=60000, frame_hashes=[flip(P, 2)]), item(collection="b", mongo_id="blank", duration_ms=90000, media_type="video")], ITEM)
    ask = lambda i, scope, ms: probe(i, scope, duration_ms=ms, **frames)
    asked = [ask("null", None, None), ask("zero duration", ["a"], 0), ask("b", ["b"], None), ask("empty band", None, 5000), ask("empty in scope", ["a", "a"], 60000), ask("band", None, 61000), ask("stated video in band", None, 90000), ask("none", ["a"], 5000), ask("nowhere", ["c"], None)]
    got = rows(video_lookup(spark.createDataFrame(asked, PROBE), items, order), "probe_id", "mongo_id")
    assert dict(got) == {"null": "none", "zero duration": "none", "b": "far", "empty band": "none", "empty in scope": "none", "band": "far", "none": "none"} and len(got) == 7
    found = rows(video_lookup(spark.createDataFrame(asked, PROBE), items, order, global_mode=True), "probe_id", "mongo_id")
    assert dict(found)["empty in scope"] == "far" and dict(found)["nowhere"] == "none"
    whole = {r["probe_id"]: (r["mongo_id"], r["reason"]) for r in lookup(spark.createDataFrame(asked, PROBE), items, order).collect()}
    assert whole["zero duration"] == ("none", "video_multiframe") and whole["nowhere"] == ("none", "video_multiframe_global")


def test_buckets_and_bands(spark, rows):
    df = spark.createDataFrame([(2500,), (3500,), (0,), (None,)], "ms bigint")
    assert [r[0] for r in df.select(bands.duration_bucket(F.col("ms"))).collect()] == [2, 4, 0, None]
    items = spark.createDataFrame([(i, f"i{i}") for i in range(12)] + [(None, "n")], "bucket int, id string")
    probes = spark.createDataFrame([("p", 2), ("q", None)], "probe_id string, probe_bucket int")
    assert rows(bands.band_join(probes, items, 4), "probe_id", "bucket") == sorted((("p", i) for i in range(7)), key=repr)


def test_cap_is_repeatable(spark, rows, order):
    c = spark.createDataFrame([("p", x, m) for x in ("b", "a", "z") for m in ("2", "1")], "probe_id string, collection string, mongo_id string")
    assert rows(mih.capped(c, order, 3), "collection", "mongo_id", "rank") == [("a", "1", 1), ("a", "2", 2), ("b", "1", 3)]


def test_lookup_stops_at_the_first_stage_that_answers(spark, order):
    items = spark.createDataFrame([item(collection="a", mongo_id="x", file_unique_id="u", media_type="photo"), item(collection="b", mongo_id="y", phash=P, dhash=D, media_type="photo")], ITEM)
    probes = spark.createDataFrame([probe("1", ["a"], file_unique_id="u", phash=P, media_type="photo"), probe("2", ["b"], phash=P, dhash=D, media_type="photo"), probe("3", ["a"], phash=P, dhash=D, media_type="photo"), probe("4", ["a"], phash=D, media_type="photo")], PROBE)
    got = {r["probe_id"]: (r["mongo_id"], r["reason"]) for r in lookup(probes, items, order).collect()}
    assert got == {"1": ("x", "uid"), "2": ("y", "photo_multihash"), "3": ("y", "photo_multihash_global"), "4": (None, "not_found")}
    assert {r["reason"] for r in lookup(probes, items, order, exact_only=True).collect()} == {"uid", "not_found"}


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1))
def test_hamming_is_a_metric(a, b, c):
    d = lambda x, y: (x ^ y).bit_count()
    assert d(a, b) == d(b, a) and d(a, c) <= d(a, b) + d(b, c)


def test_limits_are_the_documented_ones():
    assert (score.Limits().photo, score.Limits().photo_special, score.Limits().structure) == (8, 16, 12)
    assert sum(score.WEIGHTS.values()) == pytest.approx(1)
