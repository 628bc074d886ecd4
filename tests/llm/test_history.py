import itertools
import random

import numpy as np

from weftmatch.functions.hexbits import EMPTY_SHA256
from weftmatch.llm.history import MINIMA, History, _order, bands_of, media_signatures, new_against_history
from weftmatch.llm.words import scramble

SCHEMA = "mongo_id string, batch_no int, phash string, dhash string, video_signature string, p string, sig int"


def usable(h):
    h = (h or "").strip()
    try:
        ok = len(h) == 16 and all(c in "0123456789abcdefABCDEF" for c in h)
    except TypeError:
        return None
    return int(h, 16) if ok and int(h, 16) not in (0, 2**64 - 1) else None


def brute(data):
    out = set()
    for a, b in itertools.combinations(data, 2):
        if a[1] is None or b[1] is None or a[1] == b[1]:
            continue
        s, t = ((x[4] or "").strip().lower() for x in (a, b))
        same = s == t and s not in ("", EMPTY_SHA256)
        pa, pb, da, db = usable(a[2]), usable(b[2]), usable(a[3]), usable(b[3])
        if pa is not None and pb is not None:
            p = (pa ^ pb).bit_count()
            same |= p <= 8 and ((da ^ db).bit_count() <= 12 if da is not None and db is not None else p <= 2)
        if same:
            out.add(tuple(sorted((a[0], b[0]))))
    return sorted(out)


def sample(seed, n=40):
    r = random.Random(seed)
    data = []
    for i in range(n):
        p, d = r.getrandbits(64), r.getrandbits(64)
        for j in range(r.randrange(1, 6)):
            x = p ^ sum(1 << k for k in r.sample(range(64), r.randrange(0, 12)))
            y = d ^ sum(1 << k for k in r.sample(range(64), r.randrange(0, 16)))
            ph = r.choice([f"{x:016x}", f" {x:016X}", f"{x:016x}", f"{x:016x}", "zz", None, "0" * 16])
            dh = r.choice([f"{y:016x}", f"{y:016x}", None, "f" * 16])
            sig = r.choice([None, "", f"S{i} ", f"s{i}", EMPTY_SHA256])
            data.append((f"m{len(data):04d}", r.choice([0, 0, 0, 1, 2, None]), ph, dh, sig, "x", 1))
    return data


def test_every_pair_is_found(spark, rows):
    for seed in (1, 2):
        data = sample(seed)
        assert rows(new_against_history(spark.createDataFrame(data, SCHEMA))) == brute(data)


def test_many_copies_and_one_hot_signature(spark, rows):
    data = [(f"m{i:04d}", i % 3, "0123456789abcdef", None if i % 2 else "fedcba9876543210", "same" if i < 30 else None, "x", 1) for i in range(60)]
    assert rows(new_against_history(spark.createDataFrame(data, SCHEMA))) == brute(data)


def test_empty_and_single_batch(spark, rows):
    df = spark.createDataFrame(sample(3), SCHEMA)
    assert rows(new_against_history(df.limit(0))) == []
    assert rows(new_against_history(df.filter("batch_no = 2"))) == []


def media(spark, hashes, batch=0, first=0):
    return media_signatures(spark.createDataFrame([(f"m{first + i:06d}", batch, f"{h:016x}", None, None) for i, h in enumerate(hashes)], "mongo_id string, batch_no int, phash string, dhash string, video_signature string"))


def test_store_answers_batch_by_batch(spark, rows, tmp_path):
    base = 0x0123456789ABCDEF
    store = History(spark, f"file://{tmp_path}/store")
    store.append(media(spark, [base]))
    new = media(spark, [base ^ 1, base ^ 0b111, base ^ 1 << 40], 1, 10)
    pairs = store.probe(new)
    assert rows(pairs) == [("m000000", "m000010"), ("m000000", "m000012")]
    store.accept(new, pairs)
    # A later process needs the store and the new batch only, not the items of the batches before.
    again = History(spark, f"file://{tmp_path}/store")
    assert rows(again.stored().select("mongo_id").distinct()) == [("m000000",), ("m000011",)]
    assert rows(again.probe(media(spark, [base ^ 3], 2, 20))) == [("m000000", "m000020"), ("m000011", "m000020")]


def test_only_buckets_of_the_batch_are_read(spark, tmp_path, capsys):
    r = random.Random(5)
    store = History(spark, f"file://{tmp_path}/store")
    hashes = [r.getrandbits(64) for _ in range(300)]
    store.append(media(spark, hashes))
    found = store.candidates(media(spark, [hashes[7]], 1, 1000))
    found.explain("formatted")
    plan = capsys.readouterr().out
    filters = [line for line in plan.splitlines() if "PartitionFilters: [" in line and "bucket" in line]
    assert filters and all("PartitionFilters: []" not in line for line in filters)
    assert {r["mongo_id_a"] for r in found.collect()} >= {"m000007"}


def test_minwise_keys_lose_no_near_hash():
    r = random.Random(3)
    for n in (2, 3, 4):
        for _ in range(40):
            p = r.getrandbits(64)
            q = p ^ sum(1 << k for k in r.sample(range(64), 8))
            kept = [b.keys(np.array([p], np.uint64), False)[0] for b in bands_of(n)]
            asked = [b.keys(np.array([q], np.uint64), True)[0] for b in bands_of(n)]
            assert any(k[0] in a for k, a in zip(kept, asked, strict=True))


def test_minima_are_minima():
    band = bands_of(3)[0]
    p = np.array([0, 1 << 63, 0xDEADBEEF], np.uint64)
    one = band.keys(p, False)[:, 0]
    places = np.concatenate(band.parts)
    ranks = np.stack([np.argsort(_order(2 * len(places), m + 2)) for m in range(MINIMA)], axis=1).astype(np.uint8)
    low = np.stack([np.min([ranks[2 * j + (int(x) >> int(b) & 1)] for j, b in enumerate(places)], axis=0) for x in p])
    want = np.zeros(len(p), np.uint64)
    with np.errstate(over="ignore"):
        for word in low.view(np.uint64).T:
            want = scramble(want * np.uint64(0x9E3779B97F4A7C15) + word)
    assert (want & ~np.uint64(15) == one & ~np.uint64(15)).all() and (one & np.uint64(15) == 0).all()


def test_fewer_sets_and_other_buckets_find_the_same(spark, rows):
    data = sample(4, 15)
    assert rows(new_against_history(spark.createDataFrame(data, SCHEMA), bands=2)) == brute(data)
    assert rows(new_against_history(spark.createDataFrame(data, SCHEMA), bands=4)) == brute(data)


def test_items_without_hash_or_batch(spark, rows):
    data = [("a", 0, None, None, " SIG"), ("b", 1, "zz", None, "sig"), ("c", None, None, None, "sig"), ("d", 2, "", "", None)]
    df = spark.createDataFrame(data, "mongo_id string, batch_no int, phash string, dhash string, video_signature string")
    assert rows(new_against_history(df)) == [("a", "b")]
