import datetime as dt
import random

from pyspark.sql import functions as F

from weftmatch.llm.items import STAND_INS, real
from weftmatch.llm import survivors
from weftmatch.llm.survivors import COUNTED, best_records, contests, discover, elect, repeated, representatives, version_number

SCHEMA = "item_key string, mongo_id string, collection string, fingerprint_version string, updated_at timestamp, name string, card_id string, rarity string, anime_name string, command string, media_type string, file_unique_id string, sha256 string, origin_message_id bigint, support int"


def trust(spark):
    return spark.createDataFrame([("good", 1), ("fair", 2), ("poor", 3)], "collection string, trust_rank int")


def test_versions_and_real_values(spark):
    df = spark.createDataFrame([(v,) for v in ("fp-3.1", "V2", " 3.0 ", "legacy", "", None, "version 12")], "v string")
    assert [r[0] for r in df.select(version_number(F.col("v"))).collect()] == [3.1, 2.0, 3.0, -1.0, -1.0, -1.0, 12.0]
    words = spark.createDataFrame([(w,) for w in (*STAND_INS, " N/A", "", "  ", None, "x")], "w string")
    assert [r["w"] for r in words.filter(real(F.col("w"))).collect()] == ["x"]


def sample(n=150):
    r = random.Random(6)
    pick = lambda *x: r.choice(x)
    out = []
    for i in range(n):
        key = pick("k1", "k2", "k3", f"k{i // 4}", " ", None)
        when = pick(None, dt.datetime(2031, 1, 1), dt.datetime(2031, 2, 1))
        fields = [pick("v", "w", "-", "", None) for _ in range(8)]
        out.append((key, f"m{i:03d}", pick("good", " GOOD", "fair", "poor", "new", None), pick("v1", "fp-2", "3", "legacy", None), when, *fields, pick(None, 5), 1))
    return out


def dominant(data):
    rank = {"good": 1, "fair": 2, "poor": 3}
    groups = {}
    for x in data:
        if x[0] and x[0].strip():
            digits = "".join(c for c in x[3] or "" if c.isdigit() or c == ".")
            filled = sum(v is not None and str(v).strip().lower() not in ("", *STAND_INS) for v in x[5:14])
            groups.setdefault(x[0], []).append((float(digits or -1), -rank.get((x[2] or "").strip().lower(), 1 << 30), x[4] or dt.datetime.min, filled, x[1]))
    out = set()
    for key, rows in groups.items():
        for a in rows:
            if len(rows) > 1 and all(b is a or (all(p >= q for p, q in zip(a[:4], b[:4], strict=True)) and a[:4] != b[:4]) for b in rows):
                out.add((key, a[4]))
    return out


def test_dominant_records(spark):
    data = sample()
    got = representatives(spark.createDataFrame(data, SCHEMA), trust(spark)).collect()
    assert {(r["item_key"], r["mongo_id"]) for r in got if r["dominant"]} == dominant(data)
    assert len(got) == len({x[0] for x in data if x[0] and x[0].strip() and sum(y[0] == x[0] for y in data) > 1})
    assert representatives(spark.createDataFrame([], SCHEMA), trust(spark)).count() == 0


def test_elected_without_fields(spark, rows):
    df = spark.createDataFrame(sample(), SCHEMA)
    full = representatives(df, trust(spark)).filter("dominant")
    assert rows(best_records(df, trust(spark)).filter("dominant"), "item_key", "mongo_id") == rows(full, "item_key", "mongo_id")
    assert best_records(df.limit(0), trust(spark)).count() == 0


def test_weights_of_respects_choose_the_record(spark):
    """Two records are best in two respects each; which pair of respects is believed depends on all other groups."""

    def crowd(old_is_good):
        late, early = dt.datetime(2031, 2, 1), dt.datetime(2031, 1, 1)
        out = [("x", "new", "poor", "1", late, "n", "7", *[None] * 7, 1), ("x", "old", "good", "2", early, "n", *[None] * 8, 1)]
        for i in range(60):
            # The first two respects agree with one other respect here and with the fourth there.
            good = ("good", "2", early if old_is_good else late, "n", None if not old_is_good else "7")
            poor = ("poor", "1", late if old_is_good else early, "n", "7" if not old_is_good else None)
            swap = [("good", "1", *poor[2:]), ("poor", "2", *good[2:])] if not old_is_good else [good, poor]
            out += [(f"g{i}", f"{i}{n}", *x, *[None] * 7, 1) for n, x in zip("ab", swap, strict=True)]
        return spark.createDataFrame(out, SCHEMA)

    chosen = lambda df: best_records(df, trust(spark)).filter("item_key = 'x'").head()["mongo_id"]
    believed = elect({1 << 0b0011 | 1 << 0b1100: 1, 1 << 0b1011 | 1 << 0b0100: 60})
    assert min(believed[0], believed[1], believed[3]) > believed[2]
    assert chosen(crowd(True)) == "old"
    doubted = elect({1 << 0b0011 | 1 << 0b1100: 1, 1 << 0b1101 | 1 << 0b0010: 60})
    assert doubted[1] < min(doubted[0], doubted[2], doubted[3])
    assert doubted[2] + doubted[3] > doubted[0] + doubted[1]


def test_rounds_end_without_a_limit(monkeypatch):
    monkeypatch.setattr(survivors, "FREE_ROUNDS", 0)
    few = elect({0b110: 5, 0b1000000000000110: 3})
    monkeypatch.setattr(survivors, "FREE_ROUNDS", 50)
    many = elect({0b110: 5, 0b1000000000000110: 3})
    assert len(few) == len(many) == 4 and min(few + many) > 0


def test_values_of_reliable_sources_win(spark):
    r = random.Random(2)
    claims = []
    for g in range(120):
        truth = f"t{g}"
        for s, p in (("s1", 0.95), ("s2", 0.9), ("bad1", 0.3), ("bad2", 0.3), ("bad3", 0.3)):
            v = truth if r.random() < p else f"wrong{r.randrange(2)}"
            claims.append((f"g{g}", "name", v, s, 1))
    winners, weights = discover(spark.createDataFrame(claims, "g string, f string, v string, s string, n bigint"))
    w = {x["s"]: x["weight"] for x in weights.collect()}
    assert min(w["s1"], w["s2"]) > max(w[b] for b in ("bad1", "bad2", "bad3"))
    right = sum(x["v"] == "t" + x["g"][1:] for x in winners.collect())
    plain = sum(max({v for gg, _, v, _, _ in claims if gg == f"g{g}"}, key=lambda v, g=g: (sum(c[2] == v for c in claims if c[0] == f"g{g}"), v)) == f"t{g}" for g in range(120))
    assert right >= plain and right >= 105


def test_built_record_and_ties(spark):
    data = [("k", "b", "good", "1", None, "Ann", None, "Rare", None, None, None, None, None, None, 1), ("k", "a", "good", "1", None, "Ann", "7", None, None, None, None, None, None, None, 1), ("k", "c", "poor", "1", None, "Bob", "-", "Rare", None, None, None, None, None, None, 1)]
    row = representatives(spark.createDataFrame(data, SCHEMA), trust(spark)).head()
    assert (row["name"], row["card_id"], row["rarity"], row["mongo_id"], row["dominant"], row["n_records"]) == ("Ann", "7", "Rare", "a", False, 3)
    assert set(COUNTED) <= set(SCHEMA.replace(",", "").split())


def test_every_field_survives(spark):
    columns = "item_key string, mongo_id string, collection string, fingerprint_version string, updated_at timestamp, name string, card_id string, rarity string, anime_name string, command string, media_type string, file_unique_id string, sha256 string, phash string, duration_ms bigint, fps double, origin_chat_id bigint, origin_message_id bigint, archive_chat_id bigint, archive_message_id bigint, frame_hashes array<string>, sha256_aliases array<string>, name_aliases array<string>"
    at = dt.datetime(2031, 1, 1)
    base = ("k", "a", "Good", "2", None, "Ann", "7", "Rare", "S", "/c", "photo", None, None, None, 0, None, None, None, None, 4, None, [" AB", None, "-"], None)
    other = ("k", "b", "poor", "1", at, "Ann", None, None, None, None, None, "u1", " AAFF", "00FF", 9000, 2.5, 5, 6, None, None, ["f1", "f2"], ["ab", "cd"], ["Annie"])
    row = representatives(spark.createDataFrame([base, other], columns), trust(spark)).head().asDict()
    want = {"mongo_id": "a", "file_unique_id": "u1", "sha256": "aaff", "phash": "00ff", "duration_ms": 9000, "fps": 2.5, "origin_chat_id": 5, "origin_message_id": 6, "archive_chat_id": None, "archive_message_id": 4, "frame_hashes": ["f1", "f2"], "sha256_aliases": ["ab", "cd"], "name_aliases": ["Annie"], "fingerprint_version": "2", "collection": "good"}
    assert {c: row[c] for c in want} == want and row["updated_at"] is not None


def test_pairs_are_not_mixed(spark):
    data = [("k", f"m{i}", "good", "1", None, "Ann", chat, message) for i, (chat, message) in enumerate([(1, 10), (1, 11), (1, 12), (2, 20), (2, 20), (3, 99), (None, 99), (None, 99)])]
    kinds = "item_key string, mongo_id string, collection string, fingerprint_version string, updated_at timestamp, name string, origin_chat_id bigint, origin_message_id bigint"
    full = spark.createDataFrame(data, kinds).select("*", *[F.lit(None).cast("string").alias(c) for c in COUNTED if c not in kinds])
    row = representatives(full, trust(spark)).head()
    assert (row["origin_chat_id"], row["origin_message_id"]) == (2, 20)


CLAIMS = "g string, f string, v string, s string, n bigint"


def test_contests_that_are_alike_are_held_once(spark, monkeypatch):
    alike = [(f"g{i}", f, v, s, n) for i in range(30) for f in ("name", "sha256") for v, s, n in ((f"a{i}", "s1", 1), (f"b{i}", "s2", 2))]
    swapped = [("x", "name", "a", "s2", 2), ("x", "name", "b", "s1", 1)]
    claims = spark.createDataFrame([*alike, *swapped, ("y", "name", "a", "s1", 1), ("y", "name", "a", "s2", 1), ("z", "name", "a", "s3", 1)], CLAIMS)
    held = contests(claims).collect()
    assert len(held) == 4 and len({r["c"] for r in held}) == 2
    assert sorted((r["s"], r["n"], r["m"]) for r in held) == [("s1", 1, 1), ("s1", 1, 60), ("s2", 2, 1), ("s2", 2, 60)]
    monkeypatch.setattr(survivors, "ALIKE_CLAIMS", 0)
    assert {(r["v"], r["s"], r["n"], r["m"]) for r in contests(claims).collect()} == {(v, s, n, 1) for _, _, v, s, n in (*alike, *swapped)}
    assert contests(claims.limit(0)).count() == 0


def rounds(claims):
    """Weights and winners by the rule, every contest taken by itself."""
    said = {}
    for g, f, v, s, n in claims:
        said.setdefault((g, f), {}).setdefault(v, {})[s] = n
    everything = {s: sum(c[4] for c in claims if c[3] == s) for s in {c[3] for c in claims}}
    weights, n = dict.fromkeys(everything, 1.0), 0
    win = lambda values: max(values, key=lambda v: (round(sum(k * weights[s] for s, k in values[v].items()), 9), v))
    while True:
        agreed = dict.fromkeys(everything, 0)
        for values in said.values():
            for s, k in values[win(values)].items():
                agreed[s] += k
        new = {s: w + survivors._step(n) * (survivors._weight(agreed[s], everything[s]) - w) for s, w in weights.items()}
        moved, weights, n = max(abs(new[s] - weights[s]) for s in new), new, n + 1
        if moved < survivors.CLOSE:
            return weights, {k: win(v) for k, v in said.items()}


def test_rounds_over_alike_contests_are_those_over_all(spark, monkeypatch):
    r = random.Random(11)
    claims = {(f"g{r.randrange(60)}", r.choice("ab"), f"v{r.randrange(3)}", r.choice(("s1", "s1", "s2", "s3", "s4"))): r.choice((1, 1, 2)) for _ in range(700)}
    claims = [(*k, n) for k, n in claims.items()]
    weights, won = rounds(claims)
    assert max(weights.values()) > min(weights.values()) + 0.1
    for most in (64, 4, 0):
        monkeypatch.setattr(survivors, "ALIKE_CLAIMS", most)
        winners, found = discover(spark.createDataFrame(claims, CLAIMS))
        found = {x["s"]: x["weight"] for x in found.collect()}
        assert found.keys() == weights.keys() and all(abs(found[s] - w) < 1e-9 for s, w in weights.items())
        assert {(x["g"], x["f"]): x["v"] for x in winners.collect()} == won


def test_keys_that_several_items_have(spark, rows):
    keys = [("a", "k1"), ("b", "k1"), ("c", "k2"), ("d", " "), ("e", " "), ("f", None), ("g", None), ("h", "k1 ")]
    df = spark.createDataFrame(keys, "mongo_id string, item_key string")
    assert rows(repeated(df)) == [("a",), ("b",)] and repeated(df.limit(0)).count() == 0
