import itertools
import random

from hypothesis import given
from hypothesis import strategies as st

from weftmatch.llm import names
from weftmatch.llm.names import name_links, parse_name, parse_series
from weftmatch.llm.segments import cuts, edit_join, lookups


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@given(st.text("ab", max_size=12), st.text("ab", max_size=12), st.integers(0, 3))
def test_close_strings_share_a_looked_up_segment(a, b, k):
    if distance(a, b) <= k:
        index = {(len(b) * (k + 1) + i, b[s : s + z]) for i, (s, z) in enumerate(cuts(len(b), k)) if z or i == 0}
        assert any((t, a[p : p + z]) in index for t, p, z in lookups(len(a), k, False))


def test_edit_join_equals_all_pairs(spark):
    r = random.Random(8)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randrange(0, 9))) for _ in range(160)})
    df = spark.createDataFrame([(w, len(w) % 2) for w in words] + [(None, 1)], "text string, g int")
    got = {(x["l"], x["r"], x["distance"]) for x in edit_join(df, df, 2).collect()}
    assert got == {(a, b, distance(a, b)) for a, b in itertools.product(words, repeat=2) if distance(a, b) <= 2}
    grouped = {(x["l"], x["r"]) for x in edit_join(df, df, 1, "g").collect()}
    assert grouped == {(a, b) for a, b in itertools.product(words, repeat=2) if distance(a, b) <= 1 and len(a) % 2 == len(b) % 2}
    one = {tuple(sorted((x["l"], x["r"]))) for x in edit_join(df, df, 2, one_way=True).collect()}
    assert one == {tuple(sorted(x[:2])) for x in got}


def test_segments_are_not_broadcast(spark, tmp_path):
    """Files of a few kilobytes become many segments, which the driver must not gather."""
    path = f"file://{tmp_path}/texts"
    spark.createDataFrame([(f"{i:05d}", 1) for i in range(300)], "text string, g int").write.parquet(path)
    df = spark.read.parquet(path)
    for pairs in (edit_join(df, df, 2), edit_join(df, df, 2, one_way=True)):
        assert len(pairs.collect()) > 300
        # The plan as it ran, since sizes known at run time may turn a join into another.
        assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_bynames_are_told_before_series_are_joined(spark, monkeypatch):
    """What by-names are told from is read from a written table; the join with series is not made again for it."""
    seen, joined = [], []
    monkeypatch.setattr(names, "small", lambda df, f=names.small: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or f(df))
    monkeypatch.setattr(names, "skew_join", lambda *a, f=names.skew_join: joined.append(len(seen)) or f(*a))
    items = spark.createDataFrame([("1", "The Iron Hound", ["Rotar Breibren"], SERIES), ("2", "Iron Hound", None, SERIES)], "mongo_id string, name string, name_aliases array<string>, anime_name string")
    assert name_links(items).count() == 1
    assert joined == [3] and len(seen) == 4 and not any("Join LeftOuter" in p for p in seen)


def test_names_are_taken_apart():
    assert parse_name("Dr. Ann-Lee Gray ❄ [SSR]") == ("full", "ann", "leegray")
    assert parse_name("GRAY, Ann (ver. 2)") == ("full", "ann", "gray")
    assert parse_name("AnnGray") == ("full", "ann", "gray")
    assert parse_name("Gray_Ann #12") == ("full", "gray", "ann")
    assert parse_name("A. Gray") == ("init", "a", "gray") and parse_name("Gray, A.") == ("init", "a", "gray")
    assert parse_name("Ann-kun Gray") == ("short", "ann", "gray")
    assert parse_name("Ánn") == ("one", "ann", "")
    assert parse_name("The Iron Hound") == ("byname", "iron", "hound")
    assert [parse_name(x) for x in (None, "", " ", "N/A", "???", "[SSR]")] == [None] * 6


def test_series_are_named_by_main_title():
    assert parse_series("Hall of Mirrors: Second Arc (TV)") == ("hall of mirrors", "hmsa", "hm")
    assert parse_series("Hall & Mirrors - Second Arc S2")[0] == "hall and mirrors"
    assert parse_series("The Glass Hall 2nd Season") == ("glass hall", "tgh", "tgh")
    assert parse_series("unknown") == ("", "", "")


SERIES, OTHER = "Golden Harbor of Kodinfi", "Silent Ledger of Brabeth"


def links(spark, rows, *items):
    data = [(f"{i:02d}", n, al, s, 1) for i, (n, al, s) in enumerate(items)]
    got = rows(name_links(spark.createDataFrame(data, "mongo_id string, name string, name_aliases array<string>, anime_name string, sid int")))
    return {(int(a), int(b)) for a, b in got}


def test_variants_are_linked(spark, rows):
    names = ["Thinto Gurenfi", "Gurenfi, Thinto", "THINTO gurenfi", "Thint Gurenfi", "Thinot Gurenfi", "T. Gurenfi", "Thinto", "Lady Thinto Gurenfi [SSR]", "Ｔｈｉｎｔｏ Gurenfi", "Thinkins Gurenfi"]
    got = links(spark, rows, *[(n, None, SERIES) for n in names])
    assert got == set(itertools.combinations(range(len(names)), 2))


def test_series_decide(spark, rows):
    got = links(spark, rows, ("Thinto Gurenfi", [], SERIES), ("Gurenfi Thinto", None, OTHER), ("Gurenfi Thinto", None, SERIES + ": Days"), ("Thinto  Gurenfi", None, "GHK"), ("Thinto-Gurenfi", None, None))
    assert got == {(0, 2), (0, 3), (2, 3)}


def test_aliases_bynames_and_nobody(spark, rows):
    got = links(spark, rows, ("The Iron Hound", [" ", None, "Rotar Breibren"], SERIES), ("Breibren Rotar", None, SERIES), ("???", ["Rotar Breibren"], SERIES), (None, ["Rotar Breibren"], SERIES), ("The Iron Hound ", None, None), ("Iron Hound", None, OTHER))
    assert got == {(0, 1)}


def test_siblings_and_ambiguous_initials_stay_apart(spark, rows):
    got = links(spark, rows, ("Pairtar Keiparvel", None, SERIES), ("Pounmi Keiparvel", None, SERIES), ("P. Keiparvel", None, SERIES), ("Rotar Sina", None, SERIES))
    assert got == set()


def test_no_items(spark, rows):
    assert links(spark, rows, (None, None, None)) == set()
