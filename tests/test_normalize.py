from pyspark.sql import functions as F

from weftmatch.functions import normalize as N
from weftmatch.operators import attribution
from weftmatch.sources import items as I


def one(spark, expr, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(expr).head()[0]


def test_first_present_treats_white_space_as_present(spark):
    f = N.first_present("a", "b")
    assert one(spark, f, a=" ", b="x") is None
    assert one(spark, f, a="", b=" x ") == "x"
    assert one(spark, f, a=None, b=None) is None
    assert one(spark, N.clean("a"), a="\u2009\xa0x y\u3000\n") == "x y"


def test_lists(spark):
    assert one(spark, N.string_list("a"), a=[" x", None, "", "x", "y"]) == ["x", "y"]
    assert one(spark, N.frame_hashes("a"), a=["x", " ", "x"]) == ["x", "x"]
    assert one(spark, N.with_main("a", "b"), a=["x"], b=" x ") == ["x"]
    assert one(spark, N.with_main("a", "b"), a=["x"], b="y") == ["x", "y"]


def test_media_words(spark):
    kind = lambda word, v=False, p=False: one(spark, N.media_type("w", F.lit(v), F.lit(p)), w=word)
    assert [kind("GIF "), kind("pic"), kind("sticker"), kind(None, True, True), kind("", False, True), kind(None)] == ["video", "photo", "sticker", "video", "photo", None]


def test_numbers(spark):
    assert one(spark, N.nonzero_first("a", "b"), a="0", b="7") == 7
    assert one(spark, N.nonzero_first("a", "b"), a="bad", b=None) == 0
    assert one(spark, N.int_or_null("a"), a=" 12 ") == 12
    assert one(spark, N.int_or_null("a"), a="1.x") is None


def test_names(spark):
    assert one(spark, N.normalize_name("a"), a=" ┃ ： Ｙｏｔｏ   Brilewen ") == "Yoto Brilewen"
    assert one(spark, N.normalize_name("a"), a=" • ") is None
    assert one(spark, N.first_token("a"), a="- Yoto Brilewen") == "Yoto"
    assert one(spark, N.stylised_fold("a"), a="ᴄᴀᴛ Ｘ") == "cat X"
    assert one(spark, N.clean_title("a"), a="My_Great  BOT!") == "my great bot"
    assert one(spark, N.username("a"), a=" @@Some_Bot ") == "@some_bot"
    assert one(spark, N.username("a"), a=" @ ") is None
    assert one(spark, N.html_escape("a"), a="<a&b>") == "&lt;a&amp;b&gt;"
    assert one(spark, N.joined_text("a", "b"), a=" ", b="x") == "x"


def test_results(spark):
    cols = [F.col(c) for c in ("n", "i", "r", "c")]
    assert one(spark, N.format_result(*cols, ["/h"]), n="A B", i="1", r=None, c="/x") == "NAME: A B\nID: 1"
    assert one(spark, N.format_result(*cols, ["/h"]), n="A B", i="1", r="Rare", c="/h") == "NAME: A B"
    assert one(spark, N.hint_text(F.col("c"), F.col("n")), c="/x", n="A B") == "/x A"
    assert one(spark, N.document_media_type(F.col("m"), F.col("f")), m=None, f="x.GIF") == "photo"
    assert one(spark, N.document_media_type(F.col("m"), F.col("f")), m="video/mp4", f=None) == "video"
    assert [one(spark, N.document_media_type(F.col("m"), F.col("f")), m="x/y", f=f) for f in ("a.bmp", "a.avi", "a.JPEG", "a.mov")] == [None, None, "photo", "video"]
    assert [one(spark, N.age_text(F.col("s")), s=s) for s in (-1, 5, 65, 7300)] == ["N/A", "5s", "1m 5s", "2h 1m"]
    assert [one(spark, N.uptime_text(F.col("s")), s=s) for s in (5, 65, 7300, 90061)] == ["5s", "1m 5s", "2h 1m 40s", "1d 1h 1m"]
    assert [one(spark, N.count_text(F.col("s")), s=s) for s in (0, 1234567)] == ["0", "1,234,567"]
    assert [one(spark, N.ms_text(F.col("s")), s=s) for s in (2.5, 3.5, 0.2)] == ["2 ms", "4 ms", "0 ms"]


RAW = "_id string, collection string, name string, title string, type string, photo_fingerprint struct<phash string, dhash string>, video_fingerprint struct<duration_ms string, sample_hashes array<struct<position double, frame_index int, phash string, dhash string>>>, media_geometry struct<duration_ms string>, frames array<string>, id string, file_unique_ids array<string>, source_origin struct<chat_id string, message_id string>"


def test_documents_become_items(spark):
    raw = spark.createDataFrame(
        [
            ("1", " C ", "A", None, "gif", None, ("2500", [(0.5, 1, "p", "d"), (0.5, None, "p", "d")]), None, None, None, [" u ", "u"], ("5", "x")),
            ("2", "c", " ", "title", None, None, None, None, None, None, None, None),
            ("3", "c", "", "Title", None, ("ab", None), None, ("7",), None, "9", None, None),
            ("4", "c", "B", None, None, None, ("bad", None), ("8",), ["x", ""], None, None, None),
        ],
        RAW,
    )
    dims = spark.createDataFrame([("c", "/c")], "collection string, default_command string")
    got = {r["mongo_id"]: r for r in I.parse_items(raw, dims).collect()}
    assert set(got) == {"1", "3", "4"}
    a, b, c = got["1"], got["3"], got["4"]
    assert (a["media_type"], a["duration_ms"], len(a["video_samples"]), a["file_unique_ids"], a["origin_chat_id"], a["origin_message_id"], a["command"]) == ("video", 2500, 1, ["u"], 5, None, "/c")
    assert (b["name"], b["media_type"], b["duration_ms"], b["card_id"], b["phash"], b["is_bad"]) == ("Title", "photo", 7, "9", "ab", False)
    assert (c["duration_ms"], c["frame_hashes"], c["media_type"], c["is_bad"]) == (8, ["x"], "video", True)


def test_store_and_payload(spark, tmp_path, rows):
    items = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y")], "collection string, mongo_id string, name string")
    path = str(tmp_path / "store")
    I.write_items(items, path)
    I.write_items(spark.createDataFrame([("b", "3", "z")], "collection string, mongo_id string, name string"), path)
    assert rows(I.read_items(spark, path), "collection", "mongo_id") == [("a", "1"), ("b", "3")]
    assert rows(I.read_items(spark, path, ["a"]), "mongo_id") == [("1",)]
    schema = "collection string, mongo_id string, name string"
    packed = I.to_payload(items).unionByName(spark.createDataFrame([("c", "9", "{broken")], "collection string, mongo_id string, item_json string"))
    assert rows(I.from_payload(packed, schema), "mongo_id", "name") == [("1", "x"), ("2", "y")]
    ids = spark.createDataFrame([("a", "1"), ("a", "1"), ("z", "1")], "collection string, mongo_id string")
    assert rows(I.by_ids(items, ids), "mongo_id") == [("1",)]


def test_commands_and_rules(spark):
    texts = ["/Grab@bot now", "please using: /pick_2", "see /x, ok", "nothing", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    known = ["/grab", "/pick_2", "/x", "/catch"]
    said = lambda d: [r[0] for r in d.select(attribution.command_in(F.col("t"), known)).collect()]
    assert said(df) == ["/grab", "/pick_2", "/x", None, None, None]
    more = ["/unknown use /catch", "／ｃａｔｃｈ now", "ᴜsɪɴɢ = /Catch", "see /other and /x", "full/x", "http://x", "//x", "go /x@bot!", "go /x@", "/x@bot@y", "at\n/x", "/grab2", "/grab-2"]
    assert said(spark.createDataFrame([(t,) for t in more], "t string")) == ["/catch", "/catch", "/catch", None, "/x", None, None, "/x", None, "/x", "/x", None, "/grab"]
    assert said(spark.createDataFrame([("use " + "/ " * 50_000 + "/x",)], "t string")) == ["/x"]
    assert df.select(attribution.command_in(F.col("t"), []).alias("c")).filter("c is not null").count() == 0
    hand = spark.createDataFrame([("/Waifu",), ("/waifu@Bot x",), ("/waifu@other",), (" /waifu",), ("/waifus",), ("",), (None,)], "t string")
    assert [r[0] for r in hand.select(attribution.manual_command(F.col("t"), ["/waifu"], "@bot")).collect()] == ["/waifu", "/waifu", None, None, None, None, None]
    rules = [("card\\s+drop", "one"), ("drop", "two")]
    many = spark.createDataFrame([("CARD\n drop",), ("a drop",), (None,)], "t string")
    assert [r[0] for r in many.select(attribution.first_rule(rules, F.col("t"))).collect()] == ["one", "two", None]
    assert [r[0] for r in many.select(attribution.custom_rule([("drop|card", "both"), ("drop", "one")], F.col("t"))).collect()] == ["both", "one", None]


def test_titles_are_folded(spark):
    assert [one(spark, N.clean_title("a"), a=t) for t in ("မြန်မာ_Bot", "Ｍｙ ʙᴏᴛ", "…", "a__b")] == ["မြန်မာ bot", "my bot", "", "a b"]
    assert N.title_text("  Ｍｙ_ʙᴏᴛ မြ! ") == "my bot မြ"


def test_rules_for_an_account(spark):
    df = spark.createDataFrame([("@feed", "x y"), ("@other", "x y"), (None, "@feed")], "a string, t string")
    rules = [("x|y", "words"), ("@Feed", "account")]
    assert [r[0] for r in df.select(attribution.custom_rule(rules, F.col("t"), F.col("a"))).collect()] == ["account", "words", None]


def test_frame_lists_in_all_forms(spark):
    schema = "a string, b map<string,string>, c array<struct<hash string, phash string>>, d array<string>"
    df = spark.createDataFrame([("x, y,", {"k": "m"}, [("", "p"), ("h", "q"), (None, None)], ["l", " "]), ("", {}, [], None)], schema)
    get = lambda c: [r[0] for r in df.select(N.frame_hashes(I.frame_list(df, c))).collect()]
    assert get("a") == [["x", "y"], []] and get("b") == [["m"], []] and get("c") == [["p", "h"], []] and get("d") == [["l"], []]
    raw = spark.createDataFrame([("1", "c", "n", (["f1"],))], "_id string, collection string, name string, media struct<frame_hashes array<string>>")
    assert I.parse_items(raw).head()["frame_hashes"] == ["f1"]


def test_titles_scopes_and_blocks(spark, rows):
    titles = spark.createDataFrame([("lantern hunt", "l", 2), ("lantern", "k", 1), ("amber", "a", 3)], "title string, collection string, ord int")
    probes = spark.createDataFrame([("1", "Lantern_Hunt"), ("2", "the LANTERN hunt bot"), ("3", "amb"), ("4", None), ("5", "other")], "probe_id string, heard string")
    got = dict(rows(attribution.title_match(probes, titles, "heard"), "probe_id", "title_collection"))
    assert got == {"1": "l", "2": "k", "3": "a", "4": None, "5": None}
    commands = spark.createDataFrame([("/g", "b", 2), ("/g", "a", 1), ("/g", "a", 1)], "command string, collection string, ord int")
    assert rows(attribution.command_scopes(commands)) == [("/g", ["a", "b"])]
    flags = spark.createDataFrame([(True, "s", "/g", ["a"]), (False, "s", "/g", ["a"]), (False, None, "/g", ["a"]), (False, None, "/g", None)], "b boolean, s string, c string, k array<string>")
    scope = attribution.lookup_scope(F.col("b"), F.col("s"), F.col("c"), F.col("k"))
    assert [tuple(r[0]) for r in flags.select(scope).collect()] == [("blocked", []), ("source", ["s"]), ("command", ["a"]), ("all", None)]
    events = spark.createDataFrame([(1,), (2,), (None,)], "user_id bigint")
    assert rows(attribution.blocked(events, spark.createDataFrame([(1,), (1,)], "user_id bigint"))) == [(2,), (None,)]
