"""Problem 4: variant spellings of names that people type.

Names and aliases are brought to plain form and taken apart: decorations, titles and honorifics go, inverted and joined
parts are set right, and what remains is a full name (two parts), a name with an initial, or a single part. Series are
named by their main title; misspelt titles join the common one within ``SERIES_EDITS`` edits, initials stand for the one
series they fit.

Full names of one series are linked when they are within ``NAME_EDITS`` edits in either order of their parts (the
segment join of ``segments``), or occur as name and alias of one item. Linked names are consolidated to characters.
Then what is less than a full name goes to the one character of its series that it fits: initials, short forms, single
parts. Items without a series go to the one character of any series that has their name. Whatever fits several
characters stays alone.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import skew_join, skew_pairs
from ..session import materialize, small
from .groups import components
from .items import STAND_INS
from .plaintext import plain_array
from .segments import edit_join

NAME_EDITS, SERIES_EDITS = 3, 2
#: A title is a misspelling of a common one only if it is at most this share as frequent.
RARE_TITLE = 0.25

# Words before a name, endings after one, and endings of short forms.
TITLES = frozenset("lord lady sir dame dr doctor prof professor princess prince king queen capt captain agent miss mister mr mrs ms master general commander saint st".split())
HONORIFIC = re.compile(r"-(?:kun|chan|san|sama|sensei|senpai|dono|tan)\b", re.I)
SHORT_ENDS = ("kins", "ie", "y", "o")
SURE_SHORT_ENDS = ("kins", "ie", "y")
#: Letters of the longest short form without an ending of its own ('Bru' for 'Bruvel').
SHORT_LETTERS = 5
# Small words that titles' initials skip, and what follows a title without naming another series.
SMALL_WORDS = frozenset(("of", "and", "the", "a", "an", "in", "to"))
SEASON = re.compile(r"\s*(?:\(tv\)|\(ova\)|\(movie\)|season \d+|\d+(?:st|nd|rd|th) season|\bs\d+|the movie|\bpart \d+)\s*$")

_BRACKETS = re.compile(r"\[[^\]]*\]|\([^)]*\)|\{[^}]*\}|~[^~]*~|#\d+")
_CAMEL = re.compile(r"(?<=[a-zß-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ])")
_SPLIT = re.compile(r"[\s_・\-/]+")
_NOT_NAME = re.compile(r"[^\w\s,._・'\-/]+")


def fold(text: str) -> str:
    """Lower case without accents on Latin letters."""
    out = []
    for ch in text.lower():
        if ord(ch) > 127:
            parts = unicodedata.normalize("NFD", ch)
            if ord(parts[0]) < 128 or "LATIN" in unicodedata.name(parts[0], ""):
                ch = parts[0]
        out.append(ch)
    return "".join(out)


def parse_name(text: str | None) -> tuple[str, str, str] | None:
    """(kind, a, b) of a name in plain form; None where it names nobody.

    Kinds: ``full`` has two parts; ``byname`` too, after an article ("The Iron Hound"); ``init`` an initial ``a`` and the other part ``b``; ``short`` a part marked as a
    short form by an honorific, and the other part; ``one`` a single part ``a``."""
    if text is None or text.strip().lower() in STAND_INS or not text.strip():
        return None
    text = _NOT_NAME.sub(" ", _BRACKETS.sub(" ", text))
    short = bool(HONORIFIC.search(text))
    text = HONORIFIC.sub("\x00", text)
    if text.count(",") == 1:
        a, b = text.split(",")
        if a.strip() and b.strip():
            text = f"{b} {a}"
    parts = []
    for word in _SPLIT.split(text.replace(",", " ")):
        for piece in _CAMEL.split(word):
            low = fold(piece).strip("._'\x00")
            if low:
                parts.append((low, "\x00" in piece))
    while len(parts) > 1 and parts[0][0] in TITLES:
        parts = parts[1:]
    by_name = "full"
    if len(parts) > 2 and parts[0][0] == "the":
        parts, by_name = parts[1:], "byname"
    if not parts or all(p[0] in STAND_INS for p in parts):
        return None
    words = [p[0] for p in parts]
    if len(words) == 1:
        return "one", words[0], ""
    marked = next((i for i, p in enumerate(parts) if p[1]), None)
    if short and marked is not None and len(words) == 2:
        return "short", words[marked], words[1 - marked]
    singles = [i for i, w in enumerate(words) if len(w) == 1 and w.isascii()]
    if len(words) == 2 and len(singles) == 1:
        return "init", words[singles[0]], words[1 - singles[0]]
    return by_name, words[0], "".join(words[1:])


def parse_series(text: str | None) -> tuple[str, str, str]:
    """(main title, initials of the whole title, initials of the main title) in folded form; a title that is one word
    of up to six letters may itself be initials. Empty where no series is named."""
    if text is None or text.strip().lower() in STAND_INS or not text.strip():
        return "", "", ""
    low = re.sub(r"\s+", " ", fold(text).replace("&", " and ")).strip()
    while True:
        cut = SEASON.sub("", low)
        if cut == low or not cut:
            break
        low = cut
    main, _, rest = re.sub(r"\s*(?::| - )\s*", "\x01", low, count=1).partition("\x01")

    def initials(title: str) -> str:
        words = re.findall(r"[^\W_]+", title)
        return "".join(w[0] for i, w in enumerate(words) if i == 0 or w not in SMALL_WORDS)

    words = re.findall(r"[^\W_]+", main)
    main = " ".join(words)
    whole, head = initials(main) + initials(rest), initials(main)
    return (" ".join(words[1:]) if len(words) > 2 and words[0] == "the" else main), whole, head


PARSED = "mongo_id string, name string, main string, whole string, head string, kind string, a string, b string, forms array<string>, bynames array<string>"


def parsed(items: DataFrame) -> DataFrame:
    """Items with their names and series taken apart, in Arrow batches; ``forms`` has the full names of the item as
    two parts joined by a space, its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, tuple[str, str, str]] = {}
        read: dict[str | None, tuple[str, str, str] | None] = {}

        def name_of(text: str | None) -> tuple[str, str, str] | None:
            if text not in read:
                if len(read) > 50_000:
                    read.clear()
                read[text] = parse_name(text)
            return read[text]

        for batch in batches:
            names, series, aliases = plain_array(batch.column(1)).to_pylist(), plain_array(batch.column(2)).to_pylist(), batch.column(3)
            flat = plain_array(aliases.flatten()).to_pylist()
            at = 0
            out: list[list] = [[] for _ in range(8)]
            for name, title, size in zip(names, series, (0 if x is None else x for x in pc.list_value_length(aliases).to_pylist()), strict=True):
                own = name_of(name)
                if title not in known:
                    if len(known) > 50_000:
                        known.clear()
                    known[title] = parse_series(title)
                forms = [own] if own else []
                forms += [f for f in map(name_of, flat[at : at + size]) if f]
                at += size
                kind, a, b = own or (None, "", "")
                for column, value in zip(out, (*known[title], kind, a, b, [f"{x[1]} {x[2]}" for x in forms if x[0] in ("full", "byname")], [f"{x[1]} {x[2]}" for x in forms if x[0] == "byname"]), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), *(pa.array(x, pa.string()) for x in out[:6]), *(pa.array(x, pa.list_(pa.string())) for x in out[6:])], ["mongo_id", "name", "main", "whole", "head", "kind", "a", "b", "forms", "bynames"])

    return items.select("mongo_id", F.col("name").alias("n"), "anime_name", F.coalesce("name_aliases", F.array().cast("array<string>")).alias("x"), "name").mapInArrow(run, PARSED)


def series_ids(rows: DataFrame) -> DataFrame:
    """``main``, ``sid`` (a hash of the title, 0 for none): the series of every main title. A rare title goes to the most frequent one within
    ``SERIES_EDITS`` edits, initials to the one series they fit; initials that fit none or several name no series."""
    titles = materialize(rows.filter("main <> ''").groupBy("main").agg(F.count(F.lit(1)).alias("n"), F.max("whole").alias("whole"), F.max("head").alias("head")), "titles")
    word = (F.length("main") <= 6) & ~F.col("main").contains(" ")
    long = titles.filter(~word).select(F.col("main").alias("text"), "n")
    near = edit_join(long.select("text"), long.select("text"), SERIES_EDITS).filter("l <> r")
    near = near.join(long.select(F.col("text").alias("r"), "n"), "r").join(long.select(F.col("text").alias("l"), F.col("n").alias("m")), "l").filter(F.col("m") <= F.greatest(F.lit(1), F.col("n") * RARE_TITLE)).filter("n > m or (n = m and r < l)")
    up = materialize(near.groupBy("l").agg(F.max_by("r", F.struct("n", "r")).alias("top")), "series")
    step = up.join(up.select(F.col("l").alias("top"), F.col("top").alias("next")), "top", "left").select("l", F.coalesce("next", "top").alias("top"))
    sid = materialize(long.select(F.col("text").alias("main")).join(step.withColumnRenamed("l", "main"), "main", "left").select("main", F.coalesce("top", "main").alias("sid")), "sid")
    known = titles.filter(~word).join(sid, "main")
    spelt = known.select(F.explode(F.array("whole", "head")).alias("main"), "sid").distinct().groupBy("main").agg(F.count(F.lit(1)).alias("c"), F.first("sid").alias("sid")).filter("c = 1")
    short = titles.filter(word).select("main").join(spelt.select("main", "sid"), "main", "left").select("main", "sid")
    return sid.unionByName(short).select("main", F.when(F.col("sid").isNull(), F.lit(0).cast("bigint")).otherwise(F.xxhash64("sid")).alias("sid"))


def _flip(form: Column) -> Column:
    return F.concat(F.substring_index(form, " ", -1), F.lit(" "), F.substring_index(form, " ", 1))


def _close(l: Column, r: Column, sure: Column) -> Column:
    """Whether two spellings of a full name (parts in the same order) are one name: few edits in each part, fewer in a
    short part. Without a ``sure`` series only one edit is allowed; where letters only changed places, one more."""
    la, lb, ra, rb = F.substring_index(l, " ", 1), F.substring_index(l, " ", -1), F.substring_index(r, " ", 1), F.substring_index(r, " ", -1)
    da, db = F.levenshtein(la, ra), F.levenshtein(lb, rb)
    small = lambda x, y, d: d <= F.when(F.least(F.length(x), F.length(y)) <= 3, 1).otherwise(2)
    letters = lambda x: F.array_sort(F.split(x, ""))
    same = (letters(la) == letters(ra)) & (letters(lb) == letters(rb))
    return small(la, ra, da) & small(lb, rb, db) & (da + db <= F.when(sure, 3).otherwise(1) + F.when(same, 1).otherwise(0))


def _bynames(rows: DataFrame) -> DataFrame:
    """``mongo_id``, ``told``: the forms of an item that are by-names, for items that have any.

    A by-name ("The Iron Hound", "Iron Hound") is a full name both of whose words stand in such a place after an
    article somewhere in the data. It says who is meant within a series, but not without one."""
    words = materialize(rows.select(F.explode("bynames").alias("form")).distinct(), "bynames")
    first, second = words.select(F.substring_index("form", " ", 1).alias("w1")).distinct(), words.select(F.substring_index("form", " ", -1).alias("w2")).distinct()
    every = rows.select(F.explode("forms").alias("form")).distinct().withColumns({"w1": F.substring_index("form", " ", 1), "w2": F.substring_index("form", " ", -1)})
    told = materialize(every.join(small(first), "w1", "left_semi").join(small(second), "w2", "left_semi").select("form"), "told")
    # Few items have such a name, so what is joined back is small wherever that was checked.
    held = rows.select("mongo_id", F.explode("forms").alias("form")).join(small(told), "form", "left_semi")
    return materialize(held.groupBy("mongo_id").agg(F.collect_set("form").alias("told")), "held")


def _plain_first(rows: DataFrame, held: DataFrame) -> DataFrame:
    """``rows`` with ``forms`` distinct and by-names (``held``, of ``_bynames``) last, and ``proper``, the forms that are none."""
    proper = F.array_except("forms", F.coalesce("told", F.array().cast("array<string>")))
    return rows.drop("bynames").join(small(held), "mongo_id", "left").withColumn("proper", proper).withColumn("forms", F.array_distinct(F.concat("proper", "forms"))).drop("told")


ENDS = "(?:" + "|".join(SHORT_ENDS) + ")$"
SURE_ENDS = "(?:" + "|".join(SURE_SHORT_ENDS) + ")$"


def _stem(c: Column | str) -> Column:
    return F.regexp_replace(c, ENDS, "")


def _one(rows: DataFrame, *by: str) -> DataFrame:
    """Of (by, ent) the rows whose ``by`` has one ``ent`` only."""
    return rows.groupBy(*by).agg(F.min("ent").alias("ent"), F.max("ent").alias("hi")).filter("ent = hi").drop("hi")


def _moves(known: DataFrame, two: DataFrame) -> DataFrame:
    """(from_ent, to_ent): characters that are another's short form, or that have no series and another's name.

    A short form shares one part with the longer name, and its stem begins the longer part ('Netho X', 'Nethalia X');
    a misspelt one with a sure ending begins with the same two letters. Each has one possible goal, else it stays."""
    goal = two.filter("sid <> 0").select("sid", "part", F.substring("other", 1, 2).alias("two"), "other", "ent")
    cut = two.select("sid", "part", F.substring("other", 1, 2).alias("two"), F.col("other").alias("nick"), F.explode(F.array_distinct(F.array("other", _stem("other")))).alias("stem"), F.col("ent").alias("from_ent")).filter(f"length(stem) >= 2 and (stem <> nick or length(nick) <= {SHORT_LETTERS})")
    longer = F.col("other").startswith(F.col("stem")) & (F.length("other") > F.length("stem") + 1) & (_stem("other") != F.col("stem")) & (F.col("other") != F.col("nick")) & (F.col("from_ent") != F.col("ent"))
    near = cut.filter("sid <> 0").join(goal, ["sid", "part", "two"]).filter(longer).select("from_ent", "ent")
    afar = cut.filter("sid = 0").drop("sid").join(goal.drop("sid"), ["part", "two"]).filter(longer).select("from_ent", "ent")
    fits = materialize(near.unionByName(afar).distinct(), "fits")
    rest = two.filter(F.col("other").rlike(SURE_ENDS) & (F.col("sid") != 0)).join(fits.select(F.col("from_ent").alias("ent")), "ent", "left_anti")
    vague = rest.select("sid", "part", F.substring("other", 1, 2).alias("two"), F.col("ent").alias("from_ent")).join(goal.filter(~F.col("other").rlike(SURE_ENDS)), ["sid", "part", "two"]).filter("from_ent <> ent and length(other) > 3").select("from_ent", "ent")
    short = _one(fits.unionByName(vague), "from_ent")
    # Names without a series: the one character anywhere that has the name, exactly or else within an edit.
    named = known.filter("sid <> 0").select("text", "ent").distinct()
    lone = known.filter("sid = 0").select("text", F.col("ent").alias("from_ent")).distinct()
    exact = materialize(lone.join(named, "text").select("from_ent", "ent").distinct(), "exact")
    left = lone.join(exact.select("from_ent"), "from_ent", "left_anti").select(F.explode(F.array("text", _flip(F.col("text")))).alias("text"), "from_ent")
    loose = edit_join(left.select("text").distinct(), named.select("text").distinct(), 2)
    loose = loose.filter((F.col("distance") == 1) | (F.array_sort(F.split("l", "")) == F.array_sort(F.split("r", ""))))
    loose = loose.join(left.withColumnRenamed("text", "l"), "l").join(named.withColumnRenamed("text", "r"), "r").select("from_ent", "ent")
    placed = materialize(_one(exact.unionByName(loose), "from_ent"), "placed")
    moves = materialize(placed.unionByName(short.join(placed.select("from_ent"), "from_ent", "left_anti")).withColumnRenamed("ent", "to_ent"), "moves")
    step = moves.select(F.col("from_ent").alias("to_ent"), F.col("to_ent").alias("next"))
    return materialize(moves.join(step, "to_ent", "left").select("from_ent", F.coalesce("next", "to_ent").alias("to_ent")), "moves")


def characters(items: DataFrame) -> DataFrame:
    """``mongo_id``, ``name``, ``character`` of every item whose name could be placed: items of one character mean the
    same person of the same series.

    ``items`` has ``mongo_id`` (rows of one ``mongo_id`` are alike and count once) with ``name``, ``name_aliases`` (null or empty allowed, blanks and nulls
    inside too) and ``anime_name``. Null, blank and stand-in names give no row. Extra columns are ignored."""
    rows = materialize(parsed(items).filter("kind is not null"), "parsed")
    series = materialize(series_ids(rows), "sids")
    # By-names don't depend on the series, so they are told before rows and series are joined, which is done once.
    held = _bynames(rows)
    rows = skew_join(rows.drop("whole", "head"), series, "main", "left").withColumn("sid", F.coalesce("sid", F.lit(0).cast("bigint"))).drop("main")
    # Without a series only proper names count, and an item without one stands alone.
    rows = _plain_first(rows, held).withColumn("forms", F.when(F.col("sid") == 0, F.col("proper")).otherwise(F.col("forms"))).drop("proper")
    rows = materialize(rows, "placed")
    # Nodes: one full name in one series, by a 64-bit hash. A name and its flipped form are one node.
    key = lambda f: F.least(f, _flip(f))
    nodes = materialize(rows.select("sid", F.explode("forms").alias("form")).select("sid", key(F.col("form")).alias("text")).distinct().withColumn("node", F.xxhash64("sid", "text")), "nodes")
    forms, nodes = nodes, nodes.select("sid", "text")
    both = nodes.unionByName(nodes.select("sid", _flip(F.col("text")).alias("text"))).distinct()
    sure = edit_join(nodes.filter("sid <> 0"), both.filter("sid <> 0"), NAME_EDITS, "sid", one_way=True)
    unsure = edit_join(nodes.filter("sid = 0"), both.filter("sid = 0"), 2, one_way=True).withColumn("sid", F.lit(0).cast("bigint"))
    near = sure.unionByName(unsure).filter("l <> r").filter(_close(F.col("l"), F.col("r"), F.col("sid") != 0))
    node = lambda c: F.xxhash64("sid", key(F.col(c)))
    typed = near.select(node("l").alias("a"), node("r").alias("b"))
    alias = rows.filter("size(forms) > 1").select("sid", F.col("forms")[0].alias("l"), F.explode(F.slice("forms", 2, 1 << 20)).alias("r")).select(node("l").alias("a"), node("r").alias("b"))
    linked = components(typed.unionByName(alias), reduce=False)
    known = materialize(forms.join(linked.withColumnRenamed("v", "node"), "node", "left").select("sid", "text", "node", F.coalesce("root", "node").alias("ent")), "known")
    # Parts of the full names of every character, for what is less than a full name.
    a, b = F.substring_index("text", " ", 1), F.substring_index("text", " ", -1)
    two = known.select("sid", F.explode(F.array(F.struct(a.alias("part"), b.alias("other")), F.struct(b.alias("part"), a.alias("other")))).alias("x"), "ent").select("sid", "x.part", "x.other", "ent")
    two = materialize(two.distinct(), "parts")
    moves = _moves(known, two)
    final = lambda d: d.join(moves.withColumnRenamed("from_ent", "ent"), "ent", "left").withColumn("ent", F.coalesce("to_ent", "ent")).drop("to_ent")
    ent_of = final(known.select("node", "ent"))
    parts = materialize(final(two).distinct(), "parts")
    # Items with a full name, or with a full name among their aliases.
    named = rows.filter("size(forms) > 0").select("mongo_id", "name", F.xxhash64("sid", key(F.col("forms")[0])).alias("node"))
    full = named.join(ent_of, "node").select("mongo_id", "name", F.col("ent").alias("character"))
    # Within a series its own characters; without one, those of any series; failing both, those of unknown series.
    rest = materialize(rows.filter("size(forms) = 0").select("sid", "mongo_id", "name", "kind", "a", "b"), "rest")
    wants = rest.select("sid", "kind", "a", "b").distinct().withColumn("p", F.when(F.col("kind") == "init", F.substring("a", 1, 1)).otherwise(F.substring("a", 1, 2)))
    begins = F.when(F.col("kind") == "init", F.col("other").startswith(F.col("a"))).otherwise(F.col("other").startswith(_stem("a")) | F.col("other").startswith(F.col("a")))
    columns = ["sid", "kind", "a", "b", "ent"]
    part = parts.select("sid", F.col("part").alias("b"), F.explode(F.array(F.substring("other", 1, 1), F.substring("other", 1, 2))).alias("p"), "other", "ent")
    partial, single = wants.filter("kind in ('init', 'short')"), wants.filter("kind = 'one' and sid <> 0")
    fit = partial.filter("sid <> 0").join(part, ["sid", "b", "p"]).filter(begins).select(*columns)
    fit = fit.unionByName(partial.filter("sid = 0").join(part.drop("sid"), ["b", "p"]).filter(begins).select(*columns))
    whole = parts.select("sid", F.explode(F.array("part", F.concat("part", "other"))).alias("a"), "ent").distinct()
    fit = materialize(fit.unionByName(single.join(whole, ["sid", "a"]).select(*columns)).distinct(), "fit")
    none = materialize(wants.filter("sid <> 0").join(fit, ["sid", "kind", "a", "b"], "left_anti"), "none")
    later = none.filter("kind in ('init', 'short')").join(part.filter("sid = 0").drop("sid"), ["b", "p"]).filter(begins).select(*columns)
    shorts = none.filter("kind = 'short'").join(part, ["sid", "b", "p"]).select(*columns)
    misspelt = none.filter("kind = 'one' and length(a) > 4")
    typo = edit_join(misspelt.select("sid", F.col("a").alias("text")).distinct(), parts.select("sid", F.col("part").alias("text")).distinct(), 1, "sid")
    typo = typo.join(parts.select("sid", F.col("part").alias("r"), "ent"), ["sid", "r"]).select("sid", F.col("l").alias("a"), "ent")
    # Written out in steps: the driver plans a whole statement again after each of its stages.
    slips = materialize(misspelt.join(typo, ["sid", "a"]).select(*columns), "slips")
    fit = materialize(_one(fit.unionByName(later).unionByName(shorts).unionByName(slips), "sid", "kind", "a", "b"), "one")
    alone = F.when(F.col("sid") == 0, F.xxhash64("mongo_id")).otherwise(F.xxhash64("sid", "kind", "a", "b"))
    less = rest.join(fit, ["sid", "kind", "a", "b"], "left").select("mongo_id", "name", F.coalesce("ent", alone).alias("character"))
    return full.unionByName(less).distinct()


def name_links(items: DataFrame) -> DataFrame:
    """``mongo_id_a``, ``mongo_id_b`` (smaller first): items of one character whose ``name`` strings differ. The pairs of a
    character with many items are made in a grid of tasks."""
    placed = materialize(characters(items), "characters")
    a = placed.select("character", F.col("mongo_id").alias("mongo_id_a"), F.col("name").alias("na"))
    b = placed.select("character", F.col("mongo_id").alias("mongo_id_b"), F.col("name").alias("nb"))
    return skew_pairs(a, b, "character").filter("mongo_id_a < mongo_id_b and na <> nb").select("mongo_id_a", "mongo_id_b")
