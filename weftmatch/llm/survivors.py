"""Problem 3: the best representative of each duplicate group, by iterative truth discovery.

Truth discovery estimates the reliability of sources and the support of values in turn: a value's support is the sum of
the weights of the sources that claim it, a source's weight follows from the share of its claims that agree with the
winning values. It is used twice.

* Which record stands for its group: the sources are the four respects that rank a record (stated version, trust in its
  collection, recency, filled fields), each of which claims the records that are best in it. What a respect says about a
  record is one of 16 patterns and what is said in a group a set of them, so groups are counted by set once and the
  rounds need these counts only.
* What its fields hold: the sources are the collections, and every filled field of a record is its source's claim about
  the group. Claims are pre-aggregated to (group, field, value, source) counts, and only contested fields take part in
  the rounds; what is uncontested is counted once. How a field's contest ends depends on which sources claim its values
  and on the values' order, not on what they are, so contests that are alike in this are held once, with their number.

The base record is the elected one; records with equal support are told apart by how many of their values won, then by
id. A record that has the claims of all four respects, alone, dominates its group: that is checked after the election,
which such a record always wins, since no weight is 0.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import skew_join
from ..session import BROADCAST_ROWS, discard, materialize, small
from .items import real

#: Fields whose real values count as filled. Fixed by the problem's statement.
COUNTED = ("name", "card_id", "rarity", "anime_name", "command", "media_type", "file_unique_id", "sha256", "origin_message_id")
#: Fields of the surviving record that are voted on, where the items have them: texts, hex digests in lower case, sizes
#: (0 is unknown), pairs of which a whole one is voted on as one value, and lists of which one is taken as it is.
TEXTS = ("name", "card_id", "rarity", "anime_name", "command", "media_type", "file_unique_id", "fingerprint_version", "collection")
DIGESTS = ("sha256", "phash", "pixel_sha256", "phash_large", "dhash", "whash", "colorhash", "crop_hash", "video_signature")
SIZES = ("duration_ms", "fps", "frame_count", "width", "height")
PAIRS = (("origin_chat_id", "origin_message_id"), ("archive_chat_id", "archive_message_id"))
LISTS = ("frame_hashes", "video_samples")
#: Lists whose values are united.
ALIASES = ("name_aliases", "file_unique_ids", "sha256_aliases")
VOTED = (*TEXTS, *DIGESTS, *SIZES, *[f for pair in PAIRS for f in pair], *LISTS)
#: A source's agreement before anything is seen, as so many claims agreeing at this rate.
PRIOR_CLAIMS, PRIOR_RATE = 20.0, 0.8
#: The rounds end when no weight moves by ``CLOSE``. After ``FREE_ROUNDS`` each round moves weights half as far as the
#: round before, so that they end even where the winners would change back and forth.
FREE_ROUNDS, CLOSE = 12, 1e-3
#: Fields of a group with more claims than this are no longer compared with others but are contests of their own.
ALIKE_CLAIMS = 64


def version_number(column: Column) -> Column:
    """The number stated in a version text, -1 where there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(column, r"([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).try_cast("double"), F.lit(-1.0))


def stated(items: DataFrame) -> dict[str, Column]:
    """What a record claims for each field that ``items`` has, as text, null where nothing is filled in. A whole pair is
    one claim, ``first:second``, under both names joined by a colon; half a pair is one of its own field."""
    out = {c: F.when(real(F.col(c)), F.trim(c)) for c in TEXTS if c in items.columns}
    out |= {c: F.when(real(F.col(c)), F.lower(F.trim(c))) for c in DIGESTS if c in items.columns}
    if "collection" in out:
        out["collection"] = F.lower(out["collection"])
    out |= {c: F.when(F.col(c) != 0, F.col(c).cast("string")) for c in SIZES if c in items.columns}
    for pair in PAIRS:
        have = [F.col(c).cast("string") if c in items.columns else F.lit(None).cast("string") for c in pair]
        out |= {c: F.when(have[1 - i].isNull(), have[i]) for i, c in enumerate(pair) if c in items.columns}
        if set(pair) <= set(items.columns):
            out[":".join(pair)] = F.concat(have[0], F.lit(":"), have[1])
    return out | {c: F.when(F.size(c) > 0, F.to_json(c)) for c in LISTS if c in items.columns}


def read_back(items: DataFrame) -> list[Column]:
    """The fields of ``items`` in their own types, from columns of won texts named as in ``stated``."""
    kinds, out = dict(items.dtypes), []
    for c in VOTED:
        if c in kinds and c in LISTS:
            out.append(F.from_json(F.col(c), kinds[c]).alias(c))
        elif c in kinds:
            whole = [F.split(F.col(f"`{':'.join(p)}`"), ":")[p.index(c)] for p in PAIRS if c in p and set(p) <= set(kinds)]
            halves = [F.when(F.col(f"`{':'.join(p)}`").isNull(), F.col(c)) for p in PAIRS if c in p and set(p) <= set(kinds)] or [F.col(c)]
            out.append(F.coalesce(*whole, *halves).cast(kinds[c]).alias(c))
    return out


def aliases(grouped: DataFrame) -> DataFrame | None:
    """``g`` with all real values of each alias list of its records, sorted; null if ``grouped`` has no such list."""
    have = [c for c in ALIASES if c in grouped.columns]
    if not have:
        return None
    each = F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("vs")) for c in have])
    rows = grouped.select(F.col("item_key").alias("g"), F.explode(each).alias("x")).select("g", "x.f", F.explode("x.vs").alias("v")).filter(real(F.col("v")))
    once = rows.select("g", "f", F.when(F.col("f") == "sha256_aliases", F.lower(F.trim("v"))).otherwise(F.trim("v")).alias("v")).distinct()
    return once.groupBy("g").agg(*[F.sort_array(F.collect_list(F.when(F.col("f") == c, F.col("v")))).alias(c) for c in have])


def repeated(keys: DataFrame) -> DataFrame:
    """``mongo_id`` of the rows of ``keys`` (mongo_id, item_key; one row per item) whose non-blank key others have too."""
    shared = keys.filter(F.trim("item_key") != "").groupBy("item_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return skew_join(keys, shared.select("item_key"), "item_key").select("mongo_id")


def ranked(items: DataFrame, trust: DataFrame, fields: bool = True) -> DataFrame:
    """Items of non-blank ``item_key`` with the four respects, each as a double that is better when larger, and, with
    ``fields``, what they state (``said``) and their alias lists."""
    source = F.lower(F.trim("collection"))
    filled = sum((real(F.col(c)).cast("int") for c in COUNTED), F.lit(0))
    kept = items.filter(F.trim("item_key") != "").withColumn("source", F.coalesce(source, F.lit("")))
    ranks = trust.select(F.lower(F.trim("collection")).alias("source"), "trust_rank").groupBy("source").agg(F.min("trust_rank").alias("trust_rank"))
    joined = kept.join(small(ranks), "source", "left")
    more = ["source", F.struct(*[v.alias(c) for c, v in stated(items).items()]).alias("said"), "updated_at", *[c for c in ALIASES if c in items.columns]] if fields else []
    return joined.select("item_key", "mongo_id", *more, version_number(F.col("fingerprint_version")).alias("r_version"), (-F.coalesce("trust_rank", F.lit(1 << 30))).cast("double").alias("r_trust"), F.coalesce(F.unix_micros("updated_at").cast("double"), F.lit(float("-inf"))).alias("r_recent"), filled.cast("double").alias("r_filled"))


RESPECTS = ("r_version", "r_trust", "r_recent", "r_filled")
ALL = (1 << len(RESPECTS)) - 1


def _step(n: int) -> float:
    """How far round ``n`` (from 0) moves weights towards their new estimate."""
    return 0.5 ** max(0, n - FREE_ROUNDS)


def _weight(agreed: float, claims: float) -> float:
    rate = (agreed + PRIOR_CLAIMS * PRIOR_RATE) / (claims + PRIOR_CLAIMS)
    return max(0.05, math.log(rate / (1.0001 - rate)) + math.log(9))


def elect(sets: dict[int, int]) -> list[float]:
    """The weights of the respects after truth discovery over ``sets``: how many groups have which set of patterns. Bit
    p of a set says that a record of the group has pattern p; bit r of a pattern, that the record is best in respect r.
    A group's winner is the pattern with most weight, of equal ones the larger number."""
    groups, weights = sum(sets.values()), [1.0] * len(RESPECTS)
    value = lambda p: round(sum(w for r, w in enumerate(weights) if p >> r & 1), 9)
    for n in itertools.count():
        agreed = [0] * len(RESPECTS)
        for patterns, count in sets.items():
            best = max((p for p in range(ALL + 1) if patterns >> p & 1), key=lambda p: (value(p), p))
            for r in range(len(RESPECTS)):
                agreed[r] += count * (best >> r & 1)
        new = [w + _step(n) * (_weight(a, groups) - w) for w, a in zip(weights, agreed, strict=True)]
        moved = max(abs(a - b) for a, b in zip(new, weights, strict=True))
        weights = new
        if moved < CLOSE:
            return weights


def contested_groups(records: DataFrame) -> DataFrame:
    """``records`` of groups of two or more with ``won``, their pattern of respects, and ``n_records`` and ``latest`` of
    their group, written out."""
    latest = [F.max("updated_at").alias("latest")] if "updated_at" in records.columns else []
    best = records.groupBy("item_key").agg(F.count(F.lit(1)).alias("n_records"), *[F.max(r).alias(f"best_{r}") for r in RESPECTS], *latest).filter("n_records > 1")
    won = sum((F.when(F.col(r) == F.col(f"best_{r}"), 1 << i).otherwise(0) for i, r in enumerate(RESPECTS)), F.lit(0))
    both = skew_join(records, materialize(best, "best"), "item_key").withColumn("won", won)
    return materialize(both.drop(*RESPECTS, *[f"best_{r}" for r in RESPECTS]), "grouped")


def with_support(grouped: DataFrame) -> DataFrame:
    """``grouped`` with ``record_support``, the weight of the respects that claim each record."""
    sets = grouped.groupBy("item_key").agg(F.bit_or(F.expr("shiftleft(1, won)")).alias("patterns"))
    counted = sets.groupBy("patterns").agg(F.count(F.lit(1)).alias("n")).collect()  # at most one row per set of patterns
    weights = elect({r["patterns"]: r["n"] for r in counted})
    support = sum((F.when(F.col("won").bitwiseAND(F.lit(1 << i)) != 0, w).otherwise(0.0) for i, w in enumerate(weights)), F.lit(0.0))
    return grouped.withColumn("record_support", F.round(support, 9))


def best_records(items: DataFrame, trust: DataFrame) -> DataFrame:
    """``item_key``, ``mongo_id``, ``n_records``, ``respects_won``, ``dominant`` of the elected record of every
    ``item_key`` with two items or more, without looking at what the fields hold; of equal records the smallest id."""
    scored = with_support(contested_groups(ranked(items, trust, fields=False)))
    best = scored.groupBy("item_key").agg(F.min(F.struct((-F.col("record_support")).alias("s"), "mongo_id", "won")).alias("b"), F.count_if(F.col("won") == ALL).alias("n_full"), F.first("n_records").alias("n_records"))
    return best.select("item_key", "b.mongo_id", "n_records", F.bit_count("b.won").alias("respects_won"), ((F.col("b.won") == ALL) & (F.col("n_full") == 1)).alias("dominant"))


def contests(claims: DataFrame) -> DataFrame:
    """What the contested fields of ``claims`` (g, f, v, s, n) say: (c, v, s, n, m), the claims of contest ``c``, which
    occurs ``m`` times. Contests are alike if the same sources claim their first, second ... value equally often; ``v``
    is then the value's place among them. Those of more than ``ALIKE_CLAIMS`` claims keep their values."""
    field = Window.partitionBy("g", "f")
    places = claims.withColumns({"k": F.count(F.lit(1)).over(field), "lo": F.min("v").over(field), "hi": F.max("v").over(field), "place": F.dense_rank().over(field.orderBy("v"))})
    own = F.col("k") > ALIKE_CLAIMS
    said = F.struct(F.when(own, F.col("v")).otherwise(F.lpad(F.col("place").cast("string"), 9, "0")).alias("v"), "s", "n")
    rows = places.filter("lo <> hi").select("g", "f", F.when(own, F.to_json(F.struct("g", "f"))).alias("own"), F.when(own, F.struct("v", "s")).alias("one"), said.alias("said"))
    fields = rows.groupBy("g", "f", "own", "one").agg(F.sort_array(F.collect_list("said")).alias("said"))
    alike = fields.groupBy("own", "said").agg(F.count(F.lit(1)).alias("m"))
    named = alike.select(F.coalesce("own", F.monotonically_increasing_id().cast("string")).alias("c"), "m", "said")  # before the rows are taken apart
    return named.select("c", "m", F.inline("said")).select("c", "v", "s", "n", "m")


def discover(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Truth discovery over ``claims`` (g, f, v, s, n; one row per g, f, v, s): returns (g, f, v, support) of the winning
    values and (s, weight) of the sources. Ties go to the larger value text. The rounds end when no weight moves by
    ``CLOSE``."""
    open_ = materialize(contests(claims), "contested")
    base = claims.groupBy("s").agg(F.sum("n").alias("all_n")).join(open_.groupBy("s").agg(F.sum(F.col("n") * F.col("m")).alias("open_n")), "s", "left")
    base = materialize(base.select("s", "all_n", (F.col("all_n") - F.coalesce("open_n", F.lit(0))).alias("sure_n")), "base")
    few = base.count() <= BROADCAST_ROWS
    rate = lambda agreed: (agreed + PRIOR_CLAIMS * PRIOR_RATE) / (F.col("all_n") + PRIOR_CLAIMS)
    weight = lambda r: F.greatest(F.lit(0.05), F.log(r / (1.0001 - r)) + math.log(9))
    weights = materialize(base.select("s", F.lit(1.0).alias("weight")), "weights")
    for n in itertools.count():
        best = _winners(open_, weights, few, "c")
        agreed = open_.join(best.select("c", "v"), ["c", "v"]).groupBy("s").agg(F.sum(F.col("n") * F.col("m")).alias("won_n"))
        found = weight(rate(F.col("sure_n") + F.coalesce("won_n", F.lit(0))))
        new = base.join(agreed, "s", "left").join(weights.select("s", F.col("weight").alias("old")), "s").select("s", "old", (F.col("old") + _step(n) * (found - F.col("old"))).alias("weight"))
        new = materialize(new, "weights")
        moved = new.agg(F.max(F.abs(F.col("weight") - F.col("old")))).head()[0]
        discard(weights)
        weights = new
        if moved is None or moved < CLOSE:
            discard(open_)
            discard(base)
            return _winners(claims, weights, few, "g", "f"), weights.select("s", "weight")


def _winners(claims: DataFrame, weights: DataFrame, few: bool, *by: str) -> DataFrame:
    votes = claims.join(F.broadcast(weights) if few else weights, "s").groupBy(*by, "v").agg(F.sum(F.col("n") * F.col("weight")).alias("support"))
    return votes.groupBy(*by).agg(F.max_by("v", F.struct(F.round("support", 9), "v")).alias("v"), F.max("support").alias("support"))


def representatives(items: DataFrame, trust: DataFrame) -> DataFrame:
    """One row per ``item_key`` with two items or more: ``mongo_id`` of the base record, ``n_records``, ``respects_won``,
    ``dominant``, all fields of ``items`` that are voted on, the united alias lists, ``updated_at`` and ``support``.
    ``fingerprint_version``, ``collection`` and ``updated_at`` are the base record's own where it has them, else the
    voted ones and the group's latest time.

    Blank or null keys form no group. A missing version is below every number, a null ``updated_at`` older than any,
    an unknown collection trusted least. Of records with equal support the base is the one most of whose values won,
    and last the smallest ``mongo_id``. Extra columns are ignored; ``items`` must have one row per ``mongo_id``."""
    grouped = contested_groups(ranked(items, trust))
    said = list(stated(items))
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(f"said.`{c}`").alias("v")) for c in said]))
    claims = grouped.select(F.col("item_key").alias("g"), F.col("source").alias("s"), fields.alias("x")).select("g", "s", "x.f", "x.v").filter("v is not null")
    claims = materialize(claims.groupBy("g", "f", "v", "s").agg(F.count(F.lit(1)).alias("n")), "claims")
    winners, _ = discover(claims)
    own = [c for c in ("fingerprint_version", "collection") if c in said]
    built = materialize(winners.groupBy("g").agg(*[F.max(F.when(F.col("f") == c, F.col("v"))).alias(c) for c in said], F.round(F.sum("support"), 6).alias("support")), "built")
    scored = with_support(grouped).withColumnRenamed("item_key", "g").select("g", "mongo_id", "said", "updated_at", "latest", "won", "record_support", "n_records")
    top = scored.groupBy("g").agg(F.max("record_support").alias("top"), F.count_if(F.col("won") == ALL).alias("n_full"))
    tied = skew_join(scored, top, "g").filter("record_support = top")
    values = built.select("g", F.struct(*[F.col(f"`{c}`") for c in said]).alias("voted"))
    agree = sum((F.coalesce(F.col(f"said.`{c}`") == F.col(f"voted.`{c}`"), F.lit(False)).cast("int") for c in said), F.lit(0))
    kept = F.struct((-agree).alias("a"), "mongo_id", *[F.col(f"said.{c}").alias(f"own_{c}") for c in own], F.coalesce("updated_at", "latest").alias("updated_at"), "won", "n_full", "n_records")
    base = skew_join(tied, values, "g", "left").groupBy("g").agg(F.min(kept).alias("kept")).select("g", "kept.*")
    whole = base.join(built, "g", "left").withColumns({c: F.coalesce(f"own_{c}", c) for c in own})
    lists = aliases(grouped)
    lists = grouped.select(F.col("item_key").alias("g")).limit(0) if lists is None else lists
    united = [F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in lists.columns if c != "g"]
    dominant = ((F.col("won") == ALL) & (F.col("n_full") == 1)).alias("dominant")
    return whole.join(lists, "g", "left").select(F.col("g").alias("item_key"), "mongo_id", "n_records", F.bit_count("won").alias("respects_won"), dominant, *read_back(items), *united, "updated_at", "support")
