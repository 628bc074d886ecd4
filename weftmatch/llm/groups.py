"""Problem 6: pairwise matches to groups.

Items and the keys they share are the vertices of a two-sided graph, so a key of a million items costs a million edges
and not their pairs. The graph is reduced before it is solved: vertices of degree one are stripped again and again, and
chains of degree-two vertices are replaced by one edge after list ranking (pointer doubling along both directions). The
small core that remains is solved by alternating star contraction. Then the removed vertices take their labels back, in
reverse order. Every round is written to the shared folder; joins on vertices that may be hubs go through ``skew_join``,
whatever the size of the graph, with the hubs taken from the degrees that the round needs anyway.
"""

from __future__ import annotations

from functools import reduce as reduce_frames

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hexbits import EMPTY_SHA256
from ..operators.skew import skew_join
from ..session import discard, materialize

#: Rounds of stripping or compressing stop when a round removes less than this share of the edges; the core solver
#: takes whatever is left, so the number only moves work.
LEAST_GAIN = 0.05
#: A vertex with so large a share of all edge ends is a hub; there are at most 1 / HUB_SHARE of them.
HUB_SHARE = 0.002


def item_keys(items: DataFrame) -> DataFrame:
    """Distinct ``mongo_id``, ``k``: the file ids (trimmed, case kept) and digests (trimmed, lower case) of each item.
    Blanks, nulls and the SHA-256 of zero bytes are no keys; empty or null arrays have none."""
    uids = F.transform(F.concat(F.array("file_unique_id"), F.coalesce("file_unique_ids", F.array().cast("array<string>"))), lambda x: F.concat(F.lit("u"), F.trim(x)))
    shas = F.transform(F.concat(F.array("sha256"), F.coalesce("sha256_aliases", F.array().cast("array<string>"))), lambda x: F.concat(F.lit("s"), F.lower(F.trim(x))))
    long = items.filter("mongo_id is not null").select("mongo_id", F.explode(F.concat(uids, shas)).alias("k"))
    return long.filter(F.col("k").isNotNull() & ~F.col("k").isin("u", "s", "s" + EMPTY_SHA256)).distinct()


def _degrees(edges: DataFrame, n: int) -> tuple[DataFrame, list]:
    """(v, deg) of every vertex of ``n`` edges, written out, and the hubs."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("v"))
    deg = materialize(_rows_of(ends, "v"), "degrees")
    return deg, _hubs(deg, 2 * n)


def _rows_of(rows: DataFrame, vertex: str) -> DataFrame:
    return rows.groupBy(F.col(vertex).alias("v")).agg(F.count(F.lit(1)).alias("deg"))


def _hubs(deg: DataFrame, total: int) -> list:
    """Vertices whose ``deg`` is at least ``HUB_SHARE`` of ``total``, which all of them together don't exceed: so many at
    most that the driver may know them."""
    return [r["v"] for r in deg.filter(F.col("deg") >= max(2.0, HUB_SHARE * total)).select("v").collect()]


def _strip(edges: DataFrame, deg: DataFrame, hubs: list) -> tuple[DataFrame, DataFrame]:
    """Edges without those at a degree-one vertex, and (v, parent) of the vertices removed. Of an edge between two
    such vertices the larger goes."""
    leaves = deg.filter("deg = 1").select("v")
    # Only leaves are looked up, so that a vertex of any degree is known by its absence.
    one = skew_join(edges, leaves.select(F.col("v").alias("a"), F.lit(True).alias("la")), "a", "left", keys=hubs)
    known = materialize(skew_join(one, leaves.select(F.col("v").alias("b"), F.lit(True).alias("lb")), "b", "left", keys=hubs), "leaves")
    la, lb = F.coalesce("la", F.lit(False)), F.coalesce("lb", F.lit(False))
    leaf = F.when(la & (~lb | (F.col("a") > F.col("b"))), F.col("a")).when(lb, F.col("b"))
    gone = known.withColumn("v", leaf).filter("v is not null")
    removed = gone.select("v", F.when(F.col("v") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("parent"))
    return known.filter(~la & ~lb).select("a", "b"), removed


def _compress(edges: DataFrame, deg: DataFrame, hubs: list) -> tuple[DataFrame, DataFrame]:
    """Edges with every chain of degree-two vertices replaced by one edge between its ends, and (v, parent) of the
    vertices removed, the parent being the chain's end. Closed rings have no end and stay for the core solver."""
    arcs = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y")))
    inner = deg.filter("deg = 2").select(F.col("v"))
    # The two neighbours of each inner vertex: walking x -> v goes on to the other one.
    sides = skew_join(arcs.withColumnRenamed("x", "v"), inner, "v", keys=hubs).groupBy("v").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    step = sides.select(F.col("lo").alias("x"), "v", F.col("hi").alias("nxt")).unionByName(sides.select(F.col("hi").alias("x"), "v", F.col("lo").alias("nxt")))
    # A walker (x, v) stands on inner v having come from x; (px, pv) is the walker it has reached.
    walk = materialize(step.select("x", "v", F.col("v").alias("px"), F.col("nxt").alias("pv"), F.lit(False).alias("done")), "walk")
    last = -1
    while True:
        nxt = walk.select(F.col("x").alias("px"), F.col("v").alias("pv"), F.col("px").alias("qx"), F.col("pv").alias("qv"))
        moved = walk.join(nxt, ["px", "pv"], "left").select("x", "v", F.coalesce("qx", "px").alias("px"), F.coalesce("qv", "pv").alias("pv"), F.col("qx").isNull().alias("done"))
        moved = materialize(moved, "walk")
        discard(walk)
        walk = moved
        open_ = walk.filter("not done").count()
        if open_ == 0 or open_ == last:  # what no longer gets shorter is rings
            break
        last = open_
    reached = walk.filter("done").select("x", "v", F.col("pv").alias("end"))
    ends = reached.groupBy("v").agg(F.min("end").alias("e1"), F.max("end").alias("e2"), F.min("x").alias("x1"), F.max("x").alias("x2"))
    ends = materialize(ends.filter("e1 is not null"), "ends")
    # An edge goes if either end was compressed; hubs never are.
    gone = ends.select("v")
    kept = skew_join(edges, gone.select(F.col("v").alias("a"), F.lit(True).alias("ga")), "a", "left", keys=hubs)
    kept = skew_join(kept, gone.select(F.col("v").alias("b"), F.lit(True).alias("gb")), "b", "left", keys=hubs).filter("ga is null and gb is null").select("a", "b")
    short = ends.filter("e1 <> e2").select(F.col("e1").alias("a"), F.col("e2").alias("b"))
    return kept.unionByName(short).distinct(), ends.select("v", F.col("e1").alias("parent"))


def _solve(edges: DataFrame, n: int) -> DataFrame:
    """(v, label) of every vertex of ``edges``: the smallest vertex of its component, by alternating large and small
    stars. Each round's edges are written out; the number of rounds grows with the logarithm of the core."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w")).filter("u <> w").distinct(), "core")
    previous = None
    while True:
        # Large star: every larger neighbour of u is linked to the least of u and its neighbours.
        low = edges.groupBy("u").agg(F.min("w").alias("m"))
        both = edges.select("u", "w").unionByName(edges.select(F.col("w").alias("u"), F.col("u").alias("w")))
        least = low.join(edges.select(F.col("w").alias("u")).distinct(), "u", "full").select("u", F.coalesce("m", "u").alias("m"))
        hubs = _hubs(_rows_of(edges, "w"), n)
        large = skew_join(both.filter("w > u"), least, "u", keys=hubs).select(F.col("w").alias("u"), F.col("m").alias("w")).filter("u <> w").distinct()
        large = materialize(large, "large")
        # Small star: u and its smaller neighbours are linked to the least of them.
        low = materialize(large.groupBy("u").agg(F.min("w").alias("m"), F.count(F.lit(1)).alias("deg")), "low")
        joined = skew_join(large, low.drop("deg"), "u", keys=_hubs(low.withColumnRenamed("u", "v"), n))
        small = joined.select(F.col("w").alias("u"), F.col("m").alias("w")).unionByName(low.select("u", F.col("m").alias("w"))).filter("u <> w").distinct()
        small = materialize(small, "small")
        for done in (large, low, edges):
            discard(done)
        edges = small
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "w").cast("decimal(38,0)"))).head()
        if state == previous:
            break
        previous, n = state, state[0]
    return edges.select(F.col("u").alias("v"), F.col("w").alias("label"))


def components(edges: DataFrame, reduce: bool = True) -> DataFrame:
    """``v``, ``root`` for every vertex of the undirected graph ``edges`` (columns ``a``, ``b``, any one type that
    orders). Loops and repeated edges are allowed; null ends are ignored. An empty graph gives no rows. Without ``reduce``
    the whole graph is the core, which suits graphs of many small dense components."""
    now = edges.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now = materialize(now, "edges")
    n = now.count()
    vertices = now
    undo: list[tuple[DataFrame, int]] = []
    stripping = True
    while n and reduce:
        deg, hubs = _degrees(now, n)
        part, removed = _strip(now, deg, hubs) if stripping else _compress(now, deg, hubs)
        part = materialize(part, "edges")
        undo.append((materialize(removed, "removed"), n))
        discard(deg)
        left = part.count()
        gain, now, n = (n - left) / n, part, left
        if gain < LEAST_GAIN:
            if not stripping:
                break
            stripping = False
        elif not stripping:
            stripping = True
    # Labels are kept as one table per round, each written once, and united at the end.
    parts = [_solve(now, n).select("v", F.col("label").alias("root"))] if n else []
    for removed, total in reversed(undo):
        parents = removed.withColumnRenamed("parent", "p")
        if not parts:
            parts.append(removed.select("v", F.col("parent").alias("root")))
            continue
        labels = reduce_frames(DataFrame.unionByName, parts)
        hubs = _hubs(_rows_of(parents, "p"), total)
        found = skew_join(parents, labels.select(F.col("v").alias("p"), "root"), "p", "left", keys=hubs)
        parts.append(materialize(found.select("v", F.coalesce("root", "p").alias("root")), "labels"))
    if not parts:
        return vertices.select(F.col("a").alias("v"), F.col("a").alias("root")).limit(0)
    labels = reduce_frames(DataFrame.unionByName, parts)
    tops = labels.select("root").distinct().join(labels.select(F.col("v").alias("root")), "root", "left_anti").select(F.col("root").alias("v"), "root")
    return labels.unionByName(tops)


def shared_key_groups(pairs: DataFrame, item: str, key: str) -> DataFrame:
    """``item``, ``group_<item>``: every item of a group of two or more, with the group's smallest item. Two items are
    linked if they have a value of ``key`` in common, directly or over other items. Nulls link nothing."""
    clean = pairs.filter(F.col(item).isNotNull() & F.col(key).isNotNull()).select(F.col(item).alias("i"), F.col(key).alias("k")).distinct()
    shared = clean.groupBy("k").agg(F.min("i").alias("lo"), F.max("i").alias("hi")).filter("lo <> hi").select("k")
    # Vertices are 128-bit digests with the side in front; items keep their own text for the final label.
    edges = skew_join(clean, shared, "k").select(F.concat(F.lit("i"), "i").alias("a"), F.concat(F.lit("k"), F.md5("k")).alias("b"))
    found = materialize(components(edges).filter(F.col("v").startswith("i")), "found")
    least = found.groupBy("root").agg(F.min("v").alias("least"))
    named = skew_join(found, least, "root")
    return named.select(F.substring("v", 2, 1 << 20).alias(item), F.substring("least", 2, 1 << 20).alias(f"group_{item}"))
