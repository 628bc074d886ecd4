import random

import pytest

from weftmatch.functions.hexbits import EMPTY_SHA256
from weftmatch.llm.groups import components, item_keys, shared_key_groups


def roots(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        up[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in up}


def same_partition(got, want):
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    return groups(got) == groups(want)


def shapes():
    r = random.Random(4)
    path = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)]
    ring = [(f"r{i:02d}", f"r{(i + 1) % 17:02d}") for i in range(17)]
    star = [("hub", f"s{i:03d}") for i in range(150)]
    loop = [("h1", "l1"), ("l1", "l2"), ("l2", "h1"), ("h1", "x1"), ("h1", "x2")]
    theta = [("t0", "u1"), ("u1", "t9"), ("t0", "u2"), ("u2", "t9"), ("t0", "t9")]
    mesh = [(f"n{r.randrange(120):03d}", f"n{r.randrange(120):03d}") for _ in range(110)]
    return {"path": path, "ring": ring, "star": star, "loop": loop, "theta": theta, "mesh": mesh, "all": path + ring + star + loop + theta + mesh}


@pytest.mark.parametrize("shape", list(shapes()))
@pytest.mark.parametrize("reduce", [True, False])
def test_components(spark, shape, reduce):
    edges = shapes()[shape]
    noisy = edges + [(b, a) for a, b in edges[:5]] + [("q", "q"), (None, "q"), ("q", None)]
    got = {r["v"]: r["root"] for r in components(spark.createDataFrame(noisy, "a string, b string"), reduce).collect()}
    assert same_partition(got, {k: v for k, v in roots(e for e in edges if e[0] != e[1]).items()})


@pytest.mark.parametrize("share", [0.0, 1.0])
def test_hubs_make_no_difference(spark, monkeypatch, share):
    monkeypatch.setattr("weftmatch.llm.groups.HUB_SHARE", share)
    edges = shapes()["all"]
    got = {r["v"]: r["root"] for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert same_partition(got, {k: v for k, v in roots(e for e in edges if e[0] != e[1]).items()})


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0
    assert components(spark.createDataFrame([("x", "x")], "a string, b string")).count() == 0


def test_keys_and_groups(spark, rows):
    schema = "mongo_id string, file_unique_id string, file_unique_ids array<string>, sha256 string, sha256_aliases array<string>, k string"
    data = [
        ("3", " U ", None, None, None, "z"), ("2", None, ["U", None, " "], "AB", [], "z"), ("5", None, None, None, [" ab"], "z"), ("5", None, None, None, [" ab"], "z"),
        ("6", "u", None, EMPTY_SHA256, None, "z"), ("7", "", None, EMPTY_SHA256.upper(), None, "z"), ("8", None, None, None, None, "z"), (None, "U", None, None, None, "z"),
    ]
    keys = item_keys(spark.createDataFrame(data, schema))
    assert rows(shared_key_groups(keys, "mongo_id", "k")) == [("2", "2"), ("3", "2"), ("5", "2")]
    assert rows(shared_key_groups(keys.limit(0), "mongo_id", "k")) == []


def test_a_key_of_many_items(spark, rows):
    pairs = [(f"i{i:04d}", "hot") for i in range(800)] + [(f"i{i:04d}", f"k{i // 2}") for i in range(800, 900)]
    got = dict(rows(shared_key_groups(spark.createDataFrame(pairs, "i string, k string"), "i", "k")))
    assert set(got.values()) == {"i0000"} | {f"i{i:04d}" for i in range(800, 900, 2)} and len(got) == 900
