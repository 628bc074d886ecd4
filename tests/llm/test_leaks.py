import random
import re
import time

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from weftmatch.llm import leaks as module
from weftmatch.llm.leaks import RUN, ItemIndex, _leaks, _tile, leaks, tile_repetitive
from weftmatch.llm.plaintext import plain_array
from weftmatch.llm.words import slices, windows, word_text, words_of


def plain_words(text):
    return re.findall(r"[^\W_]+", plain_array(pa.array([text or ""])).to_pylist()[0].lower())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB é1-_\nо.", max_size=20)), max_size=6))
def test_words_are_runs_of_letters_and_digits(texts):
    w = words_of(pa.array(texts, pa.string()))
    got = [[word_text(w, k) for k in range(a, b)] for a, b in zip(w.offsets[:-1], w.offsets[1:], strict=True)]
    assert got == [plain_words(t) for t in texts]
    flat = [x for g in got for x in g]
    assert len(set(flat)) == len(set(w.hashes.tolist()))
    h = windows(w.hashes, 2)
    assert {(a, b): 0 for a, b in zip(flat, flat[1:], strict=False)}.keys().__len__() == len(set(h.tolist()))


def test_slices_cut_between_rows_only():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(["a" * 30, None, "b" * 90, "c"])], ["i", "t"])
    parts = list(slices(batch, 1, 40))
    assert [r for p in parts for r in p.column(0).to_pylist()] == [1, 2, 3, 4] and len(parts) > 1


def test_tiling_takes_the_longest_and_keeps_the_rest():
    assert sorted(_tile([(0, 0, 10), (5, 20, 12)], 5)) == [(0, 0, 5), (5, 20, 12)]
    assert _tile([(0, 0, 6), (10, 0, 6)], 5) == [(0, 0, 6)]
    assert _tile([(0, 0, 6), (2, 10, 8)], 5) == [(2, 10, 8)]


DOC, ITEM = "doc_id bigint, text string, item_id int", "item_id bigint, text string, doc_id int"


def test_found_equals_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [say(r.choice([3, 5, 9, 12, 13, 14, 30])) for _ in range(25)]
    items[1] = items[0]
    docs = []
    for i in range(150):
        t = r.choice(items)
        a = r.randrange(0, max(1, len(t) - 12))
        cut = t[a : a + r.choice([6, 12, 13, 13, 30])]
        docs.append(say(r.randrange(0, 40)) + cut + say(r.randrange(0, 40)))
    show = lambda ws: "".join(w.upper() + r.choice([" ", ", ", "\n* ", " **", "​ "]) for w in ws)
    d = spark.createDataFrame([(i, show(x), 1) for i, x in enumerate(docs)] + [(900, None, 1), (901, "", 1)], DOC)
    e = spark.createDataFrame([(i, " ".join(x), 1) for i, x in enumerate(items)] + [(900, None, 1), (901, " ?! ", 1)], ITEM)
    got = {(x["doc_id"], x["item_id"]) for x in leaks(d, e).collect() if x["longest_run"] >= min(RUN, x["item_words"])}
    has = lambda big, small: any(big[k : k + len(small)] == small for k in range(len(big) - len(small) + 1))
    want = {(i, j) for i, x in enumerate(docs) for j, t in enumerate(items) if any(has(x, t[k : k + RUN]) for k in range(max(1, len(t) - RUN + 1)))}
    assert got == want and len(want) > 60
    assert leaks(d, e.limit(0)).count() == 0 and leaks(d.limit(0), e).count() == 0


def test_reordered_passages_are_caught(spark):
    words = [f"w{i}" for i in range(30)]
    text = " ".join(words[20:30] + ["x"] + words[10:20] + ["y"] + words[0:10])
    row = leaks(spark.createDataFrame([(1, text, 0)], DOC), spark.createDataFrame([(2, " ".join(words), 0)], ITEM)).head()
    assert (row["longest_run"], row["n_tiles"], row["covered_words"], row["coverage"]) == (10, 3, 30, 1.0)


def test_a_very_long_text(spark):
    passage = " ".join(f"k{i}" for i in range(20))
    long = "filler words go on " * 60000 + passage + " and on" * 60000
    out = leaks(spark.createDataFrame([(1, long, 0)], DOC), spark.createDataFrame([(5, passage, 0)], ITEM)).collect()
    assert [(r["doc_id"], r["item_id"], r["longest_run"]) for r in out] == [(1, 5, 20)]


def found(docs, items):
    return sorted(_leaks(words_of(pa.array(docs)), ItemIndex(list(range(len(items))), items)))


def test_repetitive_texts_take_no_pairs_of_places():
    began = time.perf_counter()
    assert found(["again " * 16000], ["again " * 16000]) == [(0, 0, 16000, 1, 16000, 16000)]
    assert found(["left right " * 8000 + "end"], ["right left " * 5000]) == [(0, 0, 10000, 1, 10000, 10000)]
    assert time.perf_counter() - began < 3
    assert found(["a b " * 40 + "x y z u v " * 40], ["x y z u v " * 3 + "a b " * 6]) == [(0, 0, 15, 2, 27, 27)]


def test_both_ways_of_tiling_report_the_same(monkeypatch):
    r = random.Random(8)
    items = [" ".join(r.choice("abcdefgh") for _ in range(r.choice([7, 13, 20, 40]))) for _ in range(30)]
    docs = [" ".join(r.choice("abcdefgh") for _ in range(60)) + " " + r.choice(items) for _ in range(60)]
    usual = found(docs, items)
    monkeypatch.setattr(module, "REPETITIVE", 0)
    other = found(docs, items)
    assert {(x[:3], x[5]) for x in usual if x[2] >= min(RUN, x[5])} == {(x[:3], x[5]) for x in other if x[2] >= min(RUN, x[5])} and len(usual) >= 60


def test_tiles_are_common_and_do_not_overlap():
    r = random.Random(9)
    for _ in range(30):
        a, b = (np.array([r.randrange(3) for _ in range(80)], np.uint64) for _ in range(2))
        tiles = tile_repetitive(a, b, lambda *_: True)
        for side, k in ((a, 0), (b, 1)):
            used = [x for t in tiles for x in range(t[k], t[k] + t[2])]
            assert len(used) == len(set(used)) and all(x < len(side) for x in used)
        assert all((a[i : i + n] == b[j : j + n]).all() and n >= 5 for i, j, n in tiles)
        assert [t[2] for t in tiles] == sorted((t[2] for t in tiles), reverse=True)


def test_blocks_make_no_difference(spark, monkeypatch, rows):
    items = [(i, " ".join(f"w{i}x{k}" for k in range(20)), 0) for i in range(6)]
    docs = [(i, f"start {items[i % 6][1]} end", 0) for i in range(12)]
    d, e = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    one = rows(leaks(d, e))
    monkeypatch.setattr(module, "BLOCK_WORDS", 30)
    assert rows(leaks(d, e)) == one and len(one) == 12
