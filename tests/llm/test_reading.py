import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from weftmatch.llm import reading
from weftmatch.llm.reading import fit, isotonic, rated_sample, reading_levels

EASY, HARD = [f"cat{i}" for i in range(30)], [f"consolidation{i}" for i in range(30)]


def text(r, level):
    out = []
    for _ in range(12):
        pool = EASY if level in (1, 2) else HARD
        body = lambda: " ".join(r.choice(pool) for _ in range(4))
        out.append(f"although the {body()}, the {body()}, which {body()}." if level in (2, 4) else f"the {body()}.")
    return " ".join(out)


@given(st.lists(st.tuples(st.integers(0, 8), st.integers(1, 4)), min_size=1, max_size=40))
def test_isotonic_is_the_best_monotone_fit(points):
    x, y = np.array([p[0] for p in points], float), np.array([p[1] for p in points], float)
    ends, values = isotonic(x, y)
    assert (np.diff(values) >= -1e-9).all() and (np.diff(ends) > 0).all()
    fitted = np.interp(x, ends, values)
    assert abs(fitted.sum() - y.sum()) < 1e-6
    xs = np.unique(x)
    means, counts = np.array([y[x == a].mean() for a in xs]), np.array([(x == a).sum() for a in xs])
    best = np.array([max(min(np.average(means[i : j + 1], weights=counts[i : j + 1]) for j in range(k, len(xs))) for i in range(k + 1)) for k in range(len(xs))])
    assert np.allclose(fitted, best[np.searchsorted(xs, x)])


def test_words_and_build_both_count():
    r = random.Random(1)
    data = [(text(r, lv), lv) for lv in (1, 2, 3, 4) for _ in range(60)]
    r.shuffle(data)
    grader = fit([t for t, _ in data[:160]], np.array([lv for _, lv in data[:160]], float))
    got = grader.level(grader.score(grader.features(pa.array([t for t, _ in data[160:]]))))
    assert np.mean(got == np.array([lv for _, lv in data[160:]])) > 0.9


DOC, RATING = "doc_id bigint, text string, reading_level int", "doc_id bigint, rater string, reading_level int, text string"


def test_odd_rows(spark):
    r = random.Random(2)
    rows = [(i, text(r, 1 + i % 4), 9) for i in range(200)]
    docs = spark.createDataFrame(rows + [(290, None, 9), (291, "", 9), (292, " ?! ", 9), (293, "cat1 " * 100000, 9), (None, "x", 9)], DOC)
    ratings = spark.createDataFrame([(i, "a", 1 + i % 4, "t") for i in range(160)] * 2 + [(161, "a", None, "t"), (162, "a", 9, "t"), (999, "a", 1, "t")], RATING)
    texts, mean = rated_sample(docs, ratings)
    assert len(texts) == 160 and set(mean) == {1, 2, 3, 4}
    out = {x["doc_id"]: x["reading_level"] for x in reading_levels(docs, ratings).collect()}
    assert len(out) == 204 and set(out.values()) <= {1, 2, 3, 4}
    assert np.mean([out[i] == 1 + i % 4 for i in range(200)]) > 0.9
    assert reading_levels(docs, ratings.limit(0)).count() == 0 and reading_levels(docs.limit(0), ratings).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables here")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "reading_labels"))
    texts, mean = rated_sample(docs, labels)
    held = np.arange(len(texts)) % 4 == 0
    grader = fit([t for t, h in zip(texts, held, strict=True) if not h], mean[~held])
    got = grader.level(grader.score(grader.features(pa.array([t for t, h in zip(texts, held, strict=True) if h]))))
    want = mean[held]
    whole = want == np.round(want)
    assert np.mean(got[whole] == want[whole]) > 0.8 and np.mean(np.abs(got - want) <= 1) > 0.97


def test_a_long_text_does_not_end_the_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "simple words here. " * (400 if i % 3 == 0 else 5)) for i in range(60)] + [(99, None)], "doc_id bigint, text string")
    votes = spark.createDataFrame([(i, "r", 1 + i % 4) for i in range(60)] + [(99, "r", 1), (1000, "r", 2)], "doc_id bigint, rater string, reading_level int")
    monkeypatch.setattr(reading, "SAMPLE_CHARS", 2000)
    texts, means = reading.rated_sample(docs, votes)
    assert 10 < len(texts) == len(means) and sum(map(len, texts)) <= 2000
    monkeypatch.setattr(reading, "SAMPLE_CHARS", 10)
    assert len(reading.rated_sample(docs, votes)[0]) == 1
    assert reading.reading_levels(docs, votes).count() == 61


def test_a_level_rests_on_its_own_models(spark):
    """The score is a map of surprisals: each level's odds fall with the surprisal under its own models."""
    easy, hard = "the cat sat. it ran. ", "notwithstanding the aforementioned considerations, the committee deliberated. "
    texts, y = [easy * (3 + i % 5) if i % 2 else hard * (3 + i % 5) for i in range(80)], np.array([1.0 if i % 2 else 4.0 for i in range(80)])
    grader = fit(texts, y)
    assert grader.rates.shape == (4, 1 + 2 * reading.FIGURES)
    score = grader.score(grader.features(pa.array([easy * 4, hard * 4])))
    assert score[0] < score[1] and grader.level(score).tolist() == [1, 4]


def test_all_rated_documents_count(spark, monkeypatch):
    """Models come from every rated document, whatever a sample in memory may hold."""
    r = random.Random(4)
    docs = spark.createDataFrame([(i, text(r, 1 + i % 4)) for i in range(120)], "doc_id bigint, text string")
    votes = spark.createDataFrame([(i, "r", 1 + i % 4) for i in range(100)], "doc_id bigint, rater string, reading_level int")
    monkeypatch.setattr(reading, "SAMPLE", 3)
    monkeypatch.setattr(reading, "SAMPLE_CHARS", 3000)
    out = {x["doc_id"]: x["reading_level"] for x in reading_levels(docs, votes).collect()}
    assert len(out) == 120 and np.mean([out[i] == 1 + i % 4 for i in range(120)]) > 0.9


def test_counted_by_spark_as_in_memory(spark):
    r = random.Random(6)
    rows = [(text(r, 1 + i % 4), r.choice([1.0 + i % 4, 2.5]), i % 5) for i in range(90)] + [("", 1.0, 2)]
    ours = reading.fit_all(spark.createDataFrame(rows, "text string, rating double, fold int").repartition(3))
    one = fit([t for t, _, _ in rows], np.array([y for _, y, _ in rows]), np.array([f for _, _, f in rows]))
    assert (ours.vocabulary == one.vocabulary).all() and (ours.common == one.common).all()
    for a, b in ((ours.words, one.words), (ours.build, one.build)):
        assert np.array_equal(a.base, b.base)
        assert all(np.array_equal(x, y) for n in b.tables for x, y in zip(a.tables[n], b.tables[n], strict=True))
    assert np.allclose(ours.scale, one.scale) and np.allclose(ours.rates, one.rates, atol=1e-5)
    assert np.allclose(np.interp(np.arange(1, 4, 0.1), *ours.steps), np.interp(np.arange(1, 4, 0.1), *one.steps), atol=1e-3)
