import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftmatch.llm.packing import first_fit_decreasing, pack, token_sizes


def first_fit(sizes, capacity):
    free, out = [], []
    for s in sizes:
        i = next((k for k, f in enumerate(free) if f >= s), len(free))
        if i == len(free):
            free.append(capacity)
        free[i] -= s
        out.append(i)
    return out


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=60))))
def test_tournament_is_first_fit(case):
    capacity, sizes = case
    sizes = sorted(sizes, reverse=True)
    assert first_fit_decreasing(np.array(sizes, np.int64), capacity).tolist() == first_fit(sizes, capacity)


@pytest.mark.parametrize("group", [1, 50, 10_000])
def test_every_token_once_and_no_overflow(spark, group):
    rng = np.random.default_rng(5)
    sizes = [(i, int(n)) for i, n in enumerate(rng.integers(0, 260, 500))] + [(900, 5000), (901, 100), (902, None), (903, 0)]
    specs = spark.createDataFrame([("s", 100), ("m", 256), ("s", 120), ("bad", 0), (None, 5)], "container_kind string, capacity_tokens int")
    df = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint").withColumn("bin", F.lit(1))
    out = pack(df, specs, group).toPandas()
    assert set(out.container_kind) == {"s", "m"}
    for kind, cap in (("s", 100), ("m", 256)):
        part = out[out.container_kind == kind]
        assert part.groupby("container_id").n_tokens.sum().max() <= cap
        want = {i: n for i, n in sizes if n}
        assert part.groupby("doc_id").n_tokens.sum().to_dict() == want
        for doc, rows in part.sort_values("first_token").groupby("doc_id"):
            assert rows.first_token.tolist() == [0, *rows.n_tokens.cumsum().tolist()[:-1]]
            assert len(rows) == 1 or want[doc] > cap
            assert sorted(rows.piece) == list(range(len(rows)))
    if group == 10_000:
        part = out[out.container_kind == "m"]
        total = part.n_tokens.sum()
        assert part.container_id.nunique() <= 1.1 * -(-total // 256) + 1


def test_sizes_are_those_of_whole_texts(spark, rows):
    from weftmatch.llm.packing import TOKENIZER, encoding

    texts = ["", None, "hello world", "<|endoftext|> é 🎴", "word " * 30000]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens int")
    with open(TOKENIZER, "rb") as f:
        enc = encoding(f.read())
    assert rows(token_sizes(df)) == [(i, len(enc.encode_ordinary(t or ""))) for i, t in enumerate(texts)]
    assert enc.decode(enc.encode_ordinary(texts[3])) == texts[3]


def test_nothing_to_pack(spark):
    specs = spark.createDataFrame([("s", 100)], "container_kind string, capacity_tokens int")
    none = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert pack(none, specs).count() == 0
    assert pack(spark.createDataFrame([(1, 5)], none.schema), specs.limit(0)).count() == 0


def test_one_document_id_on_most_rows(spark):
    df = spark.range(3000).selectExpr("if(id < 2000, 1, id) as doc_id", "10L + id % 7 as n_tokens")
    specs = spark.createDataFrame([("s", 64)], "container_kind string, capacity_tokens int")
    out = pack(df, specs, 100).toPandas()
    assert len(out) == 3000 and out.groupby("container_id").n_tokens.sum().max() <= 64
    assert out.container_id.str.split("-").str[1].value_counts().max() < 200


def test_many_kinds_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr("weftmatch.llm.packing.KINDS_AT_ONCE", 2)
    specs = spark.createDataFrame([(f"k{i}", 10 + i) for i in range(5)], "container_kind string, capacity_tokens int")
    out = pack(spark.createDataFrame([(1, 5), (2, 25)], "doc_id bigint, n_tokens bigint"), specs).toPandas()
    assert out.groupby("container_kind").n_tokens.sum().to_dict() == {f"k{i}": 30 for i in range(5)}
