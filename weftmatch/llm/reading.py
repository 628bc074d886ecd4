"""Problem 9: the reading level of each document.

Interpolated n-gram models are trained for every rated level, over two streams of the same text: its words, and the
build of its sentences, in which words other than the most common ones are all one symbol while commas and sentence
ends, marked with the sentence's length, stay. Every document's surprisal under each model is taken over its whole text,
on average and as quartiles over its sentences. The surprisal score of a document is the level to be expected from how
well each level's models foresee it: a level's odds fall with the surprisal under its own models, at a rate calibrated for
each of them on texts that the models have not seen. Isotonic regression maps the score to the rated scale.

Models are fitted on all rated documents: words and n-grams are counted by Spark, each fold's texts are judged where they
lie, Newton's steps towards the rates are sums over all of them, and adjacent violators are pooled in sorted pieces first.
The driver holds the counts of different n-grams, never texts.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize, small
from .words import slices, words_of

LEVELS = (1, 2, 3, 4)
#: Most documents of ``rated_sample``, which ``reading_levels`` does not use, and most characters of them in all.
SAMPLE, SAMPLE_CHARS = 9_000, 40_000_000
#: A word is in the vocabulary if so many rated documents have it; a word in this share of them shows sentence build.
LEAST_DOCS, COMMON = 3, 0.12
#: Weights of bigram, unigram and uniform estimates (words), and of trigram, bigram, unigram (build).
MIX_WORDS, MIX_BUILD = (0.35, 0.60, 0.05), (0.45, 0.35, 0.20)
#: Sentence lengths at which the end symbol changes.
LENGTHS = (4, 7, 10, 14, 19, 26, 36)
#: Texts that are taken apart at once when models are fitted, which bounds the driver's memory.
AT_ONCE = 256
#: Parts of the rated texts, each judged by models of the other parts.
FOLDS = 5
#: Penalty on the rates of the score (in documents), and the step at which they are found.
PENALTY, STEP = 1.0, 1e-6

ENDS, COMMAS = np.array([ord(c) for c in ".!?\n"]), np.array([ord(c) for c in ",;"])
UNKNOWN, COMMA, FIRST_END = 0, 1, 2
RESERVED = FIRST_END + len(LENGTHS) + 1


@dataclass
class Stream:
    """Symbols of a batch, the sentence of each, the document of each sentence."""

    symbols: np.ndarray
    sentence: np.ndarray
    document: np.ndarray


def _has(codes: np.ndarray, which: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.isin(codes, which))])


def streams(texts: pa.Array, vocabulary: np.ndarray, common: np.ndarray) -> tuple[Stream, Stream]:
    """The word stream and the build stream of a batch. ``vocabulary`` is sorted word hashes; ``common`` says which
    of them keep their own symbol in the build stream, which numbers these alone. Unknown words are one symbol."""
    w = words_of(texts)
    n = len(w.hashes)
    doc = np.repeat(np.arange(len(w.offsets) - 1), np.diff(w.offsets))
    stop = w.begins + w.lengths
    after = np.append(w.begins[1:], len(w.codes))
    ends, commas = _has(w.codes, ENDS), _has(w.codes, COMMAS)
    last = np.zeros(n, bool)
    last[w.offsets[1:][np.diff(w.offsets) > 0] - 1] = True
    end = (ends[after] > ends[stop]) | last
    comma = (commas[after] > commas[stop]) & ~end
    sentence = np.cumsum(np.append(False, end[:-1])) if n else np.zeros(0, np.int64)
    size = np.bincount(sentence, minlength=int(sentence[-1]) + 1 if n else 0)
    at = np.searchsorted(vocabulary, w.hashes) if len(vocabulary) else np.zeros(n, np.int64)
    at = np.minimum(at, max(0, len(vocabulary) - 1))
    known = (vocabulary[at] == w.hashes) if len(vocabulary) else np.zeros(n, bool)
    word = np.where(known, at + RESERVED, UNKNOWN)
    own = np.where(known & common[at], (np.cumsum(common) - 1)[at] + RESERVED, UNKNOWN) if len(vocabulary) else word
    mark = np.where(end, FIRST_END + np.searchsorted(LENGTHS, size[sentence]), COMMA)
    extra = end | comma
    place = np.arange(n) + np.concatenate([[0], np.cumsum(extra)[:-1]]) if n else np.zeros(0, np.int64)
    total = n + int(extra.sum())
    which = np.empty(total, np.int64)
    which[place] = sentence
    which[place[extra] + 1] = sentence[extra]
    build = np.empty(total, np.int64)
    build[place] = own
    build[place[extra] + 1] = mark[extra]
    first = np.flatnonzero(np.append(True, np.diff(sentence) > 0)) if n else np.zeros(0, np.int64)
    owner = doc[first]
    return Stream(word, sentence, owner), Stream(build, which, owner)


def _grams(stream: Stream, size: int, order: int) -> dict[int, np.ndarray]:
    """The bigram and trigram that ends in each symbol, as numbers; they do not reach over the start of a sentence."""
    s, first = stream.symbols.astype(np.int64), np.append(True, np.diff(stream.sentence) > 0)[: len(stream.symbols)]
    prev = np.where(first, 0, np.append(0, s[:-1])) if len(s) else s
    out = {2: prev * size + s}
    if order > 2:
        second = np.append(True, first[:-1])[: len(s)] | first
        before = np.where(second, 0, np.concatenate([[0, 0], s[:-2]])[: len(s)]) if len(s) else s
        out[3] = (before * size + prev) * size + s
    return out


def _places(keys: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Where each of ``grams`` is in ``keys``, -1 where it isn't."""
    if not len(keys):
        return np.full(len(grams), -1)
    at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
    return np.where(keys[at] == grams, at, -1)


@dataclass
class Listed:
    """The numbers of all n-grams of a stream by their length, and how many symbols it may have."""

    size: int
    keys: dict[int, np.ndarray]


class Counted(Listed):
    """The n-grams of a stream, listed once, to be tallied for any part of its documents."""

    def __init__(self, order: int, stream: Stream, level: np.ndarray, size: int):
        """``level`` is the index of the level of each document, -1 where it isn't used."""
        self.symbols, self.size = stream.symbols, size
        self.level = level[stream.document].astype(np.int8)[stream.sentence]
        grams = _grams(stream, size, order)
        self.keys = {n: np.unique(g[self.level >= 0]) for n, g in grams.items()}
        self.at = {n: _places(self.keys[n], grams.pop(n)).astype(np.int32) for n in sorted(grams)}

    def tally(self, rows: np.ndarray | None = None) -> dict[int, np.ndarray]:
        """Counts by level of symbols (1) and n-grams (2, 3), over all symbols or ``rows`` of them."""
        out = {n: np.zeros((len(LEVELS), len(k)), np.int32) for n, k in {1: np.arange(self.size), **self.keys}.items()}
        for i in range(len(LEVELS)):
            some = self.level == i if rows is None else rows & (self.level == i)
            for n, counts in out.items():
                counts[i] = np.bincount(self.symbols[some] if n == 1 else self.at[n][some], minlength=counts.shape[1])
        return out


class Model:
    """Interpolated n-gram models of all levels over one stream, as tables of weighted probabilities per level."""

    def __init__(self, mix: tuple[float, ...], counted: Listed, tally: dict[int, np.ndarray]):
        """``mix`` has the weights of the longest n-grams first, down to single symbols and, for bigrams, uniform ones."""
        self.size, order, one = counted.size, max(tally), tally[1]
        if order == 2:
            self.base = mix[1] * (one + 0.1) / (one + 0.1).sum(1, keepdims=True) + mix[2] / self.size
        else:
            self.base = mix[2] * (one + 0.5) / (one + 0.5).sum(1, keepdims=True)
        self.base = self.base.astype(np.float32)
        self.tables = {}
        for n, weight in zip(range(2, order + 1), mix[: order - 1][::-1], strict=True):
            keys, c = counted.keys[n], tally[n]
            back = np.unique(keys // self.size, return_inverse=True)[1] if len(keys) else np.zeros(0, np.int64)
            total = np.stack([np.bincount(back, x) for x in c]) if len(keys) else np.zeros((len(LEVELS), 0))
            self.tables[n] = keys, (weight * c / (total[:, back] + 1)).astype(np.float32)

    def nats(self, symbols: np.ndarray, at: dict[int, np.ndarray]) -> np.ndarray:
        """Surprisal of every symbol under every level's model, given where its n-grams are: (levels, symbols)."""
        p = self.base[:, symbols]
        for n, (_, weights) in self.tables.items():
            hit = at[n] >= 0
            p[:, hit] += weights[:, at[n][hit]]
        return -np.log(p)

    def surprisal(self, stream: Stream) -> np.ndarray:
        """Nats of every symbol of a text that was not counted."""
        grams = _grams(stream, self.size, max(self.tables))
        return self.nats(stream.symbols, {n: _places(keys, grams[n]) for n, (keys, _) in self.tables.items()})


#: Figures of each level's model over one document: the mean and quartiles over sentences.
QUARTILES = (0.25, 0.5, 0.75)
FIGURES = 1 + len(QUARTILES)


def _features(stream: Stream, nats: np.ndarray, n_docs: int) -> np.ndarray:
    """(documents, levels, figures): surprisal a symbol under each level's model less the mean of all levels, over the
    whole text and as quartiles over its sentences. A text without words has zeros."""
    k = len(LEVELS)
    out = np.zeros((n_docs, k, FIGURES))
    if not len(stream.symbols):
        return out
    n_sent = len(stream.document)
    size = np.bincount(stream.sentence, minlength=n_sent)
    per = np.stack([np.bincount(stream.sentence, nats[i], n_sent) for i in range(k)])
    count = np.maximum(1, np.bincount(stream.document, size, n_docs))
    mean = np.stack([np.bincount(stream.document, per[i], n_docs) for i in range(k)]) / count
    out[:, :, 0] = (mean - mean.mean(0)).T
    each = per / np.maximum(1, size)
    each -= each.mean(0)
    at = np.searchsorted(stream.document, np.arange(n_docs))
    many = np.bincount(stream.document, minlength=n_docs)
    for i in range(k):
        order = np.lexsort((each[i], stream.document))
        for j, q in enumerate(QUARTILES, 1):
            pick = np.minimum(at + (np.maximum(many - 1, 0) * q).astype(np.int64), n_sent - 1)
            out[:, i, j] = np.where(many > 0, each[i][order[pick]], 0)
    return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares non-decreasing fit of y over x by pooling adjacent violators: both ends of every step and their
    values, between which the fit is interpolated."""
    ends, at = np.unique(x, return_inverse=True)
    return _knots(_pooled(zip(ends.tolist(), ends.tolist(), np.bincount(at, y).tolist(), np.bincount(at).tolist(), strict=True)))


def _pooled(steps: Iterable[tuple[float, float, float, float]]) -> list[list[float]]:
    """Steps (first x, last x, sum of y, weight) in order of x, with adjacent violators pooled."""
    blocks: list[list[float]] = []
    for step in steps:
        blocks.append([*step])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] > blocks[-1][2] * blocks[-2][3]:
            _, right, total, n = blocks.pop()
            blocks[-1][1:] = right, blocks[-1][2] + total, blocks[-1][3] + n
    return blocks


def _knots(blocks: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
    knots = [(x, b[2] / b[3]) for b in blocks for x in dict.fromkeys((b[0], b[1]))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


@dataclass
class Grader:
    """Everything that grading a text needs; ``features`` needs only the first four."""

    vocabulary: np.ndarray
    common: np.ndarray
    words: Model
    build: Model
    rates: np.ndarray | None = None
    scale: np.ndarray | None = None
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, texts: pa.Array) -> np.ndarray:
        a, b = streams(texts, self.vocabulary, self.common)
        return np.concatenate([_features(s, m.surprisal(s), len(texts)) for s, m in ((a, self.words), (b, self.build))], 2)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _shares(_design(x, self.scale), self.rates) @ np.array(LEVELS, float)

    def level(self, score: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(np.interp(score, *self.steps) + 0.5), LEVELS[0], LEVELS[-1]).astype(np.int32)


def _design(x: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """(documents, levels, 1 + figures): what a level's odds rest on, the surprisal figures of its own models alone."""
    return np.concatenate([np.ones((*x.shape[:2], 1)), np.clip(-x / scale, -4, 4)], 2)


def _shares(design: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """The share of each level: its odds are the exponential of its figures at its own rates (levels, 1 + figures)."""
    z = np.einsum("dlf,lf->dl", design, rates)
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _slopes(design: np.ndarray, ratings: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Loss, its gradient and its second derivatives in the rates, flat and summed over documents; a rating between two
    levels counts in part for both."""
    low = np.clip(np.floor(ratings).astype(int), LEVELS[0], LEVELS[-1] - 1)
    want = np.zeros((len(design), len(LEVELS)))
    want[np.arange(len(design)), low - 1] = 1 - (ratings - low)
    want[np.arange(len(design)), low] = ratings - low
    p = _shares(design, rates)
    curve = np.empty((*rates.shape, *rates.shape))
    for a, b in itertools.product(range(len(LEVELS)), repeat=2):
        curve[a, :, b] = (design[:, a] * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ design[:, b]
    return np.concatenate([[-(want * np.log(np.maximum(p, 1e-300))).sum()], np.einsum("dl,dlf->lf", p - want, design).ravel(), curve.ravel()])


def _calibrate(slopes: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The rates by Newton's method, given ``_slopes`` over all documents; a step that doesn't lower the loss is halved."""
    w, n, least, step = np.zeros(shape), shape[0] * shape[1], np.inf, np.zeros(shape)
    while True:
        sums = slopes(w)
        loss = sums[0] + PENALTY / 2 * (w**2).sum()
        if loss > least + 1e-9 * abs(least):
            step = step / 2
            w = w + step
            continue
        if np.abs(step).max() < STEP and least < np.inf:
            return w
        least = loss
        step = np.linalg.solve(sums[1 + n :].reshape(n, n) + PENALTY * np.eye(n), sums[1 : 1 + n] + PENALTY * w.ravel()).reshape(shape)
        w = w - step


def _unseen(stream: Stream, counted: Counted, mix: tuple[float, ...], fold: np.ndarray) -> np.ndarray:
    """Features of every document under models of the documents of the other folds."""
    total, of = counted.tally(), fold[stream.document].astype(np.int8)[stream.sentence]
    out = np.zeros((len(fold), len(LEVELS), FIGURES))
    for k in range(FOLDS):
        rows = of == k
        part = counted.tally(rows)
        model = Model(mix, counted, {n: total[n] - part[n] for n in total})
        kept, sentence = np.unique(stream.sentence[rows], return_inverse=True)
        own = Stream(stream.symbols[rows], sentence, stream.document[kept])
        some = _features(own, model.nats(own.symbols, {n: at[rows] for n, at in counted.at.items()}), len(fold))
        out[fold == k] = some[fold == k]
    return out


def _joined(parts: list[tuple[Stream, Stream]]) -> list[Stream]:
    """The streams of consecutive pieces of ``AT_ONCE`` texts as one of each kind."""
    out = []
    for kind in zip(*parts, strict=True):
        before = np.cumsum([0] + [len(s.document) for s in kind])
        out.append(Stream(np.concatenate([s.symbols for s in kind]).astype(np.int32), np.concatenate([s.sentence + n for s, n in zip(kind, before, strict=False)]).astype(np.int32), np.concatenate([s.document + i * AT_ONCE for i, s in enumerate(kind)])))
    return out


def fit(texts: list[str], ratings: np.ndarray, fold: np.ndarray | None = None) -> Grader:
    """What ``fit_all`` makes, from texts in memory, dealt into folds by ``fold`` or else by their place. Ratings may be fractions (the mean of several raters), which the models don't count.
    The rates and the regression rest on surprisals of texts under models that have not seen them."""
    pieces = [pa.array(texts[k : k + AT_ONCE], pa.string()) for k in range(0, len(texts), AT_ONCE)]
    once = [np.unique(w.hashes[a:b]) for w in map(words_of, pieces) for a, b in itertools.pairwise(w.offsets)]
    vocabulary, n_docs = np.unique(np.concatenate(once), return_counts=True)
    keep = n_docs >= LEAST_DOCS
    vocabulary, common = vocabulary[keep], (n_docs >= COMMON / 4 * len(texts))[keep]
    level = np.where(ratings == np.round(ratings), np.round(ratings) - 1, -1).astype(np.int64)
    fold = np.arange(len(texts)) * 7919 % FOLDS if fold is None else fold
    models, figures = [], []
    for stream, order, mix in zip(_joined([streams(x, vocabulary, common) for x in pieces]), (2, 3), (MIX_WORDS, MIX_BUILD), strict=True):
        counted = Counted(order, stream, level, (len(vocabulary) if order == 2 else int(common.sum())) + RESERVED)
        figures.append(_unseen(stream, counted, mix, fold))
        models.append(Model(mix, counted, counted.tally()))
    x = np.concatenate(figures, 2)
    scale = np.abs(x).mean((0, 1)) + 1e-9
    rates = _calibrate(lambda w: _slopes(_design(x, scale), ratings, w), (len(LEVELS), 1 + x.shape[2]))
    score = _shares(_design(x, scale), rates) @ np.array(LEVELS, float)
    return Grader(vocabulary, common, *models, rates, scale, isotonic(score, ratings))


def rated_sample(documents: DataFrame, ratings: DataFrame) -> tuple[list[str], np.ndarray]:
    """Texts and mean ratings of at most ``SAMPLE`` rated documents that exist and have a text, in the order of a hash of
    their id. A text that would pass ``SAMPLE_CHARS`` characters in all is left out of the fit, those after it are not;
    of texts that are all longer the shortest is taken. Null ratings, ratings off the scale and repeated rows don't count."""
    votes = ratings.filter(F.col("reading_level").between(LEVELS[0], LEVELS[-1])).select("doc_id", "rater", "reading_level").distinct()
    mean = votes.groupBy("doc_id").agg(F.avg("reading_level").alias("rating"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    sized = documents.filter("text is not null").select("doc_id", F.length("text").alias("n")).join(mean, "doc_id").groupBy("doc_id").agg(F.min("n").alias("n"), F.first("rating").alias("rating"))
    rated = sized.orderBy(*order).limit(SAMPLE).collect()
    if not rated:
        return [], np.zeros(0)
    chosen, left = {}, SAMPLE_CHARS
    for r in rated:
        if r["n"] <= left:
            chosen[r["doc_id"]], left = r["rating"], left - r["n"]
    if not chosen:
        shortest = min(rated, key=lambda r: (r["n"], r["doc_id"]))
        chosen = {shortest["doc_id"]: shortest["rating"]}
    spark = documents.sparkSession
    some = F.broadcast(spark.createDataFrame([(k,) for k in chosen], "doc_id bigint"))
    rows = documents.select("doc_id", "text").filter("text is not null").join(some, "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.length("text").alias("n"), "text")).alias("t"))
    kept = rows.select("doc_id", "t.text").orderBy(*order).collect()
    return [r["text"] for r in kept], np.array([chosen[r["doc_id"]] for r in kept])


def rated_texts(documents: DataFrame, ratings: DataFrame) -> DataFrame:
    """``text``, mean ``rating`` and ``fold`` of every rated document that exists and has a text, of a repeated id the
    shortest. Null ratings, ratings off the scale and repeated rows don't count."""
    votes = ratings.filter(F.col("reading_level").between(LEVELS[0], LEVELS[-1])).select("doc_id", "rater", "reading_level").distinct()
    mean = materialize(votes.groupBy("doc_id").agg(F.avg("reading_level").alias("rating")), "ratings")
    rows = documents.filter("text is not null").select("doc_id", "text").join(small(mean), "doc_id").groupBy("doc_id")
    once = rows.agg(F.min(F.struct(F.length("text").alias("n"), "text")).alias("t"), F.first("rating").alias("rating"))
    return once.select("t.text", "rating", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))


def _words_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word of a piece with the number of texts that have it."""
    for batch in batches:
        for piece in slices(batch, 0):
            w = words_of(piece.column(0))
            once = [np.unique(w.hashes[a:b]) for a, b in itertools.pairwise(w.offsets)]
            words, n = np.unique(np.concatenate(once), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])


ORDERS, MIXES = (2, 3), (MIX_WORDS, MIX_BUILD)
GRAMS = "kind int, size int, gram bigint, fold int, level int, n bigint"


def _tally(grams: DataFrame, sizes: list[int], keys: list[dict[int, np.ndarray]] | None = None) -> tuple[list[dict[int, np.ndarray]], list[dict[int, np.ndarray]]]:
    """The n-grams of each stream (``keys``, if they are known) and their counts by level."""
    found = grams.groupBy("kind", "size", "gram", "level").agg(F.sum("n").cast("int").alias("n")).toArrow()
    kind, size, gram, level, n = (found.column(c).to_numpy() for c in found.column_names)
    listed, tallies = [], []
    for k, order in enumerate(ORDERS):
        listed.append({})
        tallies.append({})
        for m in range(1, order + 1):
            rows = (kind == k) & (size == m)
            known = np.arange(sizes[k]) if m == 1 else np.unique(gram[rows]) if keys is None else keys[k][m]
            counts = np.zeros((len(LEVELS), len(known)), np.int32)
            counts[level[rows], _places(known, gram[rows])] = n[rows]
            tallies[k][m] = counts
            if m > 1:
                listed[k][m] = known
    return listed, tallies


def _summed(figures: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all batches of the flat array that ``of`` makes of ratings and figures (documents, levels, figures)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [of(*_read(batch)) for batch in batches if len(batch)]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([np.sum(sums, 0)], pa.list_(pa.float64()))], ["s"])

    return np.sum([r["s"] for r in figures.mapInArrow(part, "s array<double>").collect()], 0)


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(len(batch), len(LEVELS), -1)


def fit_all(rated: DataFrame) -> Grader:
    """A grader from all of ``rated_texts``, which must have a row."""
    context = rated.sparkSession.sparkContext
    n_texts = rated.count()
    words = rated.select("text").mapInArrow(_words_once, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_DOCS).toArrow()
    vocabulary, n_docs = words.column("word").to_numpy().view(np.uint64), words.column("n").to_numpy()
    order = np.argsort(vocabulary)
    vocabulary, common = vocabulary[order], (n_docs >= COMMON / 4 * n_texts)[order]
    sizes = [len(vocabulary) + RESERVED, int(common.sum()) + RESERVED]
    known = context.broadcast((vocabulary, common))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = len(LEVELS) * FOLDS
        for batch in batches:
            for piece in slices(batch, 0):
                rating, fold = piece.column(1).to_numpy(), piece.column(2).to_numpy()
                cell = np.where(rating == np.round(rating), (np.round(rating).astype(np.int64) - 1) * FOLDS + fold, -1)
                for k, stream in enumerate(streams(piece.column(0), *known.value)):
                    at = cell[stream.document][stream.sentence]
                    for m, grams in {1: stream.symbols, **_grams(stream, sizes[k], ORDERS[k])}.items():
                        found, n = np.unique(grams[at >= 0] * cells + at[at >= 0], return_counts=True)
                        gram, at_ = found // cells, found % cells
                        columns = [np.full(len(n), k, np.int32), np.full(len(n), m, np.int32), gram, (at_ % FOLDS).astype(np.int32), (at_ // FOLDS).astype(np.int32), n]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "size", "gram", "fold", "level", "n"])

    counts = rated.select("text", "rating", "fold").mapInArrow(count, GRAMS).groupBy("kind", "size", "gram", "fold", "level").agg(F.sum("n").alias("n"))
    grams = materialize(counts, "grams", ["fold"])
    keys, total = _tally(grams, sizes)
    models = lambda tallies: [Model(mix, Listed(size, key), tally) for mix, size, key, tally in zip(MIXES, sizes, keys, tallies, strict=True)]
    parts = []
    for k in range(FOLDS):
        _, own = _tally(grams.filter(F.col("fold") == k), sizes, keys)
        shared = context.broadcast(Grader(vocabulary, common, *models([{m: t[m] - o[m] for m in t} for t, o in zip(total, own, strict=True)])))

        def judge(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in slices(batch, 0):
                    x = shared.value.features(piece.column(0)).reshape(len(piece), -1)
                    yield pa.RecordBatch.from_arrays([piece.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["rating", "x"])

        parts.append(materialize(rated.filter(F.col("fold") == k).select("text", "rating").mapInArrow(judge, "rating double, x array<double>"), "figures"))
        shared.destroy()
    discard(grams)
    known.destroy()
    figures = parts[0].sparkSession.read.schema(parts[0].schema).parquet(*[p._weftmatch_path for p in parts])
    scale = _summed(figures, lambda y, x: np.abs(x).sum((0, 1))) / (n_texts * len(LEVELS)) + 1e-9
    rates = _calibrate(lambda w: _summed(figures, lambda y, x: _slopes(_design(x, scale), y, w)), (len(LEVELS), 1 + len(scale)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for y, x in map(_read, batches):
            yield pa.RecordBatch.from_arrays([pa.array(_shares(_design(x, scale), rates) @ np.array(LEVELS, float)), pa.array(y)], ["score", "rating"])

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[list[float]] = []
        for batch in batches:
            x, total, n = (c.to_pylist() for c in batch.columns)
            blocks = _pooled([*blocks, *zip(x, x, total, n, strict=True)])
        yield pa.RecordBatch.from_arrays([pa.array([b[c] for b in blocks], pa.float64()) for c in range(4)], ["a", "b", "total", "n"])

    # Equal scores are one step before any are pooled; pooling within sorted pieces first gives the same fit.
    same = figures.mapInArrow(score, "score double, rating double").groupBy("score").agg(F.sum("rating").alias("total"), F.count(F.lit(1)).cast("double").alias("n"))
    steps = same.repartitionByRange("score").sortWithinPartitions("score").mapInArrow(pool, "a double, b double, total double, n double").collect()
    for p in parts:
        discard(p)
    return Grader(vocabulary, common, *models(total), rates, scale, _knots(_pooled(sorted(tuple(r) for r in steps))))


def reading_levels(documents: DataFrame, ratings: DataFrame) -> DataFrame:
    """``doc_id``, ``score``, ``reading_level`` of every document with an id, whole texts, map-side only.

    A null or empty text, or one without words, gets the level of a text with neutral surprisal. Without any rating
    there is no scale: the result is then empty. Extra columns are ignored; a repeated row is graded again."""
    spark = documents.sparkSession
    schema = "doc_id bigint, score double, reading_level int"
    rated = materialize(rated_texts(documents, ratings), "rated", ["fold"])
    if rated.isEmpty():
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(fit_all(rated))
    discard(rated)

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grader = shared.value
        for batch in batches:
            for piece in slices(batch, 1):
                score = grader.score(grader.features(piece.column(1)))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(score), pa.array(grader.level(score))], ["doc_id", "score", "reading_level"])

    return documents.select("doc_id", "text").filter("doc_id is not null").mapInArrow(grade, schema)
