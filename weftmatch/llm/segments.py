"""Similarity join on edit distance by the pigeonhole principle.

Each string is cut into ``k + 1`` segments; a string within ``k`` edits of it holds at least one segment unchanged, at a
place shifted by no more than the edits before and after it allow. The segments form an inverted index, the other side
looks up its substrings at the allowed shifts only, and candidates are verified by a banded edit distance. Complete for
every pair within ``k``; strings of ``k`` characters or fewer are joined by length and verified as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import scramble


@cache
def cuts(length: int, k: int) -> tuple[tuple[int, int], ...]:
    """Start and length of the ``k + 1`` segments of a string of ``length``; the last ones take what doesn't divide."""
    n = k + 1
    base, extra = divmod(length, n)
    sizes = [base + (i >= n - extra) for i in range(n)]
    return tuple((sum(sizes[:i]), s) for i, s in enumerate(sizes))


@cache
def lookups(length: int, k: int, shorter_only: bool) -> tuple[tuple[int, int, int], ...]:
    """(tag, start, size) of the substrings that a string of ``length`` looks up: for every indexed length within
    ``k`` and every segment, the starts that leave edits enough on both sides."""
    out = []
    for l in range(max(0, length - k), length + (0 if shorter_only else k) + 1):
        delta = length - l
        for i, (start, size) in enumerate(cuts(l, k)):
            lo = max(0, start - i, start + delta - (k - i))
            hi = min(length - size, start + i, start + delta + (k - i))
            out += [(l * (k + 1) + i, p, size) for p in range(lo, hi + 1)] if size else [(l * (k + 1) + i, 0, 0)] * (i == 0)
    return tuple(out)


BASE, TAG, GROUP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _keys(texts: list[str], groups: np.ndarray, plan: Callable[[int], Sequence[tuple[int, int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of every (tag, start, size) that ``plan`` gives for each text's length. A key is a polynomial hash of
    the substring mixed with tag and group, taken for all texts of one length at once from running hashes."""
    lengths = np.array([len(t) for t in texts], np.int64)
    rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    with np.errstate(over="ignore"):
        for n in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == n)
            codes = np.frombuffer("".join([texts[i] for i in at]).encode("utf-32-le"), np.uint32).reshape(len(at), n).astype(np.uint64)
            run = np.zeros((len(at), n + 1), np.uint64)
            power = np.ones(n + 1, np.uint64)
            for j in range(n):
                run[:, j + 1] = run[:, j] * BASE + codes[:, j] + np.uint64(1)
                power[j + 1] = power[j] * BASE
            base = scramble(groups[at] * GROUP)
            for tag, p, size in plan(n):
                keys.append(scramble(run[:, p + size] - run[:, p] * power[size] + np.uint64(tag + 1) * TAG) ^ base)
                rows.append(at)
    return np.concatenate(rows), np.concatenate(keys)


def _explode(df: DataFrame, keep: str, plan: Callable[[int], Sequence[tuple[int, int, int]]], group: bool) -> DataFrame:
    """Column ``keep`` (and ``g`` where grouped) with ``key`` for every substring that ``plan`` gives for the text's
    length. The key only blocks; the join verifies what it brings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(1).to_numpy().view(np.uint64) if group else np.zeros(batch.num_rows, np.uint64)
            row, key = _keys(batch.column(0).to_pylist(), groups, plan)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(batch.num_columns)), pa.array(key.view(np.int64))], [*batch.schema.names, "key"])

    columns, schema = ([keep, "g"], f"{keep} string, g bigint, key bigint") if group else ([keep], f"{keep} string, key bigint")
    return df.select(*columns).filter(F.col(keep).isNotNull()).mapInArrow(run, schema)


def edit_join(left: DataFrame, right: DataFrame, k: int, within: str | None = None, one_way: bool = False) -> DataFrame:
    """Pairs (``l``, ``r``, ``distance``, and ``within``) of distinct values of ``left.text`` and ``right.text`` within
    ``k`` edits, in one group of ``within`` where given. Both sides should be distinct already. Nulls match nothing; the
    empty string is a string. Hot segments are spread by text length, segment number, group and content at once.

    ``one_way`` gives each unordered pair of a self-join at least once, from its longer text, with half the lookups."""
    g = [F.xxhash64(within).alias("g")] if within else []
    a = left.select(*g, F.col("text").alias("l"))
    b = right.select(*g, F.col("text").alias("r"))
    index = _explode(b, "r", lambda n: [(n * (k + 1) + i, s, z) for i, (s, z) in enumerate(cuts(n, k)) if z or i == 0], bool(within))
    probe = _explode(a, "l", lambda n: lookups(n, k, one_way), bool(within))
    on = ["key", "g"] if within else ["key"]
    # Sizes are estimated from the texts, of which every one becomes many segments: neither side is ever broadcast.
    pairs = probe.join(index.hint("merge"), on).filter(F.levenshtein("l", "r", k) >= 0).drop("key").distinct()
    pairs = pairs.withColumn("distance", F.levenshtein("l", "r", k))
    if within:
        groups = left.select(*g, within).distinct()
        pairs = pairs.join(groups, "g").drop("g")
    return pairs
