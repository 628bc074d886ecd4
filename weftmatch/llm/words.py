"""Words of whole texts as flat arrays: what the text operators share.

A word is a run of letters and digits in the plain form of the text, without case. Marks inside a word belong to it.
Each word is represented by a 64-bit polynomial hash of its code points; no string is made.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .plaintext import NAMED, TOP, Flat, plain_flat, to_flat

BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xFF51AFD7ED558CCD)


class Words(NamedTuple):
    """Hashes of all words of a batch, where each text's words begin (one more entry than texts), and the flat code
    points with each word's first place and length in them."""

    hashes: np.ndarray
    offsets: np.ndarray
    codes: np.ndarray
    begins: np.ndarray
    lengths: np.ndarray


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: whether it is part of a word, and its lower-case form where that is one character."""
    word, low = np.zeros(TOP, bool), np.arange(TOP, dtype=np.uint32)
    for block in (range(0x80), *NAMED):
        for code in block:
            ch = chr(code)
            word[code] = unicodedata.category(ch)[0] in "LNM"
            if len(ch.lower()) == 1:
                low[code] = ord(ch.lower())
    word[0xFE00:0xFE10] = False  # selectors that stay with emoji
    for a, b in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x2F800), (0x30000, 0x32400)):
        word[a:b] = True
    return word, low


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``BASE`` modulo 2^64 and of its inverse, ``n`` of each."""
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(n, BASE)) * 1
        inv = pow(int(BASE), -1, 1 << 64)
        down = np.cumprod(np.full(n, np.uint64(inv)))
    one = np.ones(1, np.uint64)
    return np.concatenate([one, up[:-1]]), np.concatenate([one, down[:-1]])


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers, from a table that grows by doubling."""
    return _powers(1 << max(12, int(n - 1).bit_length()))


def scramble(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * MIX
        return x ^ (x >> np.uint64(29))


def runs_hash(values: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Polynomial hash of each run of ``values``, independent of where the run lies."""
    if not len(begins):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        local = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        up, _ = powers(int(lengths.max()))
        terms = values[np.repeat(begins, lengths) + local] * up[local]
        sums = np.add.reduceat(terms, np.cumsum(lengths) - lengths)
        return scramble(sums ^ lengths.astype(np.uint64) * MIX)


def words_of(texts: pa.Array) -> Words:
    """The words of a batch of texts; a null or empty text has none."""
    word, low = _tables()
    flat: Flat = plain_flat(to_flat(texts), lines=True)
    codes = low[flat.codes]
    inside = word[codes]
    edge = np.zeros(len(codes) + 1, bool)
    edge[flat.offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    begins = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - begins
    hashes = runs_hash(codes.astype(np.uint64) + np.uint64(1), begins, lengths)
    return Words(hashes, np.searchsorted(begins, flat.offsets), codes, begins, lengths)


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of about ``most`` bytes of text, so that flat arrays stay small. A longer text is a piece of
    its own; none is cut."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(size)]
    for a, b in itertools.pairwise(cuts):
        if b > a:
            yield batch.slice(int(a), int(b - a))


def word_text(words: Words, at: int) -> str:
    """The text of one word, for checks."""
    b = words.begins[at]
    return words.codes[b : b + words.lengths[at]].tobytes().decode("utf-32-le")


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hash of every window of ``n`` words: entry i covers words i to i+n-1. Windows that cross two texts
    are for the caller to leave out."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(hashes) - n + 1, np.uint64)
        for i in range(n):
            out = out * BASE + hashes[i : len(hashes) - n + 1 + i]
        return scramble(out + np.uint64(n))
