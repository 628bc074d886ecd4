"""Problem 8: held-out passages inside the corpus, by greedy string tiling.

Seeds are runs of ``SEED`` words shared by a document and a held-out item, found by Karp-Rabin hashes of word windows.
Seeds on one diagonal join to maximal common runs; the tiling marks the longest run that touches no marked word, again
and again, until none of ``SEED`` words is left. A document is reported for an item if it has a run of ``RUN`` words (or
the whole item where that is shorter), or if its tiles cover ``COVER`` of the item, which catches reordered passages.

Seeds are expanded to pairs of places only where that costs in proportion to the text. In repetitive texts, where one
window stands at many places of both sides, the tiles are found by Karp-Rabin hashes of growing windows instead.

The held-out items are few and come in blocks of bounded size to every task; the corpus is read once per block and is
never shuffled; a block leaves the executors when its pass is done. No document, seed or candidate is left out: the
coverage bound that spares the tiling is an upper bound.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .words import BASE, Words, slices, windows, word_text, words_of

SEED, RUN, COVER = 5, 13, 0.8
#: Words of held-out text in one block, about 50 MB of index. A longer item is a block of its own.
BLOCK_WORDS = 1_000_000
#: A document is repetitive if its seeds are so many times more than its words and its distinct windows' seeds.
REPETITIVE = 16

MASK = (1 << 64) - 1
SCHEMA = "doc_id bigint, item_id bigint, longest_run int, n_tiles int, covered_words int, item_words int"


class ItemIndex:
    """The windows of one block of held-out items: sorted hashes with the item and place of each."""

    def __init__(self, ids: list[int], texts: list[str]):
        w = words_of(pa.array(texts, pa.string()))
        self.ids = np.array(ids, np.int64)
        self.lengths = np.diff(w.offsets)
        self.hashes, self.offsets = w.hashes, w.offsets
        self.text = [tuple(word_text(w, k) for k in range(a, b)) for a, b in zip(w.offsets[:-1], w.offsets[1:], strict=True)]
        #: By window length: sorted hashes, and item and place of each. Items below ``SEED`` words have their own.
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({SEED, *(int(x) for x in self.lengths if 0 < x < SEED)}):
            chosen = self.lengths >= SEED if n == SEED else self.lengths == n
            h, item, place = [], [], []
            all_ = windows(w.hashes, n)
            for t in np.flatnonzero(chosen):
                a, b = w.offsets[t], w.offsets[t + 1] - n + 1
                h.append(all_[a:b])
                item.append(np.full(b - a, t))
                place.append(np.arange(b - a))
            if h:
                flat = np.concatenate(h)
                order = np.argsort(flat, kind="stable")
                self.of[n] = flat[order], np.concatenate(item)[order], np.concatenate(place)[order]
        self.sieve = {n: self._sieve(x[0]) for n, x in self.of.items()}

    @staticmethod
    def _sieve(hashes: np.ndarray) -> np.ndarray:
        bits = max(16, int(len(hashes) * 16).bit_length())
        out = np.zeros(1 << bits, bool)
        out[hashes & np.uint64((1 << bits) - 1)] = True
        return out

    def seeds(self, w: Words, n: int) -> tuple[tuple[np.ndarray, ...], list[tuple[int, np.ndarray]]]:
        """Document, place in the batch's words, item and place in the item of every shared window of ``n`` words; and
        apart from them the repetitive documents, each with the items that it shares windows with."""
        hashes, item, place = self.of[n]
        h = windows(w.hashes, n)
        at = np.flatnonzero(self.sieve[n][h & np.uint64(len(self.sieve[n]) - 1)])
        lo = np.searchsorted(hashes, h[at], "left")
        many = np.searchsorted(hashes, h[at], "right") - lo
        at, lo, many = at[many > 0], lo[many > 0], many[many > 0]
        doc = np.searchsorted(w.offsets, at, "right") - 1
        inside = at + n <= w.offsets[doc + 1]
        at, lo, many, doc = at[inside], lo[inside], many[inside], doc[inside]
        docs = len(w.offsets) - 1
        once = np.unique(doc * (len(hashes) + 1) + lo, return_index=True)[1]
        plain = REPETITIVE * (np.bincount(doc[once], many[once], docs) + np.diff(w.offsets))
        odd = np.flatnonzero(np.bincount(doc, many, docs) > plain) if n == SEED else []
        spread = lambda a, b: np.repeat(a, b) + np.arange(b.sum()) - np.repeat(np.cumsum(b) - b, b)
        apart = [(int(d), np.unique(item[spread(lo[once][doc[once] == d], many[once][doc[once] == d])])) for d in odd]
        if len(odd):
            usual = ~np.isin(doc, odd)
            at, lo, many, doc = at[usual], lo[usual], many[usual], doc[usual]
        take = spread(lo, many)
        return (np.repeat(doc, many), np.repeat(at, many), item[take], place[take]), apart


class _Rolling:
    """Hashes of all windows of one text, of any length, and which of its words are marked."""

    def __init__(self, hashes: np.ndarray):
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        up = [1]
        total = 0
        for k, h in enumerate(hashes.tolist()):
            total = (total * int(BASE) + h) & MASK
            self.sums[k + 1] = total
            up.append(up[-1] * int(BASE) & MASK)
        self.up = np.array(up, np.uint64)
        self.marked = np.zeros(len(hashes), bool)

    def free(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows of ``n`` words without a marked one."""
        taken = np.concatenate([[0], np.cumsum(self.marked)])
        at = np.flatnonzero(taken[n:] == taken[: len(taken) - n])
        with np.errstate(over="ignore"):
            return at, self.sums[at + n] - self.sums[at] * self.up[n]


def tile_repetitive(doc: np.ndarray, item: np.ndarray, same: Callable[[int, int, int], bool]) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in document, place in item, words) of two texts given as word hashes, the longest first, without
    listing pairs of places. The longest length in common is found by halving, all its tiles are marked in order of
    place, and shorter ones follow. ``same`` compares the words of a tile themselves."""
    a, b = _Rolling(doc), _Rolling(item)
    tiles: list[tuple[int, int, int]] = []
    most = min(len(doc), len(item))
    while most >= SEED:
        low, high = SEED - 1, most
        while low < high:
            n = (low + high + 1) // 2
            low, high = (n, high) if len(np.intersect1d(a.free(n)[1], b.free(n)[1])) else (low, n - 1)
        if low < SEED:
            break
        (pa_, ha), (pb, hb) = a.free(low), b.free(low)
        there: dict[int, list[int]] = {}
        for place, h in zip(pb[::-1].tolist(), hb[::-1].tolist(), strict=True):
            there.setdefault(h, []).append(place)
        for i, h in zip(pa_.tolist(), ha.tolist(), strict=True):
            places = there.get(h, [])
            if a.marked[i] or a.marked[i + low - 1]:
                continue
            while places and (b.marked[places[-1]] or b.marked[places[-1] + low - 1]):
                places.pop()
            if places and same(i, places[-1], low):
                j = places.pop()
                a.marked[i : i + low] = b.marked[j : j + low] = True
                tiles.append((i, j, low))
        most = low - 1
    return tiles


def _tile(runs: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of ``runs`` (place in document, place in item, words): the tiles, longest first. Ties go to the
    earliest place. A run that is partly marked comes back as its unmarked pieces."""
    heap = [(-n, i, j) for i, j, n in runs]
    heapq.heapify(heap)
    in_doc: set[int] = set()
    in_item: set[int] = set()
    tiles = []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        free = [k for k in range(n) if i + k not in in_doc and j + k not in in_item]
        if len(free) == n:
            tiles.append((i, j, n))
            in_doc.update(range(i, i + n))
            in_item.update(range(j, j + n))
            continue
        start = 0
        for x in range(1, len(free) + 1):
            if x == len(free) or free[x] != free[x - 1] + 1:
                if x - start >= least:
                    heapq.heappush(heap, (start - x, i + free[start], j + free[start]))
                start = x
    return tiles


def _leaks(w: Words, index: ItemIndex) -> list[tuple[int, int, int, int, int, int]]:
    """(document, item, longest run, tiles, covered words, item words) of the reported pairs of one batch."""
    out = []
    for n in index.of:
        (doc, at, item, place), apart = index.seeds(w, n)
        for d, items in apart:
            base, stop = int(w.offsets[d]), int(w.offsets[d + 1])
            for t in items.tolist():
                own = index.hashes[index.offsets[t] : index.offsets[t + 1]]
                same = lambda i, j, size, base=base, t=t: all(word_text(w, base + i + x) == index.text[t][j + x] for x in range(size))
                _report(out, d, t, tile_repetitive(w.hashes[base:stop], own, same), len(own))
        if not len(doc):
            continue
        pair = doc * len(index.ids) + item
        diagonal = at - place
        order = np.lexsort((at, diagonal, pair))
        pair, diagonal, at, place, item, doc = (x[order] for x in (pair, diagonal, at, place, item, doc))
        fresh = np.ones(len(pair), bool)
        fresh[1:] = (pair[1:] != pair[:-1]) | (diagonal[1:] != diagonal[:-1]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(fresh)
        size = np.diff(np.append(begin, len(pair))) + n - 1
        head = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        longest = np.maximum.reduceat(size, np.searchsorted(begin, head))
        # Words of the item under any seed: no tiling covers more.
        cover = np.zeros(len(head), np.int64)
        by_place = np.lexsort((place, pair))
        gap = np.append(place[by_place][1:] - place[by_place][:-1], n)
        gap[np.append(pair[by_place][1:] != pair[by_place][:-1], True)] = n
        np.add.at(cover, np.searchsorted(head, np.arange(len(pair)), "right") - 1, np.minimum(gap, n))
        words = index.lengths[item[head]]
        wanted = np.flatnonzero((longest >= np.minimum(RUN, words)) | (cover >= COVER * words))
        stop = np.append(head[1:], len(pair))
        for k in wanted:
            a, b = np.searchsorted(begin, [head[k], stop[k]])
            base, t = w.offsets[doc[head[k]]], int(item[head[k]])
            runs = [(int(at[begin[r]] - base), int(place[begin[r]]), int(size[r])) for r in range(a, b)]
            # The words themselves decide, not their hashes.
            runs = [r for r in runs if all(word_text(w, base + r[0] + x) == index.text[t][r[1] + x] for x in range(r[2]))]
            _report(out, int(doc[head[k]]), t, _tile(runs, min(SEED, n)), int(words[k]))
    return out


def _report(out: list, doc: int, item: int, tiles: list[tuple[int, int, int]], words: int) -> None:
    """Add the pair to ``out`` if its tiles are enough."""
    covered, best = sum(x[2] for x in tiles), max((x[2] for x in tiles), default=0)
    if best >= min(RUN, words) or covered >= COVER * words:
        out.append((doc, item, best, len(tiles), covered, words))


def _blocks(items: DataFrame) -> Iterator[ItemIndex]:
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for row in items.select("item_id", "text").filter("item_id is not null and text is not null").toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += len(row["text"]) // 4 + 1
        if size >= BLOCK_WORDS:
            yield ItemIndex(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield ItemIndex(ids, texts)


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """One row per affected document and held-out item with the tiling's figures.

    ``documents`` has ``doc_id``, ``text``; ``items`` has ``item_id``, ``text``; other columns are ignored. Nulls,
    empty texts and items without words match nothing; an item text that occurs twice is reported for both ids; a
    repeated document row is reported as often as it occurs; no items or no documents give an empty result."""
    sc = documents.sparkSession.sparkContext
    out = documents.sparkSession.createDataFrame([], SCHEMA)
    for index in _blocks(items):
        shared = sc.broadcast(index)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for piece in slices(batch, 1):
                    found = _leaks(words_of(piece.column(1)), index)
                    if found:
                        doc, item, *rest = (np.array(x) for x in zip(*found, strict=True))
                        yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(doc)), pa.array(index.ids[item]), *(pa.array(x.astype(np.int32)) for x in rest)], ["doc_id", "item_id", "longest_run", "n_tiles", "covered_words", "item_words"])

        rows = documents.select("doc_id", "text").filter("doc_id is not null and text is not null").mapInArrow(scan, SCHEMA)
        out = out.unionByName(materialize(rows, "leaks"))
        shared.destroy()
    return out.withColumn("coverage", F.round(F.col("covered_words") / F.col("item_words"), 6))
