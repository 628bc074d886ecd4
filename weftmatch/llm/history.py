"""Problem 2: duplicates of a new batch against everything accepted before it.

A perceptual hash is a set of 64 features (bit position, bit). The positions are dealt at random into ``bands`` sets, and
a band key is the tuple of ``MINIMA`` minwise values of the features of one set: under each of as many random orders of
those features, the rank of the first feature that the hash has. Two hashes at most ``PHASH_BITS`` apart differ in at most
``PHASH_BITS // bands`` positions of some set, so a probe looks up the minwise keys of every feature set that near to its
own: no pair is lost, whatever the minima. (Plain minwise bands lose pairs; see the README for figures.)

The store keeps each accepted item's band keys with its hashes, signature and id, and its video signature as one more key,
partitioned by a part of the key. A batch probes the partitions that its keys fall into and nothing else: what came before
is neither recomputed nor joined. A sieve of fixed size, kept in the store too, drops most looked-up keys before they are
shuffled. Similarity is verified inside the join, where each pair comes out of the first set that it agrees on, hence once.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hexbits import EMPTY_SHA256, hamming64, usable_hash
from ..operators.skew import heavy_keys, skew_pairs
from ..session import materialize, remove_at_exit, scratch_root
from .words import scramble

PHASH_BITS, DHASH_BITS, ALONE_BITS = 8, 12, 2
#: Sets of positions. Fewer sets make rarer keys and more lookups: 3 sets take 697 lookups, 2 sets 82,898.
BANDS = 3
#: Minwise values in a band key, a multiple of 8. Too few let keys of unlike sets agree: of 100,000 random hashes a probe
#: meets 640 with 16 values, 53 with 32, 31 with 48 and 28 with 64; sets within the looked-up distance alone are 28.
MINIMA = 48
#: Partitions of the store, a power of two.
BUCKETS = 16
#: Bits of the sieve, whatever the store holds; a key sets two of them.
SIEVE_BITS = 1 << 26
#: Bits in one block of the sieve, as Spark's bitmap functions have it.
BLOCK_BITS = 1 << 15

STORED = "k bigint, p bigint, d bigint, sig string, mongo_id string"


def media_signatures(items: DataFrame) -> DataFrame:
    """``mongo_id``, ``batch_no``, usable ``p`` and ``d`` bits, cleaned ``sig``; items without any evidence drop out."""
    sig = F.lower(F.trim("video_signature"))
    out = items.select("mongo_id", "batch_no", usable_hash(F.col("phash")).alias("p"), usable_hash(F.col("dhash")).alias("d"), F.when((sig != "") & (sig != EMPTY_SHA256), sig).alias("sig"))
    return out.filter("p is not null or sig is not null")


def _order(n: int, seed: int) -> np.ndarray:
    """A random order of ``n`` things that is the same everywhere, since stored keys depend on it."""
    return np.argsort(scramble(scramble(np.arange(n, dtype=np.uint64) + np.uint64(seed * 1000 + 1))), kind="stable")


class Band:
    """The minwise keys of one set of positions."""

    def __init__(self, number: int, positions: np.ndarray, flips: int):
        self.number, self.flips = number, flips
        #: The hash bits of the set, as a signed number for expressions.
        self.mask = int(np.array([sum(1 << int(x) for x in positions)], np.uint64).view(np.int64)[0])
        parts = np.array_split(positions, 2)
        ranks = np.stack([np.argsort(_order(2 * len(positions), 100 * number + m + 2)) for m in range(MINIMA)], axis=1).astype(np.uint8)
        self.parts, self.minima = [], []
        for part, first in zip(parts, (0, len(parts[0])), strict=True):
            values = np.arange(1 << len(part))
            low = np.full((len(values), MINIMA), 255, np.uint8)
            for j in range(len(part)):
                low = np.minimum(low, ranks[2 * (first + j) + (values >> j & 1)])
            self.parts.append(part)
            self.minima.append(low)
        flipped = [[[sum(1 << j for j in c) for c in itertools.combinations(range(len(part)), n)] for n in range(flips + 1)] for part in parts]
        near = [(a, b) for n in range(flips + 1) for m in range(n + 1) for a in flipped[0][m] for b in flipped[1][n - m]]
        self.near = np.array(near, np.int64).T

    def keys(self, p: np.ndarray, near: bool) -> np.ndarray:
        """The band key of every hash (one column) or, with ``near``, of all sets within ``flips`` positions of it. Its
        last four bits are the number of the set."""
        both = []
        for part, minima, xor in zip(self.parts, self.minima, self.near, strict=True):
            value = np.zeros(len(p), np.int64)
            for j, x in enumerate(part):
                value |= (p >> np.uint64(x) & np.uint64(1)).astype(np.int64) << j
            both.append(minima[value[:, None] ^ xor[None, :] if near else value[:, None]])
        words = np.minimum(both[0], both[1]).view(np.uint64)
        key = np.zeros(words.shape[:2], np.uint64)
        with np.errstate(over="ignore"):
            for i in range(words.shape[2]):
                key = scramble(key * np.uint64(0x9E3779B97F4A7C15) + words[..., i])
        return key & ~np.uint64(15) | np.uint64(self.number)


@cache
def bands_of(n: int) -> tuple[Band, ...]:
    return tuple(Band(i, part, PHASH_BITS // n) for i, part in enumerate(np.array_split(_order(64, 0), n)))


def same_media(pa_: Column, da: Column, pb: Column, db: Column) -> Column:
    """The verification: perceptual hashes near, difference hashes near where both exist, else nearly equal."""
    near = hamming64(pa_, pb)
    return (near <= PHASH_BITS) & F.when(da.isNotNull() & db.isNotNull(), hamming64(da, db) <= DHASH_BITS).otherwise(near <= ALONE_BITS)


def _bucket(k: Column, buckets: int) -> Column:
    return F.shiftrightunsigned(k, 40).bitwiseAND(F.lit(buckets - 1)).cast("int")


def _slots(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each key in the sieve."""
    return tuple((k >> np.uint64(s) & np.uint64(SIEVE_BITS - 1)).astype(np.int64) for s in (4, 36))


def _held(used: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (used[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def _uint(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)


class History:
    """A persisted store of accepted items. ``probe`` answers for a batch, ``append`` adds one.

    Batches are results of ``media_signatures``. A store keeps the ``bands`` and ``buckets`` it was begun with: give the
    same ones when it is opened again."""

    def __init__(self, spark: SparkSession, path: str | None = None, bands: int = BANDS, buckets: int = BUCKETS):
        if buckets & (buckets - 1) or not 1 <= bands <= 15:
            raise ValueError("buckets must be a power of two, bands from 1 to 15")
        self.spark, self.bands, self.buckets = spark, bands, buckets
        self.path = path or f"{scratch_root(spark)}/weftmatch/history-{uuid.uuid4().hex}"
        self.empty = path is None
        self._used: np.ndarray | None = None
        if path is None:
            remove_at_exit(spark, self.path)

    def _band_rows(self, media: DataFrame, sieve=None) -> DataFrame:
        """(k, p, d, sig, mongo_id) of every band key of every hash or, with a ``sieve``, of all near keys in use."""
        n = self.bands

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            used = None if sieve is None else sieve.value
            bands = bands_of(n)
            step = max(1, (1 << 24) // (MINIMA * (bands[0].near.shape[1] if used is not None else 1)))
            for batch in batches:
                p = _uint(batch.column(0))
                for lo in range(0, len(p), step):
                    at, keys = [], []
                    for band in bands:
                        k = band.keys(p[lo : lo + step], used is not None)
                        if used is None:
                            row = np.repeat(np.arange(len(k)), k.shape[1])
                            k = k.ravel()
                        else:
                            a, b = _slots(k)
                            row, column = np.nonzero(_held(used, a))
                            both = _held(used, b[row, column])
                            row, column = row[both], column[both]
                            pair = np.unique(np.stack([row.astype(np.uint64), k[row, column]]), axis=1)
                            row, k = pair[0].astype(np.int64), pair[1]
                        at.append(row + lo)
                        keys.append(k)
                    some = batch.take(pa.array(np.concatenate(at)))
                    nothing = pa.nulls(some.num_rows, pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), some.column(0), some.column(1), nothing, some.column(2)], ["k", "p", "d", "sig", "mongo_id"])

        return media.filter("p is not null").select("p", "d", "mongo_id").mapInArrow(spread, STORED)

    def _rows(self, media: DataFrame, sieve=None) -> DataFrame:
        signed = media.filter("sig is not null").select(F.xxhash64("sig").alias("k"), "p", "d", "sig", "mongo_id")
        return self._band_rows(media, sieve).unionByName(signed).withColumn("bucket", _bucket(F.col("k"), self.buckets))

    def append(self, media: DataFrame) -> None:
        """Add a batch: its keys with hashes, signature and id, and its part of the sieve."""
        # Rebalancing splits a bucket that one hot key fills, and keeps small ones together.
        self._rows(media).hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/keys")
        # A block is built in one task from the places that fall into it, not once in every task.
        places = self._band_rows(media).select(F.explode(F.array(*[F.shiftrightunsigned("k", n).bitwiseAND(F.lit(SIEVE_BITS - 1)) + 1 for n in (4, 36)])).alias("at"))  # the functions count from 1
        blocks = places.withColumn("b", F.bitmap_bucket_number("at")).repartition("b").groupBy("b").agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("m"))
        part = f"{self.path}/sieve/part={uuid.uuid4().hex}"
        blocks.write.parquet(part)
        if self._used is not None or self.empty:
            self._used = self._marked(self._used, part)
        self.empty = False

    def accept(self, media: DataFrame, pairs: DataFrame) -> None:
        """Append those items of a batch that ``pairs``, the batch's own answer, finds no duplicate of."""
        self.append(media.join(pairs.select(F.col("mongo_id_b").alias("mongo_id")), "mongo_id", "left_anti"))

    def stored(self, buckets: list[int] | None = None) -> DataFrame:
        """The store's rows, of some of its partitions only where given."""
        out = self.spark.read.schema(f"{STORED}, bucket int").parquet(f"{self.path}/keys")
        return out if buckets is None else out.filter(F.col("bucket").isin(buckets))

    def _marked(self, used: np.ndarray | None, path: str) -> np.ndarray:
        """The sieve ``used`` with the blocks under ``path`` united into it: never more than ``SIEVE_BITS`` bits."""
        blocks = self.spark.read.schema("b bigint, m binary").parquet(path).repartition("b").groupBy("b").agg(F.bitmap_or_agg("m").alias("m"))
        used = np.zeros(SIEVE_BITS >> 3, np.uint8) if used is None else used.copy()
        for r in blocks.collect():
            at = (r["b"] - 1) * (BLOCK_BITS >> 3)
            piece = np.frombuffer(r["m"], np.uint8)
            used[at : at + len(piece)] |= piece
        return used

    def _sieve(self) -> np.ndarray:
        """Which band keys may be in use; read once, then kept up by ``append``."""
        if self._used is None:
            self._used = self._marked(None, f"{self.path}/sieve")
        return self._used

    def candidates(self, media: DataFrame) -> DataFrame:
        """The stored and new rows that share a key, from the store's partitions that the batch's keys fall into."""
        new = self._rows(media, self.spark.sparkContext.broadcast(self._sieve()))
        new = materialize(new.withColumnsRenamed({"p": "pb", "d": "db", "sig": "sb", "mongo_id": "mongo_id_b"}), "probes")
        buckets = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())
        old = self.stored(buckets).drop("bucket").withColumnsRenamed({"p": "pa", "d": "da", "sig": "sa", "mongo_id": "mongo_id_a"})
        return skew_pairs(new.drop("bucket"), old, "k", keys=heavy_keys(new, "k"))

    def probe(self, media: DataFrame) -> DataFrame:
        """``mongo_id_a`` (stored), ``mongo_id_b`` (new) of every stored item that shows the same media as a new one.
        An item that is stored already meets itself; an empty store answers nothing."""
        if self.empty:
            return self.spark.createDataFrame([], "mongo_id_a string, mongo_id_b string")
        alike = same_media(F.col("pa"), F.col("da"), F.col("pb"), F.col("db"))
        # The first set of positions that the two agree on; the signature's key counts where no set does.
        apart = F.col("pa").bitwiseXOR(F.col("pb"))
        first, missed, at = F.lit(False), F.lit(True), F.col("k").bitwiseAND(F.lit(15))
        for band in bands_of(self.bands):
            fits = F.bit_count(apart.bitwiseAND(F.lit(band.mask))) <= band.flips
            first = first | (missed & fits & (at == band.number))
            missed = missed & ~fits
        by_hash = F.col("sb").isNull() & F.col("sa").isNull() & alike & first
        by_sig = (F.col("sa") == F.col("sb")) & ~F.coalesce(alike, F.lit(False))
        found = self.candidates(media)
        return found.filter(by_hash | by_sig).select("mongo_id_a", "mongo_id_b")


def new_against_history(items: DataFrame, bands: int = BANDS) -> DataFrame:
    """``mongo_id_a``, ``mongo_id_b`` (smaller first): items of different batches that show the same media.

    ``items`` has one row per ``mongo_id`` with ``batch_no``, ``phash``, ``dhash``, ``video_signature``; other columns
    are ignored. Batches come in order: each probes the store of those before it and is appended. Null or malformed
    hashes give no key; items without batch match nothing; empty input gives an empty result."""
    spark = items.sparkSession
    media = materialize(media_signatures(items.filter("batch_no is not null")), "media", ["batch_no"])
    store = History(spark, bands=bands)
    out = [spark.createDataFrame([], "mongo_id_a string, mongo_id_b string")]
    for number in sorted(r["batch_no"] for r in media.select("batch_no").distinct().collect()):
        batch = media.filter(F.col("batch_no") == number)
        if not store.empty:
            out.append(materialize(store.probe(batch), "pairs"))
        store.append(batch)
    both = reduce(DataFrame.unionByName, out)
    return both.select(F.least("mongo_id_a", "mongo_id_b").alias("mongo_id_a"), F.greatest("mongo_id_a", "mongo_id_b").alias("mongo_id_b"))
