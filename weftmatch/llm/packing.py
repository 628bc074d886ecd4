"""Problem 7: texts into containers of fixed capacity, by first-fit decreasing over a tournament tree.

Texts are measured once in tokens of a public tokenizer, and only (id, size) is written down and shuffled afterwards. Documents fall into
randomised groups of bounded expected size, packed independently for every capacity; the space lost to grouping is at
most part of one container per group. A text above the capacity is cut into full containers and one rest, which is
packed like any other text; no other text is cut.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .words import slices

#: The public byte-level vocabulary (50,256 ranks) and the pattern it is used with; both can be given by the caller.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern published with this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Expected documents in a group.
GROUP = 4096
#: Kinds of containers that one pass over the sizes packs.
KINDS_AT_ONCE = 100

PIECES = "container_kind string, container_id string, doc_id bigint, piece int, first_token bigint, n_tokens bigint"


@cache
def encoding(ranks: bytes, pattern: str = PATTERN):
    """The tokenizer of a rank file's content, once per process."""
    import tiktoken

    known = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=known, special_tokens={})


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id``, ``n_tokens``: the number of tokens of every whole text; null and empty texts have none.

    The rank file is read on the driver and sent to the executors, which need no copy of it."""
    with open(tokenizer, "rb") as f:
        ranks = documents.sparkSession.sparkContext.broadcast(f.read())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value)
        for batch in batches:
            for piece in slices(batch, 1):
                sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])

    return documents.select("doc_id", "text").filter("doc_id is not null").mapInArrow(measure, "doc_id bigint, n_tokens bigint")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each of ``sizes`` (all from 1 to ``capacity``), which must be in decreasing order.

    A tournament tree holds the free space of all bins, the winner of each match being the roomier bin; walking down
    to the left-most child with room finds the first bin that fits in logarithmic time."""
    n = len(sizes)
    leaves = 1 << max(0, int(n - 1).bit_length()) if n else 1
    tree = [capacity] * (2 * leaves)
    out = np.empty(n, np.int64)
    for k, size in enumerate(sizes.tolist()):
        at = 1
        while at < leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        out[k] = at - leaves
        tree[at] -= size
        at >>= 1
        while at:
            a, b = tree[2 * at], tree[2 * at + 1]
            top = a if a > b else b
            if tree[at] == top:
                break
            tree[at] = top
            at >>= 1
    return out


def pack_group(docs: np.ndarray, sizes: np.ndarray, capacity: int) -> pd.DataFrame:
    """The pieces of one group's texts and their bins: columns bin, doc_id, piece, first_token, n_tokens."""
    full, rest = sizes // capacity, sizes % capacity
    whole = np.repeat(np.arange(len(docs)), full)
    nth = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
    tail = np.flatnonzero(rest > 0)
    tail = tail[np.lexsort((docs[tail], -rest[tail]))]
    bins = first_fit_decreasing(rest[tail], capacity)
    return pd.DataFrame(
        {
            "bin": np.concatenate([bins, (bins.max() + 1 if len(bins) else 0) + np.arange(len(whole))]),
            "doc_id": np.concatenate([docs[tail], docs[whole]]),
            "piece": np.concatenate([full[tail], nth]).astype(np.int32),
            "first_token": np.concatenate([full[tail] * capacity, nth * capacity]),
            "n_tokens": np.concatenate([rest[tail], np.full(len(whole), capacity)]),
        }
    )


def pack(sizes: DataFrame, specs: DataFrame, group: int = GROUP, seed: int = 7) -> DataFrame:
    """One row per piece of every text with tokens, for every kind of container.

    ``sizes`` has ``doc_id``, ``n_tokens``; ``specs`` has ``container_kind``, ``capacity_tokens``. Texts without tokens
    need no container; kinds without a positive capacity take nothing; of a repeated kind the smallest capacity holds.
    Repeated ``doc_id`` rows are separate texts and spread over the groups too. Ties in size go to the smaller id. Empty input gives no rows."""
    chosen = specs.filter("container_kind is not null and capacity_tokens > 0").groupBy("container_kind").agg(F.min("capacity_tokens").alias("c")).orderBy("container_kind")
    some = materialize(sizes.select("doc_id", "n_tokens").filter("n_tokens > 0"), "sizes")
    groups = max(1, -(-some.count() // group))
    keyed = some.withColumn("g", F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.monotonically_increasing_id()), F.lit(groups)))
    out = some.sparkSession.createDataFrame([], PIECES)
    for kinds in itertools.batched(((r["container_kind"], int(r["c"])) for r in chosen.toLocalIterator()), KINDS_AT_ONCE):
        out = out.unionByName(keyed.groupBy("g").applyInPandas(_packer(kinds), PIECES))
    return out


def _packer(kinds: Sequence[tuple[str, int]]):
    """Packs one group for all of ``kinds``, each a name and a capacity."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        docs, n = pdf["doc_id"].to_numpy(np.int64), pdf["n_tokens"].to_numpy(np.int64)
        out = []
        for kind, capacity in kinds:
            part = pack_group(docs, n, capacity)
            part.insert(0, "container_kind", kind)
            part["container_id"] = kind + "-" + str(key[0]) + "-" + part["bin"].astype(str)
            out.append(part)
        return pd.concat(out)[["container_kind", "container_id", "doc_id", "piece", "first_token", "n_tokens"]]

    return one
