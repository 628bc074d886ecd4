"""Fingerprints of decoded images and sampled videos, vectorised over Arrow batches with numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sampling points of a video, as shares of its length. Fixed values.
POINTS = (0.05, 0.15, 0.30, 0.50, 0.70, 0.85, 0.95)


def frame_index(count: Column, share: Column) -> Column:
    """The frame at a share of the length, within the video."""
    return F.greatest(F.lit(0), F.least(count - 1, F.floor(count * share))).cast("int")


def video_signature(samples: Column) -> Column:
    """SHA-256 over position:phash:dhash of all samples; null where there is none."""
    parts = F.transform(samples, lambda s: F.concat_ws(":", F.round(s["position"], 4).cast("string"), s["phash"], s["dhash"]))
    return F.when(F.size(samples) > 0, F.sha2(F.array_join(parts, "|"), 256))


def resize_gray(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Area-mean resize of a gray image by a summed-area table."""
    table = np.pad(image.astype(np.float64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    ys, xs = np.linspace(0, image.shape[0], h + 1), np.linspace(0, image.shape[1], w + 1)

    def at(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        y0, x0 = np.minimum(y.astype(int), image.shape[0] - 1), np.minimum(x.astype(int), image.shape[1] - 1)
        fy, fx = (y - y0)[:, None], (x - x0)[None, :]
        a, b, c, d = table[np.ix_(y0, x0)], table[np.ix_(y0, x0 + 1)], table[np.ix_(y0 + 1, x0)], table[np.ix_(y0 + 1, x0 + 1)]
        return a * (1 - fy) * (1 - fx) + b * (1 - fy) * fx + c * fy * (1 - fx) + d * fy * fx

    s = at(ys, xs)
    area = np.diff(ys)[:, None] * np.diff(xs)[None, :]
    return (s[1:, 1:] - s[:-1, 1:] - s[1:, :-1] + s[:-1, :-1]) / area


def _hex(bits: np.ndarray) -> str:
    return np.packbits(bits.ravel().astype(np.uint8)).tobytes().hex()


def _dct(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))


def perceptual_hash(gray: np.ndarray, side: int = 8) -> str:
    """Signs of the low frequencies against their median: side x side bits."""
    small = resize_gray(gray, side * 4, side * 4)
    d = _dct(side * 4)
    low = (d @ small @ d.T)[:side, :side]
    return _hex(low > np.median(low))


def difference_hash(gray: np.ndarray, side: int = 8) -> str:
    """Whether brightness rises to the right, on a grid: side x side bits."""
    small = resize_gray(gray, side, side + 1)
    return _hex(small[:, 1:] > small[:, :-1])


def average_hash(gray: np.ndarray, side: int = 8) -> str:
    """Low-pass band of the Haar transform (block means) against its median."""
    small = resize_gray(gray, side, side)
    return _hex(small > np.median(small))


HASHES = "path string, width int, height int, pixel_sha256 string, phash string, phash_large string, dhash string, whash string"


def hash_images(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``sha256`` of every file under ``path``, with its fingerprints where it decodes as an image; other files
    keep nothing but their digest."""
    same = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    files = spark.read.format("binaryFile").load(path).select(same("path").alias("path"), F.sha2("content", 256).alias("sha256"))
    images = spark.read.format("image").option("dropInvalid", True).load(path).select(same("image.origin").alias("origin"), "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(8)]
            for origin, h, w, c, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                pixels = np.frombuffer(data, np.uint8).reshape(h, w, c)
                rgb = pixels[:, :, 2::-1] if c >= 3 else np.repeat(pixels[:, :, :1], 3, 2)
                gray = rgb @ np.array([0.299, 0.587, 0.114])
                digest = hashlib.sha256(w.to_bytes(4, "big") + h.to_bytes(4, "big") + np.ascontiguousarray(rgb).tobytes()).hexdigest()
                for column, value in zip(rows, (origin, w, h, digest, perceptual_hash(gray), perceptual_hash(gray, 16), difference_hash(gray), average_hash(gray)), strict=True):
                    column.append(value)
            kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], [p.split()[0] for p in HASHES.split(", ")])

    return files.join(images.mapInArrow(run, HASHES), "path", "left")
