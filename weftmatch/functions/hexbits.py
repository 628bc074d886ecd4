"""Scalar functions over hex bit strings: guarded parsing, Hamming distance, chunks.

All are built-in column expressions. Anything that is not a plain run of hex digits (after trimming) is unusable and
gives null, including forms such as ``0x12`` or ``1_2`` that other languages parse.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: SHA-256 of zero bytes: a digest that proves nothing. Fixed value.
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def bits64(text: Column) -> Column:
    """The 64 bits of a 16-digit hex text as a signed long; null for anything else."""
    t = F.trim(text)
    ok = t.rlike("^[0-9a-fA-F]{16}$")
    return F.when(ok, F.conv(F.when(ok, t), 16, -10).cast("bigint"))


def usable_hash(text: Column) -> Column:
    """``bits64`` of a hash that says something: null also where all bits are equal."""
    bits = bits64(text)
    return F.when((bits != 0) & (bits != -1), bits)


def hamming64(a: Column, b: Column) -> Column:
    """Number of differing bits of two longs."""
    return F.bit_count(a.bitwiseXOR(b))


#: Digits of the longest hash, and digits in one word of it.
MOST_DIGITS, WORD_DIGITS = 64, 8


def hash_words(text: Column) -> Column:
    """A hex text of up to ``MOST_DIGITS`` digits as a struct (n, w): its number of bits, and its bits in words of 32,
    padded with zeros on the left. Null if it is null, blank, longer or not hex. Compute it once per row, before a join."""
    t = F.lower(F.trim(text))
    ok = t.rlike(f"^[0-9a-f]{{1,{MOST_DIGITS}}}$")
    padded = F.lpad(F.when(ok, t), MOST_DIGITS, "0")
    words = F.transform(F.sequence(F.lit(0), F.lit(MOST_DIGITS // WORD_DIGITS - 1)), lambda i: F.conv(F.substr(padded, i * WORD_DIGITS + 1, F.lit(WORD_DIGITS)), 16, 10).cast("bigint"))
    return F.when(ok, F.struct((4 * F.length(t)).alias("n"), words.alias("w")))


def hamming_words(a: Column, b: Column) -> Column:
    """Differing bits of two ``hash_words``."""
    bits = F.zip_with(a["w"], b["w"], lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(bits, F.lit(0), lambda acc, x: acc + x)


def normalized_words(a: Column, b: Column) -> Column:
    """``hamming_words`` over the bits of the longer hash."""
    return hamming_words(a, b) / F.greatest(a["n"], b["n"])


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two hex texts, the shorter padded with zeros on the left; null if either is unusable."""
    return hamming_words(hash_words(a), hash_words(b))


def normalized_hamming(a: Column, b: Column) -> Column:
    """``hamming_hex`` over the bits of the longer text."""
    return normalized_words(hash_words(a), hash_words(b))


def chunk_widths(n_bits: int, n: int) -> list[int]:
    """Widths of ``n`` chunks of ``n_bits`` bits; the first ones are a bit longer where it doesn't divide."""
    base, extra = divmod(n_bits, n)
    return [base + (i < extra) for i in range(n)]


def chunks64(bits: Column, n: int) -> Column:
    """Array of structs (position, value) of a 64-bit hash cut into ``n`` chunks, most significant first."""
    out, left = [], 64
    for i, w in enumerate(chunk_widths(64, n)):
        left -= w
        out.append(F.struct(F.lit(i).alias("position"), F.shiftrightunsigned(bits, left).bitwiseAND(F.lit((1 << w) - 1)).alias("chunk")))
    return F.array(*out)
