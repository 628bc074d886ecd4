"""Problem 5: one consistent form for text that looks the same but is stored with other characters.

Arrow text is copied to one numpy array of code points; everything after that is lookup-table gathers, expansion by
offsets and vector composition of marks over the whole batch. No Python call is made per row.

Plain form of a text
  * width, styled, joined, enclosed and small-capital variants become the ordinary characters;
  * marks stored apart are composed with their letter where Unicode has the composed letter;
  * invisible characters and controls vanish (joiners and selectors inside emoji stay);
  * every space becomes U+0020 (their number is kept);
  * letters of another alphabet inside a word of Latin letters become Latin: the letter they look like or, where none is
    known, the one their Unicode name begins with. Words wholly in another alphabet, composed accents and emoji are left
    alone, and so are ideographs and syllables of East Asian scripts, which stand beside Latin words as they are.

Null stays null and the empty text stays empty; the plain form is a fixed point of the operator.
"""

from __future__ import annotations

import unicodedata as u
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other alphabets and the Latin letters they look like, position by position.
CYRILLIC_LOOKS = "АВЕКМНОРСТУХЅІЈҮҺԚԜԌаеорсухѕіјүһԁԛԝғкмтпӏ"
CYRILLIC_LATIN = "ABEKMHOPCTYXSIJYHQWGaeopcyxsijyhdqwfkmtnl"
GREEK_LOOKS = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαεικνορτυχγηω"
GREEK_LATIN = "ABEZHIKMNOPTYXaeikvoptuxynw"
ARMENIAN_LOOKS = "ՕՍօսոհցզյ"
ARMENIAN_LATIN = "OUounhgqj"
CHEROKEE_LOOKS = "ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᏀᏃᏔᏙᏚᏞᏟᏢᏦᏴ"
CHEROKEE_LATIN = "DRTiAJEWMHGZWVSLCPKB"
# Scripts whose letters look like the letter that their names begin with, and scripts of ideographs and
# syllables, which are no alphabets beside Latin.
NAMED_LOOKS = ("COPTIC", "LISU")
NO_ALPHABET = ("LATIN", "CJK", "HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "HANGUL", "BOPOMOFO", "YI", "MODIFIER", "HALFWIDTH", "FULLWIDTH")
# Signs that Unicode decomposes though they are emoji or signs of their own.
KEPT = "™ℹ‼⁉㊗㊙…"

LATIN, OTHER, MARK, EMOJI = 1, 2, 3, 4
TOP = 0x110000
#: Ranges with characters that have names, decompositions or marks; beyond them lie ideographs and private use.
NAMED = (range(0x80, 0x3400), range(0xA000, 0xAC00), range(0xF900, 0x20000), range(0x2F800, 0x2FA20), range(0xE0000, 0xE0200))


class Flat(NamedTuple):
    """Texts of a batch end to end: code points, and where each text begins (one more entry than texts)."""

    codes: np.ndarray
    offsets: np.ndarray


class Tables(NamedTuple):
    length: np.ndarray
    start: np.ndarray
    pool: np.ndarray
    kind: np.ndarray
    ccc: np.ndarray
    gone: np.ndarray
    looks: np.ndarray
    seen: np.ndarray
    touch: np.ndarray
    pairs: np.ndarray
    composed: np.ndarray


def _ordinary(code: int, name: str) -> str | None:
    """The ordinary characters of a variant that Unicode's own decompositions don't cover."""
    for head in ("LATIN LETTER SMALL CAPITAL ", "NEGATIVE CIRCLED LATIN CAPITAL LETTER ", "NEGATIVE SQUARED LATIN CAPITAL LETTER "):
        if name.startswith(head) and len(name) == len(head) + 1:
            return name[-1].lower() if "SMALL" in head else name[-1]
    return None


def _foreign(name: str, category: str) -> str | None:
    """The Latin letter for a letter of another alphabet: the first of its own name, in its case; None for what is none."""
    script, _, rest = name.partition(" ")
    if category not in ("Lu", "Ll", "Lt", "Lo") or script in NO_ALPHABET or "LETTER " not in rest:
        return None
    first = rest.partition("LETTER ")[2][:1]
    return None if not "A" <= first <= "Z" else first.lower() if category == "Ll" else first


@cache
def tables() -> Tables:
    """The lookup tables, derived from the character database once per process."""
    length, start = np.ones(TOP, np.uint8), np.arange(TOP, dtype=np.int64)
    kind, ccc = np.zeros(TOP, np.uint8), np.zeros(TOP, np.uint8)
    gone, touch, looks = np.zeros(TOP, bool), np.zeros(TOP, bool), np.zeros(TOP, np.uint32)
    seen = np.zeros(TOP, bool)
    pool: list[int] = []
    pairs: dict[int, int] = {}
    for block in NAMED:
        for code in block:
            ch = chr(code)
            name = u.name(ch, "")
            cat, dec = u.category(ch), u.decomposition(ch)
            if not name and cat == "Cn":
                continue
            ccc[code] = u.combining(ch)
            if cat[0] == "M":
                kind[code] = MARK
            elif cat[0] == "L":
                latin = _foreign(name, cat)
                kind[code] = LATIN if name.startswith("LATIN ") else OTHER if latin else 0
                looks[code], seen[code] = ord(latin or "\0"), bool(latin) and name.startswith(NAMED_LOOKS)
            elif cat in ("So", "Sk"):
                kind[code] = EMOJI
            out = _ordinary(code, name)
            if out is None and dec and ch not in KEPT and not 0x1F200 <= code < 0x1F260:
                out = u.normalize("NFKD", ch)
                if out[0] == " " and len(out) > 1:
                    out = None
            if cat[0] == "Z":
                out = " "
            if out is not None and out != ch:
                length[code], start[code] = len(out), TOP + len(pool)
                pool += map(ord, out)
                touch[code] = u.normalize("NFC", out) != ch
                if dec and dec[0] != "<" and u.normalize("NFC", ch) == ch and " " in dec:
                    a, b = (int(x, 16) for x in dec.split())
                    pairs[a << 21 | b] = code
            gone[code] = cat == "Cc" or cat == "Cf" and not name.startswith(("ARABIC", "SYRIAC", "KAITHI", "EGYPTIAN"))
    for a, b in ((0x34F, 0x350), (0x115F, 0x1161), (0x17B4, 0x17B6), (0x180B, 0x1810), (0x3164, 0x3165), (0xFFA0, 0xFFA1), (0xFE00, 0xFE10), (0xE0100, 0xE01F0), (0, 0x20), (0x7F, 0x80)):
        gone[a:b] = True
        length[a:b], start[a:b] = 1, np.arange(a, b)
    for code in (9, 10, 11, 12, 13, 0x85):
        gone[code], length[code], start[code] = False, 1, 32
    for code in (*range(0x41, 0x5B), *range(0x61, 0x7B)):
        kind[code] = LATIN
    for other, latin in ((CYRILLIC_LOOKS, CYRILLIC_LATIN), (GREEK_LOOKS, GREEK_LATIN), (ARMENIAN_LOOKS, ARMENIAN_LATIN), (CHEROKEE_LOOKS, CHEROKEE_LATIN)):
        looks[[ord(x) for x in other]], seen[[ord(x) for x in other]] = [ord(x) for x in latin], True
    jamo = np.zeros(TOP, bool)
    jamo[0x1100:0x1200] = True
    touch |= gone | (kind == MARK) | (kind == OTHER) | jamo
    touch[[9, 10, 11, 12, 13, 0x85]] = True
    keys = np.array(sorted(pairs), np.uint64)
    return Tables(length, start, np.concatenate([np.arange(TOP, dtype=np.uint32), np.array(pool, np.uint32)]), kind, ccc, gone, looks, seen, touch, keys, np.array([pairs[int(k)] for k in keys], np.uint32))


def to_flat(texts: pa.Array) -> Flat:
    """A batch's code points; a null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(codes) != len(raw):
        at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[at]
    return Flat(codes, at)


def from_flat(flat: Flat) -> pa.Array:
    """The texts of ``flat`` as an Arrow array."""
    c = flat.codes
    data = c.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    wide = 1 + (c >= 0x80).astype(np.int8) + (c >= 0x800) + (c >= 0x10000)
    at = np.concatenate([[0], np.cumsum(wide, dtype=np.int64)])[flat.offsets]
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data))


def _lookup(t: Tables, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The composed character of each pair, or 0."""
    key = first.astype(np.uint64) << np.uint64(21) | second.astype(np.uint64)
    at = np.minimum(np.searchsorted(t.pairs, key), len(t.pairs) - 1)
    return np.where(t.pairs[at] == key, t.composed[at], 0).astype(np.uint32)


def _compose(t: Tables, codes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks in canonical order and composed with the character before them."""
    ccc = t.ccc[codes]
    if ccc.any():
        head = ccc == 0
        head[1:] |= row[1:] != row[:-1]
        head[:1] = True
        group = np.cumsum(head) - 1
        if ((ccc[1:] < ccc[:-1]) & (ccc[1:] > 0)).any():
            order = np.lexsort((np.arange(len(codes)), ccc, group))
            codes, ccc = codes[order], ccc[order]
        at = np.flatnonzero(head)
        base, last = codes[at].copy(), np.zeros(len(at), np.uint8)
        keep = head.copy()
        marks = np.flatnonzero(~head)
        rank = marks - at[group[marks]]
        marks = marks[np.argsort(rank, kind="stable")]
        for some in np.split(marks, np.flatnonzero(np.diff(np.sort(rank))) + 1) if len(marks) else []:
            g = group[some]
            made = _lookup(t, base[g], codes[some])
            fits = (made > 0) & (last[g] < ccc[some])
            base[g[fits]] = made[fits]
            keep[some[~fits]] = True
            last[g[~fits]] = ccc[some[~fits]]
        codes = codes.copy()
        codes[at] = base
        codes, row = codes[keep], row[keep]
    for _ in range(2):  # letters that compose with a following letter, Hangul syllables among them
        if len(codes) < 2:
            break
        a, b = codes[:-1], codes[1:]
        made = _lookup(t, a, b)
        lv = (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)
        lvt = (a >= 0xAC00) & (a < 0xD7A4) & ((a - 0xAC00) % 28 == 0) & (b > 0x11A7) & (b < 0x11C3)
        made = np.where(lv, 0xAC00 + ((a.astype(np.int64) - 0x1100) * 21 + b.astype(np.int64) - 0x1161) * 28, np.where(lvt, a.astype(np.int64) + b - 0x11A7, made))
        hit = (made > 0) & (row[:-1] == row[1:]) & (t.ccc[b] == 0)
        hit[1:] &= ~hit[:-1]
        if not hit.any():
            break
        codes = codes.copy()
        codes[:-1][hit] = made[hit]
        stay = np.concatenate([[True], ~hit])
        codes, row = codes[stay], row[stay]
    return codes, row


def _latinise(t: Tables, codes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Foreign letters to Latin in words that are Latin: some Latin letter, and either every other letter looks Latin or
    most letters are Latin."""
    kind = t.kind[codes]
    foreign = kind == OTHER
    if not foreign.any():
        return codes
    inside = (kind >= LATIN) & (kind <= MARK)
    first = np.ones(len(codes), bool)
    first[1:] = ~(inside[1:] & inside[:-1] & (row[1:] == row[:-1]))
    word = np.cumsum(first) - 1
    n = word[-1] + 1
    latin = np.bincount(word[kind == LATIN], minlength=n)
    strange = np.bincount(word[foreign & ~t.seen[codes]], minlength=n)
    other = np.bincount(word[foreign], minlength=n)
    fold = foreign & ((latin > 0) & ((strange == 0) | (latin > other)))[word]
    return np.where(fold, t.looks[codes], codes)


def plain_flat(flat: Flat, lines: bool = False) -> Flat:
    """The plain form of every text of a batch. Only texts that hold a character in question are worked on. With
    ``lines``, for running text, tabs and line breaks of all texts stay as they are."""
    t = tables()
    codes, offsets = flat
    n = len(offsets) - 1
    touched = t.touch[codes]
    if lines:
        touched &= (codes > 13) | (codes < 9)
    if not touched.any():
        return flat
    rows = np.repeat(np.arange(n), np.diff(offsets))
    dirty = np.bincount(rows[touched], minlength=n) > 0
    chosen = dirty[rows]
    c, r = codes[chosen], rows[chosen]
    while True:  # a folded letter can make a further composition possible; the form is reached when nothing changes
        before = c, r
        size = t.length[c].astype(np.int64)
        begin = np.cumsum(size) - size
        breaks = np.repeat(np.where((c >= 9) & (c <= 13), c, 0), size) if lines else 0
        c = t.pool[np.repeat(t.start[c] - begin, size) + np.arange(size.sum())]
        c = np.where(breaks > 0, breaks, c).astype(np.uint32) if lines else c
        r = np.repeat(r, size)
        vanish = t.gone[c]
        if vanish.any():
            glue = (c == 0x200D) | (c == 0xFE0F) | (c == 0xFE0E)
            solid = np.maximum.accumulate(np.where(glue, -1, np.arange(len(c))))
            after = (solid >= 0) & (t.kind[c[solid]] == EMOJI) & (r[solid] == r)
            nxt = np.concatenate([c[1:], [0]])
            vanish &= ~(glue & after & ((c != 0x200D) | (t.kind[nxt] == EMOJI)))
            c, r = c[~vanish], r[~vanish]
        c, r = _compose(t, c, r)
        c = _latinise(t, c, r)
        if len(c) == len(before[0]) and (c == before[0]).all():
            break
    if dirty.all():
        counts = np.bincount(r, minlength=n)
        return Flat(c, np.concatenate([[0], np.cumsum(counts)]))
    counts = np.where(dirty, np.bincount(r, minlength=n), np.diff(offsets))
    at = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(at[-1], np.uint32)
    where = np.repeat(dirty, counts)
    out[where], out[~where] = c, codes[~chosen]
    return Flat(out, at)


def plain_array(texts: pa.Array) -> pa.Array:
    """The plain form of an Arrow array of texts; nulls stay."""
    out = from_flat(plain_flat(to_flat(texts))).cast(pa.string())
    return pc.if_else(pc.is_null(texts), pa.scalar(None, pa.string()), out) if texts.null_count else out


@F.arrow_udf(T.StringType())
def _plain_udf(texts: pa.Array) -> pa.Array:
    return plain_array(texts)


def plain_text(column: Column | str) -> Column:
    """The plain form of a text column, in Arrow batches."""
    return _plain_udf(F.col(column) if isinstance(column, str) else column)


def not_plain_fields(items: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key``, ``field_name``: the fields whose text is not in plain form, once each. Null fields are plain; repeated
    rows give one row. Works map-side; only the rows found are shuffled, to drop repetitions."""
    long = items.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("__text")) for f in fields])).alias("x"))
    long = long.select(key, "x.field_name", "x.__text").filter(F.col("__text").rlike(r"[^\x20-\x7e]"))
    return long.withColumn("__plain", plain_text("__text")).filter(F.col("__plain") != F.col("__text")).select(key, "field_name").distinct()


def plain_fields(items: DataFrame, fields: list[str]) -> DataFrame:
    """``items`` with a column ``<field>_plain`` for each of ``fields``; an existing column of that name is replaced."""
    for f in fields:
        items = items.withColumn(f"{f}_plain", plain_text(f))
    return items
