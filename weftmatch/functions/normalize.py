"""Column expressions that bring heterogeneous documents to one form. All are built-in expressions except NFKC, which runs
over the distinct values of Arrow batches."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRINGS = "array<string>"
SAMPLES = "array<struct<position:double,frame_index:int,phash:string,dhash:string>>"
# Spellings of media types, file endings of photos and videos, and the small capitals that compatibility folding leaves.
PHOTO_WORDS, VIDEO_WORDS = ("image", "pic", "picture"), ("animation", "gif")
PHOTO_ENDINGS, VIDEO_ENDINGS = (".jpg", ".jpeg", ".png", ".webp", ".gif"), (".mp4", ".mkv", ".mov", ".webm")
SMALL_CAPS, SMALL_CAPS_LATIN = "ᴀʙᴄᴅᴇꜰɢʜɪᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡʏᴢ", "abcdefghijklmnoprstuvwyz"
#: White space of all kinds, dropped from both ends of a value.
SPACES = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed value: the characters dropped from the front of a name.
NOISE = r"^[\s:：|┃•·\-–—_]+"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x: Column | str) -> Column:
    """Text without white space of any kind at its ends; blank gives null."""
    return F.nullif(F.btrim(col(x), F.lit(SPACES)), F.lit(""))


def first_present(*aliases: Column | str) -> Column:
    """The first alias that is neither null nor the empty text, cleaned afterwards. White space counts as present, so
    it hides later aliases and then cleans to null."""
    return clean(F.coalesce(*[F.nullif(col(a), F.lit("")) for a in aliases]))


def string_list(x: Column | str) -> Column:
    """Cleaned elements, nulls dropped, first occurrences in order; null gives an empty list."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(col(x), F.array().cast(STRINGS)), clean), lambda v: v.isNotNull()))


def with_main(items: Column | str, main: Column | str) -> Column:
    """A string list with ``main`` appended unless it is null or there already."""
    listed, one = string_list(items), clean(main)
    return F.when(one.isNull() | F.array_contains(listed, one), listed).otherwise(F.array_append(listed, one))


def frame_hashes(x: Column | str, text: Column | str | None = None) -> Column:
    """Cleaned frame hashes in order, repetitions kept; where the list is null, ``text`` split at commas."""
    source = col(x) if text is None else F.coalesce(col(x), F.split(col(text), ","))
    return F.filter(F.transform(F.coalesce(source, F.array().cast(STRINGS)), clean), lambda v: v.isNotNull())


def video_samples(x: Column | str) -> Column:
    """Samples with a position, a frame index and both hashes; the others are dropped."""
    kept = F.filter(F.coalesce(col(x), F.array().cast(SAMPLES)), lambda s: s["position"].isNotNull() & s["frame_index"].isNotNull() & clean(s["phash"]).isNotNull() & clean(s["dhash"]).isNotNull())
    return F.transform(kept, lambda s: F.struct(s["position"].alias("position"), s["frame_index"].alias("frame_index"), clean(s["phash"]).alias("phash"), clean(s["dhash"]).alias("dhash")))


def media_type(stated: Column | str, is_video: Column, is_photo: Column) -> Column:
    """``photo`` or ``video`` from the stated word or, where none is stated, from what the item has; other words pass."""
    word = F.lower(F.trim(col(stated)))
    return F.when(word.isin(*PHOTO_WORDS), "photo").when(word.isin(*VIDEO_WORDS), "video").when(word != "", word).when(is_video, "video").when(is_photo, "photo")


def int_or_null(x: Column | str) -> Column:
    """A whole number, null where the text isn't one."""
    return F.nullif(F.trim(col(x).cast("string")), F.lit("")).try_cast("bigint")


def nonzero_first(*xs: Column | str) -> Column:
    """The first value that is neither null nor 0, else 0. Text that is no number counts as null."""
    return F.coalesce(*[F.nullif(col(x).try_cast("bigint"), F.lit(0).cast("bigint")) for x in xs], F.lit(0).cast("bigint"))


@F.arrow_udf(T.StringType())
def _nfkc(x: pa.Array) -> pa.Array:
    coded = x.dictionary_encode()
    forms = [t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in coded.dictionary.to_pylist()]
    return pa.array(forms, pa.string()).take(coded.indices)


def nfkc(x: Column | str) -> Column:
    """Compatibility composition, of each distinct value of a batch once; texts of ASCII alone are their own form."""
    return _nfkc(col(x))


def strip_noise(x: Column | str) -> Column:
    """White space collapsed, leading bullets, bars, dashes and colons dropped; blank gives null."""
    return clean(F.regexp_replace(F.regexp_replace(col(x), "(?U)" + NOISE, ""), r"(?U)\s+", " "))


def normalize_name(x: Column | str) -> Column:
    """``strip_noise`` of the NFKC form."""
    return strip_noise(nfkc(col(x)))


def first_token(x: Column | str) -> Column:
    """The part before the first space of a name without noise."""
    return F.split(strip_noise(x), " ")[0]


def html_escape(x: Column | str) -> Column:
    return F.replace(F.replace(F.replace(col(x), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def stylised_fold(x: Column | str) -> Column:
    """NFKC and small capitals to ordinary letters."""
    return F.translate(nfkc(col(x)), SMALL_CAPS, SMALL_CAPS_LATIN)


def clean_title(x: Column | str) -> Column:
    """The folded title in lower case: letters a-z, Burmese letters, digits and single spaces; underscores and all other
    characters count as spaces. Null stays null."""
    return F.trim(F.regexp_replace(F.lower(stylised_fold(x)), r"[^0-9a-z\u1000-\u109f]+", " "))


def title_text(text: str) -> str:
    """``clean_title`` of one text on the driver, for options."""
    low = unicodedata.normalize("NFKC", text).translate(str.maketrans(SMALL_CAPS, SMALL_CAPS_LATIN)).lower()
    return " ".join("".join(c if c in "0123456789abcdefghijklmnopqrstuvwxyz" or "\u1000" <= c <= "\u109f" else " " for c in low).split())


def username(x: Column | str) -> Column:
    """Lower case with exactly one @ in front; blank gives null."""
    bare = F.regexp_replace(F.lower(F.trim(col(x))), "^@+", "")
    return F.when(bare != "", F.concat(F.lit("@"), bare))


def joined_text(*parts: Column | str) -> Column:
    """Non-blank parts on lines of their own."""
    return F.array_join(F.filter(F.array(*map(col, parts)), lambda v: F.trim(v) != ""), "\n")


def format_result(name: Column, card_id: Column, rarity: Column, command: Column, hidden: Sequence[str]) -> Column:
    """NAME / ID / RARITY lines; ID and RARITY only where known and not hidden for the command."""
    shown = ~F.coalesce(command.isin(*hidden), F.lit(False))
    return F.concat_ws("\n", F.concat(F.lit("NAME: "), name), F.when(shown, F.concat(F.lit("ID: "), card_id)), F.when(shown, F.concat(F.lit("RARITY: "), rarity)))


def hint_text(command: Column, name: Column) -> Column:
    """The command with the first token of the name."""
    return F.concat_ws(" ", command, first_token(name))


def document_media_type(mime: Column, file_name: Column) -> Column:
    """Media type of a document by MIME type, else by file ending; a GIF is a photo."""
    m, f = F.coalesce(F.lower(mime), F.lit("")), F.coalesce(F.lower(file_name), F.lit(""))

    def ends(endings: Sequence[str]) -> Column:
        return F.exists(F.array(*map(F.lit, endings)), lambda e: F.endswith(f, e))

    return F.when(m.startswith("image/") | ends(PHOTO_ENDINGS), "photo").when(m.startswith("video/") | ends(VIDEO_ENDINGS), "video")


def count_text(n: Column) -> Column:
    """A whole number with thousands marked; null is 0."""
    return F.format_number(F.coalesce(n.cast("bigint"), F.lit(0).cast("bigint")), 0)


def ms_text(ms: Column) -> Column:
    """Milliseconds without decimals, halves to the even neighbour; null is 'N/A'."""
    return F.coalesce(F.concat(F.bround(ms).cast("bigint").cast("string"), F.lit(" ms")), F.lit("N/A"))


def _units(seconds: Column, *units: tuple[str, int, int | None]) -> Column:
    """``seconds`` as so many of each (letter, seconds in one, how many make the next larger unit)."""
    parts = []
    for letter, size, limit in units:
        n = F.floor(seconds / size)
        parts.append(F.concat((n if limit is None else n % limit).cast("string"), F.lit(letter)))
    return F.concat_ws(" ", *parts)


def uptime_text(seconds: Column) -> Column:
    """The time since a start in its two or three largest units, seconds only below a day."""
    s = seconds.cast("bigint")
    day, hour, minute = ("d", 86_400, None), ("h", 3_600, 24), ("m", 60, 60)
    second = ("s", 1, 60)
    below_a_day = F.when(s >= 3_600, _units(s, hour, minute, second)).when(s >= 60, _units(s, minute, second)).otherwise(_units(s, second))
    return F.when(s >= 86_400, _units(s, day, hour, minute)).otherwise(below_a_day)


def age_text(seconds: Column) -> Column:
    """'N/A' below 0, else seconds, minutes and seconds, or hours and minutes."""
    s = seconds.cast("bigint")
    return F.when(s < 0, "N/A").when(s < 60, _units(s, ("s", 1, None))).when(s < 3_600, _units(s, ("m", 60, None), ("s", 1, 60))).otherwise(_units(s, ("h", 3_600, None), ("m", 60, 60)))
