"""Which source a probe comes from, by ordered rules given as tables and patterns.

Rules are data: small dimension tables (username, user id, chat id, title), ordered patterns over the text, and custom
rules of words that must all occur. ``limit_dims`` checks that such a table is small before it is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..session import BROADCAST_ROWS, small

# Words that announce a command, and the signs that may stand between.
ANNOUNCING, SIGNS = ("using", "use", "hint", "full", "cmd", "command"), ":：-="


def first_rule(rules: Sequence[tuple[str, str]], text: Column) -> Column:
    """The result of the first (pattern, result) whose pattern is found, case and line breaks ignored."""
    out = F.lit(None).cast("string")
    for pattern, result in reversed(rules):
        out = F.when(F.coalesce(text.rlike("(?is)" + pattern), F.lit(False)), result).otherwise(out)
    return out


def custom_rule(rules: Sequence[tuple[str, str]], text: Column, account: Column | None = None) -> Column:
    """The result of the rule for the account name, else of the first (words joined by |, result) whose words all occur in
    the lower-case text. A rule that begins with @ is for the account of that name only."""
    out = F.lit(None).cast("string")
    low = F.lower(text)
    for words, result in reversed(rules):
        parts = [w.strip().lower() for w in words.split("|") if w.strip()]
        if parts and not words.strip().startswith("@"):
            every = F.lit(True)
            for w in parts:
                every = every & low.contains(w)
            out = F.when(F.coalesce(every, F.lit(False)), result).otherwise(out)
    for words, result in rules if account is not None else ():
        if words.strip().startswith("@"):
            out = F.when(account == words.strip().lower(), result).otherwise(out)
    return out


def command_in(text: Column, known: Sequence[str]) -> Column:
    """The command of ``known`` (lower case, with slash) that a text names, null if none.

    The text is folded first. Its first token counts if it is known, up to an @. Otherwise the first command that an
    announcing word stands before counts or, without any, the first that begins the text or follows white space; if that
    one is unknown, the text names none."""
    folded = F.btrim(N.stylised_fold(text), F.lit(N.SPACES))
    listed = F.array(*map(F.lit, known)) if known else F.array().cast("array<string>")
    # What follows each slash, and what stands before it: the text is cut at the slashes and each part paired with the
    # next. A space in front stands for the beginning of the text.
    parts = F.split(F.concat(F.lit(" "), folded), "/")
    n = F.greatest(F.size(parts) - 1, F.lit(0))

    def place(before: Column, after: Column) -> Column:
        name = F.regexp_extract(after, "^[A-Za-z0-9_]*", 0)
        rest = F.substr(after, F.length(name) + 1)
        bare = F.rtrim(before, F.lit(N.SPACES))
        bare = F.when(F.right(bare, F.lit(1)).isin(*SIGNS), F.rtrim(F.left(bare, F.length(bare) - 1), F.lit(N.SPACES))).otherwise(bare)
        told = F.exists(F.array(*map(F.lit, ANNOUNCING)), lambda w: F.endswith(F.lower(bare), w))
        apart = (F.rtrim(before, F.lit(N.SPACES)) != before)
        mention = F.regexp_extract(rest, "^@[A-Za-z0-9_]+", 0)
        ended = ~F.startswith(rest, F.lit("@")) | ((mention != "") & ~F.startswith(F.substr(rest, F.length(mention) + 1), F.lit("@")))
        return F.struct(F.concat(F.lit("/"), F.lower(name)).alias("name"), (told & (name != "")).alias("told"), (apart & ended & (name != "")).alias("free"))

    places = F.zip_with(F.slice(parts, 1, n), F.slice(parts, 2, n), place)
    of = lambda flag: F.try_element_at(F.filter(places, lambda x: x[flag]), F.lit(1))["name"]
    token = F.split(F.lower(F.split(folded, r"(?U)\s")[0]), "@")[0]
    found = F.coalesce(of("told"), of("free"))
    return F.when(F.array_contains(listed, token), token).when(F.array_contains(listed, found), found)


def manual_command(text: Column, commands: Sequence[str], bot: str) -> Column:
    """The command that a message gives to this bot: its first token, if that is one of ``commands`` alone or with the
    bot's own name behind an @; else null. A message with white space in front gives none."""
    token = F.lower(F.split(text, r"(?U)\s")[0])
    name, mention = F.substring_index(token, "@", 1), F.when(token.contains("@"), F.substr(token, F.instr(token, "@") + 1))
    return F.when(name.isin(*[c.lower() for c in commands]) & (mention.isNull() | (mention == bot.lower().lstrip("@"))), name)


def known_commands(commands: DataFrame, column: str = "command") -> list[str]:
    """The distinct commands of a dimension table, whose size is checked."""
    rows = commands.select(F.lower(column).alias("c")).filter("c is not null").distinct().limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        raise ValueError("the table of commands is too large to be a dimension")
    return sorted(r["c"] for r in rows)


def command_scopes(commands: DataFrame) -> DataFrame:
    """(command, scope): the collections of each command in order. ``commands`` has command, collection, ord."""
    return commands.groupBy("command").agg(F.array_sort(F.collect_set(F.struct("ord", "collection"))).alias("c")).select("command", F.col("c.collection").alias("scope"))


def title_match(probes: DataFrame, titles: DataFrame, title: str) -> DataFrame:
    """``probes`` with ``title_collection``: of the exact title, else of the first (by ord) that contains the probe's
    title or is contained in it. ``titles`` (title, collection, ord) is a dimension table whose size is checked; each
    distinct title is compared once, however many probes have it."""
    key = N.clean_title(title)
    asked = probes.select(key.alias("__t")).filter("__t <> ''").distinct()
    dims = titles.select(N.clean_title("title").alias("__d"), "collection", "ord")
    rows = dims.limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        raise ValueError("the title table is too large to be a dimension")
    table = F.array(*[F.struct(F.lit(r["ord"]).alias("ord"), F.lit(r["__d"]).alias("d"), F.lit(r["collection"]).alias("c")) for r in sorted(rows, key=lambda r: (r["ord"], r["__d"]))])
    hits = F.filter(table, lambda x: F.contains(F.col("__t"), x["d"]) | F.contains(x["d"], F.col("__t")))
    same = F.filter(table, lambda x: x["d"] == F.col("__t"))
    found = asked.select("__t", F.coalesce(F.try_element_at(same, F.lit(1)), F.try_element_at(hits, F.lit(1)))["c"].alias("title_collection"))
    return probes.withColumn("__t", key).join(found, "__t", "left").drop("__t")


@dataclass(frozen=True)
class Blocked:
    """Sources that are turned away: ids of chats and users, account names, titles or full names. These are options that
    an operator sets, not data."""

    ids: frozenset[int] = frozenset()
    usernames: frozenset[str] = frozenset()
    titles: frozenset[str] = frozenset()

    def holds(self, ids: Sequence[Column], usernames: Sequence[Column], titles: Sequence[Column]) -> Column:
        """Whether any id, account name or (cleaned) title is among them; nulls are not."""
        names = sorted({"@" + u.strip().lower().lstrip("@") for u in self.usernames if u.strip("@ ")})
        out = F.lit(False)
        for column in ids if self.ids else ():
            out = out | F.coalesce(column.isin(*sorted(self.ids)), F.lit(False))
        for column in usernames if names else ():
            out = out | F.coalesce(N.username(column).isin(*names), F.lit(False))
        wanted = sorted({t for t in map(N.title_text, self.titles) if t})
        for column in titles if wanted else ():
            out = out | F.coalesce(N.clean_title(column).isin(*wanted), F.lit(False))
        return out


def blocked(probes: DataFrame, ids: DataFrame, column: str = "user_id") -> DataFrame:
    """``probes`` without those whose ``column`` is among ``ids``, a table of any size."""
    return probes.join(small(ids.select(column).distinct()), column, "left_anti")


def lookup_scope(is_blocked: Column, source: Column, command: Column, command_scope: Column) -> Column:
    """Struct (mode, collections): blocked, the one source, the command's collections, or everything (null)."""
    none = F.lit(None).cast("array<string>")
    make = lambda mode, c: F.struct(F.lit(mode).alias("mode"), c.alias("collections"))
    return F.when(is_blocked, make("blocked", F.array().cast("array<string>"))).when(source.isNotNull(), make("source", F.array(source))).when(command.isNotNull() & (F.size(command_scope) > 0), make("command", command_scope)).otherwise(make("all", none))
