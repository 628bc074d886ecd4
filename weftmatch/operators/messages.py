"""Messages as probes: who sent them, from where, with which media and text, and which source they are attributed to.

Messages are nested columns; every part may be missing from the schema, and a missing part counts as null. All rules are
coalesced expressions and joins with dimension tables, so a batch of messages is attributed in one pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from .attribution import Blocked, command_in, custom_rule, first_rule, small, title_match


def at(df: DataFrame, path: str, kind: str = "string") -> Column:
    """The nested column ``path``, or a typed null where the schema lacks it."""
    node = df.schema
    for part in path.split("."):
        if not hasattr(node, "fieldNames") or part not in node.fieldNames():
            return F.lit(None).cast(kind)
        node = node[part].dataType
    return F.col(path)


def _full_name(df: DataFrame, who: str) -> Column:
    parts = F.concat_ws(" ", N.clean(at(df, f"{who}.first_name")), N.clean(at(df, f"{who}.last_name")))
    return F.coalesce(N.clean(at(df, f"{who}.full_name")), F.nullif(parts, F.lit("")))


def _if_bot(df: DataFrame, field: str, kind: str = "string") -> Column:
    return F.when(at(df, "from_user.is_bot", "boolean"), at(df, f"from_user.{field}", kind))


# The places of a message that name where it comes from, in order.
CHATS = ("forward_origin.chat", "forward_origin.sender_chat", "forward_from_chat", "sender_chat")
USERS = ("forward_origin.sender_user", "via_bot", "forward_from")


def origin_columns(df: DataFrame) -> dict[str, Column]:
    """Origin of a message: chat and message id, user id, account name and title, each from the first place that has it."""
    first = lambda paths, field, kind: [at(df, f"{p}.{field}", kind) for p in paths]
    return {
        "origin_chat_id": F.coalesce(*first(CHATS, "id", "bigint")),
        "origin_message_id": F.coalesce(at(df, "forward_origin.message_id", "bigint"), at(df, "forward_from_message_id", "bigint")),
        "source_user_id": F.coalesce(*first(USERS, "id", "bigint"), _if_bot(df, "id", "bigint")),
        "source_username": F.coalesce(*[N.username(c) for c in first(CHATS, "username", "string") + first(USERS, "username", "string")], N.username(_if_bot(df, "username"))),
        "source_title": F.coalesce(*[N.clean(c) for c in first(CHATS, "title", "string")], _full_name(df, "forward_origin.sender_user"), N.clean(at(df, "forward_origin.sender_user_name"))),
    }


def message_text(df: DataFrame) -> Column:
    """Caption and text of the message, of what it quotes and of what it replies to, blank ones left out, folded."""
    return N.stylised_fold(N.joined_text(*[at(df, f"{where}{field}") for where in ("", "external_reply.", "reply_to_message.") for field in ("caption", "text", "html_text", "md_text")]))


def is_blocked(df: DataFrame, listed: Blocked, where: str = "") -> Column:
    """Whether a message comes from a blocked source: its origin chat, any user it names as its sender, or a hidden name."""
    chat = [f"{where}{p}" for p in CHATS]
    users = [f"{where}{p}" for p in (USERS[0], "from_user", "forward_from", "via_bot")]
    first = lambda field, kind="string": F.coalesce(*[at(df, f"{p}.{field}", kind) for p in chat])
    return listed.holds(
        [first("id", "bigint"), *[at(df, f"{u}.id", "bigint") for u in users]],
        [first("username"), *[at(df, f"{u}.username") for u in users]],
        [first("title"), *[_full_name(df, u) for u in users], at(df, f"{where}forward_origin.sender_user_name")],
    )


def media_columns(df: DataFrame, where: str = "") -> dict[str, Column]:
    """Media type and file id of a message: its largest photo, its video, its animation (a video), or a document."""
    photos = at(df, f"{where}photo", "array<struct<file_id:string,file_unique_id:string>>")
    photo = F.try_element_at(photos, F.lit(-1))["file_unique_id"]
    video = F.coalesce(at(df, f"{where}video.file_unique_id"), at(df, f"{where}animation.file_unique_id"))
    paper = F.when(N.document_media_type(at(df, f"{where}document.mime_type"), at(df, f"{where}document.file_name")).isNotNull(), at(df, f"{where}document.file_unique_id"))
    kind = F.when(photo.isNotNull(), "photo").when(video.isNotNull(), "video").when(paper.isNotNull(), N.document_media_type(at(df, f"{where}document.mime_type"), at(df, f"{where}document.file_name")))
    return {"media_type": kind, "file_unique_id": F.coalesce(photo, video, paper)}


def attribute(messages: DataFrame, accounts: DataFrame, titles: DataFrame, rules: Sequence[tuple[str, str]] = (), custom: Sequence[tuple[str, str]] = (), commands: Mapping[str, Sequence[str]] | None = None, listed: Blocked = Blocked()) -> DataFrame:
    """``messages`` with origin columns, ``message_text``, ``text_command``, ``is_blocked`` and ``source_collection``.

    A blocked message has no source. Else it is that of the account name, else of the user id, else of the chat id, else
    of the title, else of the first text rule, else of the custom rule's command, if that has one collection only.
    ``accounts`` has (kind, key, collection) with kind ``username``, ``user`` or ``chat``; ``titles`` has (title,
    collection, ord); ``commands`` has the collections of every known command. Keys listed twice count as their smallest
    collection."""
    known = dict(commands or {})
    out = messages.withColumns({**origin_columns(messages), "message_text": message_text(messages), "is_blocked": is_blocked(messages, listed)})
    held = accounts.groupBy("kind", "key").agg(F.min("collection").alias("collection"))
    for kind, column in (("username", "source_username"), ("user", "source_user_id"), ("chat", "origin_chat_id")):
        side = held.filter(F.col("kind") == kind).select(F.col("key").alias("__key"), F.col("collection").alias(f"__{kind}"))
        out = out.join(small(side), F.col(column).cast("string") == F.col("__key"), "left").drop("__key")
    out = title_match(out, titles, "source_title")
    only = F.lit(None).cast("string")
    by_custom = custom_rule(custom, F.concat_ws("\n", "source_title", "message_text"), F.col("source_username"))
    for command, collections in known.items():
        if len(collections) == 1:
            only = F.when(by_custom == command, collections[0]).otherwise(only)
    found = F.coalesce("__username", "__user", "__chat", "title_collection", first_rule(rules, F.col("message_text")), only)
    out = out.withColumn("source_collection", F.when(~F.col("is_blocked"), found)).withColumn("custom_command", by_custom)
    return out.withColumn("text_command", command_in(F.col("message_text"), sorted(known))).drop("__username", "__user", "__chat", "title_collection")


def output_command(by_account: Column, by_title: Column, by_rule: Column, in_text: Column, default: Column, allowed: Column) -> Column:
    """The command that a result is shown with: of the account, else of the title, else of the rule or the text where
    the item's collection allows it (``allowed`` lists the commands), else the collection's own."""
    fits = lambda c: F.when(F.coalesce(F.array_contains(allowed, c), F.lit(False)), c)
    return F.coalesce(by_account, by_title, fits(by_rule), fits(in_text), default)


def with_final_command(found: DataFrame, probes: DataFrame, commands: DataFrame, defaults: DataFrame) -> DataFrame:
    """Results of a lookup with the ``command`` that each is shown with.

    ``probes`` may have ``account_command``, ``title_command``, ``rule_command`` and ``text_command``; ``commands`` has
    (command, collection), ``defaults`` (collection, default_command). A command from a rule or from the text counts only
    if it is one of the result's collection. Results without a collection have no command."""
    hints = [c for c in ("account_command", "title_command", "rule_command", "text_command") if c in probes.columns]
    allowed = commands.groupBy("collection").agg(F.collect_set("command").alias("__allowed"))
    rows = found.join(probes.select("probe_id", *hints).dropDuplicates(["probe_id"]), "probe_id", "left").join(small(allowed), "collection", "left").join(small(defaults.select("collection", "default_command")), "collection", "left")
    get = lambda c: F.col(c) if c in hints else F.lit(None).cast("string")
    shown = output_command(get("account_command"), get("title_command"), get("rule_command"), get("text_command"), F.col("default_command"), F.col("__allowed"))
    return rows.withColumn("command", F.when(F.col("collection").isNotNull(), shown)).select(*found.columns, "command")


def privileged(user: Column, owners: Sequence[int], helpers: Sequence[int] = ()) -> Column:
    """Whether a user is an owner or one of the owners' helpers."""
    return F.coalesce(user.isin(*owners, *helpers), F.lit(False)) if [*owners, *helpers] else F.lit(False)


def recent(events: DataFrame, at_column: str, start: Column) -> DataFrame:
    """Events not older than ``start``; those without a time drop out."""
    return events.filter(F.col(at_column) >= start)


def with_setting(rows: DataFrame, settings: DataFrame, key: Column) -> DataFrame:
    """``rows`` with ``is_enabled``: a setting without a value counts as enabled, a missing setting as disabled."""
    one = settings.groupBy("key").agg(F.bool_and(F.coalesce("enabled", F.lit(True))).alias("__on"))
    return rows.withColumn("__key", key).join(one.withColumnRenamed("key", "__key"), "__key", "left").withColumn("is_enabled", F.coalesce("__on", F.lit(False))).drop("__key", "__on")


def gate(enabled: Column, is_private: Column, private_allowed: Column, always: Column, approved_only: Column, approved: Column) -> Column:
    """Whether a message may start a lookup by itself."""
    return enabled & F.when(is_private, private_allowed).when(always, True).when(approved_only, approved).otherwise(True)


def all_joined(users: DataFrame, members: DataFrame, channels: DataFrame, free: DataFrame) -> DataFrame:
    """Users who are in every channel, or who are free of that rule. Without channels everyone is."""
    need = channels.select("channel_id").distinct()
    n = need.count()
    have = members.join(small(need), "channel_id", "left_semi").select("user_id", "channel_id").distinct().groupBy("user_id").agg(F.count(F.lit(1)).alias("__n"))
    ok = have.filter(F.col("__n") == n).select("user_id").unionByName(free.select("user_id")).distinct()
    return users if n == 0 else users.join(ok, "user_id", "left_semi")


def groups_in_settings(settings: DataFrame, prefix: str) -> DataFrame:
    """Distinct group ids named by enabled settings with keys ``prefix:<id>``; other keys are skipped."""
    pattern = f"^{prefix}:(-?[0-9]+)$"
    hit = settings.filter(F.col("key").rlike(pattern) & F.coalesce("enabled", F.lit(False)))
    return hit.select(F.regexp_extract("key", pattern, 1).cast("bigint").alias("group_id")).distinct()
