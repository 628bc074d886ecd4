"""DuckDB statements of the queries in ``lookups``, written apart from them."""

from __future__ import annotations

_I = """with i as (select mongo_id, min(batch_no) as batch_no, max(updated_at) as updated_at, lower(trim(any_value(collection))) as collection, any_value(name) as name, any_value(name_aliases) as name_aliases,
 any_value(card_id) as card_id, any_value(rarity) as rarity, any_value(command) as command, any_value(media_type) as media_type, any_value(file_unique_id) as file_unique_id, any_value(file_unique_ids) as file_unique_ids,
 any_value(sha256) as sha256, any_value(sha256_aliases) as sha256_aliases, any_value(pixel_sha256) as pixel_sha256, any_value(video_signature) as video_signature, any_value(origin_chat_id) as origin_chat_id,
 any_value(origin_message_id) as origin_message_id, any_value(phash) as phash, any_value(dhash) as dhash, any_value(whash) as whash, any_value(phash_large) as phash_large, any_value(colorhash) as colorhash,
 any_value(video_samples) as video_samples, any_value(frame_hashes) as frame_hashes, any_value(duration_ms) as duration_ms from item_snapshots where mongo_id is not null group by mongo_id)"""

_PROBE = "('0x' || right({x}, 8))::ubigint % 50 = 0"


def _clean(c: str) -> str:
    return f"nullif(trim({c}), '')"


_KEYS = f""", k as (select distinct kind, value, collection, mongo_id, batch_no from (
 select 'origin' as kind, cast(origin_chat_id as varchar) || ':' || cast(origin_message_id as varchar) as value, collection, mongo_id, batch_no from i
 union all select 'uid', trim(unnest(list_concat(coalesce(file_unique_ids, []), [file_unique_id]))), collection, mongo_id, batch_no from i
 union all select 'sha', lower(trim(unnest(list_concat(coalesce(sha256_aliases, []), [sha256])))), collection, mongo_id, batch_no from i
 union all select 'pixel_sha', lower({_clean("pixel_sha256")}), collection, mongo_id, batch_no from i
 union all select 'video_signature', lower({_clean("video_signature")}), collection, mongo_id, batch_no from i) where value is not null and value <> ''),
pk as (select distinct mongo_id as probe_id, collection as scope, kind, value from (
 select mongo_id, collection, 'origin' as kind, cast(origin_chat_id as varchar) || ':' || cast(origin_message_id as varchar) as value from i where batch_no > 0
 union all select mongo_id, collection, 'uid', {_clean("file_unique_id")} from i where batch_no > 0
 union all select mongo_id, collection, 'sha', lower({_clean("sha256")}) from i where batch_no > 0
 union all select mongo_id, collection, 'pixel_sha', lower({_clean("pixel_sha256")}) from i where batch_no > 0
 union all select mongo_id, collection, 'video_signature', lower({_clean("video_signature")}) from i where batch_no > 0) where value is not null),
t as (select * from (values ('origin', 1), ('uid', 2), ('sha', 3), ('pixel_sha', 4), ('video_signature', 5)) v(kind, tier))"""

_INSIDE = """, s as (select kind, value, collection, max(mongo_id) as mongo_id from k where batch_no = 0 group by all),
h1 as (select probe_id, tier, 0 as outside, s.collection, s.mongo_id, kind as reason from pk join s using (kind, value) join t using (kind) where s.collection = pk.scope)"""

_OUTSIDE = """, g as (select kind, value, arg_min(k.collection, (coalesce(ord, 1073741824), k.collection, mongo_id)) as collection, arg_min(mongo_id, (coalesce(ord, 1073741824), k.collection, mongo_id)) as mongo_id
 from k left join collection_dim d on d.collection = k.collection where batch_no = 0 group by all),
h2 as (select * from h1 union all select probe_id, tier, 1 as outside, g.collection, g.mongo_id, kind || '_global' from pk join g using (kind, value) join t using (kind))"""


def _best(h: str) -> str:
    return f"select probe_id, arg_min(collection, (tier, outside, mongo_id)) as collection, arg_min(mongo_id, (tier, outside, mongo_id)) as mongo_id, arg_min(reason, (tier, outside, mongo_id)) as reason from {h} group by probe_id"


_HEX64 = "case when regexp_full_match(trim({c}), '[0-9a-fA-F]{{16}}') then ('0x' || lower(trim({c})))::ubigint end"


def _search(field: str, t: int) -> str:
    bits = _HEX64.format(c=field)
    return f"{_I}, b as (select mongo_id, collection, {bits} as b from i) select p.mongo_id as probe_id, b.collection, b.mongo_id, bit_count(xor(p.b, b.b)) as distance from b p join b on bit_count(xor(p.b, b.b)) <= {t} where {_PROBE.format(x='p.mongo_id')}"


def _hamming(a: str, b: str) -> str:
    """Differing bits of two hex texts of up to 64 digits, in words of 8 digits."""
    words = " + ".join(f"bit_count(xor(('0x' || substr(lpad(lower({a}), 64, '0'), {i * 8 + 1}, 8))::ubigint, ('0x' || substr(lpad(lower({b}), 64, '0'), {i * 8 + 1}, 8))::ubigint))::integer" for i in range(8))
    return f"case when regexp_full_match({a}, '[0-9a-fA-F]{{1,64}}') and regexp_full_match({b}, '[0-9a-fA-F]{{1,64}}') then {words} end"


_WEIGHTS = (("phash", 0.35), ("dhash", 0.25), ("whash", 0.15), ("phash_large", 0.15), ("colorhash", 0.10))


def _photo(strict: bool, only: str = "true", own: bool = False) -> str:
    hashes = ", ".join(f"{_clean(h)} as {h}" for h, _ in _WEIGHTS)
    dist = ", ".join(f"{_hamming('p.' + h, 'q.' + h)} as d_{h}, 4.0 * greatest(length(p.{h}), length(q.{h})) as n_{h}" for h, _ in _WEIGHTS)
    up = " + ".join(f"coalesce({w} * (1 - d_{h} / n_{h}), 0.0)" for h, w in _WEIGHTS)
    down = " + ".join(f"case when d_{h} is not null then {w} else 0.0 end" for h, w in _WEIGHTS)
    t = "case when collection = 'items_stray_album' then 16 else 8 end"
    least = 0.88 if strict else 0.80
    alone = f"d_phash <= {t} and 1 - d_phash / 64.0 >= {0.88 if strict else 0.0}"
    return f"""{_I}, h as (select mongo_id, collection, {hashes} from i), p as (select * from h where {_PROBE.format(x="mongo_id")}), q as (select * from h where {only}),
r as (select p.mongo_id as probe_id, q.mongo_id, q.collection, q.dhash, {dist} from p join q on {"true" if own else "p.mongo_id <> q.mongo_id"}),
s as (select *, cast(case when dhash is null then 1 - d_phash / 64.0 when ({down}) > 0 then ({up}) / ({down}) end as double) as score from r),
a as (select * from s where score > 0 and case when dhash is null then {alone} else (coalesce(d_phash <= {t}, false) or coalesce(d_dhash <= 12, false)) and score >= {least} end),
o as (select a.*, coalesce(ord, 1073741824) as ord from a left join collection_dim using (collection))
select probe_id, arg_min(collection, (-round(score, 9), ord, mongo_id)) as collection, arg_min(mongo_id, (-round(score, 9), ord, mongo_id)) as mongo_id, round(arg_min(score, (-round(score, 9), ord, mongo_id)), 6) as score from o group by probe_id"""


def _video(strict: bool, wide: bool = False, own: bool = False) -> str:
    cut = 2 if strict else 0
    bits = "('0x' || {c})::ubigint"
    other = "true" if own else "p.mongo_id <> q.mongo_id"
    limits = "l <= 64 and a <= 64" if wide else f"l <= (case when i.collection = 'items_stray_album' then 14 else 10 end) - {cut} and a <= (case when i.collection = 'items_stray_album' then 16 else 12 end) - {cut}"
    return f"""{_I}, u as (select mongo_id, collection, case when duration_ms > 0 then cast(round_even(duration_ms / 1000.0, 0) as integer) end as b, coalesce(video_samples, []) as s,
  list_filter(list_transform(coalesce(frame_hashes, []), lambda x: nullif(trim(x), '')), lambda x: x is not null) as f, {_MEDIA} as m from i),
v as (select * from u where len(s) > 0 or len(f) > 0), w as (select * from u where m = 'video' or len(s) > 0 or len(f) > 0), a as (select p.* from v p where {_PROBE.format(x="p.mongo_id")}),
n as (select distinct p.mongo_id from a p join w q on q.b between greatest(0, p.b - 4) and p.b + 4 and {other}),
r as (select p.mongo_id as probe_id, q.mongo_id, q.collection, p.s as ps, q.s as qs, p.f as pf, q.f as qf from a p join v q on {other} and (q.b between greatest(0, p.b - 4) and p.b + 4 or p.mongo_id not in (select mongo_id from n))),
x as (select probe_id, mongo_id, unnest(ps) as a, qs from r where len(ps) > 0 and len(qs) > 0),
y as (select probe_id, mongo_id, a, unnest(qs) as b from x),
d as (select probe_id, mongo_id, unnest([bit_count(xor({bits.format(c="a.phash")}, {bits.format(c="b.phash")})), bit_count(xor({bits.format(c="a.dhash")}, {bits.format(c="b.dhash")}))]) as d from y where round(a.position, 3) = round(b.position, 3)
 union all select probe_id, mongo_id, bit_count(xor(case when regexp_full_match(pf[n], '[0-9a-fA-F]{{16}}') then ('0x' || pf[n])::ubigint end, case when regexp_full_match(qf[n], '[0-9a-fA-F]{{16}}') then ('0x' || qf[n])::ubigint end))
 from (select *, unnest(range(1, least(len(pf), len(qf)) + 1)) as n from r where (len(ps) = 0 or len(qs) = 0))),
m as (select probe_id, mongo_id, avg(d) as a, min(d) as l from d where d is not null group by 1, 2),
s as (select m.*, i.collection, coalesce(ord, 1073741824) as ord, greatest(0.0, 1 - a / 64) as score from m join i using (mongo_id) left join collection_dim c on c.collection = i.collection
 where {limits} and 1 - a / 64 > 0)
select probe_id, arg_min(collection, (-round(score, 9), ord, mongo_id)) as collection, arg_min(mongo_id, (-round(score, 9), ord, mongo_id)) as mongo_id, round(arg_min(score, (-round(score, 9), ord, mongo_id)), 6) as score from s group by probe_id"""


def _chunk_index() -> str:
    parts = []
    for field in ("phash", "dhash"):
        for n in (9, 13, 17):
            base, extra = divmod(64, n)
            left = 64
            for p in range(n):
                w = base + (p < extra)
                left -= w
                parts.append(f"select '{field}' as field, {n} as chunk_count, {p} as position, (b_{field} >> {left}) & {(1 << w) - 1} as v from b where b_{field} is not null")
    return f"{_I}, b as (select {_HEX64.format(c='phash')} as b_phash, {_HEX64.format(c='dhash')} as b_dhash from i), c as ({' union all '.join(parts)}) select field, chunk_count, position, count(*) as n_rows, count(distinct v) as n_values, cast(sum(v) as bigint) as total from c group by all"


_MEDIA = "case when lower(trim(media_type)) in ('image', 'pic', 'picture') then 'photo' when lower(trim(media_type)) in ('animation', 'gif') then 'video' when lower(trim(media_type)) <> '' then lower(trim(media_type)) when len(list_filter(coalesce(frame_hashes, []), lambda x: trim(x) <> '')) > 0 or len(coalesce(video_samples, [])) > 0 then 'video' when trim(phash) <> '' then 'photo' end"
_SHA = "sha256({x})"
_TITLE = "trim(regexp_replace(regexp_replace(lower({x}), '[^0-9a-z\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_ESC = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _commands(columns: str = "doc_id") -> str:
    """CTE c (columns, command): the text is cut at slashes, and a part that begins with a name is judged by what stands before it."""
    return f"""a as (select {columns}, split_part(lower(regexp_extract(trim(text), '^\\S+')), '@', 1) as t, string_split(' ' || trim(text), '/') as p from documents),
b as (select *, list_filter(range(2, len(p) + 1), lambda i: regexp_matches(p[i], '^\\w') and list_has_any(['using', 'use', 'hint', 'full', 'cmd', 'command'], [right(rtrim(regexp_replace(rtrim(lower(p[i - 1]), ' ' || chr(9) || chr(10) || chr(13)), '[:：=-]$', ''), ' ' || chr(9) || chr(10) || chr(13)), n) for n in [3, 4, 5, 7]])) as told,
 list_filter(range(2, len(p) + 1), lambda i: regexp_matches(p[i], '^\\w+(@\\w+)?([^\\w@]|$)') and regexp_matches(p[i - 1], '\\s$')) as free from a),
c as (select * exclude (t, p, told, free), case when t in (select default_command from collection_dim) then t when '/' || lower(regexp_extract(p[coalesce(told[1], free[1])], '^\\w+')) in (select default_command from collection_dim) then '/' || lower(regexp_extract(p[coalesce(told[1], free[1])], '^\\w+')) end as command from b)"""


_ORDERED = "list_filter(list_transform(coalesce({x}, []), lambda v: nullif(trim(v), '')), lambda v: v is not null)"


def _distinct_list(x: str) -> str:
    o = _ORDERED.format(x=x)
    return f"list_reduce(list_transform({o}, lambda v: [v]), lambda a, v: case when list_contains(a, v[1]) then a else list_concat(a, v) end, cast([] as varchar[]))"


_CONTENT = "case when regexp_matches(text, 'took\\s+\\d+\\s+ms', 'is') then 'log' when regexp_matches(text, '\\bID\\b\\s*\\d+', 'is') then 'card' when regexp_matches(text, 'please\\s+read', 'is') then 'notice' when regexp_matches(text, 'build\\s+\\d', 'is') then 'release' end"
_CUSTOM = "case when contains(lower({x}), 'seen:') and contains(lower({x}), 'wanted:') then 'trade' when contains(lower({x}), '#') and contains(lower({x}), 'chat') then 'heading_chat' when contains(lower({x}), '/') then 'command' end"
_RULES = f"coalesce({_CONTENT}, {_CUSTOM.format(x='text')}, 'none')"
_EMA = "list_reduce(list(ms order by ts, id), lambda a, x: case when a = 0 then x else 0.15 * x + 0.85 * a end)"
_EVENTS = "(select distinct id, ts, chat_id, ms from lookup_events where ms is not null and ts is not null)"

SQL = {
    "exact_sha_lookup": "select doc_id, min(doc_id) over (partition by text) as first_doc_id, count(*) over (partition by text) as n_copies from documents",
    "exact_cascade_ranked": f"{_I}{_KEYS}{_INSIDE}{_OUTSIDE} select *, cast(1.0 as double) as confidence from ({_best('h2')})",
    "exact_scoped_only": f"{_I}{_KEYS}{_INSIDE} {_best('h1')}",
    "unresolved_probes": f"{_I}{_KEYS}{_INSIDE}{_OUTSIDE} select mongo_id as probe_id, collection from i where batch_no > 0 and mongo_id not in (select probe_id from h2)",
    "writers_by_key": f"{_I}{_KEYS}, g as (select kind, value, arg_min(k.collection, (coalesce(ord, 1073741824), k.collection, mongo_id)) as first_collection, arg_min(mongo_id, (coalesce(ord, 1073741824), k.collection, mongo_id)) as first_id from k left join collection_dim d on d.collection = k.collection group by all) select kind, value, k.collection, max(mongo_id) as last_id, first_collection, first_id from k join g using (kind, value) group by all",
    "items_that_were_hit": f"{_I} select collection, mongo_id from i where (collection, mongo_id) in (select (collection, mongo_id) from lookup_events where hit)",
    "hamming_search_phash": _search("phash", 8),
    "hamming_search_dhash": _search("dhash", 12),
    "mih_candidate_counts": f"with r as (select distinct position, chunk_value, mongo_id from hash_chunks where field = 'phash' and chunk_count = 9) select p.mongo_id as probe_id, count(distinct r.mongo_id) as n_candidates from r p join r using (position, chunk_value) where {_PROBE.format(x='p.mongo_id')} group by 1",
    "hash_chunk_index": _chunk_index(),
    "hash_distances": f"{_I}, d as (select mongo_id, {_hamming('trim(phash)', 'trim(dhash)')} as distance, 4.0 * greatest(length(trim(phash)), length(trim(dhash))) as n from i) select mongo_id, cast(distance as integer) as distance, cast(round(distance / n, 6) as double) as share from d where distance is not null",
    "photo_weighted_top1": _photo(False),
    "photo_strict_top1": _photo(True),
    "photo_single_hash_top1": _photo(False, "dhash is null", True),
    "video_multiframe_top1": _video(False, own=True),
    "video_strict_top1": _video(True, own=True),
    "video_nearest": _video(False, True),
    "duration_buckets": f"{_I} select cast(round_even(duration_ms / 1000.0, 0) as integer) as bucket, count(*) as n_items from i group by 1",
    "duration_band_counts": f"{_I}, v as (select mongo_id, cast(round_even(duration_ms / 1000.0, 0) as integer) as b from i where duration_ms > 0) select p.mongo_id as probe_id, count(*) as n_near from v p join v q on q.b between p.b - 4 and p.b + 4 where {_PROBE.format(x='p.mongo_id')} group by 1",
    "candidate_cap": f"{_I}, v as (select i.mongo_id, cast(round_even(duration_ms / 1000.0, 0) as integer) as b, ord from i left join collection_dim using (collection) where duration_ms > 0), n as (select p.mongo_id as probe_id, q.mongo_id, cast(row_number() over (partition by p.mongo_id order by q.ord nulls last, q.mongo_id) as integer) as rank from v p join v q on q.b between p.b - 1 and p.b + 1 where {_PROBE.format(x='p.mongo_id')}) select * from n where rank <= 5",
    "first_present_alias": f"{_I} select mongo_id, {_clean('''coalesce(nullif(card_id, ''), nullif(rarity, ''), nullif(command, ''))''')} as label from i",
    "string_lists": f"{_I} select mongo_id, coalesce(array_to_string({_distinct_list('name_aliases')}, '|'), '') as aliases, coalesce(array_to_string({_distinct_list('list_concat(coalesce(file_unique_ids, []), [file_unique_id])')}, '|'), '') as uids from i",
    "media_type_canonical": f"{_I} select collection, {_MEDIA} as media_type, count(*) as n_items from i group by 1, 2",
    "name_cleanup": "select c_custkey, c_name || ' x' as name, split_part(c_name || ' x', ' ', 1) as first_token from customer",
    "text_scalars": f"select doc_id, {_SHA.format(x=_ESC)} as escaped_sha, '@' || regexp_replace(lower(trim(source)), '^@+', '') as account, {_TITLE.format(x='source')} as title, sha256(concat_ws(chr(10), nullif(trim(kind), ''), text, case when trim(lang) <> '' then lang end)) as joined_sha from documents",
    "content_rule_counts": f"select {_RULES} as rule, source, count(*) as n_docs from documents group by 1, 2",
    "commands_in_texts": f"with {_commands()} select doc_id, command, collection from c left join collection_dim on default_command = command where command is not null",
    "lookup_scopes": f"""with p as (select distinct a.default_command as command, b.collection, b.ord from collection_dim a join collection_dim b using (trust_rank)), s as (select command, string_agg(collection, '|' order by ord, collection) as scope from p group by 1),
{_commands("doc_id, source, nullif(trim(collection), '') as collection")}
select doc_id, case when source = 'relay_main' then 'blocked' when collection is not null then 'source' when scope is not null then 'command' else 'all' end as mode, case when source = 'relay_main' then '' when collection is not null then collection else scope end as collections from c left join s using (command)""",
    "title_sources": f"{_I} select mongo_id, arg_min(d.collection, ord) as title_collection from i left join collection_dim d on contains('the ' || {_TITLE.format(x='''replace(replace(i.collection, 'items_', ''), '_', ' ')''')} || ' bot', {_TITLE.format(x='''replace(replace(d.collection, 'items_', ''), '_', ' ')''')}) group by 1",
    "message_attribution": f"""with m as (select doc_id, text, '@' || regexp_replace(lower(trim(source)), '^@+', '') as source_username, {_TITLE.format(x="concat_ws(' ', kind, collection)")} as title, concat_ws(chr(10), nullif(trim(concat_ws(' ', kind, collection)), ''), text) as said from documents),
d as (select *, {_TITLE.format(x="replace(replace(collection, 'items_', ''), '_', ' ')")} as t, '@feed_' || lpad(cast(ord as varchar), 2, '0') as account from collection_dim),
h as (select doc_id, arg_min(d.collection, ord) as by_title from m join d on contains(m.title, d.t) or contains(d.t, m.title) group by 1),
k as (select doc_id, case when source_username = '@feed_19' then '/ember' when contains(lower(said), 'seen:') and contains(lower(said), 'wanted:') then '/moon' when contains(lower(said), '#') and contains(lower(said), 'chat') then '/paper' when contains(lower(said), '/') then '/lookup' end as by_custom from m),
{_commands()}
select m.doc_id, source_username, case when not coalesce(source_username = '@relay_main' or title = 'bio items paper heroes', false) then coalesce(a.collection, by_title, {_CONTENT}, o.collection) end as source_collection, command as text_command, coalesce(source_username = '@relay_main' or title = 'bio items paper heroes', false) as is_blocked
from m left join d a on a.account = source_username left join h using (doc_id) join k using (doc_id) left join collection_dim o on o.default_command = by_custom join c using (doc_id)""",
    "final_commands": "with e as (select distinct id as probe_id, collection, chat_id from lookup_events where hit) select probe_id, e.collection, case when e.collection is not null then coalesce(case when chat_id % 7 = 0 then '/chat' end, case when chat_id % 2 = 0 and (ord <= 8 or default_command = '/amber') then '/amber' end, default_command) end as command from e left join collection_dim d on d.collection = e.collection",
    "manual_commands": "select doc_id, case when doc_id % 5 = 0 then '/moon' when doc_id % 5 = 1 then '/amber' end as command from documents",
    "folded_titles": "select c_custkey, case when c_custkey % 5 = 2 then 'မြန်မာ lantern' else 'lantern hunt' end as title, case when c_custkey % 5 = 2 then 'items_amber_catcher' else 'items_lantern_hunt' end as title_collection from customer",
    "media_of_documents": "select p_partkey, case when p_size % 5 = 0 or p_partkey % 8 in (0, 1, 2) then 'photo' when p_size % 7 = 0 or p_partkey % 8 in (5, 6) then 'video' end as media_type from part",
    "status_texts": "with o as (select o_orderkey, o_totalprice, o_orderkey * 61 as u, o_orderkey * 7 - 10 as g from orders) select o_orderkey, format('{:,}', o_orderkey * 997) as count, cast(cast(round_even(o_totalprice, 0) as bigint) as varchar) || ' ms' as ms, case when u >= 86400 then format('{}d {}h {}m', u // 86400, u // 3600 % 24, u // 60 % 60) when u >= 3600 then format('{}h {}m {}s', u // 3600, u // 60 % 60, u % 60) when u >= 60 then format('{}m {}s', u // 60, u % 60) else format('{}s', u) end as uptime, case when g < 0 then 'N/A' when g < 60 then format('{}s', g) when g < 3600 then format('{}m {}s', g // 60, g % 60) else format('{}h {}m', g // 3600, g // 60 % 60) end as age from o",
    "cached_results": "with e as (select distinct id, ts, chat_id, hit, mongo_id from lookup_events where ts is not null) select r.id, epoch_us(r.ts) as ts_us, arg_max(w.mongo_id, (w.ts, w.mongo_id)) as value from e r left join e w on w.chat_id = r.chat_id and w.hit and w.mongo_id is not null and w.ts < r.ts and epoch_us(w.ts) + 3600000001 > epoch_us(r.ts) group by r.id, r.ts, r.chat_id, r.hit, r.mongo_id",
    "parsed_marks": "select lower(trim(collection)) as collection, epoch_us(max(try_cast(trim(updated_at) as timestamptz))) as mark_us, count(try_cast(trim(updated_at) as timestamptz)) as n_read from fingerprint_items group by 1",
    "blocked_filter": "select distinct id, chat_id from lookup_events where chat_id not in (select chat_id from lookup_events where reason = 'blocked_source')",
    "formatted_results": f"{_I} select mongo_id, concat_ws(chr(10), 'NAME: ' || {_clean('name')}, case when not coalesce({_clean('command')} in ('/amber', '/copper'), false) then 'ID: ' || {_clean('card_id')} end, case when not coalesce({_clean('command')} in ('/amber', '/copper'), false) then 'RARITY: ' || {_clean('rarity')} end) as text, concat_ws(' ', {_clean('command')}, {_clean('name')}) as \"full\" from i",
    "build_counts": "select lower(trim(collection)) as collection, count(*) as n_items from item_snapshots group by 1",
    "media_type_counts": "select count(*) as total, count(*) filter (lower(trim(media_type)) = 'photo') as photos, count(*) filter (lower(trim(media_type)) = 'video') as videos from fingerprint_items",
    "filtered_count": "select count(*) as n from lookup_events where reason like '%\\_global' escape '\\' and hit",
    "distinct_union_count": "select count(distinct mongo_id) as n_distinct from (select mongo_id from hash_chunks union all select mongo_id from fingerprint_items)",
    "delta_window": "select b.batch_no as window_no, count(*) as n_rows, count(distinct mongo_id) as n_items from item_snapshots s join sync_batches b on updated_at > window_start and updated_at <= window_end group by 1",
    "delta_scan": "select mongo_id, batch_no from item_snapshots where updated_at > timestamptz '2031-03-03 00:00:00+00' and updated_at <= timestamptz '2031-03-05 00:00:00+00'",
    "upsert_latest": "select mongo_id, batch_no, coalesce(epoch_us(updated_at), -1) as updated_us from item_snapshots qualify row_number() over (partition by mongo_id order by updated_at desc nulls last, batch_no desc) = 1",
    "first_and_last_seen": "select chat_id, epoch_us(min(ts)) as created_us, epoch_us(max(ts)) as updated_us from lookup_events group by 1",
    "inserted_ids": "select distinct mongo_id from item_snapshots where batch_no > 0 and mongo_id not in (select mongo_id from item_snapshots where batch_no = 0)",
    "chat_state": "select chat_id, id, reason from (select distinct chat_id, ts, id, reason from lookup_events) qualify row_number() over (partition by chat_id order by ts desc, id desc, reason desc) = 1 and reason <> 'blocked_source'",
    "watermark": "select cast(cast(received_at as date) as varchar) as day, epoch_us(case when bool_or(error) then timestamptz '2031-03-01 00:00:00+00' else greatest(max(ts), timestamptz '2031-03-01 00:00:00+00') end) as mark_us from lookup_events group by 1",
    "ttl_greedy_dedupe": "with recursive e as materialized (select distinct chat_id, ts from lookup_events where chat_id is not null and ts is not null), w(chat_id, ts) as (select chat_id, min(ts) from e group by 1 union all select w.chat_id, min(e.ts) from w join e on e.chat_id = w.chat_id and e.ts > w.ts + interval 1 hour group by w.chat_id) select chat_id, epoch_us(ts) as ts_us from w",
    "latency_ema": f"select chat_id, round({_EMA} + 1e-9, 6) as ema from {_EVENTS} group by 1",
    "latency_ema_total": f"select round({_EMA} + 1e-9, 6) as ema from {_EVENTS}",
    "hit_miss_counters": "with e as (select id, any_value(chat_id) as chat_id, coalesce(bool_or(hit), false) as hit, coalesce(bool_or(error), false) as error from lookup_events group by 1) select chat_id, count(*) as total, count(*) filter (hit and not error) as hits, count(*) filter (not hit and not error) as misses, count(*) filter (error) as errors from e group by 1",
    "payload_codec": f"{_I} select collection, mongo_id, name, duration_ms from i",
    "stored_payloads": "select distinct mongo_id, json_extract_string(item_json, '$.rarity') as rarity, cast(json_extract_string(item_json, '$.duration_ms') as bigint) as duration_ms from fingerprint_items where item_json is not null",
}
