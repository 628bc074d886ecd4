"""DuckDB statements of the queries that SQL can express."""

_ITEMS = """
with i as (select mongo_id, min(batch_no) as batch_no, max(updated_at) as updated_at, any_value(phash) as phash, any_value(dhash) as dhash, any_value(video_signature) as video_signature, any_value(item_key) as item_key,
  any_value(collection) as collection, any_value(fingerprint_version) as fingerprint_version, any_value(name) as name, any_value(card_id) as card_id, any_value(rarity) as rarity, any_value(anime_name) as anime_name,
  any_value(command) as command, any_value(media_type) as media_type, any_value(file_unique_id) as file_unique_id, any_value(sha256) as sha256, any_value(origin_message_id) as origin_message_id
  from item_snapshots where mongo_id is not null group by mongo_id)
"""

_BITS = "case when regexp_full_match(lower(trim({c})), '[0-9a-f]{{16}}') and lower(trim({c})) not in ('0000000000000000', 'ffffffffffffffff') then ('0x' || lower(trim({c})))::ubigint end"

P2 = (
    _ITEMS
    + f""", m as (select mongo_id, batch_no, {_BITS.format(c="phash")} as p, {_BITS.format(c="dhash")} as d,
  case when trim(video_signature) <> '' and lower(trim(video_signature)) <> 'e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855' then lower(trim(video_signature)) end as sig from i)
select least(a.mongo_id, b.mongo_id) as mongo_id_a, greatest(a.mongo_id, b.mongo_id) as mongo_id_b from m a join m b on a.batch_no < b.batch_no
where a.sig = b.sig or (bit_count(xor(a.p, b.p)) <= 8 and case when a.d is not null and b.d is not null then bit_count(xor(a.d, b.d)) <= 12 else bit_count(xor(a.p, b.p)) <= 2 end)
"""
)

_REAL = "(case when {c} is not null and lower(trim(cast({c} as varchar))) not in ('', '-', '--', '?', '??', '???', 'n/a', 'na', 'null', 'none', 'nil', 'unknown', 'tbd', 'untitled', 'no name', 'noname', 'undefined', 'nan', '.', '...', '_') then 1 else 0 end)"
_COUNTED = ("name", "card_id", "rarity", "anime_name", "command", "media_type", "file_unique_id", "sha256", "origin_message_id")

P3 = (
    _ITEMS
    + f""", r as (select i.item_key, i.mongo_id, coalesce(try_cast(nullif(regexp_extract(fingerprint_version, '([0-9]+(\\.[0-9]+)?)', 1), '') as double), -1) as v, -coalesce(t.trust_rank, 1073741824) as t,
  coalesce(epoch_us(updated_at), -9223372036854775807) as u, {" + ".join(_REAL.format(c="i." + c) for c in _COUNTED)} as f
  from i left join (select lower(trim(collection)) as collection, min(trust_rank) as trust_rank from collection_dim group by 1) t on lower(trim(i.collection)) = t.collection where trim(item_key) <> ''),
b as (select item_key, count(*) as n, max(v) as v, max(t) as t, max(u) as u, max(f) as f from r group by 1 having count(*) > 1)
select r.item_key, min(r.mongo_id) as mongo_id from r join b on r.item_key = b.item_key and r.v = b.v and r.t = b.t and r.u = b.u and r.f = b.f group by 1 having count(*) = 1
"""
)

P6 = """
with recursive k as (
  select distinct mongo_id, u as k from (select mongo_id, 'u' || trim(unnest(list_concat([file_unique_id], coalesce(file_unique_ids, [])))) as u from item_snapshots
  union all select mongo_id, 's' || lower(trim(unnest(list_concat([sha256], coalesce(sha256_aliases, []))))) as u from item_snapshots)
  where mongo_id is not null and u is not null and u not in ('u', 's', 'se3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855')),
e as (select distinct a.mongo_id as a, b.mongo_id as b from k a join k b using (k)),
w(a, b) as (select a, b from e union select w.a, e.b from w join e on w.b = e.a)
select a as mongo_id, min(b) as group_mongo_id from w group by a having count(*) > 1
"""

SQL: dict[str, str] = {"p2_found": P2, "p3_found": P3, "p6_found": P6}
