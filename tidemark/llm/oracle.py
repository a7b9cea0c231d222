"""DuckDB SQL of the operators that SQL can express."""

# Every 13-word window of a document is looked up among the benchmark's; an item
# of fewer words is looked up with its own length. Near items: word q of an item
# lies on diagonal g of a document if the same word stands within 2 places of
# q + g there; an item is near if one diagonal holds four fifths of a window.
_DECONTAM = r"""
with doc_words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
item_words as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null and item_id is not null),
sized as (select item_id, w, least(13, len(w)) as size from item_words where len(w) > 0),
windows as (
  select distinct item_id, size, array_to_string(w[i:i + size - 1], ' ') as phrase
  from (select item_id, w, size, unnest(range(1, len(w) - size + 2)) as i from sized)),
places as (
  select doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') as phrase
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i
        from doc_words, (select distinct size from windows) where len(w) >= size)),
found as (select doc_id, item_id, i, size from places join windows using (size, phrase)),
hit as (select doc_id, count(distinct p) as n_hit
        from (select doc_id, unnest(range(i, i + size)) as p from (select distinct doc_id, i, size from found)) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(k, ',' order by k) as names
          from (select distinct doc_id, cast(item_id as varchar) as k from found) group by doc_id),
item_places as (select distinct item_id, size, q, w[q] as word from (select item_id, w, size, unnest(range(1, len(w) + 1)) as q from sized)),
doc_places as (select doc_id, p, w[p] as word from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from doc_words)),
diagonals as (
  select distinct doc_id, item_id, size, q, p - q + drift as g
  from doc_places join item_places using (word), (select unnest(range(-2, 3)) as drift)),
near as (
  select distinct doc_id, cast(item_id as varchar) as k
  from (select doc_id, item_id, size,
               count(*) over (partition by doc_id, item_id, g order by q range between 12 preceding and current row) as n
        from diagonals)
  where 5 * n >= 4 * size),
near_items as (select doc_id, count(*) as n_near, string_agg(k, ',' order by k) as near_names from near group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated,
       coalesce(n_near, 0) as n_near_items, sha256(coalesce(near_names, '')) as near_items_sha256
from doc_words left join hit using (doc_id) left join items using (doc_id) left join near_items using (doc_id)
"""

_EXACT = r"""
with t as (
  select doc_id, length(coalesce(text, '')) as chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as body
  from documents)
select doc_id, first_value(doc_id) over best as keep_id, count(*) over (partition by body) as group_size,
       row_number() over best = 1 as kept, sha256(body) as text_sha256
from t
window best as (partition by body order by chars desc, doc_id nulls last)
"""

# crc32 by its table; a prefix is named by the digests of its turns.
_TRIE = r"""
with crc_table as (
  select list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b)) as steps),
turns as (
  select conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as digest,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words
  from conversations where conv_id is not null),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, digest) as pos from turns),
convs as (
  select conv_id, conv_id - conv_id % 20 as base,
         xor(list_reduce(list_transform(string_split(cast(conv_id as varchar), ''), lambda x: cast(ascii(x) as bigint)),
                         lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 4 as h
  from (select distinct conv_id from turns), crc_table),
taken as (
  select c.conv_id, 0 as own, n.pos, n.digest, n.words from convs c join numbered n on n.conv_id = c.base and n.pos <= c.h
  union all
  select n.conv_id, 1, n.pos, n.digest, n.words from numbered n join convs c using (conv_id) where n.pos > c.h),
paths as (
  select conv_id, coalesce(list(digest order by own, pos) filter (digest is not null), []) as digests, coalesce(list(words order by own, pos) filter (digest is not null), []) as words
  from convs left join taken using (conv_id) group by conv_id),
prefixes as (
  select conv_id, d as depth, array_to_string(digests[1:d], '') as path, array_to_string(digests[1:d - 1], '') as up, case when d = 0 then 0 else words[d] end as words, d = len(digests) as ends
  from (select *, unnest(range(0, len(digests) + 1)) as d from paths)),
nodes as (
  select depth, path, min(up) as up, min(words) as words, min(conv_id) as conv_id, count(*) as n_convs,
         sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ends), '')) as ends_sha256
  from prefixes group by depth, path),
children as (select depth - 1 as depth, up as path, count(*) as n_children from nodes where depth > 0 group by 1, 2),
owned as (select n.*, coalesce(n_children, 0) as n_children from nodes n left join children using (depth, path)),
below as (
  select p.depth, p.path, sum((o.n_convs - 1) * o.words) as saved_tokens, sum(case when o.n_children = 0 then 1 else 0 end) as n_leaves
  from prefixes p join owned o on o.conv_id = p.conv_id and o.depth >= p.depth group by 1, 2)
select o.conv_id, o.depth, u.conv_id as parent_conv_id, o.n_convs, o.n_children, cast(b.n_leaves as bigint) as n_leaves,
       cast(b.saved_tokens as bigint) as saved_tokens, o.ends_sha256
from owned o join below b using (depth, path) left join owned u on o.depth > 0 and u.depth = o.depth - 1 and u.path = o.up
"""

ORACLE: dict[str, str] = {"op5_decontamination": _DECONTAM, "op12_exact_dedup": _EXACT, "op13_prefix_trie": _TRIE}
