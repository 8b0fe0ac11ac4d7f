"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

#: The alphabet of base 32.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = f"""
with bodies as (select page_id, coalesce(html, '') as body from pages),
hashed as (select page_id, strlen(body)::bigint as payload_bytes, sha1(body) as digest from bodies),
kept as (select digest, max(page_id) as keeper from hashed group by digest)
select page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('{_BASE32}',
    (((('0x' || substr(digest, (5 * (i // 4) + 1)::bigint, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31) + 1)::bigint, 1)), '') as payload_digest,
  case when page_id is not distinct from keeper then 'response' else 'revisit' end as record_type,
  case when page_id is not distinct from keeper then null else keeper end as refers_to
from hashed join kept using (digest)
"""


def near_copies(width: int, num: int, den: int, source: str = "documents") -> str:
    """CTEs `sized(doc_id, n_shingles)` and `labelled(doc_id, component_id)` of a similarity join."""
    gram = " || chr(1) || ".join(f"w[i + {k}]" for k in range(1, width + 1))
    return f"""
worded as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') as w from {source}),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < {width} then [array_to_string(w, chr(1))]
  else list_distinct(list_transform(range(0, len(w) - {width - 1}), lambda i: {gram})) end as grams from worded),
sized as (select doc_id, len(grams)::bigint as n_shingles from sets),
classes as (select grams, min(doc_id) as rep from (select doc_id, list_sort(grams) as grams from sets) where len(grams) > 0 group by grams),
flat as (select rep, unnest(grams) as gram from classes),
shared as (select a.rep as a, b.rep as b, count(*) as n from flat a join flat b on a.gram = b.gram and a.rep < b.rep group by a.rep, b.rep),
class_sizes as (select rep, len(grams) as n from classes),
links as (select a, b from shared join class_sizes x on x.rep = a join class_sizes y on y.rep = b
  where {den} * shared.n >= {num} * (x.n + y.n - shared.n)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select rep as node, rep as seen from classes union select reach.node, both_ways.b from reach join both_ways on both_ways.a = reach.seen),
labelled as (select s.doc_id, coalesce(r.root, s.doc_id) as component_id from (select doc_id, list_sort(grams) as grams from sets) s
  left join (select classes.grams, min(seen) as root from reach join classes on classes.rep = reach.node group by classes.grams) r
  on len(s.grams) > 0 and s.grams = r.grams)"""


OP4 = f"with recursive {near_copies(3, 90, 100)} select doc_id, n_shingles, component_id from sized join labelled using (doc_id)"

_WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def windows(source: str = "documents") -> str:
    """CTEs `words(doc_id, w)` and `found(doc_id, item_id, i, n)`: item windows that start at a document's word i."""
    lower = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    return f"""
words as (select doc_id, regexp_extract_all({lower}, '{_WORDS}') as w from {source}),
item_words as (select item_id, regexp_extract_all({lower}, '{_WORDS}') as w from benchmark),
runs as (select distinct item_id, len(run) as n, array_to_string(run, ' ') as run from (
  select item_id, unnest(case when len(w) = 0 then [] when len(w) < 10 then [w]
    else list_transform(range(0, len(w) - 9), lambda i: w[i + 1 : i + 10]) end) as run from item_words)),
lengths as (select distinct n from runs),
spans as (select doc_id, n, unnest(range(1, len(w) - n + 2)) as i, w from words, lengths where len(w) >= n),
found as (select doc_id, item_id, i, spans.n from spans join runs on runs.n = spans.n and runs.run = array_to_string(w[i : i + spans.n - 1], ' '))"""


OP7 = f"""
with {windows()},
hit as (select doc_id, count(distinct place)::bigint as n_hit from (select doc_id, unnest(range(i, i + n)) as place from found) group by doc_id),
named as (select doc_id, count(*)::bigint as n_items, array_to_string(list_sort(list(name)), ',') as names
  from (select distinct doc_id, item_id::varchar as name from found) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join hit using (doc_id) left join named using (doc_id)
"""

SQL = {"op1_warc": OP1, "op4_jaccard_join": OP4, "op7_decontaminate": OP7}
