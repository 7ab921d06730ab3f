"""DuckDB SQL for the registered queries that SQL can express."""

OP1_MIXING = r"""
with docs as (
  select doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, coalesce('=' || source, '?') as name,
    ('0x' || substr(md5('mix|' || coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')), 1, 15))::bigint as key
  from documents),
sources as (
  select name, sum(size)::bigint as source_size, ((row_number() over (order by name) - 1) % 3 + 1)::double as weight
  from docs group by name),
ordered as (
  select *, (source_size * 3)::double as most, sum(source_size) over () as total,
    row_number() over (order by (source_size * 3)::double / weight, name) as k
  from sources),
shared as (
  select *, total - coalesce(sum(most) over (order by k rows between unbounded preceding and 1 preceding), 0) as rest,
    sum(weight) over (order by k rows between current row and unbounded following) as weights
  from ordered),
level as (select rest, weights from shared where most / weight > rest / weights order by k limit 1),
aims as (
  select name, source_size, case when most / weight <= shared.rest / shared.weights then most else weight * level.rest / level.weights end as target
  from shared left join level on true),
budgets as (
  select *, case when source_size > 0 then floor(round(target) / source_size) else 0 end::bigint as epochs from aims),
running as (
  select name, key, sum(sum(size)) over (partition by name order by key) - sum(size) as before, count(*) as n from docs group by name, key)
select d.doc_id, d.size, b.source_size, b.target,
  (b.epochs * d.size + greatest(0, least(d.size, floor((round(b.target) - b.epochs * b.source_size - r.before) / r.n))))::bigint as taken
from docs d join budgets b using (name) join running r using (name, key)
"""

OP7_URLS = r"""
with u as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages),
rules(v, h, p) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'),
  ('block', 'net', '/fr/'))
select page_id, host, path, w.h || w.p as rule, coalesce(w.v, 'allow') as verdict
from u left join lateral (
  select * from rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
  order by length(h) + length(p) desc, length(h) desc, v desc limit 1) w on true
"""

OP2_TOP_K = r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e
  from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from pairs)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""

# crc32 is worked out bit by bit: DuckDB has no function for it.
OP11_TRIE = r"""
with own as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as place
  from conversations where conv_id is not null),
ids as (
  select conv_id, list_reduce([4294967295::bigint] || list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint),
    lambda crc, byte: list_reduce([xor(crc, byte)] || list_transform(range(8), lambda b: 0::bigint), lambda x, _: xor(x >> 1, (x & 1) * 3988292384))) as crc
  from (select distinct conv_id from own) i),
shared as (select conv_id, conv_id - conv_id % 20 as base, xor(crc, 4294967295) % 4 as h from ids),
said as (
  select s.conv_id, o.place, o.role, o.text from shared s join own o on o.conv_id = s.base where o.place <= h
  union all
  select s.conv_id, o.place, o.role, o.text from shared s join own o using (conv_id) where o.place > h),
named as (
  select conv_id, row_number() over (partition by conv_id order by place) as depth, md5(length(role)::varchar || ' ' || role || text) as turn,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::bigint as words
  from said),
prefixes as (
  select conv_id, depth, md5(string_agg(turn, '' order by depth) over (partition by conv_id order by depth)) as node, words from named
  union all
  select conv_id, 0, 'root', 0 from shared),
linked as (
  select *, lag(node) over (partition by conv_id order by depth) as parent, lead(node) over (partition by conv_id order by depth) is null as last from prefixes),
ends as (
  select node, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends_sha256 from linked where last group by node),
nodes as (
  select node, any_value(parent) as parent, any_value(depth)::bigint as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words
  from linked group by node),
children as (select parent, count(*) as n_children from nodes where parent is not null group by parent),
own_values as (
  select n.*, coalesce(n_children, 0) as n_children, (n_convs - 1) * words as saved, (n_children is null)::bigint as leaf
  from nodes n left join children c on c.parent = n.node),
above as (
  select distinct a.node as top, b.node as below from linked a join linked b on a.conv_id = b.conv_id and a.depth <= b.depth),
sums as (
  select top, sum(leaf)::bigint as n_leaves, sum(saved)::bigint as saved_tokens from above join own_values v on v.node = above.below group by top)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens,
  coalesce(e.ends_sha256, sha256('')) as ends_sha256
from own_values n left join nodes p on p.node = n.parent join sums s on s.top = n.node left join ends e on e.node = n.node
"""

OP12_LINES = r"""
with docs as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
numbered as (
  select r, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as i from docs),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from numbered),
often as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 20 group by key having count(distinct r) >= 3),
marked as (
  select k.*, o.key is not null and o.keeper is not null and k.doc_id is distinct from o.keeper as lost from keyed k left join often o using (key))
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (lost) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not lost), '')) as kept_sha256
from marked group by r
"""

OP13_NEGATIVES = r"""
with v as (
  select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e
  from embeddings
  where embedding is not null and vec_id is not null and label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select a.vec_id as anchor_id, c.vec_id, c.label = a.label as same, list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2]))::bigint as score
  from v a join v c on a.vec_id <> c.vec_id where a.vec_id % 100 = 0),
positives as (
  select * from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as place from pairs where same) s where place <= 5),
ranked as (
  select p.anchor_id, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score,
    row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id)::integer as rank
  from positives p join pairs n on n.anchor_id = p.anchor_id and not n.same and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ranked where rank <= 10
"""
