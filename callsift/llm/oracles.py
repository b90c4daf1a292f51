"""DuckDB twins of operators whose results SQL can express."""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Reachable nodes along `links (u, v)` from each of `nodes (id)`.
_REACH = """
reach as (
  select id as a, id as b from nodes
  union
  select reach.a, links.v from reach join links on links.u = reach.b),
groups as (select a as id, min(b) as component_id from reach group by a)"""

EXACT_DEDUP = r"""
with t as (
  select doc_id, length(coalesce(text, '')) as cp,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as norm
  from documents),
g as (
  select *, first_value(doc_id) over (partition by norm order by cp desc, doc_id) as keep_id,
    count(*) over (partition by norm) as group_size
  from t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from g"""

NEAR_DUPLICATES = f"""
with recursive d as (select doc_id as id, {_WORDS.format(_LOWER)} as ws from documents),
shingles as (
  select distinct id, array_to_string(ws[i:i+4], ' ') as s
  from d, unnest(range(1, greatest(len(ws) - 3, 2))) as u(i) where len(ws) > 0),
sizes as (select id, count(*) as n from shingles group by id),
shared as (
  select a.id as u, b.id as v, count(*) as n from shingles a join shingles b on a.s = b.s and a.id <> b.id
  group by a.id, b.id),
links as (
  select u, v from shared join sizes p on p.id = u join sizes q on q.id = v
  where 100 * shared.n >= 85 * (p.n + q.n - shared.n)),
nodes as (select id from d), {_REACH}
select d.id as doc_id, coalesce(n, 0) as n_shingles, component_id, d.id = component_id as kept
from d left join sizes on sizes.id = d.id join groups on groups.id = d.id"""

SUBSTRING_DEDUP = f"""
with d as (select doc_id, {_WORDS.format("coalesce(text, '')")} as ws from documents),
windows as (
  select doc_id, i, array_to_string(ws[i:i+34], ' ') as w from d, unnest(range(1, len(ws) - 33)) as u(i)
  where len(ws) >= 35),
repeated as (select doc_id, i from windows qualify count(*) over (partition by w) > 1),
gone as (select distinct doc_id, i + k as pos from repeated, unnest(range(0, 35)) as u(k)),
words as (select doc_id, pos, ws[pos] as word from d, unnest(range(1, len(ws) + 1)) as u(pos)),
kept as (
  select words.doc_id, string_agg(word, ' ' order by words.pos) as text, count(*) as n
  from words anti join gone on gone.doc_id = words.doc_id and gone.pos = words.pos group by words.doc_id)
select d.doc_id, len(ws) as n_words, len(ws) - coalesce(kept.n, 0) as n_removed,
  sha256(coalesce(kept.text, '')) as kept_sha256
from d left join kept on kept.doc_id = d.doc_id"""

EMBEDDING_DUPLICATES = f"""
with recursive d as (select vec_id as id, label, cast(embedding as double[]) as e from embeddings),
links as (
  select a.id as u, b.id as v from d a join d b on a.label = b.label and a.id <> b.id
  where list_cosine_similarity(a.e, b.e) >= 0.98),
degrees as (select u, count(*) as n from links group by u),
nodes as (select id from d), {_REACH}
select d.id as vec_id, coalesce(n, 0) as n_links, component_id, d.id = component_id as kept
from d left join degrees on degrees.u = d.id join groups on groups.id = d.id"""

# CRC-32 of each distinct feature: every byte's part is shifted by the bytes behind it, and all are xored.
RESAMPLING = r"""
with recursive docs as (
  select 0 as kind, doc_id as id, text from documents union all select 1, item_id, text from benchmark),
words as (
  select kind, id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as ws from docs),
grams as (
  select kind, id, unnest(ws) as g from words
  union all
  select kind, id, ws[i] || ' ' || ws[i + 1] from words, unnest(range(1, len(ws))) as u(i)),
features as (select g, hex(encode(g)) as h from (select distinct g from grams)),
bits(b, k, v) as (
  select b, 0, b from range(256) as r(b)
  union all
  select b, k + 1, xor(v >> 1, case when v & 1 = 1 then 3988292384 else 0 end) from bits where k < 8),
steps as (select b, v from bits where k = 8),
most as (select max(len(h)) // 2 as n from features),
parts(d, b, v) as (
  select 0::bigint, b, v from steps
  union all
  select p.d + 1, p.b, xor(p.v >> 8, s.v) from parts p join steps s on s.b = p.v & 255 where p.d < (select n from most)),
opened(d, v) as (
  select 0::bigint, 4294967295::bigint
  union all
  select o.d + 1, xor(o.v >> 8, s.v) from opened o join steps s on s.b = o.v & 255 where o.d < (select n from most)),
bytes as (
  select g, len(h) // 2 as n, i,
    16 * (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1 as b
  from features, unnest(range(0, len(h) // 2)) as u(i)),
summed as (
  select g, n, bit_xor(p.v) as v from bytes join parts p on p.d = n - 1 - i and p.b = bytes.b group by g, n),
buckets as (select g, xor(xor(s.v, o.v), 4294967295) % 10000 as k from summed s join opened o on o.d = s.n),
placed as (select kind, id, k from grams join buckets using (g)),
counts as (
  select k, count(*) filter (kind = 0) as s, count(*) filter (kind = 1) as t from placed group by k),
totals as (select sum(s)::double + 10000 as s, sum(t)::double + 10000 as t from counts),
gains as (
  select k, floor(1000 * ln((c.t + 1)::double * totals.s / ((c.s + 1)::double * totals.t)))::bigint as gain from counts c, totals),
weights as (
  select id, count(*) as n, floor(sum(gain)::double / count(*))::bigint as weight
  from placed join gains using (k) where kind = 0 group by id),
scored as (
  select id as doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight, len(ws) >= 20 as fit,
    ('0x' || sha256('7:' || id)[1:8])::bigint as h
  from words left join weights using (id) where kind = 0),
noisy as (
  select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from scored),
ranked as (
  select *, row_number() over (partition by fit order by score desc, doc_id) as r, count(*) over (partition by fit) as n
  from noisy)
select doc_id, n_features, weight, score, case when fit and r <= 25 * n // 100 then r end as rank from ranked"""


def clustering(rounds: int = 5, clusters: int = 40) -> str:
    """Lloyd's rounds, one group of expressions each."""
    near = """
near{0} as (
  select id, arg_min(c, (d, c)) as c, min(d) as d from (
    select p.id, q.c, sum((p.x - q.x) * (p.x - q.x)) as d from p join c{0} q on q.i = p.i group by p.id, q.c)
  group by id)"""
    moved = """,
sums{0} as (select c, i, sum(x) as s, count(*) as n from p join near{0} using (id) group by c, i),
c{1} as (
  select q.c, q.i, coalesce((s - ((s % n) + n) % n) // n, q.x) as x from c{0} q left join sums{0} on sums{0}.c = q.c and sums{0}.i = q.i),"""
    steps = "".join(near.format(r) + (moved.format(r, r + 1) if r < rounds else "") for r in range(rounds + 1))
    return f"""
with kept as (
  select vec_id as id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
p as (select id, i, e[i] as x from kept, unnest(range(1, 65)) as u(i)),
first as (
  select id, row_number() over (order by sha256('2:' || id)) - 1 as c from kept
  qualify c < {clusters}),
c0 as (select c, i, x from first join p using (id)),{steps},
inertia as (select c, sum(d) as cluster_inertia from near{rounds} group by c),
digests as (select c, sha256(string_agg(x::bigint::varchar, ',' order by i)) as centroid_sha256 from c{rounds} group by c)
select id as vec_id, near{rounds}.c::int as cluster, d::bigint as distance, cluster_inertia::bigint as cluster_inertia,
  (select sum(d) from near{rounds})::bigint as inertia, centroid_sha256
from near{rounds} join inertia using (c) join digests using (c)"""


TOP_PRODUCTS = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint::double) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
scores as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score
  from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 20 = 0)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from scores qualify rank <= 20"""
