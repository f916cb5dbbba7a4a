"""DuckDB SQL of the queries that SQL can express over whole tables: every pair, every window, no sketch or hash table."""

from __future__ import annotations

#: Every node reachable from a node over the symmetric table links(a, b), and the least of them.
_REACH = """
reach as (select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b),
least_of as (select a as node, min(b) as least from reach group by a)"""

OP1 = rf"""with recursive
w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as materialized (select doc_id, case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
  else list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' '))) end as sh from w),
p as materialized (select doc_id, unnest(sh) as g from s),
common as (select x.doc_id as a, y.doc_id as b, count(*) as c from p x join p y using (g) where x.doc_id <> y.doc_id group by 1, 2),
links as materialized (select a, b from common join s x on x.doc_id = a join s y on y.doc_id = b where 100 * c >= 80 * (len(x.sh) + len(y.sh) - c)),
{_REACH}
select doc_id, len(sh)::bigint as n_shingles, least(doc_id, coalesce(least, doc_id)) as component_id, coalesce(least >= doc_id, true) as kept
from s left join least_of on node = doc_id"""

OP5 = """with
d as materialized (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
c as (select doc_id, n, k, substr(h, 2000 * k + 1, 2098) as piece from (select *, unnest(range(0, (n + 999) // 1000)) as k from d where n >= 50)),
w as materialized (select doc_id, 1000 * k + i as p, substr(piece, 2 * i + 1, 100) as s from (select *, unnest(range(0, least(1000, n - 49 - 1000 * k))) as i from c)),
first as (select s, min(doc_id) as least from w group by s),
gone as (select doc_id, p from w join first using (s) where least < doc_id),
cut as (select *, case when p <= lag(p) over (partition by doc_id order by p) + 50 then 0 else 1 end as new from gone),
run as (select doc_id, min(p) as a, max(p) + 50 as b from (select *, sum(new) over (partition by doc_id order by p) as r from cut) group by doc_id, r),
r2 as (select *, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from run),
parts as (select r2.doc_id, sum(b - a) as n_removed, count(*) as n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) as kept, max(b) as upto from r2 join d using (doc_id) group by 1)
select doc_id, n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(upto, 0) + 1))) as kept_sha256
from d left join parts using (doc_id)"""

OP10 = f"""with recursive
v as materialized (select vec_id, embedding::double[] as x from embeddings),
good as (select * from v where len(x) > 0 and len(list_filter(x, lambda e: e is null or not isfinite(e))) = 0 and len(list_filter(x, lambda e: e <> 0)) > 0),
links as materialized (select p.vec_id as a, q.vec_id as b from good p join good q on p.vec_id <> q.vec_id and len(p.x) = len(q.x) where list_cosine_similarity(p.x, q.x) >= 0.95),
{_REACH},
n_of as (select a as node, count(*) as n from links group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, least(vec_id, coalesce(least, vec_id)) as component_id, coalesce(least >= vec_id, true) as kept
from v left join n_of on n_of.node = vec_id left join least_of on least_of.node = vec_id"""

_WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"
_DRAW = "((('0x' || substr(md5({}), 1, 12))::bigint + 0.5) / 281474976710656.0)"

#: The fixed point of the targets by water level, then every document in Pareto order: it is in the sample if the words before it are short of those due by half of its own or more.
OP3 = f"""with
d as (select doc_id, source, {_WORDS}::bigint as size, md5(coalesce(text, '')) as digest from documents),
s as (select source, sum(size)::bigint as source_size, count(*) as n from d group by source),
w as (select *, source_size * 2.0::double as cap, [3.0::double, 1.0::double, 2.0::double][((row_number() over (order by source is null, encode(source)) - 1) % 3 + 1)::int] as weight from s),
l as (select *, (sum(source_size) over ()) * 1.5::double as total, sum(weight) over () - coalesce(sum(weight) over b, 0) as w_left, coalesce(sum(cap) over b, 0) as c_used
  from w window b as (order by cap / weight, source is null, encode(source) rows between unbounded preceding and 1 preceding)),
o as (select *, case when cap >= (total - c_used) / w_left * weight then (total - c_used) / w_left end as open_level from l),
f as (select *, first_value(open_level ignore nulls) over (order by cap / weight, source is null, encode(source) rows between unbounded preceding and current row) as water from o),
t as (select source, source_size, n, greatest(case when water is null then cap else least(cap, water * weight) end, 0.0::double) as target from f),
r as (select *, case when source_size > 0 then target / source_size else 0.0::double end as ratio from t),
c as (select *, floor(ratio + 1e-12::double) as certain, greatest(ratio - floor(ratio + 1e-12::double), 0.0::double) as rest from r),
x as (select d.*, c.source_size, c.target, c.certain, c.rest * c.source_size as due, rest / (1 - least(rest, 1 - 1e-9::double)) * pow((size + 1)::double / (c.source_size::double / n + 1), -0.1::double) as odds,
  {_DRAW.format("'20:' || coalesce(doc_id::varchar, '') || ':' || digest")} as u from d join c on d.source is not distinct from c.source),
k as (select *, (u / (1 - u)) / greatest((odds / (1 + odds)) / (1 - odds / (1 + odds)), 1e-12::double) as rank from x),
e as (select *, coalesce(sum(size) over (partition by source order by rank / (1 + rank), doc_id nulls first, digest rows between unbounded preceding and 1 preceding), 0) as earlier from k)
select doc_id, size, source_size, target, (certain + (due > 0 and earlier < due and 2 * (due - earlier) >= size)::int)::int as copies,
  (size * (certain + (due > 0 and earlier < due and 2 * (due - earlier) >= size)::int))::bigint as taken from e"""

#: CRC-32 is linear: each byte adds what its bits become in as many zero bytes as follow it.  The jumps of a key go on to the first shard beyond the last.
OP6 = f"""with recursive
t as (select n, n as c, 0 as k from (select unnest(range(256)) as n) union all select n, case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, k + 1 from t where k < 8),
tab as materialized (select n, c from t where k = 8),
d as materialized (select row_number() over () as i, doc_id, coalesce(doc_id::varchar, '') as key, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, ''))::bigint as n from documents),
basis as (select 0::bigint as far, n as bit, c from tab where n in (1, 2, 4, 8, 16, 32, 64, 128)
  union all select far + 1, bit, xor(basis.c >> 8, tab.c) from basis join tab on tab.n = basis.c & 255 where far < (select max(n) from d)),
start as (select 0::bigint as n, 4294967295::bigint as c union all select start.n + 1, xor(start.c >> 8, tab.c) from start join tab on tab.n = start.c & 255 where start.n < (select max(n) from d)),
b as (select i, n - 1 - p as far, ('0x' || substr(h, (2 * p + 1)::int, 2))::bigint as v from (select *, unnest(range(0, n)) as p from d)),
sums as (select i, bit_xor(c) as c from b join basis on b.far = basis.far and v & bit <> 0 group by i),
crc as (select d.i, d.doc_id, d.key, d.n + 1 as size, xor(xor(start.c, coalesce(sums.c, 0)), 4294967295)::bigint as text_crc32 from d join start on start.n = d.n left join sums using (i)),
jumps as (select key, 0::bigint as b, floor(1 / {_DRAW.format("'0:' || key || ':0'")})::bigint as next from (select distinct key from d)
  union all select key, next, floor((next + 1) / {_DRAW.format("'0:' || key || ':' || next")})::bigint from jumps where next < 17),
place as (select key, max(b) filter (b < 16)::int as shard, max(b)::int as grown_shard from jumps group by key)
select doc_id, size, text_crc32, 'key' as law, shard, row_number() over (partition by shard order by ('0x' || substr(md5(key || ':' || text_crc32), 1, 2))::int, doc_id nulls first, text_crc32) - 1 as slot, grown_shard
from crc join place using (key)"""

#: Each pattern's matches are marked, and their places are the lengths of what stands before the marks.  The tables hold no disguised data, so the plain spans are all.
OP7 = r"""with
p as (select * from (values (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
  (2, 'card', '[0-9]([\x20-]?[0-9])+'), (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')) as p(k, kind, pattern)),
d as materialized (select row_number() over () as i, doc_id, coalesce(text, '') as t from documents),
m as (select i, k, kind, string_split(regexp_replace(t, pattern, chr(1) || '\0' || chr(2), 'g'), chr(1)) as parts from d, p),
u as (select i, k, kind, unnest(list_transform(range(2, len(parts) + 1), lambda j: {'found': string_split(parts[j], chr(2))[1], 'a': list_sum(list_transform(parts[1:j - 1], lambda x: length(x))) - (j - 2)})) as x from m where len(parts) > 1),
f as (select i, k, kind, x.found as found, x.a::bigint as a, (x.a + length(x.found))::bigint as b, regexp_replace(x.found, '[^0-9]', '', 'g') as digits from u),
s as (select * from f where case k when 0 then true
  when 1 then list_bool_and(list_transform(string_split(found, '.'), lambda x: length(ltrim(x, '0')) <= 3 and coalesce(try_cast(ltrim(x, '0') as int), 0) <= 255))
  when 2 then length(digits) between 12 and 19 and list_sum(list_transform(range(0, length(digits)), lambda j: digits[length(digits) - j]::int * (1 + j % 2) - case when digits[length(digits) - j]::int * (1 + j % 2) > 9 then 9 else 0 end)) % 10 = 0
  else length(digits) between 9 and 15 end),
g as (select i, count(*) filter (k = 0) as n_email, count(*) filter (k = 1) as n_ip, count(*) filter (k = 2) as n_card, count(*) filter (k = 3) as n_phone, string_agg(kind || ':' || a || ':' || b, ',' order by a, k) as spans from s group by i)
select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone, sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (i)"""
