"""DuckDB SQL for the operators that SQL can express, by query."""

op3_chat_formatting = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (
  select *,
    length(role) + length(text)
    + length(role || text) - length(translate(role || text, '\<[', ''))
    + 8 + 8 + 7 as size
  from t)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(size) as bigint) as formatted_chars
from e group by conv_id
"""

op8_benchmark_decontamination = r"""
with dw as (
  select doc_id, row_number() over () as r,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from documents),
bw as (
  select item_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from benchmark),
g as (
  select distinct item_id, least(13, len(w)) as n, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') as gram
  from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as p from bw where len(w) > 0)),
sizes as (select distinct n from g),
d as (
  select r, n, p, array_to_string(w[p : p + n - 1], ' ') as gram
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as p from dw, sizes where len(w) >= n)),
h as (select r, d.n, p, item_id from d join g on d.n = g.n and d.gram = g.gram),
c as (select r, count(distinct q) as n_hit from (select r, unnest(range(p, p + n)) as q from (select distinct r, p, n from h)) group by r),
i as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct r, cast(item_id as varchar) as item_id from h) group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join c using (r) left join i using (r)
"""

op9_sharding = r"""
with recursive shards as (
  select i, 'shard-' || lpad(cast(i as varchar), 2, '0') as name from range(32) t(i)),
prefs as (
  select i, list_transform(range(4099), lambda j: cast((o + j * s) % 4099 as integer)) as slots
  from (select i, cast('0x' || substr(md5(name || '/offset'), 1, 15) as bigint) % 4099 as o,
          cast('0x' || substr(md5(name || '/step'), 1, 15) as bigint) % 4098 + 1 as s from shards)),
fill as (
  select 0 as turn, list_transform(range(4099), lambda j: cast(-1 as integer)) as owner
  union all
  select turn + 1, list_concat(owner[: slot], [cast(turn % 32 as integer)], owner[slot + 2 :])
  from (select turn, owner, list_filter(slots, lambda s: owner[s + 1] < 0)[1] as slot from fill join prefs on prefs.i = fill.turn % 32 where turn < 4099)),
owners as (select unnest(range(4099)) as slot, unnest(owner) as i from fill where turn = 4099)
select doc_id, source, n_chars, cast(slot as integer) as slot, name as shard
from (select *, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) % 4099 as slot from documents)
join owners using (slot) join shards using (i)
"""

op10_url_filter = r"""
with p as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from (select page_id, coalesce(case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end, '') as rest from pages)),
l as (select doc_id as page_id, max(quality) as good from labels where quality is not null and doc_id is not null group by 1),
h0 as (select host, cast(coalesce(sum(good), 0) as double) as good, cast(count(good) as double) as seen from p left join l using (page_id) group by host),
h as (
  select *, string_split(host, '.') as w, array_to_string(w[-2:], '.') in ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.nz', 'co.in') as long,
    array_to_string(case when long then w[-3:] else w[-2:] end, '.') as domain,
    array_to_string(case when long then w[-2:] else w[-1:] end, '.') as suffix
  from h0),
d as (select domain, suffix, sum(good) as good, sum(seen) as seen from h group by 1, 2),
s as (select suffix, sum(good) as good, sum(seen) as seen from d group by 1),
k as (
  select level, least(greatest(coalesce(avg(good / seen) * (1 - avg(good / seen))
      / greatest(var_samp(good / seen) - avg(good / seen * (1 - good / seen) / seen), 1e-9) - 1, 500.0), 2.0), 500.0) as k
  from (select 'h' as level, good, seen from h union all select 'd', good, seen from d union all select 's', good, seen from s)
  where seen >= 2 group by level),
top as (select (sum(good) + 1) / (sum(seen) + 2) as m from s),
sm as (select suffix, (good + k * m) / (seen + k) as m from s, top, (select coalesce(max(k), 500.0) as k from k where level = 's')),
dm as (select domain, suffix, (d.good + k * sm.m) / (d.seen + k) as m from d join sm using (suffix), (select coalesce(max(k), 500.0) as k from k where level = 'd')),
hb as (
  select host, greatest(a / (a + b) - sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 0.0) as bound
  from (select host, good + k * dm.m as a, seen - good + k * (1 - dm.m) as b
    from h join dm using (domain, suffix), (select coalesce(max(k), 500.0) as k from k where level = 'h'))),
r as (select * from (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) t(says, h, pre))
select page_id, p.host, path,
  (select h || pre from r where (p.host = h or ends_with(p.host, '.' || h)) and starts_with(p.path, pre) order by length(h || pre) desc limit 1) as rule,
  coalesce((select says from r where (p.host = h or ends_with(p.host, '.' || h)) and starts_with(p.path, pre) order by length(h || pre) desc limit 1),
    case when bound >= 0.5 then 'allow' else 'block' end) as verdict,
  round(bound, 6) as bound
from p join hb using (host)
"""

op6_ngram_join = r"""
with recursive d as (
  select row_number() over () as r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
s as (
  select distinct r, array_to_string(w[p : p + least(5, len(w)) - 1], ' ') as gram
  from (select r, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) as p from d where len(w) > 0)),
n as (select r, count(*) as n from s group by r),
shared as (select gram from s group by gram having count(*) > 1),
few as (select r, gram from s semi join shared using (gram)),
links as (
  select a, b from (select a.r as a, b.r as b, count(*) as c from few a join few b on a.gram = b.gram and a.r < b.r group by 1, 2)
  join n x on x.r = a join n y on y.r = b where 100 * c >= 80 * (x.n + y.n - c)),
both_ways as (select a, b from links union all select b, a from links),
reached(r, t) as (select r, r from n union select reached.r, b from reached join both_ways on a = t),
least_id as (select reached.r, min(d.doc_id) as component_id from reached join d on d.r = reached.t group by 1)
select doc_id, coalesce(n.n, 0) as n_shingles, case when n.n is null then doc_id else component_id end as component_id
from d left join n using (r) left join least_id using (r)
"""

op7_suffix_dedup = r"""
with d as (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as b from documents),
p as (select r, unnest(range(0, octet_length(b) - 399)) as p from d where octet_length(b) >= 400),
h as (select r, p, md5(array_slice(b, p + 1, p + 400)) as h from p join d using (r)),
dup as (select r, p from (select r, p, count(*) over (partition by h) as c from h) where c > 1),
island as (select r, p, sum(case when q is null or p > q + 400 then 1 else 0 end) over (partition by r order by p) as k
  from (select r, p, lag(p) over (partition by r order by p) as q from dup)),
span as (select r, k, min(p) as s, max(p) + 400 as e from island group by 1, 2),
piece as (
  select r, s as o, coalesce(lag(e) over (partition by r order by s), 0) as f, s as t from span
  union all select r, 1000000000, max(e), octet_length(any_value(b)) from span join d using (r) group by r),
kept as (select r, string_agg(case when t > f then hex(array_slice(b, f + 1, t)) else '' end, '' order by o) as x from piece join d using (r) group by r),
sums as (select r, sum(e - s) as n_removed, count(*) as n_spans from span group by r)
select doc_id, octet_length(b) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(case when x is null then b else unhex(x) end) as kept_sha256, octet_length(b) - cast(coalesce(n_removed, 0) as bigint) as n_kept,
  try(decode(case when x is null then b else unhex(x) end)) as kept
from d left join sums using (r) left join kept using (r)
"""

op12_spelling_variants = r"""
with recursive low as (
  select coalesce(cast(doc_id as varchar), '') as d, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
runs as (
  select d, w, count(*) as c from (select d, unnest(regexp_extract_all(t, '[A-Za-zÀ-ÿ]+')) as w from low) where length(w) >= 7 group by all),
hashed as (
  select w, c, xor(list_reduce(
      list_prepend(4294967295::bigint, flatten(list_transform(string_split(d || ':' || w, ''), lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [195::bigint, unicode(x)::bigint - 64] end))),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, k: xor(v >> 1, 3988292384::bigint * (v & 1)))), 4294967295::bigint) as h
  from runs),
v as (
  select word, sum(c)::bigint as n
  from (select case when h % 31 = 0 then w[: h % length(w)] || w[h % length(w) + 2 :] else w end as word, c from hashed)
  where length(word) >= 7 group by 1 having sum(c) >= 2),
less as (select word, n, p, word[: p] || word[p + 2 :] as x from (select word, n, unnest(range(length(word))) as p from v)),
pairs as (
  select a.word, b.word as other, b.n as m from less a join less b on a.x = b.x and a.p = b.p and a.word <> b.word
  union select l.word, v.word, v.n from less l join v on l.x = v.word
  union select v.word, l.word, l.n from less l join v on l.x = v.word),
near as (select word, count(*) as n_near, arg_min(other, struct_pack(a := -m, b := encode(other))) as best, max(m) as best_n from pairs group by 1),
told as (
  select word, case when best_n >= 10 * n then best end as form, n, coalesce(n_near, 0) as n_near, case when best_n >= 10 * n then best_n end as form_n
  from v left join near using (word)),
walk as (
  select word, word as at, form as next from told
  union all select walk.word, told.word, told.form from walk join told on walk.next = told.word)
select told.word, told.form, walk.at as root, told.n, told.n_near, told.form_n from told join walk on walk.word = told.word and walk.next is null
"""

_ASSIGN = """a{k} as (
  select part, vec_id, r, x, e, away from (
    select p.part, p.vec_id, p.r, p.x, b.e, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as away,
      row_number() over (partition by p.part, p.r order by away, b.e) as k
    from parts p join b{k} b on p.part = b.part)
  where k = 1)"""
_MOVE = """b{next} as (
  select b.part, b.e, coalesce(m.x, b.x) as x
  from b{k} b left join (
    select part, e, list(y order by i) as x
    from (select part, e, i, cast(floor(sum(x[i]) / count(*)) as bigint) as y from (select *, unnest(range(1, len(x) + 1)) as i from a{k}) group by all)
    group by all) m on b.part = m.part and b.e = m.e)"""

op13_vector_codes = f"""
with kept as (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint)) as q, row_number() over (order by vec_id nulls last, embedding) as r
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as (
  select vec_id, r, part, q[part * len(q) // 16 + 1 : (part + 1) * len(q) // 16] as x from (select *, unnest(range(16)) as part from kept)),
b0 as (select part, r - 1 as e, x from parts where r <= 64),
{", ".join(_ASSIGN.format(k=k) + ", " + _MOVE.format(k=k, next=k + 1) for k in (0, 1))},
{_ASSIGN.format(k=2)},
codes as (select r, string_agg(lower(printf('%02x', e::integer)), '' order by part) as code, sum(away)::bigint as error from a2 group by r),
books as (select sha256(string_agg(cast(y as varchar), ',' order by part, e, i)) as codebooks_sha256 from (select part, e, unnest(x) as y, unnest(range(len(x))) as i from b2))
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from kept join codes using (r), books
"""
