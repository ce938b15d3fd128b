"""DuckDB SQL of the registered queries, where SQL can express them; literals stand here on their own."""

#: bytes as pairs of hex digits; a string of 50 bytes is 100 digits
OP3 = r"""
with raw as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
sized as (select doc_id, h, length(h) // 2 as n from raw),
starts as (
  select doc_id, u.s as s, substr(h, 2 * u.s + 1, 100) as w
  from (select * from sized where n >= 50) d, lateral (select unnest(range(0, d.n - 49)) as s) u
),
firsts as (select w, min(doc_id) as f from starts group by w having min(doc_id) < max(doc_id)),
hits as (select s.doc_id, s.s from starts s join firsts f on s.w = f.w where f.f < s.doc_id),
gone as (select distinct doc_id, s + u.k as b from hits, lateral (select unnest(range(0, 50)) as k) u),
tops as (select doc_id, b, lag(b) over (partition by doc_id order by b) as before from gone),
spans as (
  select doc_id, b, sum(case when before is null or before < b - 1 then 1 else 0 end) over (partition by doc_id order by b) as g from tops
),
ranges as (select doc_id, g, min(b) as a, max(b) + 1 as z from spans group by doc_id, g),
parts as (
  select doc_id, a, coalesce(lag(z) over (partition by doc_id order by a), 0) as before, z from ranges
),
kept as (
  select p.doc_id, string_agg(substr(s.h, 2 * p.before + 1, 2 * (p.a - p.before)), '' order by p.a)
    || substr(any_value(s.h), 2 * max(p.z) + 1) as h, count(*) as spans, sum(p.z - p.a) as removed
  from parts p join sized s on s.doc_id = p.doc_id group by p.doc_id
)
select s.doc_id, s.n as n_bytes, coalesce(k.removed, 0)::bigint as n_removed, coalesce(k.spans, 0) as n_spans,
  sha256(unhex(coalesce(k.h, s.h))) as kept_sha256
from sized s left join kept k on k.doc_id = s.doc_id
"""

OP4 = r"""
with recursive v as (
  select vec_id, label, embedding::double[] as e, label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 as ok
  from embeddings
),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.ok and b.ok and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.98
),
reach(vec_id, r) as (select vec_id, vec_id from v union select reach.vec_id, l.b from reach join links l on l.a = reach.r)
select r.vec_id, (select count(*) from links l where l.a = r.vec_id) as n_links, min(r.r) as component_id, r.vec_id = min(r.r) as kept
from reach r group by r.vec_id
"""

OP7 = r"""
with places as (
  select coalesce(doc_id, -9223372036854775808) as doc, u.pos - 1 as pos, u.line as line
  from (select doc_id, text from documents where text is not null) d,
       lateral (select unnest(string_split(d.text, chr(10))) as line, unnest(range(1, len(string_split(d.text, chr(10))) + 1)) as pos) u
),
solid as (select * from places where trim(regexp_replace(line, '\s', ' ', 'g')) <> ''),
firsts as (select line, min(row(doc, pos)) as f, length(line) as n from solid group by line),
halves as (
  select line, f, n, 'x' as side, n as l, substr(line, 1, n // 2) as half from firsts where n >= 16
  union all select line, f, n, 'y', n, substr(line, n // 2 + 1) from firsts where n >= 16
  union all select line, f, n, 'x', n - 1, substr(line, 1, (n - 1) // 2) from firsts where n >= 16
  union all select line, f, n, 'y', n - 1, substr(line, n - ((n - 1) - (n - 1) // 2) + 1) from firsts where n >= 16
),
near as (
  select distinct a.line from halves a join halves b on a.side = b.side and a.l = b.l and a.half = b.half and abs(a.n - b.n) <= 1
  where b.f < a.f and levenshtein(a.line, b.line) = 1
),
gone as (
  select s.doc, s.pos from solid s join firsts f on s.line = f.line
  where row(s.doc, s.pos) > f.f or s.line in (select line from near)
)
select d.doc_id,
  case when d.text is null then 0 else len(string_split(d.text, chr(10))) end as n_lines,
  (select count(*) from gone g where g.doc = coalesce(d.doc_id, -9223372036854775808)) as n_dropped,
  sha256(coalesce((select string_agg(p.line, chr(10) order by p.pos) from places p
    where p.doc = d.doc_id and not exists (select 1 from gone g where g.doc = p.doc and g.pos = p.pos)), '')) as kept_sha256
from documents d
"""

OP8 = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
),
shingles as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s
  from words
),
sizes as (select w.doc_id, count(s.s) as n from words w left join shingles s on w.doc_id = s.doc_id group by w.doc_id),
common as (
  select a.doc_id as a, b.doc_id as b, count(*) as k from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
),
links as (
  select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)
),
both_ways as (select a, b from links union select b, a from links),
reach(doc_id, r) as (
  select doc_id, doc_id from sizes union select reach.doc_id, b.b from reach join both_ways b on b.a = reach.r
)
select s.doc_id, s.n as n_shingles, min(r.r) as component_id, s.doc_id = min(r.r) as kept
from sizes s join reach r on r.doc_id = s.doc_id group by s.doc_id, s.n
"""

#: one round of slots by recursion: at each slot the released block with the earliest deadline, ties by name
OP10 = r"""
with recursive counts as (
  select coalesce('s' || source, 'n') as s, count(*) as n from documents group by 1
),
q as (select greatest(1000, 10 * count(*)) as q, count(*) as k from counts),
exact as (select s, power(n, 0.5) * (q.q - q.k) / sum(power(n, 0.5)) over () as e, q.q as q from counts, q),
shares as (
  select s, q, 1 + floor(e)::bigint
    + (case when row_number() over (order by floor(e) - e, s) <= q - sum(1 + floor(e)::bigint) over () then 1 else 0 end) as a
  from exact
),
names as (select list(s order by s) as s, list(a order by s) as a, any_value(q) as q from shares),
slots(t, had, pick) as (
  select -1, list_transform(a, lambda x: 0::bigint), 0::bigint from names
  union all
  select t + 1, list_transform(had, lambda x, i: x + (i = p)::bigint), p from (
    select t, had, q, (list_sort(list_transform(list_filter(range(1, len(a) + 1), lambda i: had[i] < a[i] and had[i] * q // a[i] <= t + 1),
      lambda i: [((had[i] + 1) * q + a[i] - 1) // a[i], i]))[1])[2] as p
    from slots, names where t + 1 < q
  )
),
round_of as (
  select names.s[pick] as s, t, row_number() over (partition by pick order by t) - 1 as k from slots, names where t >= 0
),
ranked as (
  select doc_id, source, coalesce('s' || source, 'n') as s,
    row_number() over (partition by source order by md5(coalesce(doc_id::varchar, ''))) - 1 as r
  from documents
)
select d.doc_id, d.source, (d.r // 8) // h.a * h.q + o.t as mix_slot, (d.r % 8)::int as mix_offset
from ranked d join shares h on h.s = d.s join round_of o on o.s = d.s and o.k = (d.r // 8) % h.a
"""

OP11 = r"""
with docs as (
  select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from documents
),
items as (
  select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from benchmark
),
windows as (
  select distinct item_id, least(len(w), 10) as size, array_to_string(w[u.i:u.i + least(len(w), 10) - 1], ' ') as win
  from (select * from items where len(w) > 0) x, lateral (select unnest(range(1, greatest(len(x.w) - 9, 1) + 1)) as i) u
),
places as (
  select r, s.size, u.i, array_to_string(w[u.i:u.i + s.size - 1], ' ') as win
  from docs d, (select distinct size from windows) s, lateral (select unnest(range(1, greatest(len(d.w) - s.size + 2, 1))) as i) u
),
hits as (select p.r, p.i, p.size, v.item_id from places p join windows v on p.size = v.size and p.win = v.win),
touched as (select r, count(distinct i + u.k) as n from hits h, lateral (select unnest(range(0, h.size)) as k) u group by r),
named as (select r, count(*) as n, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct r, item_id from hits where item_id is not null) group by r)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(t.n, 0)::bigint as n_hit, coalesce(i.n, 0)::bigint as n_items,
  sha256(coalesce(i.ids, '')) as items_sha256, coalesce(t.n, 0) > 0 as contaminated
from docs d left join touched t on t.r = d.r left join named i on i.r = d.r
"""

OP12 = r"""
with docs as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from documents
),
words as (select r, lang, source, unnest(w) as term from docs),
terms as (select lang, term, count(*) as c from words group by lang, term having count(distinct r) >= 30),
sizes as (select lang, count(*) as v, sum(c) as n from terms group by lang),
counts as (select w.lang, w.source, w.term, count(*) as c from words w join terms t on t.lang = w.lang and t.term = w.term group by 1, 2, 3),
groups as (select distinct lang, source from docs),
totals as (
  select g.lang, g.source, coalesce((select sum(c) from counts c where c.lang = g.lang and c.source = g.source), 0)::hugeint as n, coalesce(s.v, 0)::hugeint as v
  from groups g left join sizes s on s.lang = g.lang
),
shares as (
  select g.lang, g.source, t.term, coalesce(c.c, 0) as c, (1 + (1000000000::hugeint * (coalesce(c.c, 0) + 5)) // (g.n + 5 * g.v)) as p,
    1 + (1000000000::hugeint * (t.c + 5)) // (s.n + 5 * s.v) as q
  from totals g join terms t on t.lang = g.lang join sizes s on s.lang = g.lang left join counts c on c.lang = g.lang and c.source = g.source and c.term = t.term
),
pairs as (
  select a.lang, a.source, b.source as item, coalesce((select sum(abs(x.p - y.p)) from shares x join shares y on y.lang = x.lang and y.term = x.term
    where x.lang = a.lang and x.source = a.source and y.source = b.source), 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
),
both_parts as (
  select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all
  select lang, source, 'term', term, (p - q)::bigint, row_number() over (partition by lang, source order by p - q desc, term) from shares where c > 0 and p > q
)
select lang, source, part, item, value, rank::int as rank from both_parts where part = 'pair' or rank <= 50
"""

OP13 = r"""
with docs as (
  select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from documents
),
items as (
  select row_number() over () as i, item_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) as term
  from benchmark
),
size as (select count(*)::bigint as n, sum(len(w))::bigint as l from docs where len(w) > 0),
counts as (select r, term, count(*)::bigint as tf from (select r, unnest(w) as term from docs) group by r, term),
held as (select term, count(*)::bigint as df from counts group by term),
impacts as (
  select c.r, c.term, (floor(1000 * ln((2 * s.n + 2)::double / (2 * h.df + 1)::double)))::bigint
    * ((1000000000 * c.tf) // (1000 * c.tf + 8 * (100 - 75 + (75 * len(d.w)::bigint * s.n) // s.l))) as gain
  from counts c join held h on h.term = c.term join docs d on d.r = c.r, size s
  where c.term in (select term from items)
),
wanted as (select i, item_id, term, count(*)::bigint as k from items group by 1, 2, 3),
scores as (
  select w.i, w.item_id, m.r, sum(w.k * m.gain)::bigint as score from wanted w join impacts m on m.term = w.term group by 1, 2, 3
),
ranked as (
  select s.item_id, row_number() over (partition by s.i order by s.score desc, d.doc_id)::int as rank, d.doc_id, s.score
  from scores s join docs d on d.r = s.r where s.score > 0
)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""

SQL = {"op3_suffix_array_dedup": OP3, "op4_embedding_near_dedup": OP4, "op7_line_dedup": OP7, "op8_minhash_near_dedup": OP8, "op10_source_mixing": OP10, "op11_benchmark_decontamination": OP11,
       "op12_source_divergence": OP12, "op13_ranked_search": OP13}
