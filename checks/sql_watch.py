"""DuckDB SQL for the watch-log queries."""

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

WATCH = """
watch as (
  select user_id as viewer_id, event_type as video_id,
         (epoch_us(ts) % 600000000) / 1e6::double as start_point,
         least((epoch_us(ts) % 600000000) / 1e6::double + value * 0.6::double, 600::double) as end_point
  from events)"""

LECTURE_WATCH = """
watch as (
  select event_type || '-' || (day(ts) % 7) as viewer_id, 'u' || user_id as video_id,
         (epoch_us(ts) % 600000000) / 1e6::double as start_point,
         least((epoch_us(ts) % 600000000) / 1e6::double + value * 0.6::double, 600::double) as end_point
  from events)"""


def chain(tol):
    return f"""
entries as (
  select viewer_id, video_id, min(start_point) as first, max(end_point) as last, count(*) as n
  from watch group by all),
lec as (
  select video_id, count(*) as n_viewers, count(*) filter (where first <= {tol}) as n_starters,
         max(last) as duration_s, sum(n)::bigint as lines
  from entries group by 1),
norm as (
  select viewer_id, video_id, least(start_point, end_point) s, greatest(start_point, end_point) e from watch),
marked as (
  select *, case when s <= max(e) over (partition by viewer_id, video_id order by s, e
            rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from norm),
numbered as (
  select *, sum(fresh) over (partition by viewer_id, video_id order by s, e) as island from marked),
merged as (
  select viewer_id, video_id, min(s) as s, max(e) as e from numbered group by viewer_id, video_id, island),
anchored as (
  select viewer_id, video_id, case when s = min(s) over (partition by viewer_id, video_id) and s <= {tol}
         then 0 else s end as s, e from merged),
spans as (
  select a.video_id, greatest(0, floor(s))::int as a, least(ceil(duration_s), ceil(e))::int as b
  from anchored a join lec using (video_id) join entries n using (viewer_id, video_id)
  where n.first <= {tol}),
deltas as (
  select video_id, t, sum(d)::bigint as delta from (
    select video_id, a as t, 1 as d from spans where b > a
    union all select video_id, b, -1 from spans where b > a) group by 1, 2),
grid as (select video_id, n_starters, unnest(range(0, ceil(duration_s)::int)) as t from lec),
curve as (
  select g.video_id, g.t, sum(coalesce(delta, 0)) over (partition by g.video_id order by g.t)::bigint as watching,
         sum(coalesce(delta, 0)) over (partition by g.video_id order by g.t) / greatest(n_starters, 1)::double as retention
  from grid g left join deltas d on d.video_id = g.video_id and d.t = g.t),
tiles0 as (
  select video_id, duration_s, unnest(range(0, greatest(ceil(duration_s / 12), 1)::int)) as idx from lec),
tiles as (
  select video_id, idx, duration_s, idx * 12::double as start, least((idx + 1) * 12::double, duration_s) as "end" from tiles0),
ends as (
  select t.*, c0.retention as r0, c1.retention as r1
  from tiles t join lec l using (video_id)
  join curve c0 on c0.video_id = t.video_id and c0.t = least(ceil(l.duration_s)::int - 1, floor(start)::int)
  join curve c1 on c1.video_id = t.video_id
   and c1.t = least(ceil(l.duration_s)::int - 1, greatest(0, ceil("end")::int - 1))),
haz as (
  select video_id, idx, duration_s, start, "end", r1 as actual_r,
         case when r0 <= 0 then 0 else greatest(0, least(1, 1 - r1 / r0)) end as hazard,
         ln(greatest(r0, 1e-3::double) / greatest(r1, 1e-3::double)) / greatest("end" - start, 1e-3::double) as signed_rate,
         start / duration_s as rel_start, "end" / duration_s as rel_end,
         case when ('0x' || substr(sha256(video_id), 1, 8))::bigint % 10000 < 2000 then 'test' else 'train' end as split
  from ends)"""


BASE = "with" + WATCH + "," + chain(30)
LECT = "with" + LECTURE_WATCH + "," + chain(60)
PROD = """product(1 - greatest(0, least(1, hazard))) over (partition by video_id order by idx)"""

CAPS = r"""
caps as (
  select doc_id::varchar as ccid, string_split(text, chr(10)) as text from documents),
lines0 as (
  select ccid, unnest(text) as t, generate_subscripts(text, 1) - 1 as i from caps),
lines as (select ccid, t, i, i * 4.0::double as s, i * 4.0::double + length(t) / 10.0::double as e from lines0)"""

ASR = """with l as (
  select doc_id as video_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i,
         len(string_split(text, chr(10))) as n from documents),
w0 as (select video_id, i, n, list_filter(string_split(x, ' '), lambda w: w <> '') as ws from l),
w1 as (select video_id, i, n, unnest(ws) as w, generate_subscripts(ws, 1) - 1 as j from w0),
w2 as (select video_id, i, n, j, regexp_replace(w, '^""" + WS + "+|" + WS + """+$', '', 'g') as text,
    round_even(i * 10::double + j * 0.37::double - (j % 4) * 0.5::double, 3) as s, round_even(i * 10::double + j * 0.37::double + 0.3::double - (j % 5) * 0.1::double, 3) as e,
    0.5::double + (j % 5) / 10::double as p from w1 where j % 7 <> 6),
asr as (select video_id, row_number() over o - 1 as word_idx, text, max(s) over (o rows unbounded preceding) as start, e, p,
    coalesce(lead(i) over o <> i, true) and i < n - 1 as phrase_break from w2 where text <> '' window o as (partition by video_id order by i, j))"""

SQL = {
    "src_asr_words": ASR + """ select video_id, word_idx, text, start, greatest(e, start) as "end", round(p, 2) as confidence, phrase_break from asr""",
    "asr_confidence": ASR + " select video_id, round_even(avg(p), 4) as mean_confidence from asr group by 1",
    "rate_to_hazard": BASE + """
select video_id, idx, round(1 - exp(-greatest(signed_rate, 0) * greatest("end" - start, 0)), 6) as hazard from haz""",
    "src_watch_log": "with" + WATCH + """
select viewer_id::varchar as viewer_id, 0 as entry, video_id, round(start_point, 6) as start_point,
       round(end_point, 6) as end_point from watch where video_id <> 'error'""",
    "src_id_map": """select o_orderkey::varchar as video_id, o_orderpriority as ccid from orders
where o_orderpriority not like '% %'""",
    "src_captions": "with" + CAPS + """
select ccid, round(max(e), 4) as duration_s, count(*)::int as lines from lines group by 1""",
    "src_caption_words": "with recursive" + CAPS + r""",
kept as (
  select ccid, s, e, regexp_replace(t, '""" + WS + r"""', '', 'g') as c,
         row_number() over (partition by ccid order by s, e, t) as k
  from lines where e > s and regexp_replace(t, '""" + WS + r"""', '', 'g') <> ''),
clamp as (
  select ccid, k, c, greatest(s, 0) as s, greatest(e, greatest(s, 0) + 0.01::double) as e from kept where k = 1
  union all
  select n.ccid, n.k, n.c, greatest(n.s, round(p.e, 3)) as s, greatest(n.e, greatest(n.s, round(p.e, 3)) + 0.01::double) as e
  from clamp p join kept n on n.ccid = p.ccid and n.k = p.k + 1)
select ccid as video_id, (k - 1)::int as sent_idx, length(c) as n_words, round(s, 3) as start, round(e, 3) as "end",
       c[1] as first_char, c[length(c)] as last_char from clamp""",
    "merge_intervals": BASE + """
select viewer_id, video_id, round(s, 6) as start, round(e, 6) as "end" from merged""",
    "anchor_start": BASE + """
select viewer_id, video_id, round(s, 6) as start, round(e, 6) as "end" from anchored""",
    "viewer_counts": BASE + " select video_id, n_viewers, n_starters from lec",
    "qualify_topk": LECT + """
select video_id, n_starters, n_viewers, round(duration_s, 6) as duration_s, lines from lec
where n_starters >= 3 and duration_s between 180 and 1500 and lines >= 20
order by n_starters desc, video_id limit 40""",
    "coverage_diff": BASE + " select video_id, t, delta from deltas",
    "retention_curve": BASE + " select video_id, t, watching, round(retention, 6) as retention from curve",
    "hash_split": """select doc_id, case when ('0x' || substr(sha256(doc_id::varchar), 1, 8))::bigint % 10000 < 2000
then 'test' else 'train' end as split from documents""",
    "segment_hazard": BASE + """
select video_id, idx, round(start, 6) as start, round("end", 6) as "end", round(hazard, 6) as hazard from haz""",
    "actual_at_end": BASE + " select video_id, idx, round(actual_r, 6) as actual_r from haz",
    "hazard_to_rate": BASE + """,
rates as (select *, -ln(1 - greatest(0, least(0.999::double, hazard))) / greatest("end" - start, 1e-3::double) as rate from haz)
select video_id, idx, round(rate, 6) as rate,
       round(1 - exp(-greatest(rate, 0) * greatest("end" - start, 0)), 6) as hazard_back from rates""",
    "signed_rate": BASE + " select video_id, idx, round(signed_rate, 6) as signed_rate from haz",
    "curve_from_hazard": BASE + f"select video_id, idx, round({PROD}, 6) as retention from haz",
}
