"""DuckDB SQL for audio and picture queries."""

from __future__ import annotations

from checks.sql_semantic import EMB

LOUD = """loud as (
  select event_id // 500 as video_id, (event_id % 500)::int as k, 10 * log10(value * value + 1e-10::double) as db from events),
thr as (select video_id, quantile_cont(db, 0.95) - 35 as threshold_db, quantile_cont(db, 0.05) as p5 from loud group by 1),
med as (select video_id, quantile_cont(db, 0.5) as voiced_median from loud join thr using (video_id) where db >= threshold_db group by 1)"""


def tiles(src, n, width, length):
    return f"""tiles as (
  select video_id, idx, idx * {width}::double as start, least((idx + 1) * {width}::double, {length}::double) as "end",
         case when idx % 4 = 3 then 'silence' else 'speech' end as kind
  from (select distinct video_id from {src}) d, (select unnest(range(0, {n}))::int as idx) r)"""


SAMPLES = """chunks as (select vec_id // 50 as video_id, (vec_id % 50) * 64 as first, embedding as s from embeddings),
samples as (select video_id, first + generate_subscripts(s, 1) - 1 as p, unnest(s) as xf, unnest(s)::double as x from chunks)"""
PITCH = """pitch as (
  select event_id // 500 as video_id, (event_id % 500)::int as i, case when event_type <> 'error' then 70 + value % 330 end as f0 from events)"""
VOICED = """,
voiced as (
  select p.*, f0 is not null and coalesce(l.db >= t.threshold_db, false) as voiced
  from pitch p join (select video_id, max(k) as last from loud group by 1) m using (video_id)
  left join loud l on l.video_id = p.video_id and l.k = least(floor(p.i * 0.05::double / 0.1::double)::int, m.last)
  left join thr t on t.video_id = p.video_id)"""
SEMI = """,
st0 as (select *, 12 * log2(f0 / 100) as st from %s),
st as (select a.video_id, a.i, any_value(a.st) as st, case when any_value(a.st) is not null then quantile_cont(b.st, 0.5) end as semitone
  from st0 a join st0 b on a.video_id = b.video_id and b.i between a.i - 2 and a.i + 2 group by 1, 2)"""
PICS = "with recursive " + EMB + """,
pics as (select video_id, idx as i, list_transform(v, lambda x: floor((x + 1) * 127.5::double)::int) as px from emb),
d0 as (select video_id, i, px, lag(px) over (partition by video_id order by i) as q from pics),
diffs as (select video_id, i, case when q is null then 0 else list_sum(list_transform(px, lambda x, j: abs(x - q[j]))) / len(px)::double / 255 end as diff from d0)"""
CUTS = """,
local as (select a.video_id, a.i, a.diff, coalesce(median(b.diff), 0) as med from diffs a left join diffs b
  on a.video_id = b.video_id and b.i between a.i - 5 and a.i + 5 and b.i <> a.i and b.i > 0 where a.i > 0 group by all),
jumps as (select video_id, round(i / 0.5::double, 3) as t from local where diff >= 0.05::double and diff >= 1.1::double * med),
kept as (
  select video_id, min(t) as t, 0 as n from jumps group by 1
  union all
  select k.video_id, (select min(j.t) from jumps j where j.video_id = k.video_id and j.t - k.t >= 5) as t, n + 1 from kept k
  where exists (select 1 from jumps j where j.video_id = k.video_id and j.t - k.t >= 5))"""
LABELS = "with labels as (select vec_id // 50 as video_id, (vec_id % 50)::int as i, 'type' || (label // 4) as label, embedding::double[] as v from embeddings)"

SQL = {
    "frame_db": "with " + SAMPLES + """,
f as (select video_id, p, x, unnest(range(greatest(ceil((p - 15) / 6::double), 0)::bigint, p // 6 + 1)) as k from samples)
select video_id, k::int as k, round(10 * log10(avg(x * x) + 1e-10::double), 4) as db from f group by 1, 2 having count(*) = 16""",
    "silence_threshold": "with " + LOUD + " select video_id, round(threshold_db, 4) as threshold_db from thr",
    "snr": "with " + LOUD + " select video_id, round_even(voiced_median - p5, 2) as snr_db from thr left join med using (video_id)",
    "segment_audio": "with " + LOUD + "," + tiles("loud", 5, 12, 50) + """
select t.video_id, t.idx, round_even(1 - count(*) filter (where db >= threshold_db) / count(*)::double, 4) as silence_ratio,
  round_even(avg(db) filter (where db >= threshold_db) - coalesce(any_value(voiced_median), 0), 3) as energy_db,
  round_even(case when count(*) filter (where db >= threshold_db) > 1 then stddev_pop(db) filter (where db >= threshold_db) end, 3) as energy_variation_db
from tiles t join loud l on l.video_id = t.video_id and l.k * 0.1::double + 0.0125::double >= t.start - 1e-9 and l.k * 0.1::double + 0.0125::double < t."end" - 1e-9
join thr on thr.video_id = t.video_id left join med on med.video_id = t.video_id group by 1, 2""",
    "clipping_ratio": "with " + SAMPLES + "," + tiles("chunks", 5, 1.2, 5) + """
select t.video_id, t.idx, round_even(avg((abs(xf) >= 0.25::float)::int), 5) as clipping_ratio
from tiles t join samples s on s.video_id = t.video_id and s.p >= floor(t.start * 640) and s.p < floor(t."end" * 640) group by 1, 2""",
    "voiced_mask": "with " + LOUD + "," + PITCH + VOICED + " select video_id, i, voiced from voiced",
    "smooth_pitch": "with " + PITCH + SEMI % "pitch" + " select video_id, i, round(semitone, 4) as semitone from st",
    "segment_pitch": "with " + LOUD + "," + PITCH + VOICED + SEMI % "voiced" + "," + tiles("loud", 9, 3, 25) + """,
per as (
  select t.video_id, t.idx, count(*) * 0.05::double as s, round_even(quantile_cont(semitone, 0.9) - quantile_cont(semitone, 0.1), 3) as r
  from tiles t join voiced v on v.video_id = t.video_id and v.i * 0.05::double >= t.start - 1e-9 and v.i * 0.05::double < t."end" - 1e-9
  join st on st.video_id = v.video_id and st.i = v.i where v.voiced group by 1, 2),
j as (select t.*, case when round(s, 2) >= 2 then r end as pitch_range_st from tiles t left join per using (video_id, idx))
select video_id, idx, pitch_range_st,
  round_even(pitch_range_st / nullif(quantile_cont(case when kind = 'speech' then pitch_range_st end, 0.5) over (partition by video_id), 0), 3) as pitch_range_ratio from j""",
    "pitch_median_hz": "with " + LOUD + "," + PITCH + VOICED + " select video_id, round_even(quantile_cont(f0, 0.5), 1) as pitch_median_hz from voiced where voiced group by 1",
    "frame_diffs": PICS + " select video_id, i, round(diff, 6) as diff from diffs",
    "scene_cuts": PICS + CUTS + " select video_id, n, t from kept",
    "segment_visual": PICS + CUTS + "," + tiles("emb", 9, 12, 100) + """,
f as (select t.video_id, t.idx, t.start, t."end", d.i, d.diff, d.diff < 0.055::double as st from tiles t join diffs d
  on d.video_id = t.video_id and d.i > 0 and d.i / 0.5::double >= t.start and d.i / 0.5::double < t."end"),
r as (select *, sum((not st)::int) over (partition by video_id, idx order by i) as run from f),
runs as (select video_id, idx, run, count(*) filter (where st) as len from r group by 1, 2, 3),
per as (select video_id, idx, start, "end", avg(diff) as m, avg(st::int) as s from f group by all)
select p.video_id, p.idx, (select count(*) from kept k where k.video_id = p.video_id and k.t >= p.start and k.t < p."end")::int as scene_cut_count,
  round_even((select count(*) from kept k where k.video_id = p.video_id and k.t >= p.start and k.t < p."end") * 60 / (p."end" - p.start), 4) as cuts_per_minute,
  round_even(m, 5) as visual_change_mean, round_even(s, 4) as static_ratio,
  round_even((select max(len) from runs r where r.video_id = p.video_id and r.idx = p.idx) / 0.5::double, 3) as longest_static_s,
  round_even(p."end" - coalesce((select max(t) from kept k where k.video_id = p.video_id and k.t < p."end"), 0), 3) as seconds_since_cut
from per p""",
    "classify_frames": "with " + EMB + """,
lab as (select label, embedding::double[] as v from embeddings where label < 7),
td as (select label, generate_subscripts(v, 1) as d, unnest(v) as x from lab),
tm as (select label, d, avg(x) as x from td group by 1, 2),
tv0 as (select label, list(x order by d) as v from tm group by 1),
tv as (select 'type' || label as key, list_transform(v, lambda x: x / (sqrt(list_inner_product(v, v)) + 1e-12::double)) as v from tv0),
z as (select e.video_id, e.idx as i, key, 20 * list_inner_product(e.v, tv.v) as z from emb e, tv),
s as (select video_id, i, arg_max(key, z) as best, max(z) as top, list(z) as zs from z group by 1, 2),
c as (select video_id, i, best, 1 / list_sum(list_transform(zs, lambda x: exp(x - top))) as conf from s)
select video_id, i, case when conf >= 0.35::double then best else 'unclear' end as label, round(conf, 4) as confidence from c""",
    "label_islands": LABELS + """,
m as (select *, row_number() over (partition by video_id order by i) - row_number() over (partition by video_id, label order by i) as g from labels)
select video_id, label, min(i) / 0.5::double as start, (max(i) + 1) / 0.5::double as "end" from m group by video_id, label, g""",
    "segment_content": LABELS + "," + tiles("labels", 9, 12, 100) + """,
f as (select t.video_id, t.idx, l.label, case when kind = 'speech' and s.v is not null then list_inner_product(l.v, s.v) end as dot
  from tiles t join labels l on l.video_id = t.video_id and l.i / 0.5::double >= t.start and l.i / 0.5::double < t."end"
  left join labels s on s.video_id = t.video_id and s.i = t.idx * 6),
per as (select video_id, idx, label, count(*) as n, sum(dot) as dot from f group by 1, 2, 3),
best as (select *, row_number() over (partition by video_id, idx order by n desc, label) as r from per),
top as (select video_id, idx, max(label) filter (where r = 1) as visual_type, round_even(max(n) / sum(n)::double, 3) as visual_type_share,
  round_even(sum(dot) / sum(n)::double, 4) as speech_match from best group by 1, 2)
select *, round_even(speech_match / nullif(quantile_cont(speech_match, 0.5) over (partition by video_id), 0), 3) as speech_match_ratio from top""",
}
