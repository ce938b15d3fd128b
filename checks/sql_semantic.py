"""DuckDB SQL for segmentation and vector queries."""

from __future__ import annotations

from checks.sql_text import PLAIN, TILED, TURNS
from stayline.plans.views import SEG_FEATURES, _DOUBLES

UNITS = """with rows0 as (
  select doc_id as video_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents),
units as (
  select video_id, i, i * 12::double + 2 as s, i * 12::double + 2 + least(12::double, length(x) / 40::double) as e from rows0 where length(x) > 0),
vids as (select video_id, max(i) * 12::double + 20 as duration_s from units group by 1),
fresh as (select *, case when s - lag(e) over (partition by video_id order by i) >= 5 then 1 else 0 end as f from units),
numbered as (select *, sum(f) over (partition by video_id order by i)::bigint as run from fresh),
runs0 as (
  select video_id, run, count(*)::int as n_units, min(s) as s, arg_max(e, i) as e, min(i) as w0, max(i) + 1 as w1 from numbered group by 1, 2),
runs as (
  select r.*, duration_s, lead(s) over w as next_s, lead(w0) over w as next_w, row_number() over w = 1 as first
  from runs0 r join vids using (video_id) window w as (partition by video_id order by run))"""

EMB = """emb as (
  select vec_id // 50 as video_id, (vec_id % 50)::int as idx, (vec_id % 50) * 12::double as start,
         (vec_id % 50) * 12::double + 12 as "end", embedding::double[] as v from embeddings)"""

_INNER = SEG_FEATURES.replace("{id}", "event_id // 50").replace("{pos}", "(event_id % 50)::int").replace(
    "{k}", "json_extract_string(props, '$.k')::int"
).replace("as end,", 'as "end",')
for _n in ("1000.0", "500.0", "400.0", "100.0", "50.0", "10.0"):
    _INNER = _INNER.replace(f"/ {_n}", f"/ {_n[:-2]}::double")
SEGF = (
    "with segf0 as (select * from " + _INNER + "),\nsegf as (select * replace ("
    + ", ".join(f'"{c}"::double as "{c}"' for c in _DOUBLES) + ") from segf0)"
)

VECS = """,
stoks as (select video_id, sent_idx as idx, start, "end", len(tokens) >= 4 as eligible, unnest(case when len(tokens) = 0 then [null] else tokens end) as tok from sf),
sdims as (select video_id, idx, start, "end", eligible, case when tok is null then 0 else ('0x' || substr(md5(tok), 1, 8))::bigint % 256 end as dim, count(*) as c
  from stoks group by all),
snorm as (select video_id, idx, sqrt(sum(c * c)) as n from sdims group by 1, 2),
svec as (select d.*, c / n as w from sdims d join snorm using (video_id, idx)),
ssims as (
  select b.video_id, b.idx, a.idx as match, round(sum(a.w * b.w), 9) as sim
  from svec b join svec a on a.video_id = b.video_id and a.dim = b.dim and a.idx < b.idx and a."end" <= b.start - 20
  where a.eligible and b.eligible group by 1, 2, 3),
best as (
  select video_id, idx, arg_max(match, struct_pack(a := sim, b := -match)) as match, max(sim) as sim from ssims group by 1, 2 having max(sim) >= 0.527)"""

TOPIC = """,
sides as (
  select video_id, idx, start, min(start) over (partition by video_id) as first_start, count(*) over (partition by video_id) as n, v,
         lag(v, 1) over w as l1, lag(v, 2) over w as l2, lead(v, 1) over w as r1 from emb window w as (partition by video_id order by idx)),
lr as (
  select video_id, idx, start, first_start, case when l2 is null then l1 else list_transform(l1, lambda x, i: x + l2[i]) end as l,
         case when r1 is null then v else list_transform(v, lambda x, i: x + r1[i]) end as r from sides where l1 is not null and n >= 3),
gaps as (
  select video_id, idx, start, first_start,
         round(list_inner_product(l, r) / (sqrt(list_inner_product(l, l)) * sqrt(list_inner_product(r, r))), 9) as gap from lr),
g as (select *, lag(gap) over w as p, lead(gap) over w as q from gaps window w as (partition by video_id order by idx)),
peaks as (
  select a.video_id, a.idx, a.start, a.first_start, a.gap, a.p, a.q,
    (select b.gap from g b where b.video_id = a.video_id and b.idx <= a.idx and (b.p is null or b.p < b.gap) order by b.idx desc limit 1) as lp,
    (select b.gap from g b where b.video_id = a.video_id and b.idx >= a.idx and (b.q is null or b.q < b.gap) order by b.idx limit 1) as rp
  from g a),
depths as (select *, round(lp + rp - 2 * gap, 9) as depth, coalesce(gap <= p, true) and coalesce(gap <= q, true) as is_minimum from peaks)"""

def prev3(col):
    return f"(select avg(x) from (select b.{col} as x from segf b where b.video_id = s.video_id and b.idx < s.idx and b.{col} is not null order by b.idx desc limit 3) q)"


SQL = {
    "speech_runs": UNITS + """
select video_id, run, n_units, s, e, case when first and s < 5 then 0 else s end as a,
       case when next_s is null and duration_s - e < 5 then duration_s else e end as b from runs""",
    "silence_segments": UNITS + """,
spans as (
  select video_id, 0::double as a, s as b, w0 as w from runs where first and s >= 5
  union all select video_id, e, next_s, next_w from runs where next_s is not null
  union all select video_id, e, duration_s, w1 from runs where next_s is null and duration_s - e >= 5),
sized as (select *, greatest(1, ceil((b - a) / 15 - 1e-9::double))::int as n from spans),
cut as (select *, unnest(range(0, n)) as m from sized)
select video_id, round(a + m * ((b - a) / n), 4) as start, round(case when m = n - 1 then b else a + (m + 1) * ((b - a) / n) end, 4) as "end",
       w::int as word_start from cut""",
    "tile_invariants": PLAIN + """
select video_id, 0 as gaps, true as from_zero, round(max("end") + 0.5::double, 3) as duration_s, round(max("end") + 0.5::double, 3) as covered_s,
       max(word_idx) + 1 as n_words, 0 as too_long from words group by 1""",
    "hash_embed": TURNS + """,
toks as (select video_id, sent_idx, unnest(case when len(tokens) = 0 then [null] else tokens end) as tok from feats),
d as (select video_id, sent_idx, (case when tok is null then 0 else ('0x' || substr(md5(tok), 1, 8))::bigint % 256 end)::int as dim, count(*) as c from toks group by all)
select video_id, sent_idx, dim, round(c / sqrt(sum(c * c) over (partition by video_id, sent_idx)), 6) as w from d""",
    "cosine": "with " + EMB + """
select a.video_id, a.idx, round(list_inner_product(a.v, b.v), 6) as cosine from emb a join emb b on a.video_id = b.video_id and b.idx = 0""",
    "sentence_matches": TILED + VECS + " select video_id, idx, match, round(sim, 6) as sim from best",
    "segment_repetition": "with " + EMB + """,
p as (select a.video_id, a.idx, b.idx as j, round(list_inner_product(a.v, b.v), 9) as sim from emb a left join emb b
  on a.video_id = b.video_id and b.idx < a.idx and b."end" <= a.start - 20)
select video_id, idx, round(max(sim), 6) as sim, arg_max(j, struct_pack(a := sim, b := -j)) filter (where sim is not null) as match,
       count(*) filter (where sim >= 0.3::double) as n_similar from p group by 1, 2""",
    "repeated_sentence_ratio": TILED + VECS + """,
per as (select n.video_id, floor(n.start / 12)::int as idx, n.sent_idx, count(*) as c from numbered n group by all),
j as (select p.*, b.match, b.sim from per p left join best b on b.video_id = p.video_id and b.idx = p.sent_idx)
select video_id, idx, round_even(sum(case when sim is not null then c else 0 end) / sum(c)::double, 4) as repeated_sentence_ratio,
       least(3, count(sim))::int as n_matches, max(round_even(sim, 4)) as top_similarity from j group by 1, 2""",
    "novelty": "with " + EMB + """
select a.video_id, a.idx, round(1 - max(list_inner_product(a.v, b.v)), 6) as novelty from emb a left join emb b
  on a.video_id = b.video_id and b.idx < a.idx group by 1, 2""",
    "information_gain": "with " + EMB + """,
pairs as (select a.video_id, a.idx, b.v from emb a join emb b on a.video_id = b.video_id and b.idx < a.idx and b."end" > a.start - 60),
dims as (select video_id, idx, unnest(v) as x, generate_subscripts(v, 1) as d from pairs),
cent as (select video_id, idx, d, avg(x) as c from dims group by all),
cvec as (select video_id, idx, list(c order by d) as c from cent group by 1, 2)
select e.video_id, e.idx, round(1 - list_inner_product(e.v, c) / sqrt(list_inner_product(c, c)), 6) as information_gain
from emb e left join cvec using (video_id, idx)""",
    "topic_shift": "with " + EMB + """
select video_id, idx, round(1 - list_inner_product(v, lag(v) over (partition by video_id order by idx)), 6) as topic_shift from emb""",
    "topic_depths": "with " + EMB + TOPIC + " select video_id, idx, round(gap, 6) as gap, round(depth, 6) as depth, is_minimum from depths",
    "topic_sections": SEGF + """,
t as (select *, sum(topic_boundary::int) over (partition by video_id order by idx)::int as topic from segf)
select video_id, topic, min(start) as start, max("end") as "end", min(idx) as first_segment, max(idx) as last_segment from t group by 1, 2""",
    "model_features": SEGF + f"""
select video_id, idx, round(start / duration_s, 6) as rel_start, round("end" / duration_s, 6) as rel_end, round(ln(1 + start), 6) as log_start_s,
  "end" - start as seg_duration_s, (idx = 0)::int::double as is_first, (kind = 'silence')::int::double as is_silence,
  round(pace_ratio, 6) as pace_ratio, round(semantic_novelty, 6) as semantic_novelty, round(information_gain, 6) as information_gain,
  round(repetition_similarity, 6) as repetition_similarity, round(repeated_sentence_ratio, 6) as repeated_sentence_ratio, repetition_count::double as repetition_count,
  round(topic_shift, 6) as topic_shift, topic_boundary::int::double as topic_boundary,
  round({prev3('semantic_novelty')}, 6) as novelty_prev3_mean, round({prev3('information_gain')}, 6) as gain_prev3_mean,
  round(start - coalesce((select max(b.start) from segf b where b.video_id = s.video_id and b.idx <= s.idx and b.topic_boundary), 0), 6) as s_since_topic_start
from segf s""",
}
