"""DuckDB SQL for fitting, prediction and validation."""

from __future__ import annotations

from checks.sql_semantic import SEGF
from checks.sql_watch import LECT, WS

BASE = LECT + """,
rates as (select *, -ln(1 - greatest(0, least(0.999::double, hazard))) / greatest("end" - start, 1e-3::double) as y,
    case when idx = 0 then -1 else least(19, floor(rel_start * 20))::int end as bin, least(9, floor(rel_end * 10))::int as bbin from haz),
per as (select bin, avg(y) as rate from rates where split = 'train' group by 1),
table0 as (
  select b.bin, coalesce(rate, (select avg(y) from rates where split = 'train' and idx > 0)) as rate
  from (select unnest(range(-1, 20))::int as bin) b left join per on per.bin = b.bin),
pred as (
  select r.*, t.rate, 1 - exp(-greatest(t.rate, 0) * greatest("end" - start, 0)) as p from rates r join table0 t on t.bin = r.bin),
tiles2 as (
  select *, p * (0.5::double + (('0x' || substr(md5(video_id || ':' || idx), 1, 8))::bigint % 1000) / 1000::double) as score,
    product(1 - greatest(0, least(1, p))) over (partition by video_id order by idx) as raw from pred)"""
FIT = BASE + """,
kgrid as (select 0.1::double + i * 0.01::double as k from (select unnest(range(0, 191)) as i)),
mses as (select k, avg(pow(pow(raw, k) - actual_r, 2)) as mse from tiles2, kgrid where split = 'train' group by 1),
kfit as (select arg_min(k, struct_pack(a := mse, b := k)) as k, min(mse) as mse from mses)"""
CAL = FIT + """,
cal as (select t.*, min(least(1, greatest(0, pow(raw, k)))) over (partition by video_id order by idx) as r from tiles2 t, kfit),
band0 as (select bbin, quantile_cont(actual_r - r, 0.1) as lo, quantile_cont(actual_r - r, 0.9) as hi from cal where split = 'train' group by 1),
band as (select b.bin, coalesce(lo, 0) as lo, coalesce(hi, 0) as hi from (select unnest(range(0, 10))::int as bin) b left join band0 on bbin = bin),
banded as (select c.*, b.lo, b.hi from cal c join band b on b.bin = c.bbin)"""
DROPS = BASE + """,
dbase as (select b.bin, greatest(coalesce(avg((r.hazard >= 0.05::double)::int), 0), 1e-3::double) as base
  from (select unnest(range(0, 20))::int as bin) b left join rates r on r.split = 'train' and r.idx > 0 and r.bin = b.bin group by 1)"""
CURVE = CAL + """,
lim as (select *, min(least(1, greatest(0, r + lo))) over (partition by video_id order by idx) as l, least(1, greatest(0, r + hi)) as h from banded),
imp as (select *, least(1, greatest(0, 1 - r / greatest(coalesce(lag(r) over w, 1), 1e-9::double))) as pd,
    least(1, greatest(0, 1 - h / greatest(coalesce(lag(h) over w, 1), 1e-9::double))) as pl,
    least(1, greatest(0, 1 - l / greatest(coalesce(lag(l) over w, 1), 1e-9::double))) as ph from lim window w as (partition by video_id order by idx)),
points as (select video_id, idx, "end" as t, round_even(r, 4) as retention, round_even(least(l, r), 4) as lower, round_even(greatest(h, r), 4) as upper,
    round_even(pd, 4) as p_drop, round_even(least(pl, pd), 4) as p_drop_low, round_even(greatest(ph, pd), 4) as p_drop_high from imp)"""


def detect(split, thresholds):
    return f""",
u as (select * from tiles2 where split = '{split}' and idx > 0),
th as (select unnest({thresholds})::double as threshold),
act as (select * from u where hazard >= 0.05::double),
nearp as (select a.video_id, a.idx, q.idx as j, q.score, abs(q.start - a.start) as d from act a join u q on q.video_id = a.video_id
  and a.start - 10 <= q."end" and q.start <= a."end" + 10),
cnt as (select threshold,
   (select count(distinct (n.video_id, n.idx)) from nearp n where n.score >= threshold) as detected, (select count(*) from act) as total,
   (select count(distinct (n.video_id, n.j)) from nearp n where n.score >= threshold) as hits, (select count(*) from u where u.score >= threshold) as predicted from th),
pr as (select *, coalesce(hits / nullif(predicted, 0)::double, 0) as p, coalesce(detected / nullif(total, 0)::double, 0) as r from cnt),
detection as (select threshold, detected, total, hits, predicted, round(p, 3) as precision, round(r, 3) as recall,
   round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 3) as f1 from pr)"""


RANKS = """,
x0 as (select video_id, idx, actual_r, hazard, p, raw from tiles2 where split = 'test'),
x as (select *, round(raw, 12) as c, round(actual_r, 12) as a, round(hazard, 12) as h, round(p, 12) as q from x0),
rc as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2::double as ra, rank() over (order by c) + (count(*) over (partition by c) - 1) / 2::double as rb from x),
rh as (select rank() over (order by h) + (count(*) over (partition by h) - 1) / 2::double as ra, rank() over (order by q) + (count(*) over (partition by q) - 1) / 2::double as rb from x where idx > 0),
rw as (select video_id, h, q, rank() over (partition by video_id order by h) + (count(*) over (partition by video_id, h) - 1) / 2::double as ra,
   rank() over (partition by video_id order by q) + (count(*) over (partition by video_id, q) - 1) / 2::double as rb from x where idx > 0),
wv as (select video_id, corr(ra, rb) as rho from rw group by 1 having count(*) > 2 and stddev_pop(h) > 0 and stddev_pop(q) > 0)"""
TOPK = """,
ranked as (select video_id, row_number() over (partition by video_id order by %s desc, idx) as rank, (start + "end") / 2 as t from tiles2 where idx > 0),
top as (select * from ranked where rank <= 5)"""
SCORE = """,
drops as (select video_id, idx, start, "end" from tiles2 where idx > 0 and hazard >= 0.05::double)"""
REPLIES = """replies as (
  select event_id, 'u' || user_id as video_id, case event_type when 'view' then 'json' when 'click' then 'text' else 'none' end as kind,
    case event_type when 'view' then [trunc(value)::double, (event_id % 700) + 0.5::double, 999]
      when 'click' then [(event_id % 900)::double, trunc(value) + 0.25::double, 31] else [] end::double[] as nums from events),
parsed as (select event_id, video_id, list_filter(nums, lambda x: x >= 0 and x <= 600) as points from replies)"""
SCORED = f"""scored as (
  select doc_id, lang as grp, round(length(text) / len(list_filter(string_split_regex(text, '{WS}+'), lambda x: x <> ''))::double, 2) as score, quality as label
  from documents join labels using (doc_id))"""
AUC = "count(*) filter (where label = 1) as n_pos, count(*) filter (where label = 0) as n_neg"

FEATS = """rel_start rel_end log_start_s is_first is_silence pace_ratio semantic_novelty information_gain repetition_similarity repeated_sentence_ratio
repetition_count topic_shift topic_boundary novelty_prev3_mean gain_prev3_mean s_since_topic_start""".split()
#: lecture segments with observed drops, and measured features where a video has the lecture's number
MATRIX = LECT + ", " + SEGF.removeprefix("with ") + """,
nov3 as (select video_id, idx, avg(semantic_novelty) over (partition by video_id order by idx rows between 2 preceding and current row) as m from segf where semantic_novelty is not null),
gain3 as (select video_id, idx, avg(information_gain) over (partition by video_id order by idx rows between 2 preceding and current row) as m from segf where information_gain is not null),
meas as (
  select s.video_id, s.idx, (s.kind = 'silence')::int::double as is_silence, s.pace_ratio, s.semantic_novelty, s.information_gain, s.repetition_similarity,
    s.repeated_sentence_ratio, s.repetition_count::double as repetition_count, s.topic_shift, s.topic_boundary::int::double as topic_boundary,
    n.m as novelty_prev3_mean, g.m as gain_prev3_mean,
    s.start - coalesce(max(case when s.topic_boundary then s.start end) over (partition by s.video_id order by s.idx), 0) as s_since_topic_start
  from segf s asof left join nov3 n on n.video_id = s.video_id and n.idx < s.idx asof left join gain3 g on g.video_id = s.video_id and g.idx < s.idx),
matrix as (
  select h.video_id, h.idx, h.split, h.start, h."end", h.hazard, h.actual_r, h.signed_rate, h.rel_start, h.rel_end, ln(1 + h.start) as log_start_s, (h.idx = 0)::int::double as is_first,
    m.* exclude (video_id, idx) from haz h left join meas m on h.video_id = 'u' || m.video_id and h.idx = m.idx)"""
#: the given forest, node by node: tree, node, feature, cut, whether missing goes left, children, value
WALKED = MATRIX + """,
fnames as (select ['""" + "', '".join(FEATS) + """'] as f),
roots as (select t, u.n as node, fnames.f[1 + (t * [1, 3, 5][u.n + 1]) % 16] as feature, t * [3, 7, 9][u.n + 1] as x, (t % [2, 3, 3][u.n + 1] = 0) <> (u.n = 2) as lost_left
  from (select unnest(range(0, 12)) as t), (select unnest(range(0, 3)) as n) u, fnames),
inner_nodes as (select t, node, feature, case when feature in ('log_start_s', 's_since_topic_start') then (x % 7)::double else (x % 10) / 10::double end as cut, lost_left from roots),
long as (unpivot (select video_id, idx, """ + ", ".join(f"coalesce({f}::double, 'nan'::double) as {f}" for f in FEATS) + """ from matrix) on """ + ", ".join(FEATS) + """ into name feature value x),
sides as (select l.video_id, l.idx, i.t, i.node, case when isnan(l.x) then i.lost_left else l.x <= i.cut end as goes_left from long l join inner_nodes i on i.feature = l.feature),
per as (select video_id, idx, t, bool_or(goes_left) filter (where node = 0) as a, bool_or(goes_left) filter (where node = 1) as b, bool_or(goes_left) filter (where node = 2) as c
  from sides group by all),
walked as (
  select video_id, idx, 0.0078125::double + sum((((t * 7 + 5 * (case when a then (case when b then 0 else 1 end) else (case when c then 2 else 3 end) end)) % 11) - 4) / 8192::double) as score
  from per group by 1, 2)"""
FOREST_CURVE = WALKED + """,
tiles2 as (
  select m.video_id, m.idx, m.split, m.start, m."end", m.actual_r, least(9, floor(m.rel_end * 10))::int as bbin,
    product(1 - greatest(0, least(1, 1 - exp(-greatest(w.score, 0) * greatest(m."end" - m.start, 0))))) over (partition by m.video_id order by m.idx) as raw
  from matrix m join walked w using (video_id, idx))""" + CURVE.removeprefix(BASE)

SQL = {
    "position_baseline": BASE + " select bin, round(rate, 6) as rate from table0",
    "calibrate_k": FIT + " select round(k, 3) as k, round(mse, 6) as mse from kfit",
    "band_offsets": CAL + " select bin, round(lo, 6) as lo, round(hi, 6) as hi from band",
    "band_lookup": CAL + " select video_id, idx, round(lo, 6) as lo, round(hi, 6) as hi from banded",
    "drop_rate_by_position": DROPS + " select bin, round(base, 6) as base from dbase",
    "risk_levels": DROPS + """,
rt as (select t.video_id, t.idx, t.split, t.score / d.base as ratio from tiles2 t join dbase d on d.bin = least(19, floor(t.rel_start * 20))::int),
cut as (select quantile_cont(ratio, 0.9) as hi, quantile_cont(ratio, 0.75) as me from rt where split = 'train' and idx > 0)
select video_id, idx, round(ratio, 6) as ratio, case when ratio >= hi then 'high' when ratio >= me then 'medium' else 'low' end as risk from rt, cut""",
    "predict_curve": CURVE + " select * from points",
    "curve_points": CURVE + """
select video_id, t, retention, lower, upper from points union all select distinct video_id, 0, 1, 1, 1 from points""",
    "curve_metrics": BASE + RANKS + """
select round(avg(abs(c - a)), 5) as mae, round(sqrt(avg((c - a) * (c - a))), 5) as rmse, round(corr(a, c), 5) as pearson,
  (select round(corr(ra, rb), 5) from rc) as spearman, (select round(corr(ra, rb), 5) from rh) as hazard_spearman_pooled,
  (select round(avg(rho), 5) from wv) as hazard_spearman_within from x""",
    "drop_detection": BASE + detect("test", "[0.12]") + """
select d.*, (select round(quantile_cont(m, 0.5), 1) from (select min(d) as m from nearp where score >= 0.12::double group by video_id, idx)) as median_delay_s from detection d""",
    "detection_curve": BASE + detect("train", "[" + ", ".join(str(i / 50) for i in range(1, 16)) + "]") + " select * from detection",
    "pick_threshold": BASE + detect("train", "(select list(distinct q) from (select unnest(quantile_cont(score, [" + ", ".join(f"{0.5 + i * 0.01!r}::double" for i in range(50)) + "])) as q from tiles2 where split = 'train' and idx > 0))")
    + " select round(arg_max(threshold, struct_pack(a := f1, b := -threshold)), 6) as threshold, max(f1) as f1 from detection",
    "band_coverage": CAL + """,
e as (select video_id, arg_max(actual_r, idx) as a, arg_max(r, idx) as p from banded where split = 'test' group by 1)
select round(avg((round(actual_r - r, 9) between round(lo, 9) and round(hi, 9))::int), 5) as coverage, (select round(quantile_cont(a, 0.5), 5) from e) as median_end_actual,
  (select round(quantile_cont(p, 0.5), 5) from e) as median_end_predicted from banded where split = 'test'""",
    "validation_report": CAL + """,
tl as (select video_id, n_starters from lec where video_id in (select video_id from cal where split = 'test') order by n_starters desc, video_id limit 6)
select video_id, n_starters, count(*)::int as n_points, string_agg(printf('%d:%.4f:%.4f:%s', idx, round(actual_r, 4), round(r, 4),
  case when idx > 0 and hazard >= 0.05::double then 'true' else 'false' end), ' ' order by idx) as points
from cal join tl using (video_id) group by 1, 2""",
    "topk_points": BASE + TOPK % "score" + " select video_id, rank, t from top",
    "score_points": BASE + TOPK % "score" + SCORE + """
select p.video_id, count(distinct rank) filter (where d.idx is not null) as hits, count(distinct d.idx) as found,
  (select count(*) from drops x where x.video_id = p.video_id) as total, count(distinct rank) as named
from top p left join drops d on d.video_id = p.video_id and p.t between d.start - 10 and d."end" + 10 group by 1""",
    "parse_point_replies": "with " + REPLIES + " select event_id, points[1:3] as points from parsed",
    "method_comparison": BASE + "," + REPLIES + SCORE + """,
r1 as (select video_id, row_number() over (partition by video_id order by score desc, idx) as rank, (start + "end") / 2 as t from tiles2 where idx > 0),
r2 as (select video_id, row_number() over (partition by video_id order by p desc, idx) as rank, (start + "end") / 2 as t from tiles2 where idx > 0),
pts as (
  select 'score' as method, video_id, rank::varchar as rank, t from r1 where rank <= 5
  union all select 'position', video_id, rank::varchar, t from r2 where rank <= 5
  union all select 'replies', video_id, event_id || '-' || i, points[i] from (select event_id, video_id, points, unnest(range(1, least(len(points), 5) + 1)) as i from parsed)),
mper as (select p.method, p.video_id, count(distinct rank) filter (where d.idx is not null) as hits, count(distinct d.idx) as found, count(distinct rank) as named
  from pts p left join drops d on d.video_id = p.video_id and p.t between d.start - 10 and d."end" + 10 group by 1, 2),
tot as (select video_id, count(*) as total from drops group by 1)
select method, round(coalesce(sum(hits) / nullif(sum(named), 0)::double, 0), 3) as precision,
  round(coalesce(sum(found) / nullif(sum(coalesce(total, 0)), 0)::double, 0), 3) as recall,
  sum(found)::bigint as drops_found, sum(coalesce(total, 0))::bigint as drops_total, sum(named)::bigint as points_named
from mper left join tot using (video_id) group by 1""",
    "pair_auc": "with " + SCORED + f""",
g as (select 'all' as grp, score, label from scored union all select grp, score, label from scored),
c as (select grp, {AUC} from g group by 1),
w as (select a.grp, sum(case when a.score > b.score then 1 when a.score = b.score then 0.5::double else 0 end) as w
  from g a join g b on a.grp = b.grp and a.label = 1 and b.label = 0 group by 1)
select grp as "group", n_pos, n_neg, round(w / (n_pos * n_neg), 6) as auc from c left join w using (grp)""",
    "best_f1": "with " + SCORED + """,
t as (select distinct score as threshold from scored),
c as (select threshold, count(*) filter (where label = 1 and score >= threshold) as tp, count(*) filter (where label = 0 and score >= threshold) as fp,
  count(*) filter (where label = 1) as pos from t, scored group by 1),
f as (select threshold, tp / (tp + fp)::double as precision, tp / pos::double as recall from c),
h as (select *, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 12) as f1 from f)
select round(f1, 6) as f1, round(threshold, 6) as threshold, round(precision, 6) as precision, round(recall, 6) as recall from h order by h.f1 desc, h.threshold limit 1""",
    "pair_groups": """with e as (select vec_id // 3 as item, vec_id % 3 as role, embedding::double[] as v from embeddings),
it as (select a.item, a.item // 10 as grp, a.v as a, r.v as r, p.v as p from e a join e r on r.item = a.item and r.role = 1 join e p on p.item = a.item and p.role = 2 where a.role = 0),
s as (select *, list_inner_product(a, r) as rep, list_inner_product(a, p) as prog from it),
u as (select x.grp, avg((list_inner_product(x.a, y.r) + list_inner_product(x.a, y.p)) / 2) as mu from it x join it y on x.grp = y.grp and x.item <> y.item group by 1)
select s.grp as "group", count(*) as n, round(avg(rep), 6) as mean_repeat, round(avg(prog), 6) as mean_progress, round(any_value(mu), 6) as mean_unrelated,
  round(avg(rep) - avg(prog), 6) as margin, round(min(rep), 6) as min_repeat, round(max(prog), 6) as max_progress
from s left join u on u.grp = s.grp group by 1""",
    "choose_model": "with " + SCORED + f""",
c as (select grp, {AUC} from scored group by 1),
w as (select a.grp, sum(case when a.score > b.score then 1 when a.score = b.score then 0.5::double else 0 end) as w
  from scored a join scored b on a.grp = b.grp and a.label = 1 and b.label = 0 group by 1),
r as (select grp as model, round(w / (n_pos * n_neg), 6) as auc, n_pos + n_neg as params from c join w using (grp))
select * from r where (select max(auc) from r) - auc <= 0.1::double order by params, model limit 1""",
    "training_set": MATRIX + """
select video_id, idx, split, round(hazard, 6) as hazard, round(actual_r, 6) as actual_r, round(signed_rate, 6) as signed_rate, """
    + ", ".join(f"round({f}, 6) as {f}" for f in FEATS) + " from matrix",
    "forest_scores": WALKED + " select * from walked",
    "forest_curve": FOREST_CURVE + " select * from points",
    "fit_rate_directions": """select unnest(['repetition_similarity', 'repeated_sentence_ratio', 'repetition_count', 'semantic_novelty', 'information_gain',
  'novelty_prev3_mean', 'gain_prev3_mean', 'pace_ratio']) as feature, true as kept""",
}
