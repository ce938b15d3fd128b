"""DuckDB SQL for edit plans, simulation, comparison, gates and sinks."""

from __future__ import annotations

from checks.sql_detect import CHECKS, FLAGS, LEDGER, POINTS, WORDS, mmss
from checks.sql_semantic import SEGF
from checks.sql_watch import CAPS, LECT, LECTURE_WATCH, chain

DONE = "round((event_id * 37 % 5800) / 10::double, 1)"
PLAN = f"""with plans as (select distinct event_id // 20 as plan_id, 600::double as duration_s from events),
sug as (select event_id // 20 as plan_id, 'e' || (event_id % 20) as id, (event_id % 20)::int as pos,
  case when event_type in ('click', 'view') then 'CUT' when event_type = 'signup' then 'MOVE' else 'SHORTEN' end as action,
  {DONE} as start, {DONE} + 1 + event_id % 13 as "end", case when event_type = 'signup' then round((event_id * 91 % 5900) / 10::double, 1) end as target_time
  from events where event_type <> 'error'),
cus as (select event_id // 20 as plan_id, 'c' || (event_id % 20) as id, (event_id % 20)::int as pos,
  case event_id % 4 when 0 then 'SPEED' when 1 then 'CUT' when 2 then 'SPEED' else case when event_id % 8 = 3 then 'TRIM_START' else 'TRIM_END' end end as action,
  case when event_id % 8 = 7 then 590::double + event_id % 9 else {DONE} end as start,
  case when event_id % 8 = 3 then 1::double + event_id % 11 else {DONE} + 2 + event_id % 17 end as "end", 1.25::double + (event_id % 3) * 0.25::double as factor
  from events where event_type = 'error')"""
#: every plan's whole list of edits: suggested cuts in (start, id) order, then the editor's own; one that overlaps
#: an accepted one is left out
WHOLE = PLAN.replace("with plans", "with recursive plans", 1) + """,
q0 as (
  select plan_id, 0 as grp, start as o1, id as o2, 0 as o3, start as a, "end" as b, 'infinity'::double as f, id, false as custom, action = 'CUT' and "end" > start as ok from sug
  union all
  select plan_id, 1, 0, '', pos, a, b, f, id, true, b > a from (
    select plan_id, pos, id, greatest(0, case when action = 'TRIM_START' then 0 else start end) as a, least(600, case when action = 'TRIM_END' then 600 else "end" end) as b,
      case when action = 'SPEED' then factor else 'infinity'::double end as f from cus)),
q as (select *, row_number() over (partition by plan_id order by grp, o1, o2, o3) as n from q0),
grow(plan_id, n, ops) as (
  select plan_id, 0::bigint, []::struct(a double, b double, f double, id varchar, custom boolean)[] from plans
  union all
  select g.plan_id, q.n, case when q.ok and len(list_filter(g.ops, lambda o: q.a < o.b and q.b > o.a)) = 0
    then list_append(g.ops, struct_pack(a := q.a, b := q.b, f := q.f, id := q.id, custom := q.custom)) else g.ops end
  from grow g join q on q.plan_id = g.plan_id and q.n = g.n + 1),
taken as (select plan_id, arg_max(ops, n) as took, list_sort(arg_max(ops, n)) as ops from grow group by 1),
segs as (select plan_id, idx, idx * 12::double as start, idx * 12::double + 12 as "end", ((plan_id * 7 + idx * 13) % 40) / 10000::double as rate,
  -0.02::double - (idx % 5) / 100::double as lo, 0.03::double + (idx % 4) / 100::double as hi from plans, (select unnest(range(0, 50)) as idx)),
gone as (select s.*, list_transform(t.ops, lambda o: (greatest(0, least(s."end", o.b) - o.a)) * (1 - case when isinf(o.f) then 0 else 1 / o.f end)) as z,
  list_transform(t.ops, lambda o: (greatest(0, least(s.start, o.b) - o.a)) * (1 - case when isinf(o.f) then 0 else 1 / o.f end)) as y from segs s join taken t using (plan_id)),
kd as (select * exclude (z, y), coalesce(list_sum(z), 0) as saved, "end" - start - (coalesce(list_sum(z), 0) - coalesce(list_sum(y), 0)) as kept from gone)"""


def simulated(kept, name):
    """Points (plan_id, idx, t, retention, lower, upper) of rows with ``saved`` and ``kept``."""
    return f""",
{name}_h as (select *, product(exp(-greatest(rate, 0) * greatest(kept, 0))) over (partition by plan_id order by idx) as raw from {kept}),
{name}_r as (select *, min(least(1, greatest(0, pow(raw, 0.8::double)))) over (partition by plan_id order by idx) as r from {name}_h),
{name}_l as (select *, min(least(1, greatest(0, r + lo))) over (partition by plan_id order by idx) as l, least(1, greatest(0, r + hi)) as u from {name}_r),
{name} as (
  select plan_id, idx::int as idx, round_even("end" - saved, 3) as t, round_even(r, 4) as retention, round_even(least(l, r), 4) as lower, round_even(greatest(u, r), 4) as upper from {name}_l where kept > 1e-6
  union all select plan_id, -1, 0, 1, 1, 1 from plans),
{name}_n as (select *, lead(t) over (partition by plan_id order by t, idx) as t2, lead(retention) over (partition by plan_id order by t, idx) as r2 from {name}),
{name}_a as (select plan_id, case when max(t) > 0 then sum((t2 - t) * (retention + r2) / 2) / max(t) else 1 end as avg_r, arg_max(retention, struct_pack(a := t, b := idx)) as end_r from {name}_n group by 1)"""


#: the older conflict rule, then blocks: cuts drop theirs, moves play theirs before the block at the target
KEPT = PLAN.replace("with plans", "with recursive plans", 1) + """,
rq as (select *, row_number() over (partition by plan_id order by start, id) as n from sug),
hold(plan_id, n, acc) as (
  select plan_id, 0::bigint, []::struct(a double, b double, action varchar, t double, id varchar)[] from plans
  union all
  select h.plan_id, q.n, case when q.action not in ('CUT', 'MOVE') or q."end" <= q.start
      or len(list_filter(h.acc, lambda k: (q.start < k.b and q."end" > k.a) or (k.action = 'MOVE' and q.start < k.t and k.t < q."end"))) > 0
      or (q.action = 'MOVE' and len(list_filter(h.acc, lambda k: q.target_time < k.b and q.target_time > k.a)) > 0)
    then h.acc else list_append(h.acc, struct_pack(a := q.start, b := q."end", action := q.action, t := q.target_time, id := q.id)) end
  from hold h join rq q on q.plan_id = h.plan_id and q.n = h.n + 1),
held as (select plan_id, arg_max(acc, n) as acc from hold group by 1),
res as (select plan_id, k.a, k.b, k.action, k.t, k.id from (select plan_id, unnest(acc) as k from held)),
cuts as (select plan_id, a, b from res where action = 'CUT'),
moves as (select plan_id, a, b, t from res where action = 'MOVE'),
pts0 as (select plan_id, p from (select plan_id, a as p from res union select plan_id, b from res union select plan_id, t from moves) where p between 0 and 600
  union select plan_id, 0::double from plans union select plan_id, duration_s from plans),
blk as (select plan_id, p as a, lead(p) over (partition by plan_id order by p) as b from pts0),
cls as (select k.*, m.a as ma, m.t as mt, exists (select 1 from cuts c where c.plan_id = k.plan_id and k.a >= c.a and k.b <= c.b) as is_cut
  from blk k left join moves m on m.plan_id = k.plan_id and k.a >= m.a and k.b <= m.b where k.b is not null),
kb as (select plan_id, a, b, a as k1, 1 as k2, 0::double as k3 from cls where ma is null and not is_cut
  union all select c.plan_id, c.a, c.b, c.mt, 0, c.ma from cls c where c.ma is not null and exists (select 1 from cls x where x.plan_id = c.plan_id and x.a = c.mt and x.ma is null and not x.is_cut)),
ob as (select *, row_number() over w as place, coalesce(sum(b - a) over (partition by plan_id order by k1, k2, k3, a rows between unbounded preceding and 1 preceding), 0) as new_start
  from kb window w as (partition by plan_id order by k1, k2, k3, a))"""


def split(ps, t):
    return f"flatten(list_transform({ps}, lambda p: case when p.s < {t} and {t} < p.e then [struct_pack(s := p.s, e := {t}, f := p.f), struct_pack(s := {t}, e := p.e, f := p.f)] else [p] end))"


#: what is kept or sped up, in source order, then each move in (start, id) order: its pieces go before the first
#: of the others that starts at its target or later
PIECES = (WHOLE + """,
gaps as (select plan_id, ops, list_concat([0::double], list_transform(ops, lambda o: o.b)) as lo, list_concat(list_transform(ops, lambda o: o.a), [600::double]) as hi from taken),
base as (select plan_id, flatten(list_transform(range(1, len(lo) + 1), lambda i: list_concat(
    case when hi[i] > lo[i] then [struct_pack(s := lo[i], e := hi[i], f := 1::double)] else [] end,
    case when i <= len(ops) and not isinf(ops[i].f) then [struct_pack(s := ops[i].a, e := ops[i].b, f := ops[i].f)] else [] end))) as ps from gaps),
mq as (select *, row_number() over (partition by plan_id order by start, id) as n from sug where action = 'MOVE' and target_time is not null),
moved(plan_id, n, ps, ids) as (
  select plan_id, 0::bigint, ps, []::varchar[] from base
  union all
  select plan_id, n, case when inert or len(mine) = 0 then old else list_concat(list_concat(rest[1:before], mine), rest[before + 1:len(rest)]) end, case when inert or len(mine) = 0 then ids else list_append(ids, id) end
  from (select *, coalesce(list_min(list_filter(list_transform(rest, lambda p, i: case when p.s >= target_time then i - 1 end), lambda i: i is not null)), len(rest)) as before
    from (select *, list_filter(cut, lambda p: p.s >= start and p.e <= stop) as mine, list_filter(cut, lambda p: not (p.s >= start and p.e <= stop)) as rest
      from (select *, """ + split("cut2", "target_time") + """ as cut from (select *, """ + split("cut1", "stop") + """ as cut2 from (
        select m.plan_id, q.n, q.id, q.start, q."end" as stop, q.target_time, m.ids, m.ps as old, q.start <= q.target_time and q.target_time <= q."end" as inert, """
    + split("m.ps", "q.start") + """ as cut1
        from moved m join mq q on q.plan_id = m.plan_id and q.n = m.n + 1)))))),
done as (select plan_id, list_filter(arg_max(ps, n), lambda p: p.e - p.s >= 0.25::double) as ps, arg_max(ids, n) as ids from moved group by 1),
listed as (select plan_id, ps, ids, round_even(coalesce(list_sum(list_transform(ps, lambda p: (p.e - p.s) / p.f)), 0), 3) as output_duration_s,
  left(sha256('[' || array_to_string(list_transform(ps, lambda p: '[' || round_even(p.s, 3) || ', ' || round_even(p.e, 3) || ', ' || round_even(p.f, 4) || ']'), ', ') || ']'), 16) as plan_key from done)
select plan_id, list_transform(ps, lambda p: p.s) as starts, list_transform(ps, lambda p: p.e) as ends, list_transform(ps, lambda p: p.f) as factors, ids as moved, output_duration_s, plan_key from listed""")
# pieces are not cut where nothing happens: neighbours that continue in source and in play order join,
# except at a move's target
SIG = SEGF + POINTS + CHECKS + LEDGER + FLAGS


def at(t, name):
    a = f"(select max(t) from pts p where p.video_id = v.video_id and p.t <= {t})"
    b = f"(select min(t) from pts p where p.video_id = v.video_id and p.t >= {t})"
    return f"""
{name} as (
  select v.video_id, pa.retention + (pb.retention - pa.retention) * s.w as retention, pa.lower + (pb.lower - pa.lower) * s.w as lower, pa.upper + (pb.upper - pa.upper) * s.w as upper
  from (select video_id, coalesce(ta, tb) as ta, coalesce(tb, ta) as tb, case when tb > ta then ({t} - ta) / (tb - ta) else 0 end as w
        from (select video_id, {a} as ta, {b} as tb from (select distinct video_id from pts) v)) s
  join (select distinct video_id from pts) v on v.video_id = s.video_id join pts pa on pa.video_id = s.video_id and pa.t = s.ta join pts pb on pb.video_id = s.video_id and pb.t = s.tb)"""


SIGNALS = SIG + "," + at("30::double", "i30") + "," + at("60::double", "i60") + """,
agg as (select video_id, coalesce(sum(filler_count) filter (where start < 30 and kind = 'speech'), 0)::bigint as fillers,
  round_even(avg(pace_ratio) filter (where start < 30 and kind = 'speech'), 3) as pace,
  round_even(coalesce(sum(least("end", 30) - start) filter (where kind = 'silence' and start < 30), 0), 1) as dead_air,
  (count(*) filter (where k % 3 = 0 and start < 30))::int as cuts from segf group by 1),
sig as (select a.video_id, x.retention as r30_retention, x.lower as r30_lower, x.upper as r30_upper, y.retention as r60_retention, y.lower as r60_lower, y.upper as r60_upper,
  c.fm as title_at, a.fillers, a.pace, coalesce((select arg_min(status, idx) from led l where l.video_id = a.video_id and made_at < 30), 'none') as promise,
  (select count(*) from fl f where f.video_id = a.video_id and f.start < 60) as flags60, a.dead_air, a.cuts
  from agg a join i30 x using (video_id) join i60 y on y.video_id = a.video_id left join checks c on c.video_id = a.video_id)"""
RANK = "case %s when 'kept' then 3 when 'late' then 2 when 'open' then 1 else 0 end"


def met(pos, key, va, vb, better, tol, cond="true", shown=None):
    op = "<" if better == "lower" else ">"
    return f"""select pair_id, {pos} as pos, '{key}' as key, ({shown or va})::double as va, ({(shown or va).replace('a.', 'b.') if shown else vb})::double as vb, '{better}' as better,
  case when ({va}) is null or ({vb}) is null then 'n/a' when ({va}) = ({vb}) or abs(({va}) - ({vb})) <= {tol} then 'tie' when ({va}) {op} ({vb}) then 'a' else 'b' end as winner from pr where {cond}"""


def band(m):
    return f"least(a.{m}_upper - a.{m}_lower, b.{m}_upper - b.{m}_lower) / 2"


AB = SIGNALS + """,
pr as (select a.video_id as pair_id, a, b from sig a join sig b on b.video_id = a.video_id + 1 where a.video_id % 2 = 0),
mets as (""" + " union all ".join([
    met(0, "r30", "a.r30_retention", "b.r30_retention", "higher", band("r30"), shown="round_even(a.r30_retention, 3)"),
    met(1, "r60", "a.r60_retention", "b.r60_retention", "higher", band("r60"), shown="round_even(a.r60_retention, 3)"),
    met(2, "title_at", "coalesce(a.title_at, 'infinity'::double)", "coalesce(b.title_at, 'infinity'::double)", "lower", "2", shown="round_even(a.title_at, 1)"),
    met(3, "fillers", "a.fillers", "b.fillers", "lower", "0"), met(4, "pace", "a.pace", "b.pace", "higher", "0.05::double"),
    met(5, "promise", RANK % "a.promise", RANK % "b.promise", "higher", "0"),
    met(6, "dead_air", "a.dead_air", "b.dead_air", "lower", "1"), met(7, "cuts", "a.cuts", "b.cuts", "higher", "0"), met(8, "flags60", "a.flags60", "b.flags60", "lower", "0"),
]) + ")"
LIMITS = "n_starters >= 3 and duration_s between 180 and 1500 and lines >= 20"

#: the curve build: watch intervals under caption ids, lectures as long as their captions
BUILT = "with" + LECTURE_WATCH.replace("watch as (", "watch0 as (") + "," + CAPS + """,
cmeta as (select ccid as video_id, max(e) as duration_s, count(*)::int as lines from lines group by 1),
ids as (select distinct 'u' || user_id as video, (user_id % 400)::varchar as cc from events where user_id % 17 <> 0),
watch as (select viewer_id || '/' || video_id as viewer_id, cc as video_id, start_point, end_point from watch0 join ids on video = video_id where cc in (select video_id from cmeta)),""" + chain(60).replace(
    "max(last) as duration_s, sum(n)::bigint as lines\n  from entries group by 1", "any_value(m.duration_s) as duration_s, any_value(m.lines) as lines\n  from entries join cmeta m using (video_id) group by 1"
).replace("tiles0 as", "tiles0 as") + """,
top as (select * from lec where n_starters >= 2 and duration_s between 20 and 1500 and lines >= 5 order by n_starters desc, video_id limit 40)"""

SQL = {
    "edit_ops": WHOLE + """
select plan_id, list_transform(ops, lambda o: o.a) as starts, list_transform(ops, lambda o: o.b) as ends, list_transform(list_filter(took, lambda o: not o.custom), lambda o: o.id) as applied,
  coalesce((select list(q.id order by q.n) from q where q.plan_id = t.plan_id and not q.custom and len(list_filter(t.took, lambda o: not o.custom and o.id = q.id)) = 0), []) as skipped,
  list_transform(list_filter(took, lambda o: o.custom), lambda o: o.id) as applied_custom from taken t""",
    "kept_duration": WHOLE + " select plan_id, idx, round(saved, 6) as saved, round(kept, 6) as kept from kd",
    "simulate_exposure": WHOLE + simulated("kd", "sim") + " select * from sim",
    "simulate_conflicting": WHOLE + simulated("kd", "sim") + " select * from sim",
    "retention_delta": WHOLE + ", plain as (select *, 0::double as saved, \"end\" - start as kept from segs)" + simulated("kd", "sim") + simulated("plain", "orig") + """
select plan_id, round_even(100 * (s.end_r - o.end_r), 1) as end_retention_pp, round_even(100 * (s.avg_r - o.avg_r), 1) as avg_retention_pp from sim_a s join orig_a o using (plan_id)""",
    "resolve_edits": KEPT + """
select plan_id, list_transform(acc, lambda k: k.id) as kept,
  coalesce((select list(q.id order by q.n) from rq q where q.plan_id = h.plan_id and len(list_filter(h.acc, lambda k: k.id = q.id)) = 0), []) as skipped from held h where plan_id in (select plan_id from sug)""",
    "avg_retention": SEGF + POINTS + """,
n as (select *, lead(t) over (partition by video_id order by t) as t2, lead(retention) over (partition by video_id order by t) as r2 from pts)
select video_id, round(sum((t2 - t) * (retention + r2) / 2) / max(t), 6) as avg_retention, round(arg_max(retention, t), 6) as end_retention from n group by 1""",
    "edit_blocks": KEPT + " select plan_id, place, a, b, round(new_start, 4) as new_start from ob",
    "apply_edits": KEPT + """,
w as (select plan_id, j as word_idx, 'w' || j as text, j * 2::double + 0.2::double as start, j * 2::double + 1.3::double as "end" from plans, (select unnest(range(0, 300))::int as j)),
m as (select w.*, o.place, o.new_start - o.a as off from w join ob o on o.plan_id = w.plan_id and (w.start + w."end") / 2 >= o.a and (w.start + w."end") / 2 < o.b)
select plan_id, (row_number() over (partition by plan_id order by place, word_idx) - 1)::int as new_idx, word_idx, text, round_even(start + off, 3) as start, round_even("end" + off, 3) as "end" from m""",
    "edit_pieces": PIECES,
    "edit_pieces_full": PIECES,
    "skip_ranges": PLAN + """,
r as (select plan_id, start as s, "end" as e from sug where action in ('CUT', 'SHORTEN') union all select plan_id, start, "end" from cus where action <> 'SPEED'),
f as (select *, case when s <= max(e) over (partition by plan_id order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as n from r),
g as (select *, sum(n) over (partition by plan_id order by s, e rows unbounded preceding) as i from f)
select plan_id, round(min(s), 4) as start, round(max(e), 4) as "end" from g group by plan_id, i""",
    "export_edit_plan": PLAN + """,
u as (select plan_id, 'suggested' as source, id, action, start, "end", target_time, null::double as factor, 'planted' as reason, pos from sug
  union all select plan_id, 'custom', id, action, start, "end", null, factor, 'Made in the editor', pos from cus)
select plan_id, row_number() over (partition by plan_id order by start, source desc, pos) as place, source, id, action, start, "end", target_time, factor, reason from u""",
    "top_edits": SEGF + FLAGS + """,
r as (select *, row_number() over (partition by video_id order by severity, risk_score desc, start, flag_id) as place from fl where action = 'CUT')
select video_id, place, 'e' || idx as edit_id, flag_id from r where place <= 3""",
    "interp_at": SIG + "," + at("67.5::double", "ip") + " select video_id, round(retention, 6) as retention, round(lower, 6) as lower, round(upper, 6) as upper from ip",
    "hook_signals": SIGNALS + " select * replace (" + ", ".join(f"round(r{m}_{c}, 6) as r{m}_{c}" for m in (30, 60) for c in ("retention", "lower", "upper")) + ") from sig",
    "ab_compare": AB + """
select pair_id, key, case when key = 'promise' then (select promise from sig s where s.video_id = pair_id) end as said_a, case when key <> 'promise' then round(va, 3) end as num_a,
  case when key = 'promise' then (select promise from sig s where s.video_id = pair_id + 1) end as said_b, case when key <> 'promise' then round(vb, 3) end as num_b, better, winner,
  case when key in ('r30', 'r60') and winner = 'tie' then 'difference smaller than the model''s uncertainty' end as note from mets""",
    "ab_summary": AB + """,
s as (select pair_id, count(*) filter (where winner = 'a') as wins_a, count(*) filter (where winner = 'b') as wins_b, count(*) as n, bool_and(winner = 'tie') filter (where key in ('r30', 'r60')) as same from mets group by 1)
select pair_id, wins_a, wins_b, case when wins_a = wins_b then 'No clear winner: the versions trade off; see each signal.'
  else printf('%s leads on %d of %d signals (the other leads on %d).', case when wins_a > wins_b then 'Version A' else 'Version B' end, greatest(wins_a, wins_b), n, least(wins_a, wins_b)) end
  || case when same then ' The predicted curves are within the model''s uncertainty of each other.' else '' end as summary from s""",
    "corpus_summary": SIG + WORDS + f"""
select s.video_id, round_even(max(duration_s) / 60, 1) as minutes, (select count(*) from sw w where w.video_id = s.video_id) as words, count(*) as segments,
  (select round_even(arg_max(retention, t) * 100, 0)::bigint || '%' from pts p where p.video_id = s.video_id) as end_retention,
  (select round_even(arg_max(lower, t) * 100, 0)::bigint || '%–' || round_even(arg_max(upper, t) * 100, 0)::bigint || '%' from pts p where p.video_id = s.video_id) as end_range,
  (select case when title = 'x y' then 'skipped' when fm is null then 'never' else {mmss('fm')} end from checks c where c.video_id = s.video_id) as title_addressed,
  coalesce(string_agg({mmss('start')}, ', ' order by start) filter (where risk = 'high'), 'none') as high_risk from segf s group by 1""",
    "flag_table": SEGF + FLAGS + f"""
select video_id, flag_id, {mmss('start')} || '–' || {mmss('"end"')} as time, severity, 'flag ' || k as title, source, 'planted' as suggested from fl""",
    "src_media_manifest": """
select o_orderkey as video_id, case when o_orderkey % 3 > 0 then (o_orderkey % 1500) + 0.5::double when o_orderkey % 7 > 0 then 9.125::double when o_orderkey % 5 > 0 then 7.25::double else 0 end as duration_s,
  o_orderkey % 5 > 0 as has_audio, o_orderkey % 7 > 0 as has_video,
  case when o_orderkey % 7 > 0 then case o_custkey % 4 when 1 then 29.97::double when 2 then 25::double when 3 then 24::double end end as fps,
  case when o_orderkey % 7 > 0 then 1280 end as width, case when o_orderkey % 7 > 0 then 720 end as height,
  case when o_orderkey % 5 > 0 then (16000 + o_custkey % 3 * 16000)::int end as audio_sample_rate, case when o_orderkey % 5 > 0 then (1 + o_custkey % 2)::int end as audio_channels, 'mov,mp4' as container from orders""",
    "gate_duration": """
with u as (select o_orderkey as id, case when o_custkey % 3 = 0 then 'script' else 'video' end as st, case o_orderkey % 5 when 0 then '.mp4' when 1 then '.mov' when 2 then '.txt' when 3 then '.md' else '.avi' end as ext,
  o_totalprice / 300 as d, o_orderkey % 4 <> 0 as au, o_orderkey * 1009 % 2000000 as nb from orders),
r as (select *, list_filter(case when st = 'video' then [
    case when ext not in ('.mp4', '.mov') then 'unsupported video type ''' || ext || '''; use MP4 or MOV' end, case when not au then 'video has no audio track' end,
    case when d < 60 then 'too short: ' || round_even(d, 0)::bigint || 's (minimum 60s)' end, case when d > 1200 then 'too long: ' || round_even(d, 0)::bigint || 's (maximum 1200s)' end]
  else [case when ext not in ('.txt', '.md') then 'unsupported script type ''' || ext || '''; use TXT or MD' end, case when nb > 1048576 then 'script too large' end,
    case when id % 50 = 0 then 'script is not a text file' end, case when id % 40 = 0 then 'script is empty' end] end, lambda x: x is not null) as reasons from u)
select id as video_id, case when len(reasons) = 0 then 'accepted' else 'rejected' end as status, reasons,
  case when len(reasons) = 0 and (d < 300 or d > 900) then [case when st = 'video' then 'Duration ' else 'Estimated spoken length ' end || round_even(d / 60, 1) || ' min is outside the tested 5–15 min range; results may be less reliable.'] else [] end as warnings from r""",
    "sink_artifacts": """
with r as (select user_id as video_id, event_type as kind, epoch_us(ts) as created_at, 'v' || (event_id % 3) as version, event_id::varchar as payload,
  row_number() over (partition by user_id, event_type order by ts desc, event_id % 3 desc, event_id::varchar desc) as n from events) select * exclude (n) from r where n = 1""",
    "sink_curves": BUILT + """
select t.video_id, case when ('0x' || substr(sha256(t.video_id), 1, 8))::bigint % 10000 < 2000 then 'test' else 'train' end as split, n_starters, n_viewers,
  round_even(t.duration_s, 3) as duration_s, list(round_even(retention, 4) order by c.t) as retention from top t join curve c using (video_id) group by all""",
    "sink_captions": BUILT + """
select ccid, round(duration_s, 4) as duration_s, len(text)::int as lines, text from caps join cmeta on video_id = ccid where ccid in (select video_id from top)""",
    "sink_summary": BUILT + """
select (select count(distinct viewer_id) from watch0) as viewers_read, (select count(*) from lec) as lectures_seen, count(*) as lectures_used,
  count(*) filter (where ('0x' || substr(sha256(video_id), 1, 8))::bigint % 10000 >= 2000) as train, count(*) filter (where ('0x' || substr(sha256(video_id), 1, 8))::bigint % 10000 < 2000) as test,
  sum(ceil(duration_s))::bigint as seconds, count(*) as captions, sum(lines)::bigint as caption_lines from top""",
    "curve_run_summary": LECT + f""",
top as (select * from lec where {LIMITS} order by n_starters desc, video_id limit 40),
s as (select count(*) as lectures_used, count(*) filter (where ('0x' || substr(sha256(video_id), 1, 8))::bigint % 10000 < 2000) as test from top)
select (select count(distinct viewer_id) from watch) as viewers_read, (select count(*) from lec) as lectures_seen, lectures_used, lectures_used - test as train, test from s""",
}
SQL["cut_seconds"] = "select plan_id, round(sum(e - s), 4) as cut_s from (" + SQL["skip_ranges"].replace(
    'select plan_id, round(min(s), 4) as start, round(max(e), 4) as "end" from g', "select plan_id, min(s) as s, max(e) as e from g") + ") group by 1"
