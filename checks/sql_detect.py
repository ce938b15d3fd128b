"""DuckDB SQL for promises, rules, evidence, scores and QA."""

from __future__ import annotations

from checks.sql_semantic import SEGF
from checks.sql_text import MARKS, PLAIN, SOFT, SOFT_SENTS, TOKENS, TURNS, features, inlist, lit
from stayline.functions import lexicon as lex
from stayline.operators import rules, scores


def mmss(x):
    return f"printf('%02d:%02d', greatest(0, round_even({x}, 0)::bigint) // 60, greatest(0, round_even({x}, 0)::bigint) % 60)"


def whole(x):
    return f"round_even({x}, 0)::bigint::varchar"


WORDS = """,
sw as (select video_id, idx * 6 + j as word_idx, 'w' || (idx * 6 + j) as text, start + j * 2 + 0.3::double as start, start + j * 2 + 1.6::double as "end"
  from segf, (select unnest(range(0, 6)) as j) where kind = 'speech')"""
CHECKS = """,
checks0 as (select video_id, arg_min(speech_start, idx) filter (where k % 10 = 3 and kind = 'speech') as m from segf group by 1),
checks as (select video_id, case when video_id % 4 < 3 then 'alpha beta gamma' else 'x y' end as title, case when video_id % 3 > 0 then m end as fm,
  m as bm, case when m is not null then 0.5::double end as bs from checks0)"""
LEDGER = """,
led as (select video_id, idx, 's' || idx as text, speech_start as made_at, speech_end as made_end, k,
  case when k % 3 = 1 then speech_start + 100 + k end as payoff_at, case when k % 3 = 1 then speech_start + 104 + k end as payoff_end,
  case when k % 3 = 1 then 100::double + k end as delay_s, case k % 3 when 0 then 'kept' when 1 then 'late' else 'open' end as status
  from segf where kind = 'speech' and idx < 6 and k % 2 = 0)"""
POINTS = """,
pts as (select video_id, idx, k, "end" as t, greatest(0.05::double, 1 - "end" / 700 - p_drop / 10) as retention,
  greatest(0.05::double, 1 - "end" / 700 - p_drop / 10) - 0.05::double - k / 2000::double as lower,
  greatest(0.05::double, 1 - "end" / 700 - p_drop / 10) + 0.05::double + k / 2000::double as upper from segf)"""
FLAGS = """,
fl as (select video_id, 'f' || idx as flag_id, idx, start, start + 12 * (1 + k % 3 + idx % 2) as "end",
  case k % 5 when 0 then 'pacing' when 1 then 'low_information' when 2 then 'repetition' when 3 then 'visual_monotony' else 'payoff_delay' end as category,
  case when k % 12 = 0 then 'high' else 'medium' end as severity, (k % 10) / 10::double as risk_score, k,
  case when k % 18 = 0 then 'model+rule' else 'rule' end as source,
  case when k % 5 = 3 then 'ADD_VISUAL' when k % 12 = 0 then 'CUT' else 'SHORTEN' end as action from segf where k % 6 = 0)"""
FACTS = """,
facts as (select video_id, max(duration_s) as duration_s, max(least(30, duration_s)) as hook_end,
  coalesce(arg_min(speech_start, idx) filter (where kind = 'speech'), 0) as first_speech,
  coalesce(sum(filler_count) filter (where start < 30), 0)::bigint as hook_fillers,
  coalesce(sum(coalesce(speech_end, "end") - coalesce(speech_start, start)) filter (where kind = 'speech'), 0) / greatest(max(duration_s), 1e-6::double) as speech_share
  from segf group by 1)"""
INSIDE = """,
ins as (select f.video_id, f.flag_id, f.category, f.source, s.* exclude (video_id, start, "end"), s.start as s0, s."end" as s1
  from fl f join segf s on s.video_id = f.video_id and s.start < f."end" and s."end" > f.start)"""


def flag(start, end, severity, category, risk, title, why, ev, n, action=None, a=None, b=None, reason=None):
    q = lambda x: x if x is not None else "null"
    return f"""select video_id, ({start})::double as start, ({end})::double as "end", {severity} as severity, '{category}' as category,
  round(({risk})::double, 4) as risk_score, {title} as title, {why} as explanation, {ev} as ev, ({n})::int as n_edits, {q(action)} as action,
  round(({q(a)})::double, 4) as edit_start, round(({q(b)})::double, 4) as edit_end, {q(reason)} as reason """


def evs(*items):
    """Evidence values; a pair (condition, value) is left out when the condition fails."""
    parts = []
    for it in items:
        if isinstance(it, tuple):
            parts.append(f"case when {it[0]} then [round(({it[1]})::double, 4)] else [] end")
        elif it is None:
            parts.append("[null]::double[]")
        else:
            parts.append(f"[round(({it})::double, 4)]")
    return "(" + " || ".join(parts) + ")"


def runs(src, cond):
    return f""",
hit as (select *, coalesce({cond}, false) as h from {src}),
st as (select *, case when h and not coalesce(lag(h) over (partition by video_id order by idx), false) then 1 else 0 end as f from hit),
rn as (select *, sum(f) over (partition by video_id order by idx) as run from st)"""


NAMES = "case visual_type " + " ".join(f"when '{k}' then {lit(n)}" for k, n in rules.VISUAL_NAMES.items()) + " end"
FIXES = "case vt " + " ".join(f"when '{k}' then {lit(n)}" for k, n in rules.VISUAL_FIX.items()) + " end"

LINES = PLAIN + MARKS + SOFT + SOFT_SENTS + "," + features("sents", "sf") + """,
mids as (select video_id, count(*) // 2 as mid from sf group by 1),
titles as (select s.video_id, s.text as title, s.tokens as ttoks from sf s join mids m on m.video_id = s.video_id and s.sent_idx = m.mid)"""
CUES = lex.flat(lex.PROMISE_CUES)


def vectors(name, src, cols):
    """(cols, dim, w) from token lists ``toks``."""
    return f""",
{name}0 as (select {cols}, unnest(case when len(toks) = 0 then [null] else toks end) as tok from {src}),
{name}1 as (select {cols}, case when tok is null then 0 else ('0x' || substr(md5(tok), 1, 8))::bigint % 256 end as dim, count(*) as c from {name}0 group by all),
{name} as (select *, c / sqrt(sum(c * c) over (partition by {cols})) as w from {name}1)"""


CHECK = LINES + """,
ssrc as (select video_id, sent_idx, tokens as toks from sf),
tsrc as (select video_id, ttoks as toks from titles)""" + vectors("sv", "ssrc", "video_id, sent_idx") + vectors("tv", "tsrc", "video_id") + """,
tsims as (select s.video_id, s.sent_idx, round(coalesce(sum(v.w * t.w), 0), 9) as sim from sf s left join sv v using (video_id, sent_idx)
  left join tv t on t.video_id = v.video_id and t.dim = v.dim group by 1, 2),
hits as (select s.*, sf.start, sf.text from tsims s join sf using (video_id, sent_idx)),
pcheck as (select video_id, min(sent_idx) filter (where sim >= 0.45::double and not (sent_idx = 0 and sim > 0.9::double)) as fi,
  arg_max(start, struct_pack(a := sim, b := -sent_idx)) as bm, max(sim) as bs from hits group by 1),
checkd as (select p.video_id, f.start as fm, f.text as ft, bm, bs from pcheck p left join hits f on f.video_id = p.video_id and f.sent_idx = p.fi)"""
CUEHIT = " or ".join(f"contains(pt, {lit(' ' + ' '.join(c.split()) + ' ')})" for c in CUES)
CUEEND = "greatest(" + ", ".join(f"case when contains(low, {lit(c)}) then instr(low, {lit(c)}) - 1 + {len(c)} else -1 end" for c in CUES) + ")"
LEDGERQ = CHECK + f""",
cued as (select *, ' ' || array_to_string(tokens, ' ') || ' ' as pt, lower(text) as low from sf where start < 75),
made0 as (select *, row_number() over (partition by video_id order by sent_idx) as rn, {CUEEND} as ce from cued where {CUEHIT}),
made1 as (select video_id, sent_idx as p, start as ps, "end" as pe, text as ptext, case when ce >= 0 and len(list_filter(string_split(trim(substr(text, ce + 1), ' ,.:;-'), ' '), lambda x: x <> '')) >= 3
   then trim(substr(text, ce + 1), ' ,.:;-') else text end as part from made0 where rn <= 4),
psrc as (select video_id, p, {TOKENS.replace("string_split_regex(text,", "string_split_regex(part,")} as toks from made1)""" + vectors("pv", "psrc", "video_id, p") + """,
lsims as (select m.video_id, m.p, s.sent_idx, s.start, round(coalesce(sum(a.w * b.w), 0), 9) as sim
  from made1 m join sf s on s.video_id = m.video_id and s.start >= m.pe + 15 left join sv b on b.video_id = s.video_id and b.sent_idx = s.sent_idx
  left join pv a on a.video_id = b.video_id and a.p = m.p and a.dim = b.dim group by 1, 2, 3, 4),
lth as (select video_id, p, max(sim) as best, case when count(*) >= 5 then least(0.45::double, greatest(0.35::double, round(avg(sim) + 2 * stddev_pop(sim), 9))) else 0.45::double end as thr from lsims group by 1, 2),
lhit as (select l.video_id, l.p, min(sent_idx) as hi from lsims l join lth using (video_id, p) where sim >= thr group by 1, 2),
full0 as (select m.*, h.start as hs, h.sim as hsim, t.best from made1 m left join lth t using (video_id, p) left join lhit x using (video_id, p)
  left join lsims h on h.video_id = m.video_id and h.p = m.p and h.sent_idx = x.hi)"""

SQL = {
    "promise_check": CHECK + " select video_id, fm as first_mention_s, ft as first_mention_text, bm as best_match_s, round_even(bs, 4) as best_similarity from checkd",
    "promise_ledger": LEDGERQ + """
select video_id, p as sent_idx, 'intro' as source, ps as made_at, pe as made_end, hs as payoff_at, round_even(coalesce(hsim, best), 4) as similarity,
  round(round(hs - ps, 9), 1) as delay_s, case when hs is null then 'open' when hs - ps > 90 then 'late' else 'kept' end as status from full0
union all
select t.video_id, -1, 'title', 0, 0, fm, null, fm, case when fm is null then 'open' when fm > 90 then 'late' else 'kept' end
from titles t join checkd using (video_id) where len(string_split(title, ' ')) >= 3""",
    "rule_slow_hook": SEGF + WORDS + FACTS + """,
x0 as (select f.*, (select count(*) from sw w where w.video_id = f.video_id and w.start < 30) as n from facts f),
x as (select *, first_speech >= 5 as q, coalesce(hook_fillers / nullif(n, 0)::double, 0) >= 0.06::double as fl from x0),
y as (select *, list_filter([case when q then 'nothing is said for the first ' || """ + whole("first_speech") + """ || ' s' end,
   case when fl then hook_fillers || ' filler words in the first ' || """ + whole("hook_end") + """ || ' s' end], lambda z: z is not null) as why from x where q or fl)
""" + flag("0", "hook_end", "'high'", "slow_hook", "0.8", "'Slow hook: ' || why[1]", "'The opening is where most viewers decide to leave; ' || array_to_string(why, '; ') || '.'",
           evs(("q", "round_even(first_speech, 1)"), ("fl", "hook_fillers")), "q::int + fl::int", "case when q then 'CUT' else 'REWRITE' end", "0",
           "case when q then greatest(0, first_speech - 0.5::double) else hook_end end",
           f"case when q then 'Cut the silent intro 00:00–' || {mmss('first_speech - 0.5::double')} else 'Tighten the opening: remove filler words and channel housekeeping' end") + " from y",
    "rule_late_promise": SEGF + CHECKS + FACTS + """,
x as (select c.*, f.duration_s, f.first_speech, (select min(s.idx) from segf s where s.video_id = c.video_id and s.kind = 'speech' and s.speech_start <= fm and fm < s.speech_end + 1e-6::double) as li
  from checks c join facts f using (video_id) where title = 'alpha beta gamma' and (fm is null or fm > 30)),
y as (select x.*, s.speech_start as ls, s.speech_end as le from x left join segf s on s.video_id = x.video_id and s.idx = x.li)
""" + flag("0", "coalesce(fm, least(60, duration_s))", "case when fm is null or fm > 60 then 'high' else 'medium' end", "payoff_delay", "0.75",
           f"case when fm is not null then 'Title promise not addressed until ' || {mmss('fm')} else 'The video never clearly addresses its title' end",
           "'Viewers clicked for the title; until it is addressed they have no reason to stay.'", evs(None, ("fm is not null", "round_even(fm, 1)"), ("bs is not null", "bs")),
           "(ls is not null)::int", "case when ls is not null then 'MOVE' end", "ls", "le", f"case when ls is not null then 'Move the line at ' || {mmss('ls')} || ' to the opening as the hook' end") + " from y",
    "rule_repetition": SEGF + CHECKS + """,
q as (select video_id, greatest(0.6::double, quantile_cont(repetition_similarity, 0.9)) as thr from segf where kind = 'speech' group by 1),
c0 as (select s.*, q.thr, m.start as ms, m."end" as me, c.fm, k % 3 > 0 as has, s.start + 1 as r0, s.start + 7 + k % 3 as r1, m.start + 1 as x0, m.start + 6 as x1
  from segf s join q using (video_id) join (select video_id, idx, start, "end" from segf) m on m.video_id = s.video_id and m.idx = s.repetition_match_segment
  join checks c on c.video_id = s.video_id where s.kind = 'speech' and s.repetition_similarity >= thr),
c1 as (select *, row_number() over (partition by video_id order by repetition_similarity desc, start) as place from c0
  where fm is null or not (case when has then x0 <= fm and fm < x1 + 1e-6::double else ms <= fm and fm < me end)),
c2 as (select *, case when has then greatest(speech_start, r0) else speech_start end as a0, case when has then least(speech_end, r1) else speech_end end as b0 from c1 where place <= 5),
y as (select *, case when b0 - a0 < 1 then speech_start else a0 end as a, case when b0 - a0 < 1 then speech_end else b0 end as b, """ + mmss("ms") + " || '–' || " + mmss("me") + """ as span from c2)
""" + flag("start", '"end"', "case when repetition_similarity >= 0.7::double then 'high' else 'medium' end", "repetition", "round_even(least(1, repetition_similarity), 3)", "'Repeats ' || span",
           "'This section says much the same as ' || span || ' (similarity ' || repetition_similarity || ', above this video''s usual level).'",
           evs("repetition_similarity", "round_even(thr, 4)", ("semantic_novelty is not null", "semantic_novelty")), "1", "'CUT'", "a", "b",
           f"'Cut ' || {mmss('a')} || '–' || {mmss('b')} || ': repeats ' || span") + " from y",
    "rule_low_information": SEGF + """,
q as (select video_id, least(0.35::double, quantile_cont(information_gain, 0.2)) as thr from segf where kind = 'speech' group by 1),
sp as (select s.*, thr from segf s join q using (video_id) where kind = 'speech')""" + runs("sp", "information_gain < thr") + """,
y as (select video_id, run, min(start) as s, max("end") as e, min(information_gain) as low, arg_min(start, struct_pack(a := information_gain, b := idx)) as ws,
  arg_min("end", struct_pack(a := information_gain, b := idx)) as we from rn where h group by 1, 2 having max("end") - min(start) >= 24)
""" + flag("s", "e", "'medium'", "low_information", "0.5", f"'Little new information for ' || {whole('e - s')} || ' s'",
           f"{mmss('s')} || '–' || {mmss('e')} || ' adds little beyond the previous minute, even by this video''s own standard.'", evs("round_even(e - s, 1)", "round_even(low, 4)"), "1", "'SHORTEN'", "ws", "we",
           f"'Shorten ' || {mmss('ws')} || '–' || {mmss('we')} || ', the least new part'") + " from y",
    "rule_pacing": SEGF + runs("segf", """kind = 'speech' and "end" - start >= 5 and pace_ratio < 0.7::double""") + """,
y as (select video_id, run, min(start) as s, max("end") as e, min(pace_ratio) as low from rn where h group by 1, 2)
""" + flag("s", "e", "'medium'", "pacing", "0.4", "'Slower than your average pace'", f"'Speaking rate drops to ' || {whole('low * 100')} || '% of this video''s own average.'",
           evs("low", "round_even(e - s, 1)"), "1", "'SHORTEN'", "s", "e", "'Tighten pauses or trim this section'") + " from y",
    "rule_silence": SEGF + FACTS + """,
j as (select s.*, f.hook_end, f.speech_share from segf s join facts f using (video_id))""" + runs("j", "kind = 'silence' and start >= hook_end") + """,
y0 as (select video_id, run, min(start) as s, max("end") as e, avg(silence_ratio) as quiet, any_value(speech_share) as share from rn where h group by 1, 2),
y1 as (select *, case when quiet is not null then quiet >= 0.6::double else share >= 0.4::double end as dead from y0),
y as (select * from y1 where e - s >= 6 and (dead or e - s >= 45))
""" + flag("s", "e", "'medium'", "silence", "case when dead then 0.6::double else 0.3::double end", f"{whole('e - s')} || case when dead then ' s of dead air' else ' s of music/visuals without speech' end",
           "case when dead then 'No speech and almost no sound here; viewers have nothing to hold on to.' else 'Music or visuals carry this stretch without speech. Fine if something worth watching is on screen; long stretches risk losing viewers.' end",
           evs("round_even(e - s, 1)", ("dead and quiet is not null", "round_even(quiet, 3)"), ("not dead", "round_even(share, 3)")), "1", "'CUT'", "s + 0.5::double", "e - 0.5::double",
           f"'Trim ' || {mmss('s')} || '–' || {mmss('e')} || ' to a short beat'") + " from y",
    "rule_static": SEGF + " " + flag("start", '"end"', "'medium'", "visual_monotony", "0.4", "'Picture barely changes'", f"'The picture is almost static for ' || {whole('longest_static_s')} || ' s.'",
                                     evs("longest_static_s", "seconds_since_cut"), "1", "'ADD_VISUAL'", "start", '"end"', "'Add B-roll, a screen recording or a cut here'") + " from segf where longest_static_s >= 20",
    "rule_ledger": SEGF + LEDGER + " " + flag("made_at", "made_end", "case when status = 'late' then 'medium' else 'high' end", "payoff_delay", "case when status = 'late' then 0.6::double else 0.7::double end",
        f"case when status = 'late' then 'Promise at ' || {mmss('made_at')} || ' kept only at ' || {mmss('payoff_at')} || ' (' || {mmss('delay_s')} || ' later)' else 'Promise at ' || {mmss('made_at')} || ' is never clearly paid off' end",
        "case when status = 'late' then 'Viewers were promised something early and wait a long time for it; many leave before the payoff.' else 'An open loop: the video promises something it never visibly delivers, which costs trust and watch time.' end",
        evs(None, ("status = 'late'", "round_even(payoff_at, 1)"), ("status = 'late'", "delay_s"), ("status = 'late'", "0.5")), "1", "case when status = 'late' then 'MOVE' else 'REWRITE' end",
        "case when status = 'late' then payoff_at else made_at end", "case when status = 'late' then payoff_end else made_end end",
        f"case when status = 'late' then 'Preview the payoff (' || {mmss('payoff_at')} || ') right after the promise, then explain how' else 'Deliver what this line promises, or drop the promise' end") + " from led where status <> 'kept'",
    "rule_model_only": SEGF + FLAGS + """,
h as (select * from segf s where risk = 'high' and not exists (select 1 from fl f where f.video_id = s.video_id and f.start < s."end" and f."end" > s.start)),
y as (select *, row_number() over (partition by video_id order by p_drop desc, idx) as r from h)
""" + flag("start", '"end"', "'medium'", "model_risk", "round_even(least(1, p_drop * 5), 3)", "'Model-estimated drop risk, no single clear cause'",
           "'The retention model rates this section high-risk, but no specific rule fired. Review it.'", evs("p_drop"), "0") + " from y where r <= 3",
    "flag_source": SEGF + FLAGS + """
select video_id, flag_id, case when exists (select 1 from segf s where s.video_id = f.video_id and s.risk = 'high' and s.start < f."end" and s."end" > f.start)
  then 'model+rule' else 'rule' end as source from fl f""",
    "snap_to_pause": SEGF + WORDS + """,
p as (select event_id // 50 as video_id, event_id::varchar as point_id, (event_id * 37 % 6000) / 10::double as t from events),
w as (select *, coalesce((lag("end") over o + start) / 2, start) as b, coalesce(("end" + lead(start) over o) / 2, "end") as a from sw window o as (partition by video_id order by word_idx)),
j as (select p.*, w.b, w.a, w.word_idx from p left join w on w.video_id = p.video_id and w.start < p.t and p.t < w."end"),
n as (select *, case when abs(a - t) < abs(b - t) then a else b end as near from j)
select video_id, point_id, t, round(case when word_idx is not null and abs(near - t) <= 1.5::double then round_even(near, 3) else t end, 3) as snapped from n""",
    "delivery_evidence": SEGF + FLAGS + INSIDE + """,
sp as (select * from ins where kind = 'speech'),
pp as (select video_id, flag_id, min(struct_pack(a := pitch_range_ratio, b := pitch_range_st)) filter (where pitch_range_ratio is not null) as p,
  max(struct_pack(a := longest_pause_s, b := -coalesce(longest_pause_at, 0), c := longest_pause_at)) filter (where longest_pause_s > 0) as g from sp group by 1, 2),
ph as (select video_id, flag_id, 'phrase ' || (k % 3) as phrase, arg_max(3 + k % 3, idx) as c, arg_max(s0, idx) as at1 from sp
  where category in ('repetition', 'low_information', 'pacing', 'model_risk') and k % 4 < 2 group by 1, 2, 3),
pr as (select *, row_number() over (partition by video_id, flag_id order by c desc, at1, phrase) as n from ph),
pl as (select video_id, flag_id, list('Phrase "' || phrase || '" said (first at 00:01)' order by n) as l, list(c::double order by n) as v from pr where n <= 2 group by 1, 2)
select f.video_id, f.flag_id, round(risk_score, 4) as risk_score,
  case when p.a < 0.6::double then ['Pitch range vs your average (flatter delivery)', 'Pitch range here'] else [] end
  || case when g.a >= 1.5::double and g.c is not null then ['Longest pause between words (at ' || """ + mmss("g.c") + """ || ')'] else [] end || coalesce(l, []) as labels,
  case when p.a < 0.6::double then [round(p.a, 4), round(p.b, 4)] else [] end || case when g.a >= 1.5::double and g.c is not null then [round(g.a, 4)] else [] end || coalesce(v, []) as vals,
  'planted' as reason from fl f left join pp using (video_id, flag_id) left join pl using (video_id, flag_id)""",
    "visual_evidence": SEGF + FLAGS + INSIDE + """,
t as (select video_id, flag_id, max(struct_pack(a := s1 - s0, b := -idx, c := visual_type, d := visual_type_share)) filter (where visual_type <> 'unclear') as top, min(speech_match_ratio) as m from ins group by 1, 2),
y as (select f.*, case when top is not null then top.c end as vt, top.d as sh, case when top is not null then m end as m, top is not null as has from fl f left join t using (video_id, flag_id))
select video_id, flag_id, round(risk_score, 4) as risk_score,
  case when has and category <> 'payoff_delay' then ['On screen: ' || """ + NAMES.replace("case visual_type", "case vt") + """] else [] end
  || case when has and category <> 'payoff_delay' and m < 0.8::double then ['Picture matches your words (vs your average)'] else [] end as labels,
  case when has and category <> 'payoff_delay' then [round(sh, 4)] else [] end || case when has and category <> 'payoff_delay' and m < 0.8::double then [round(m, 4)] else [] end as vals,
  case when has and category = 'visual_monotony' and action = 'ADD_VISUAL' then """ + FIXES + " else 'planted' end as reason from y",
    "visual_compensation": SEGF + FLAGS + INSIDE + """,
sp as (select *, case when cuts_per_minute >= 6 then """ + whole("cuts_per_minute") + """ || ' scene cuts per minute'
    when visual_type in ('diagram', 'chart', 'screen', 'broll') and visual_type_share >= 0.6::double and speech_match_ratio >= 1 then """ + NAMES + """ || ' on screen that matches the words' end as why
  from ins where kind = 'speech' and source = 'rule' and category in ('pacing', 'low_information', 'fillers')),
c as (select video_id, flag_id, count(coalesce(cuts_per_minute::varchar, visual_type, speech_match_ratio::varchar)) as n, count(why) as s, arg_min(why, idx) filter (where why is not null) as reason from sp group by 1, 2),
d as (select * from c where s > 0 and s * 2 >= n)
select f.video_id, f.flag_id, case when d.reason is not null then round_even(risk_score * 0.7::double, 3) else round(risk_score, 4) end as risk_score,
  case when d.reason is not null then ['Visuals may carry this stretch: ' || d.reason || ' (rule, not validated)'] else [] end as labels,
  case when d.reason is not null then [null::double] else [] end as vals, 'planted' as reason from fl f left join d using (video_id, flag_id)""",
}


def share(col, cond="true"):
    return f"case when {cond} and {col} is not null then (select count(*) from segf b where b.video_id = s.video_id and b.{col} <= s.{col}{'' if cond == 'true' else ' and b.kind = ' + chr(39) + 'speech' + chr(39)})::double / (select count(b.{col}) from segf b where b.video_id = s.video_id{'' if cond == 'true' else ' and b.kind = ' + chr(39) + 'speech' + chr(39)}) end"


SPK = "kind = 'speech'"
SCORES = SEGF + f""",
q as (select video_id, greatest(0.6::double, quantile_cont(repetition_similarity, 0.9)) as thr from segf where kind = 'speech' group by 1),
sh as (select s.*, q.thr, {share('semantic_novelty', SPK)} as pn, {share('information_gain', SPK)} as pg, {share('visual_change_mean')} as pv, {share('energy_variation_db')} as pe, {share('pitch_range_st')} as pp
  from segf s left join q using (video_id)),
ln as (select video_id, idx,
  case when kind = 'speech' then 100 * (pace_ratio - 0.5::double) / 0.6::double end as pacing,
  case when kind = 'speech' then 100 * (0.5::double * pn + 0.5::double * pg) * case when repetition_similarity >= thr then 0.6::double else 1 end end as content,
  100 * (0.4::double * (1 - static_ratio) + 0.3::double * least(1, coalesce(cuts_per_minute, 0) / 6) + 0.3::double * coalesce(pv, 0)) as visual,
  case when kind = 'speech' then 100 * (0.35::double * (1 - silence_ratio) + 0.2::double * coalesce(pe, 0.5::double) + 0.2::double * coalesce(pp, 0.5::double)
    + 0.25::double * (1 - least(1, coalesce(clipping_ratio, 0) * 100))) - case when energy_db < -8 then 20 else 0 end end as audio from sh),
cl as (select video_id, idx, case when pacing is not null then least(100, greatest(0, pacing)) end as pacing, case when content is not null then least(100, greatest(0, content)) end as content,
  case when visual is not null then least(100, greatest(0, visual)) end as visual, case when audio is not null then least(100, greatest(0, audio)) end as audio from ln),
sco as (select video_id, idx, round_even(round(pacing, 9), 1) as pacing, round_even(round(content, 9), 1) as content, round_even(round(visual, 9), 1) as visual, round_even(round(audio, 9), 1) as audio,
  round_even(round(list_avg(list_filter([pacing, content, visual, audio], lambda x: x is not null)), 9), 1) as overall from cl)"""

NUM = lit(scores.NUMBER)


def forms(x):
    return (
        f"[printf('%.0f', round_even({x}, 0)), printf('%.1f', round_even({x}, 1)), printf('%.2f', round_even({x}, 2))] || case when {x} between 0 and 1 then "
        f"[printf('%.0f%%', round_even({x} * 100, 0)), printf('%.0f', round_even({x} * 100, 0)), printf('%.1f%%', round_even({x} * 100, 1))] else [] end"
    )


WORDLIST = "list_filter(string_split_regex(%s, '[ \\n\\t\\r]+'), lambda x: x <> '')"
DEVA = "length(regexp_replace(%s, '[^\\x{0900}-\\x{097F}]', '', 'g')) / greatest(length(regexp_replace(%s, '[^\\p{L}]', '', 'g')), 1)::double"


def retok(col):
    return TOKENS.replace("string_split_regex(text,", f"string_split_regex({col},")



SQL |= {
    "segment_scores": SCORES + " select * from sco",
    "flag_evidence_json": SEGF + FLAGS + WORDS + f""",
said as (select f.video_id, f.flag_id, f.category, f.severity, f.source, f.action, f.k, f.start as s0, {mmss('f.start')} as a, {mmss('f."end"')} as b, {mmss('f.start + 5')} as c,
  coalesce(left(string_agg(w.text, ' ' order by w.word_idx), 500), '') as excerpt
  from fl f left join sw w on w.video_id = f.video_id and w.start >= f.start and w.start < f."end" group by all)
select video_id, flag_id, excerpt, '{{"flag":{{"category":"' || category || '","severity":"' || severity || '","source":"' || source || '","start":"' || a || '","end":"' || b || '","title":"flag ' || k
  || '"}},"evidence":[{{"label":"Planted","value":' || k || '.0,"unit":"s"}}],"suggested_edits":[{{"action":"' || action || '","start":"' || a || '","end":"' || c
  || '","reason":"planted"}}],"transcript_excerpt":"' || excerpt || '"}}' as evidence_json from said""",
    "number_guard": f"""with e as (select event_id, value, json_extract_string(props, '$.k')::int as k from events),
t as (select event_id, '{{"value": ' || value || ', "k": ' || k || '}}' as blob, value, k / 100::double as s,
  'About ' || round_even(value, 0)::int || ' or ' || k || '%, two of 3, at 1:' || lpad((event_id % 60)::varchar, 2, '0') || ' near ' || (event_id % 17) || '.5 times' as text from e),
a as (select *, regexp_extract_all(blob, {NUM}, 1) || {forms('value')} || {forms('s')} as own from t),
b as (select *, own || list_transform(own, lambda x: rtrim(x, '%')) as allowed from a)
select event_id, list_filter(regexp_extract_all(text, {NUM}, 1), lambda n: not (list_contains(allowed, n) or list_contains(allowed, rtrim(n, '%')) or rtrim(n, '%') in ('0', '1', '2', '3'))) as new_numbers from b""",
    "rewrite_gate": TURNS + f""",
w as (select video_id, sent_idx, text as original, {WORDLIST % 'text'} as w from turns),
k as (select *, array_to_string(list_filter(list_transform(w, lambda x, i: case when (i - 1) % 10 < 4 + sent_idx * 2 % 7 then x end), lambda x: x is not null), ' ')
   || case when sent_idx % 5 = 4 then ' 42%' else '' end as rewrite from w),
c as (select video_id, sent_idx, original, trim(rewrite) as rewrite, len(w)::int as n, len({WORDLIST % 'rewrite'})::int as m from k),
d as (select *, greatest(6, floor(n * 0.8::double)) as most, greatest(1, floor(n * 0.35::double)) as least,
  regexp_extract_all(original, {lit(scores.SOURCE_NUMBER)}, 1) as src, regexp_extract_all(rewrite, {NUM}, 1) as nums from c),
b as (select *, list_filter(nums, lambda x: not (list_contains(src, x) or list_contains(src, rtrim(x, '%')) or list_contains(list_transform(src, lambda y: rtrim(y, '%')), x) or list_contains(list_transform(src, lambda y: rtrim(y, '%')), rtrim(x, '%')) or rtrim(x, '%') in ('0', '1', '2', '3'))) as added from d),
e as (select *, list_filter([case when m > most then 'not shorter enough (' || m || ' words, limit ' || most::int || ')' end, case when m < least then 'cut too much (' || m || ' words, at least ' || least::int || ')' end,
   case when len(added) > 0 then 'added numbers not in the original: ' || array_to_string(added, ', ') end,
   case when abs({DEVA % ('rewrite', 'rewrite')} - {DEVA % ('original', 'original')}) > 0.35::double then 'wrong script for the video''s language' end], lambda x: x is not null) as why from b),
osrc as (select video_id, sent_idx, {retok('original')} as toks from c),
rsrc as (select video_id, sent_idx, {retok('rewrite')} as toks from c)""" + vectors("ov", "osrc", "video_id, sent_idx") + vectors("rv", "rsrc", "video_id, sent_idx") + """,
s as (select o.video_id, o.sent_idx, round_even(round(sum(o.w * r.w), 12), 3) as sim from ov o join rv r using (video_id, sent_idx, dim) group by 1, 2),
f as (select e.*, case when len(why) = 0 and n >= 12 then coalesce(sim, 0) end as ms from e left join s using (video_id, sent_idx)),
g as (select *, case when n < 12 then ['too little text to rewrite'] when ms < 0.7::double then list_append(why, 'meaning changed (similarity ' || ms || ', needs 0.7)') else why end as rejected from f)
select video_id, sent_idx, rewrite, n as original_words, m as rewrite_words, ms as meaning_similarity, len(rejected) = 0 as accepted,
  case when len(rejected) = 0 then round_even((n - m) / 2.5::double, 1) end as est_seconds_saved, rejected from g""",
    "report_rollup": SCORES + FLAGS + LEDGER + POINTS + """
select s.video_id, count(*) as segments, sum(filler_count)::bigint as fillers,
  (select count(*) from fl f where f.video_id = s.video_id) as flags, (select count(*) from fl f where f.video_id = s.video_id and severity = 'high') as high_flags,
  (select count(*) from led l where l.video_id = s.video_id and status <> 'kept') as broken_promises,
  (select round(round(avg(pacing), 9), 4) from sco x where x.video_id = s.video_id) as pacing, (select round(round(avg(content), 9), 4) from sco x where x.video_id = s.video_id) as content,
  (select round(round(avg(visual), 9), 4) from sco x where x.video_id = s.video_id) as visual, (select round(round(avg(audio), 9), 4) from sco x where x.video_id = s.video_id) as audio,
  (select round(arg_max(retention, t), 4) from pts p where p.video_id = s.video_id) as end_retention, (select round(arg_max(lower, t), 4) from pts p where p.video_id = s.video_id) as end_lower,
  (select round(arg_max(upper, t), 4) from pts p where p.video_id = s.video_id) as end_upper from segf s group by 1""",
    "display_order": SEGF + FLAGS + " select video_id, flag_id, row_number() over (partition by video_id order by severity, start, flag_id) as place from fl",
    "flag_for_promise": SEGF + FLAGS + LEDGER + """,
c as (select l.video_id, l.made_at, f.flag_id, row_number() over (partition by l.video_id, l.made_at order by case when abs(f.start - l.made_at) < 0.5::double then 0 else 1 end, f.start, f.flag_id) as r
  from led l join fl f on f.video_id = l.video_id and f.category = 'payoff_delay'
   and (abs(f.start - l.made_at) < 0.5::double or (f.start <= l.made_at + 0.5::double and l.made_at < f."end" + 0.5::double)))
select l.video_id, l.made_at, c.flag_id from led l left join c on c.video_id = l.video_id and c.made_at = l.made_at and r = 1""",
}
