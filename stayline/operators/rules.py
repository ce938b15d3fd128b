"""Drop-off rules. Each takes whole-corpus tables and returns flags in one shape; ``assemble``
puts them together, numbers them and attaches evidence.

``segs`` is one row per segment with its text features, risk and audio / picture features.
Per-video windows hold one timeline. The titles, explanations, labels and reasons below are fixed
values, like the thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stayline.functions.timeline import flag_runs, mmss, overlap_join
from stayline.session import ensure_checkpoint_dir

# Fixed values
HOOK_S, LEAD_SILENCE_S, FILLER_RATIO = 30.0, 5.0, 0.06
MIN_TITLE_WORDS, LATE_AFTER_S, HIGH_AFTER_S = 3, 30.0, 60.0
REPEAT_FLAG, REPEAT_HIGH, REPEAT_Q, REPEAT_MAX = 0.60, 0.70, 0.90, 5
GAIN_FLAG, GAIN_Q, GAIN_RUN_S = 0.35, 0.20, 24.0
SLOW_RATIO, PACE_MIN_S = 0.70, 5.0
SILENCE_S, MUSIC_SHARE, DEAD_AIR, MUSIC_MIN_S = 6.0, 0.4, 0.6, 45.0
STATIC_S = 20.0
SNAP_S = 1.5
MODEL_MAX = 3
FLAT_PITCH, PAUSE_S = 0.6, 1.5
PHRASE_CATEGORIES = ["repetition", "low_information", "pacing", "model_risk"]
WEAK_MATCH = 0.8
MATCH_CATEGORIES = ["low_information", "repetition", "pacing", "model_risk", "visual_monotony"]
COMPENSATED = ["pacing", "low_information", "fillers"]
STRONG_CUTS, STRONG_TYPES, STRONG_SHARE, STRONG_MATCH, COMPENSATION = 6.0, ["diagram", "chart", "screen", "broll"], 0.6, 1.0, 0.7
VISUAL_NAMES = {
    "slide_text": "Slide with text", "diagram": "Diagram", "chart": "Chart or table", "screen": "Screen recording or code",
    "talking_head": "Person talking to camera", "broll": "Footage or photo", "blank": "Blank or title card", "unclear": "Unclear",
}
VISUAL_FIX = {
    "talking_head": "Cut to a diagram, a screen recording or B-roll here",
    "slide_text": "Change the slide, or reveal it point by point as you speak",
    "diagram": "Animate or annotate the diagram, or cut back to camera",
    "chart": "Highlight the number you are talking about, or zoom into the chart",
    "screen": "Zoom into the part of the screen you are talking about",
    "broll": "Switch the footage to match what you are saying",
    "blank": "Put something on screen: the topic, a diagram or your face",
}

def _video():
    return W.partitionBy("video_id")

_NO_EDITS = "array<struct<action:string,start:double,end:double,target_time:double,reason:string,rewrite_text:string>>"


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def evidence(label, value, unit=None, ref_start=None, ref_end=None, text: bool = False) -> Column:
    """One piece of evidence; a value is a number or a text."""
    v = _col(value)
    return F.struct(
        _col(label).cast("string").alias("label"),
        (F.lit(None) if text else v).cast("double").alias("value_num"),
        (v if text else F.lit(None)).cast("string").alias("value_str"),
        _col(unit).cast("string").alias("unit"),
        _col(ref_start).cast("double").alias("ref_start"),
        _col(ref_end).cast("double").alias("ref_end"),
    )


def edit(action: str, start, end, reason, target_time=None, rewrite_text=None) -> Column:
    return F.struct(
        F.lit(action).alias("action"), _col(start).cast("double").alias("start"), _col(end).cast("double").alias("end"),
        _col(target_time).cast("double").alias("target_time"), _col(reason).cast("string").alias("reason"),
        _col(rewrite_text).cast("string").alias("rewrite_text"),
    )


def _flags(df: DataFrame, rule: int, *, start, end, severity, category, risk, title, why, ev: list[Column], edits: list[Column] = ()) -> DataFrame:
    listed = F.array_compact(F.array(*edits)) if edits else F.array().cast(_NO_EDITS)
    return df.select(
        "video_id", F.lit(rule).alias("rule"), _col(start).cast("double").alias("start"), _col(end).cast("double").alias("end"),
        _col(severity).alias("severity"), F.lit(category).alias("category"), _col(risk).cast("double").alias("risk_score"),
        _col(title).alias("title"), _col(why).alias("explanation"),
        F.array_compact(F.array(*ev)).alias("evidence"), listed.alias("edits"),
    )


def _whole(c: Column) -> Column:
    """A number as text without decimals."""
    return F.bround(c).cast("long").cast("string")


def video_facts(segs: DataFrame) -> DataFrame:
    """(video_id, duration_s, hook_end, first_speech, hook_fillers, speech_share)."""
    hook = F.least(F.lit(HOOK_S), F.col("duration_s"))
    speech = F.col("kind") == "speech"
    said = F.coalesce("speech_end", "end") - F.coalesce("speech_start", "start")
    return segs.groupBy("video_id").agg(
        F.max("duration_s").alias("duration_s"), F.max(hook).alias("hook_end"),
        F.coalesce(F.min_by("speech_start", F.when(speech, F.col("idx"))), F.lit(0.0)).alias("first_speech"),
        F.coalesce(F.sum(F.when(F.col("start") < hook, F.col("filler_count"))), F.lit(0)).alias("hook_fillers"),
        (F.coalesce(F.sum(F.when(speech, said)), F.lit(0.0)) / F.greatest(F.max("duration_s"), F.lit(1e-6))).alias("speech_share"),
    )


def rule_slow_hook(segs: DataFrame, words: DataFrame) -> DataFrame:
    """Nothing said for the first seconds, or too many fillers in the opening."""
    facts = video_facts(segs)
    n = words.where(F.col("start") < HOOK_S).groupBy("video_id").agg(F.count(F.lit(1)).alias("hook_words"))
    x = facts.join(n, "video_id", "left")
    quiet = F.col("first_speech") >= LEAD_SILENCE_S
    fillers = F.coalesce(F.try_divide("hook_fillers", "hook_words"), F.lit(0.0)) >= FILLER_RATIO
    x = x.withColumns({"_q": quiet, "_f": fillers}).where("_q or _f")
    said = F.array_compact(F.array(
        F.when(F.col("_q"), F.concat(F.lit("nothing is said for the first "), _whole(F.col("first_speech")), F.lit(" s"))),
        F.when(F.col("_f"), F.concat(F.col("hook_fillers").cast("string"), F.lit(" filler words in the first "), _whole(F.col("hook_end")), F.lit(" s"))),
    ))
    x = x.withColumn("_why", said)
    before = F.col("first_speech") - 0.5
    return _flags(
        x, 1, start=0.0, end=F.col("hook_end"), severity="high", category="slow_hook", risk=0.8,
        title=F.concat(F.lit("Slow hook: "), F.col("_why")[0]),
        why=F.concat(F.lit("The opening is where most viewers decide to leave; "), F.array_join("_why", "; "), F.lit(".")),
        ev=[
            F.when(F.col("_q"), evidence("No speech before", F.bround("first_speech", 1), "s")),
            F.when(F.col("_f"), evidence("Filler words in the first 30 s", F.col("hook_fillers"))),
        ],
        edits=[
            F.when(F.col("_q"), edit("CUT", 0.0, F.greatest(F.lit(0.0), before), F.concat(F.lit("Cut the silent intro 00:00–"), mmss(before)))),
            F.when(F.col("_f"), edit("REWRITE", 0.0, F.col("hook_end"), "Tighten the opening: remove filler words and channel housekeeping")),
        ],
    )


def rule_late_promise(segs: DataFrame, promises: DataFrame, sentences: DataFrame) -> DataFrame:
    """The title is addressed late or never. ``promises``: title, first_mention_s, best_match_s,
    best_similarity per video."""
    when = F.col("first_mention_s")
    x = promises.where((F.size(F.split(F.trim("title"), r"\s+")) >= MIN_TITLE_WORDS) & (when.isNull() | (when > LATE_AFTER_S)))
    s = sentences.select("video_id", F.col("sent_idx"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("text").alias("_t"))
    line = (
        x.select("video_id", "first_mention_s").join(s, "video_id")
        .where((F.col("_s") <= when) & (when < F.col("_e") + 1e-6))
        .groupBy("video_id").agg(F.min_by(F.struct("_s", "_e", "_t"), "sent_idx").alias("line"))
    )
    x = x.join(video_facts(segs), "video_id").join(line, "video_id", "left")
    high = when.isNull() | (when > HIGH_AFTER_S)
    return _flags(
        x, 2, start=0.0, end=F.coalesce(when, F.least(F.lit(60.0), F.col("duration_s"))),
        severity=F.when(high, "high").otherwise("medium"), category="payoff_delay", risk=0.75,
        title=F.when(when.isNotNull(), F.concat(F.lit("Title promise not addressed until "), mmss(when))).otherwise("The video never clearly addresses its title"),
        why="Viewers clicked for the title; until it is addressed they have no reason to stay.",
        ev=[
            evidence("Title", F.col("title"), text=True),
            F.when(when.isNotNull(), evidence("Title promise first addressed at", F.bround(when, 1), "s")),
            F.when(F.col("best_similarity").isNotNull(), evidence("Best title match (similarity)", F.col("best_similarity"), None, F.col("best_match_s"))),
        ],
        edits=[F.when(F.col("line").isNotNull(), edit(
            "MOVE", F.col("line._s"), F.col("line._e"), F.concat(F.lit("Move the line at "), mmss(F.col("line._s")), F.lit(" to the opening as the hook")),
            F.col("first_speech"), F.col("line._t")))],
    )


def rule_repetition(segs: DataFrame, promises: DataFrame) -> DataFrame:
    """Segments that say again what was said well before, judged against the video's own level;
    the strongest few. A segment that only echoes the promise line is the payoff, not a repeat."""
    speech = segs.where("kind = 'speech'")
    usual = F.percentile("repetition_similarity", F.lit(REPEAT_Q)).over(_video())
    x = speech.withColumn("_thr", F.greatest(F.lit(REPEAT_FLAG), usual)).where(F.col("repetition_similarity") >= F.col("_thr"))
    m = segs.select("video_id", F.col("idx").alias("repetition_match_segment"), F.col("start").alias("_ms"), F.col("end").alias("_me"))
    x = x.join(m, ["video_id", "repetition_match_segment"]).join(promises.select("video_id", "first_mention_s"), "video_id", "left")
    fm, hits = F.col("first_mention_s"), F.col("repetition_matches")
    echo = F.when(F.size(hits) > 0, F.forall(hits, lambda h: (h["matched_start"] <= fm) & (fm < h["matched_end"] + 1e-6))).otherwise(
        (F.col("_ms") <= fm) & (fm < F.col("_me")))
    x = x.where(fm.isNull() | ~echo)
    best = _video().orderBy(F.desc("repetition_similarity"), "start")
    x = x.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= REPEAT_MAX)
    lo, hi = F.coalesce("speech_start", "start"), F.coalesce("speech_end", "end")
    a = F.greatest(lo, F.coalesce(F.array_min(F.transform(hits, lambda h: h["start"])), lo))
    b = F.least(hi, F.coalesce(F.array_max(F.transform(hits, lambda h: h["end"])), hi))
    x = x.withColumns({"_lo": lo, "_hi": hi, "_a": a, "_b": b, "_span": F.concat(mmss(F.col("_ms")), F.lit("–"), mmss(F.col("_me")))})
    short = F.col("_b") - F.col("_a") < 1.0
    x = x.withColumns({"_a": F.when(short, F.col("_lo")).otherwise(F.col("_a")), "_b": F.when(short, F.col("_hi")).otherwise(F.col("_b"))})
    sim = F.col("repetition_similarity")
    return _flags(
        x, 3, start=F.col("start"), end=F.col("end"), severity=F.when(sim >= REPEAT_HIGH, "high").otherwise("medium"),
        category="repetition", risk=F.bround(F.least(F.lit(1.0), sim), 3), title=F.concat(F.lit("Repeats "), F.col("_span")),
        why=F.concat(F.lit("This section says much the same as "), F.col("_span"), F.lit(" (similarity "), sim.cast("string"), F.lit(", above this video's usual level).")),
        ev=[
            evidence("Similarity to earlier section", sim, None, F.col("_ms"), F.col("_me")),
            evidence("This video's usual similarity (90th percentile)", F.bround("_thr", 4)),
            F.when(F.col("semantic_novelty").isNotNull(), evidence("New information vs everything before", F.col("semantic_novelty"))),
        ],
        edits=[edit("CUT", F.col("_a"), F.col("_b"), F.concat(F.lit("Cut "), mmss(F.col("_a")), F.lit("–"), mmss(F.col("_b")), F.lit(": repeats "), F.col("_span")))],
    )


def rule_low_information(segs: DataFrame) -> DataFrame:
    """Runs of speech that add little, below an absolute level and the video's own low level."""
    speech = segs.where("kind = 'speech'")
    thr = F.least(F.lit(GAIN_FLAG), F.percentile("information_gain", F.lit(GAIN_Q)).over(_video()))
    x = speech.withColumn("_thr", F.coalesce(thr, F.lit(GAIN_FLAG)))
    runs = flag_runs(x, ["video_id"], "idx", F.col("information_gain") < F.col("_thr")).groupBy("video_id", "run").agg(
        F.min("start").alias("s"), F.max("end").alias("e"), F.min("information_gain").alias("low"),
        F.min_by(F.struct("start", "end"), F.struct("information_gain", "idx")).alias("worst"),
    ).where(F.col("e") - F.col("s") >= GAIN_RUN_S)
    span = F.col("e") - F.col("s")
    return _flags(
        runs, 4, start=F.col("s"), end=F.col("e"), severity="medium", category="low_information", risk=0.5,
        title=F.concat(F.lit("Little new information for "), _whole(span), F.lit(" s")),
        why=F.concat(mmss(F.col("s")), F.lit("–"), mmss(F.col("e")), F.lit(" adds little beyond the previous minute, even by this video's own standard.")),
        ev=[evidence("Duration", F.bround(span, 1), "s"), evidence("Lowest information gain", F.bround("low", 4))],
        edits=[edit("SHORTEN", F.col("worst.start"), F.col("worst.end"), F.concat(F.lit("Shorten "), mmss(F.col("worst.start")), F.lit("–"), mmss(F.col("worst.end")), F.lit(", the least new part")))],
    )


def rule_pacing(segs: DataFrame) -> DataFrame:
    """Runs of segments much slower than the video's usual pace."""
    slow = (F.col("kind") == "speech") & (F.col("end") - F.col("start") >= PACE_MIN_S) & (F.col("pace_ratio") < SLOW_RATIO)
    runs = flag_runs(segs, ["video_id"], "idx", slow).groupBy("video_id", "run").agg(
        F.min("start").alias("s"), F.max("end").alias("e"), F.min("pace_ratio").alias("low"))
    return _flags(
        runs, 5, start=F.col("s"), end=F.col("e"), severity="medium", category="pacing", risk=0.4, title="Slower than your average pace",
        why=F.concat(F.lit("Speaking rate drops to "), _whole(F.col("low") * 100), F.lit("% of this video's own average.")),
        ev=[evidence("Slowest pace vs your average", F.col("low")), evidence("Duration", F.bround(F.col("e") - F.col("s"), 1), "s")],
        edits=[edit("SHORTEN", F.col("s"), F.col("e"), "Tighten pauses or trim this section")],
    )


def rule_silence(segs: DataFrame) -> DataFrame:
    """Long stretches without speech after the opening: dead air, or music worth a look."""
    facts = video_facts(segs).select("video_id", "hook_end", "speech_share")
    x = segs.join(facts, "video_id")
    runs = flag_runs(x, ["video_id"], "idx", (F.col("kind") == "silence") & (F.col("start") >= F.col("hook_end"))).groupBy("video_id", "run").agg(
        F.min("start").alias("s"), F.max("end").alias("e"), F.avg("silence_ratio").alias("quiet"), F.first("speech_share").alias("share"))
    span = F.col("e") - F.col("s")
    dead = F.when(F.col("quiet").isNotNull(), F.col("quiet") >= DEAD_AIR).otherwise(F.col("share") >= MUSIC_SHARE)
    x = runs.withColumn("dead", dead).where((span >= SILENCE_S) & (F.col("dead") | (span >= MUSIC_MIN_S)))
    return _flags(
        x, 6, start=F.col("s"), end=F.col("e"), severity="medium", category="silence", risk=F.when(F.col("dead"), 0.6).otherwise(0.3),
        title=F.concat(_whole(span), F.when(F.col("dead"), " s of dead air").otherwise(" s of music/visuals without speech")),
        why=F.when(F.col("dead"), "No speech and almost no sound here; viewers have nothing to hold on to.").otherwise(
            "Music or visuals carry this stretch without speech. Fine if something worth watching is on screen; long stretches risk losing viewers."),
        ev=[
            evidence("No speech for", F.bround(span, 1), "s"),
            F.when(F.col("dead") & F.col("quiet").isNotNull(), evidence("Share of this stretch that is silent audio", F.bround("quiet", 3))),
            F.when(~F.col("dead"), evidence("Share of video with speech", F.bround("share", 3))),
        ],
        edits=[edit("CUT", F.col("s") + 0.5, F.col("e") - 0.5, F.concat(F.lit("Trim "), mmss(F.col("s")), F.lit("–"), mmss(F.col("e")), F.lit(" to a short beat")))],
    )


def rule_static(segs: DataFrame) -> DataFrame:
    """The picture barely changes for a long time."""
    x = segs.where(F.col("longest_static_s") >= STATIC_S)
    return _flags(
        x, 7, start=F.col("start"), end=F.col("end"), severity="medium", category="visual_monotony", risk=0.4, title="Picture barely changes",
        why=F.concat(F.lit("The picture is almost static for "), _whole(F.col("longest_static_s")), F.lit(" s.")),
        ev=[evidence("Longest static stretch", F.col("longest_static_s"), "s"), evidence("Seconds since last cut", F.col("seconds_since_cut"), "s")],
        edits=[edit("ADD_VISUAL", F.col("start"), F.col("end"), "Add B-roll, a screen recording or a cut here")],
    )


def rule_ledger(ledger: DataFrame) -> DataFrame:
    """Promises of the opening that pay off late or never."""
    x = ledger.where("source = 'intro' and status <> 'kept'")
    late = F.col("status") == "late"
    made, paid = mmss(F.col("made_at")), mmss(F.col("payoff_at"))
    return _flags(
        x, 8, start=F.col("made_at"), end=F.col("made_end"), severity=F.when(late, "medium").otherwise("high"), category="payoff_delay",
        risk=F.when(late, 0.6).otherwise(0.7),
        title=F.when(late, F.concat(F.lit("Promise at "), made, F.lit(" kept only at "), paid, F.lit(" ("), mmss(F.col("delay_s")), F.lit(" later)"))).otherwise(
            F.concat(F.lit("Promise at "), made, F.lit(" is never clearly paid off"))),
        why=F.when(late, "Viewers were promised something early and wait a long time for it; many leave before the payoff.").otherwise(
            "An open loop: the video promises something it never visibly delivers, which costs trust and watch time."),
        ev=[
            evidence("Promise", F.col("text"), None, F.col("made_at"), F.col("made_end"), text=True),
            F.when(late, evidence("Paid off at", F.bround("payoff_at", 1), "s", F.col("payoff_at"), F.col("payoff_end"))),
            F.when(late, evidence("Delay", F.col("delay_s"), "s")),
            F.when(late, evidence("Payoff match (similarity)", F.col("similarity"))),
        ],
        edits=[
            F.when(late, edit("MOVE", F.col("payoff_at"), F.col("payoff_end"), F.concat(F.lit("Preview the payoff ("), paid, F.lit(") right after the promise, then explain how")), F.col("made_end"), F.col("payoff_text"))),
            F.when(~late, edit("REWRITE", F.col("made_at"), F.col("made_end"), "Deliver what this line promises, or drop the promise")),
        ],
    )


def rule_model_only(segs: DataFrame, flags: DataFrame) -> DataFrame:
    """High-risk segments no rule explains, the three with the largest drop."""
    high = segs.where("risk = 'high'").select("video_id", "idx", "start", "end", "p_drop")
    hit = overlap_join(high, flags.select("video_id", "start", "end"), closed=False).select("video_id", "idx").distinct()
    x = high.join(hit, ["video_id", "idx"], "left_anti")
    x = x.withColumn("_r", F.row_number().over(_video().orderBy(F.desc("p_drop"), "idx"))).where(F.col("_r") <= MODEL_MAX)
    return _flags(
        x, 9, start=F.col("start"), end=F.col("end"), severity="medium", category="model_risk", risk=F.bround(F.least(F.lit(1.0), F.col("p_drop") * 5), 3),
        title="Model-estimated drop risk, no single clear cause",
        why="The retention model rates this section high-risk, but no specific rule fired. Review it.",
        ev=[evidence("Model-estimated drop probability", F.col("p_drop"))],
    )


# ---------------------------------------------------------------- enrichment


def flag_source(flags: DataFrame, segs: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``source``: rule, or model+rule where a high-risk segment overlaps; model-only flags
    stay model. ``keys`` identify a flag within all flags."""
    high = segs.where("risk = 'high'").select("video_id", "start", "end")
    hit = overlap_join(flags.select(*keys, "start", "end"), high, closed=False).select(*keys).distinct().withColumn("_m", F.lit(True))
    x = flags.join(hit, keys, "left")
    src = F.when(F.col("category") == "model_risk", "model").when(F.col("_m"), "model+rule").otherwise("rule")
    return x.withColumn("source", src).drop("_m")


def snap_to_pause(points: DataFrame, words: DataFrame, window_s: float = SNAP_S) -> DataFrame:
    """Adds ``snapped``: a time inside a word moves to the nearer pause around it, if close
    enough. ``points``: video_id, point_id, t. The word is the last one starting before t, found in
    one ordered pass over words and points together."""
    order = W.partitionBy("video_id").orderBy("word_idx")
    around = words.select(
        "video_id", F.col("start").alias("t"), F.lit(1).alias("_k"), F.lit(None).cast(points.schema["point_id"].dataType).alias("point_id"),
        F.struct(
            "start", "end",
            F.coalesce((F.lag("end").over(order) + F.col("start")) / 2, F.col("start")).alias("before"),
            F.coalesce((F.col("end") + F.lead("start").over(order)) / 2, F.col("end")).alias("after"),
        ).alias("w"),
    )
    asks = points.select("video_id", "t", F.lit(0).alias("_k"), "point_id", F.lit(None).cast(around.schema["w"].dataType).alias("w"))
    seen = W.partitionBy("video_id").orderBy("t", "_k").rowsBetween(W.unboundedPreceding, 0)
    x = around.unionByName(asks).withColumn("w", F.last("w", ignorenulls=True).over(seen)).where("_k = 0")
    t = F.col("t")
    inside = F.coalesce((F.col("w.start") < t) & (t < F.col("w.end")), F.lit(False))
    near = F.when(F.abs(F.col("w.after") - t) < F.abs(F.col("w.before") - t), F.col("w.after")).otherwise(F.col("w.before"))
    moved = F.when(inside & (F.abs(near - t) <= window_s), F.bround(near, 3)).otherwise(t)
    return x.select("video_id", "point_id", "t", moved.alias("snapped"))


def _inside(flags: DataFrame, segs: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    return overlap_join(flags.select(*keys, "category", "start", "end"), segs.select("video_id", "idx", "start", "end", *cols), closed=False)


def _append(flags: DataFrame, extra: DataFrame, keys: list[str], col: str) -> DataFrame:
    more = F.coalesce(F.array_compact(F.col(col)), F.array().cast(flags.schema["evidence"].dataType))
    return flags.join(extra, keys, "left").withColumn("evidence", F.concat("evidence", more)).drop(col)


def delivery_evidence(flags: DataFrame, segs: DataFrame, keys: list[str], phrases: DataFrame | None = None) -> DataFrame:
    """Appends flat pitch, the longest pause and repeated phrases of the flagged range.
    ``phrases``: video_id, idx, phrase, count, at, first_at."""
    x = _inside(flags.where("category <> 'silence'"), segs.where("kind = 'speech'"), keys, ["pitch_range_ratio", "pitch_range_st", "longest_pause_s", "longest_pause_at"])
    x = x.groupBy(*keys).agg(
        F.min(F.when(F.col("pitch_range_ratio_r").isNotNull(), F.struct("pitch_range_ratio_r", "pitch_range_st_r"))).alias("p"),
        F.max(F.when(F.col("longest_pause_s_r") > 0, F.struct("longest_pause_s_r", (-F.coalesce("longest_pause_at_r", F.lit(0.0))).alias("at"), F.col("longest_pause_at_r").alias("real")))).alias("g"),
    )
    flat = F.col("p.pitch_range_ratio_r") < FLAT_PITCH
    long = (F.col("g.longest_pause_s_r") >= PAUSE_S) & F.col("g.real").isNotNull()
    more = F.array(
        F.when(flat, evidence("Pitch range vs your average (flatter delivery)", F.col("p.pitch_range_ratio_r"))),
        F.when(flat, evidence("Pitch range here", F.col("p.pitch_range_st_r"), "semitones")),
        F.when(long, evidence(F.concat(F.lit("Longest pause between words (at "), mmss(F.col("g.real")), F.lit(")")), F.col("g.longest_pause_s_r"), "s")),
    )
    out = _append(flags, x.select(*keys, more.alias("_more")), keys, "_more")
    if phrases is None:
        return out
    said = _inside(flags.where(F.col("category").isin(PHRASE_CATEGORIES)), segs.where("kind = 'speech'"), keys, []).withColumnRenamed("idx_r", "_i")
    said = said.select(*keys, "_i").join(phrases.withColumnRenamed("idx", "_i"), ["video_id", "_i"])
    # one row per phrase (its last mention in the range), then the two said most
    per = said.groupBy(*keys, "phrase").agg(F.max_by(F.struct("count", "at", "first_at"), "_i").alias("s")).select(*keys, "phrase", "s.*")
    top = W.partitionBy(*keys).orderBy(F.desc("count"), "at", "phrase")
    label = F.concat(F.lit('Phrase "'), F.col("phrase"), F.lit('" said (first at '), mmss(F.col("first_at")), F.lit(")"))
    two = per.withColumn("_n", F.row_number().over(top)).where("_n <= 2").groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_n", evidence(label, F.col("count"), "times").alias("e")))), lambda z: z["e"]).alias("_more"))
    return _append(out, two, keys, "_more")


def _names(c: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in VISUAL_NAMES.items() for x in kv])
    return F.coalesce(m[c], c)


def visual_evidence(flags: DataFrame, segs: DataFrame, keys: list[str]) -> DataFrame:
    """Appends what is on screen and a weak picture-words match; sharpens picture edits."""
    x = _inside(flags, segs, keys, ["visual_type", "visual_type_share", "speech_match_ratio"])
    typed = (F.col("visual_type_r") != "unclear")
    x = x.groupBy(*keys, "category").agg(
        F.max(F.when(typed, F.struct((F.col("end_r") - F.col("start_r")).alias("len"), (-F.col("idx_r")).alias("neg"), "visual_type_r", "visual_type_share_r"))).alias("top"),
        F.min("speech_match_ratio_r").alias("match"),
    ).where("top is not null")
    shown = F.col("category").isin(["visual_monotony", *MATCH_CATEGORIES])
    weak = F.col("category").isin(MATCH_CATEGORIES) & (F.col("match") < WEAK_MATCH)
    more = F.array(
        F.when(shown, evidence(F.concat(F.lit("On screen: "), _names(F.col("top.visual_type_r"))), F.col("top.visual_type_share_r"))),
        F.when(weak, evidence("Picture matches your words (vs your average)", F.col("match"))),
    )
    fixes = F.create_map(*[F.lit(z) for kv in VISUAL_FIX.items() for z in kv])
    fix = F.when(F.col("category") == "visual_monotony", fixes[F.col("top.visual_type_r")])
    out = _append(flags, x.select(*keys, more.alias("_more"), fix.alias("_fix")), keys, "_more")
    sharper = F.transform("edits", lambda e: F.when((e["action"] == "ADD_VISUAL") & F.col("_fix").isNotNull(), e.withField("reason", F.col("_fix"))).otherwise(e))
    return out.withColumn("edits", sharper).drop("_fix")


def visual_compensation(flags: DataFrame, segs: DataFrame, keys: list[str]) -> DataFrame:
    """Rule-only flags count less where strong pictures carry at least half the covered speech.
    Speech without any picture measurement is not counted."""
    cand = flags.where((F.col("source") == "rule") & F.col("category").isin(COMPENSATED))
    x = _inside(cand, segs.where("kind = 'speech'"), keys, ["cuts_per_minute", "visual_type", "visual_type_share", "speech_match_ratio"])
    why = F.when(F.col("cuts_per_minute_r") >= STRONG_CUTS, F.concat(_whole(F.col("cuts_per_minute_r")), F.lit(" scene cuts per minute"))).when(
        F.col("visual_type_r").isin(STRONG_TYPES) & (F.col("visual_type_share_r") >= STRONG_SHARE) & (F.col("speech_match_ratio_r") >= STRONG_MATCH),
        F.concat(_names(F.col("visual_type_r")), F.lit(" on screen that matches the words")))
    measured = F.coalesce(F.col("cuts_per_minute_r").cast("string"), F.col("visual_type_r"), F.col("speech_match_ratio_r").cast("string"))
    x = x.withColumn("_why", why).groupBy(*keys).agg(
        F.count(measured).alias("n"), F.count("_why").alias("strong"), F.min_by("_why", F.when(F.col("_why").isNotNull(), F.col("idx_r"))).alias("reason"))
    x = x.where("strong > 0 and strong * 2 >= n").select(*keys, F.col("reason").alias("_reason"))
    out = flags.join(x, keys, "left")
    more = evidence(F.concat(F.lit("Visuals may carry this stretch: "), F.col("_reason"), F.lit(" (rule, not validated)")), F.lit("yes"), text=True)
    return out.withColumns({
        "risk_score": F.when(F.col("_reason").isNotNull(), F.bround(F.col("risk_score") * COMPENSATION, 3)).otherwise(F.col("risk_score")),
        "evidence": F.when(F.col("_reason").isNotNull(), F.concat("evidence", F.array(more))).otherwise(F.col("evidence")),
    }).drop("_reason")


def _snap_edits(flags: DataFrame, words: DataFrame) -> DataFrame:
    """CUT edits with both ends moved out of words, where a range is left."""
    keys = ["video_id", "rule", "start"]
    pts = flags.select(*keys, F.posexplode("edits").alias("n", "e")).where("e.action = 'CUT'")
    pts = pts.select("video_id", F.concat_ws(":", "rule", F.col("start").cast("string"), "n").alias("cut"), F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("e.start").alias("t")), F.struct(F.lit("b").alias("side"), F.col("e.end").alias("t")))).alias("p"))
    snapped = snap_to_pause(pts.select("video_id", F.concat_ws("/", "cut", "p.side").alias("point_id"), F.col("p.t").alias("t")), words)
    table = snapped.groupBy("video_id").agg(F.map_from_entries(F.collect_list(F.struct("point_id", "snapped"))).alias("_snaps"))
    x = flags.join(table, "video_id", "left")

    def moved(e: Column, n: Column) -> Column:
        cut = F.concat_ws(":", "rule", F.col("start").cast("string"), n.cast("string"))
        a, b = F.col("_snaps")[F.concat(cut, F.lit("/a"))], F.col("_snaps")[F.concat(cut, F.lit("/b"))]
        return F.when((e["action"] == "CUT") & (b > a), e.withField("start", a).withField("end", b)).otherwise(e)

    return x.withColumn("edits", F.transform("edits", moved)).drop("_snaps")


def assemble(segs: DataFrame, rules: list[DataFrame], words: DataFrame | None = None, phrases: DataFrame | None = None) -> DataFrame:
    """All flags of the corpus: ids f1.. and e1.. in rule order, sources, snapped cuts, evidence
    from delivery and pictures. Sort by (start, flag_id) for display."""
    flags = rules[0]
    for r in rules[1:]:
        flags = flags.unionByName(r)
    # every step below reads the flags twice (as rows and as ranges); checkpoints keep both the
    # work and the plan from doubling each time. A few rows per video are written.
    ensure_checkpoint_dir(segs.sparkSession)
    flags = flags.checkpoint()
    flags = flags.unionByName(rule_model_only(segs, flags))
    order = _video().orderBy("rule", "start", "end")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    flags = flags.withColumns({
        "flag_id": F.concat(F.lit("f"), F.row_number().over(order).cast("string")),
        "_e0": F.coalesce(F.sum(F.size("edits")).over(before), F.lit(0)),
    })
    if words is not None:
        flags = _snap_edits(flags, words)
    keys = ["video_id", "flag_id"]
    flags = flag_source(flags.checkpoint(), segs, keys).checkpoint()
    flags = delivery_evidence(flags, segs, keys, phrases).checkpoint()
    flags = visual_evidence(flags, segs, keys).checkpoint()
    flags = visual_compensation(flags, segs, keys)
    edits = F.transform("edits", lambda e, n: F.struct(
        F.concat(F.lit("e"), (F.col("_e0") + n + 1).cast("string")).alias("id"), F.col("flag_id"), e["action"].alias("action"),
        e["start"].alias("start"), e["end"].alias("end"), e["target_time"].alias("target_time"), e["reason"].alias("reason"),
        e["rewrite_text"].alias("rewrite_text"), (e["action"] == "CUT").alias("simulatable")))
    return flags.withColumn("edits", edits).drop("_e0")
