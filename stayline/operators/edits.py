"""Edit plans: which edits apply, what they do to the timeline and to the predicted curve.

A plan is the edits of one viewer session on one video; its edits are gathered per plan (a
person's handful of edits), everything per segment or per word stays in rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stayline.functions.timeline import merge_spans
from stayline.operators.model import calibrated_curve, predict_curve

# Fixed values
MIN_PIECE_S = 0.25
SKIPPABLE = ["CUT", "SHORTEN"]
REMOVED = float("inf")  # factor of removed time
_OPS = "array<struct<start:double,end:double,factor:double,id:string,custom:boolean>>"


def edit_ops(edits: DataFrame, custom: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan_id, duration_s, ops, applied, skipped, applied_custom): suggested cuts in (start, id)
    order, then the editor's own edits in theirs; one that overlaps an accepted one is left out.

    ``edits``: plan_id, id, action, start, end, simulatable. ``custom``: plan_id, pos, id, action,
    start, end, factor. ``plans``: plan_id, duration_s."""
    usable = (F.col("action") == "CUT") & F.col("simulatable") & (F.col("end") > F.col("start"))
    s = edits.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("start", "id", "end", usable.alias("ok")))).alias("_s"))
    c = custom.join(plans, "plan_id").withColumns({
        "_a": F.greatest(F.lit(0.0), F.when(F.col("action") == "TRIM_START", 0.0).otherwise(F.col("start"))),
        "_b": F.least("duration_s", F.when(F.col("action") == "TRIM_END", F.col("duration_s")).otherwise(F.col("end"))),
    })
    factor = F.when(F.col("action") == "SPEED", F.col("factor")).otherwise(F.lit(REMOVED))
    c = c.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("_a").alias("start"), F.col("_b").alias("end"), factor.alias("factor"), "id"))).alias("_c"))
    x = plans.join(s, "plan_id", "left").join(c, "plan_id", "left")
    queue = (
        "concat(transform(coalesce(_s, array()), e -> named_struct('start', e.start, 'end', e.end, 'factor', double('infinity'), 'id', e.id, 'custom', false, 'ok', e.ok)),"
        " transform(coalesce(_c, array()), e -> named_struct('start', e.start, 'end', e.end, 'factor', e.factor, 'id', e.id, 'custom', true, 'ok', e.end > e.start)))"
    )
    take = (
        f"aggregate(_q, cast(array() as {_OPS}), (acc, e) -> if(e.ok and not exists(acc, o -> e.start < o.end and e.end > o.start),"
        " array_append(acc, named_struct('start', e.start, 'end', e.end, 'factor', e.factor, 'id', e.id, 'custom', e.custom)), acc))"
    )
    x = x.withColumn("_q", F.expr(queue)).withColumn("_t", F.expr(take))
    return x.select(
        "plan_id", "duration_s", F.array_sort("_t").alias("ops"),
        F.expr("transform(filter(_t, o -> not o.custom), o -> o.id)").alias("applied"),
        F.expr("transform(filter(_q, e -> not e.custom and not exists(_t, o -> not o.custom and o.id = e.id)), e -> e.id)").alias("skipped"),
        F.expr("transform(filter(_t, o -> o.custom), o -> o.id)").alias("applied_custom"),
    )


def saved_before(ops: str, t: str) -> Column:
    """Seconds taken out of the timeline before ``t``."""
    return F.expr(
        f"aggregate({ops}, 0D, (s, o) -> s + greatest(0D, least({t}, o.end) - o.start) * (1 - if(o.factor = double('infinity'), 0D, 1 / o.factor)))"
    )


def _by_plan(rows: DataFrame) -> DataFrame:
    """Rows that come by the dozen from one row of a plan, for a join: Spark takes them for as small as the plans and
    would send them all through the driver, so the join is told to sort and merge."""
    return rows.hint("merge")


def kept_duration(segments: DataFrame, ops: DataFrame) -> DataFrame:
    """Segments of each plan's video with ``saved`` (before the segment's end) and ``kept`` seconds.
    ``segments``: plan_id, idx, start, end; the plan's few operations travel as one array."""
    x = _by_plan(segments).join(ops.select("plan_id", "ops"), "plan_id")
    x = x.withColumns({"_s0": saved_before("ops", "start"), "saved": saved_before("ops", "end")})
    return x.withColumn("kept", F.col("end") - F.col("start") - (F.col("saved") - F.col("_s0"))).drop("_s0", "ops")


def simulate_exposure(segments: DataFrame, ops: DataFrame, k: float) -> DataFrame:
    """(plan_id, t, retention, lower, upper) on the edited timeline: unchanged per-second rates
    over the time that is left; removed segments drop out. ``segments`` has rate, lo, hi."""
    x = kept_duration(segments, ops).withColumn("video_id", F.col("plan_id"))
    curve = calibrated_curve(x, k, F.greatest(F.col("kept"), F.lit(0.0)))
    p = predict_curve(curve).select("video_id", "idx", "retention", "lower", "upper")
    y = x.select("video_id", "idx", F.bround(F.col("end") - F.col("saved"), 3).alias("t"), "kept").join(_by_plan(p), ["video_id", "idx"]).where("kept > 1e-6")
    start = ops.select(F.col("plan_id").alias("video_id"), F.lit(-1).alias("idx"), F.lit(0.0).alias("t"), *[F.lit(1.0).alias(c) for c in ("retention", "lower", "upper")])
    out = y.drop("kept").unionByName(start)
    return out.withColumnRenamed("video_id", "plan_id")


def avg_retention(points: DataFrame, key: str) -> DataFrame:
    """(key, avg_retention, end_retention): trapezoid area over the curve divided by its length."""
    order = W.partitionBy(key).orderBy("t", "idx")
    x = points.withColumns({"_t": F.lead("t").over(order), "_r": F.lead("retention").over(order)})
    area = F.sum((F.col("_t") - F.col("t")) * (F.col("retention") + F.col("_r")) / 2)
    per = x.groupBy(key).agg(area.alias("a"), F.max("t").alias("len"), F.max_by("retention", F.struct("t", "idx")).alias("end_retention"))
    return per.select(key, F.when(F.col("len") > 0, F.col("a") / F.col("len")).otherwise(1.0).alias("avg_retention"), "end_retention")


def retention_delta(original: DataFrame, simulated: DataFrame, key: str) -> DataFrame:
    """Change of end and average retention in percentage points."""
    a = avg_retention(original, key).withColumnsRenamed({"avg_retention": "a0", "end_retention": "e0"})
    b = avg_retention(simulated, key)
    return b.join(a, key).select(
        key, F.bround(100 * (F.col("end_retention") - F.col("e0")), 1).alias("end_retention_pp"),
        F.bround(100 * (F.col("avg_retention") - F.col("a0")), 1).alias("avg_retention_pp"))


def resolve_edits(edits: DataFrame) -> DataFrame:
    """(plan_id, kept, skipped): the older conflict rule, where a MOVE's target counts as a point.
    ``edits``: plan_id, id, action, start, end, target_time, simulatable."""
    e = edits.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("start", "id", "end", "action", "target_time", "simulatable"))).alias("q"))

    def clash(lo: str, hi: str) -> str:
        return f"exists(acc, k -> ({lo} < k.end and {hi} > k.start) or (k.action = 'MOVE' and {lo} < k.target_time and k.target_time < {hi}))"

    bad = f"not e.simulatable or e.end <= e.start or {clash('e.start', 'e.end')} or (e.action = 'MOVE' and {clash('e.target_time', 'e.target_time')})"
    keep = F.expr(
        "aggregate(q, cast(array() as array<struct<start:double,id:string,end:double,action:string,target_time:double,simulatable:boolean>>),"
        f"(acc, e) -> if(coalesce({bad}, false), acc, array_append(acc, e)))"
    )
    x = e.withColumn("_k", keep)
    return x.select("plan_id", F.expr("transform(_k, k -> k.id)").alias("kept"),
                    F.expr("transform(filter(q, e -> not exists(_k, k -> k.id = e.id)), e -> e.id)").alias("skipped"))


def edit_blocks(edits: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan_id, a, b, new_start): the kept blocks of the original timeline in play order. Blocks
    lie between edit boundaries; CUT drops them, MOVE plays them before the block at its target.
    ``edits`` must already be free of conflicts."""
    bounds = F.array(F.col("start"), F.col("end"), F.when(F.col("action") == "MOVE", F.col("target_time")))
    inner = edits.where(F.col("action").isin("CUT", "MOVE")).join(plans, "plan_id").select("plan_id", "duration_s", F.explode(F.array_compact(bounds)).alias("a")).where("a between 0 and duration_s").select("plan_id", "a")
    ends = plans.select("plan_id", F.explode(F.array(F.lit(0.0), F.col("duration_s"))).alias("a"))
    order = W.partitionBy("plan_id").orderBy("a")
    blocks = inner.unionByName(ends).distinct().withColumn("b", F.lead("a").over(order)).where("b is not null")
    per = edits.groupBy("plan_id").agg(F.collect_list(F.struct("action", "start", "end", "target_time")).alias("es"))
    x = blocks.join(per, "plan_id", "left")
    hit = "filter(coalesce(es, array()), e -> e.action = '{0}' and e.start <= a and b <= e.end)"
    x = x.withColumns({"_cut": F.size(F.expr(hit.format("CUT"))), "_mv": F.expr(hit.format("MOVE"))})
    x = x.withColumn("_m", F.get("_mv", F.lit(0)))
    targets = x.where("_m is null and _cut = 0").select("plan_id", F.col("a").alias("_ta")).distinct()
    moved = x.where("_m is not null").withColumn("_ta", F.col("_m.target_time"))
    # a moved block plays only where a kept block starts at its target
    moved = moved.join(targets, ["plan_id", "_ta"]).select("plan_id", "a", "b", F.col("_ta").alias("k1"), F.lit(0).alias("k2"), F.col("_m.start").alias("k3"))
    kept = x.where("_m is null and _cut = 0").select("plan_id", "a", "b", F.col("a").alias("k1"), F.lit(1).alias("k2"), F.lit(0.0).alias("k3"))
    play = W.partitionBy("plan_id").orderBy("k1", "k2", "k3", "a")
    out = kept.unionByName(moved).withColumn("new_start", F.coalesce(F.sum(F.col("b") - F.col("a")).over(play.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    return out.withColumn("place", F.row_number().over(play)).select("plan_id", "place", "a", "b", "new_start")


def apply_edits(words: DataFrame, edits: DataFrame, plans: DataFrame) -> DataFrame:
    """Words on the edited timeline, in play order: each keeps its offset inside the block that
    holds its midpoint. ``words``: plan_id, word_idx, start, end, text."""
    blocks = edit_blocks(edits, plans).join(plans, "plan_id")
    sec = F.explode(F.sequence(F.floor("a"), F.floor("b")))
    b = blocks.select("plan_id", "place", "a", "b", "new_start", "duration_s", sec.alias("_sec"))
    w = words.withColumn("_mid", (F.col("start") + F.col("end")) / 2).withColumn("_sec", F.floor("_mid"))
    x = _by_plan(w).join(_by_plan(b), ["plan_id", "_sec"]).where(
        ((F.col("a") <= F.col("_mid")) & (F.col("_mid") < F.col("b"))) | ((F.col("b") == F.col("duration_s")) & (F.col("_mid") == F.col("b"))))
    off = F.col("new_start") - F.col("a")
    order = W.partitionBy("plan_id").orderBy("place", "word_idx")
    return x.select(
        "plan_id", (F.row_number().over(order) - 1).alias("new_idx"), "word_idx", "text",
        F.bround(F.col("start") + off, 3).alias("start"), F.bround(F.col("end") + off, 3).alias("end"))


def edit_pieces(ops: DataFrame, moves: DataFrame, min_piece_s: float = MIN_PIECE_S) -> DataFrame:
    """(plan_id, pieces, moved, output_duration_s, plan_key): kept and sped-up source ranges in
    play order. A MOVE replays its range just before its target; one into itself does nothing.

    ``moves``: plan_id, id, start, end, target_time. Every list here is one plan's."""
    base = (
        "aggregate(ops, named_struct('at', 0D, 'out', cast(array() as array<struct<start:double,end:double,factor:double>>)), (acc, o) -> named_struct("
        "'at', greatest(acc.at, o.end), 'out', concat(acc.out, filter(array(named_struct('start', acc.at, 'end', o.start, 'factor', 1D)), p -> p.end > p.start),"
        " filter(array(named_struct('start', o.start, 'end', o.end, 'factor', o.factor)), p -> p.factor <> double('infinity')))),"
        " acc -> concat(acc.out, filter(array(named_struct('start', acc.at, 'end', duration_s, 'factor', 1D)), p -> p.end > p.start)))"
    )
    m = moves.where("target_time is not null").groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("start", "id", "end", "target_time"))).alias("ms"))
    x = ops.join(m, "plan_id", "left").withColumn("_p", F.expr(base))

    def split(pieces: str, t: str) -> str:
        return (
            f"flatten(transform({pieces}, p -> if(p.start < {t} and {t} < p.end, array(named_struct('start', p.start, 'end', {t}, 'factor', p.factor),"
            f" named_struct('start', {t}, 'end', p.end, 'factor', p.factor)), array(p))))"
        )

    cut = split(split(split("acc.p", "m.start"), "m.end"), "m.target_time")
    mine = "filter(ps, p -> p.start >= m.start and p.end <= m.end)"
    rest = "filter(ps, p -> not (p.start >= m.start and p.end <= m.end))"
    # pieces before the first remaining one that starts at or after the target, then the moved ones
    at = "coalesce(array_min(filter(transform(rest, (p, i) -> if(p.start >= m.target_time, i, null)), i -> i is not null)), size(rest))"
    step = (
        "if(m.start <= m.target_time and m.target_time <= m.end, acc, transform(array(" + cut + "), ps -> if(size(" + mine + ") = 0, acc,"
        " transform(array(" + rest + "), rest -> transform(array(" + at + "), n -> named_struct('p',"
        " concat(slice(rest, 1, n), " + mine + ", slice(rest, n + 1, size(rest))), 'ids', array_append(acc.ids, m.id)))[0])[0]))[0])"
    )
    fold = f"aggregate(coalesce(ms, array()), named_struct('p', _p, 'ids', cast(array() as array<string>)), (acc, m) -> {step})"
    x = x.withColumn("_f", F.expr(fold))
    x = x.withColumn("pieces", F.filter("_f.p", lambda p: p["end"] - p["start"] >= min_piece_s))
    total = F.aggregate("pieces", F.lit(0.0), lambda s, p: s + (p["end"] - p["start"]) / p["factor"])
    key = F.array_join(F.transform("pieces", lambda p: F.format_string("[%s, %s, %s]", F.bround(p["start"], 3).cast("string"), F.bround(p["end"], 3).cast("string"), F.bround(p["factor"], 4).cast("string"))), ", ")
    return x.select(
        "plan_id", "pieces", F.col("_f.ids").alias("moved"), F.bround(total, 3).alias("output_duration_s"),
        F.left(F.sha2(F.concat(F.lit("["), key, F.lit("]")), 256), F.lit(16)).alias("plan_key"))


def skip_ranges(accepted: DataFrame, custom: DataFrame) -> DataFrame:
    """(plan_id, start, end): what a preview of the plan jumps over, overlapping ranges merged."""
    a = accepted.where(F.col("action").isin(SKIPPABLE)).select("plan_id", F.col("start").alias("s"), F.col("end").alias("e"))
    c = custom.where("action <> 'SPEED'").select("plan_id", F.col("start").alias("s"), F.col("end").alias("e"))
    return merge_spans(a.unionByName(c), ["plan_id"], 120.0).select("plan_id", F.col("s").alias("start"), F.col("e").alias("end"))


def export_edit_plan(accepted: DataFrame, custom: DataFrame) -> DataFrame:
    """Accepted and own edits in start order (``place``)."""
    a = accepted.select("plan_id", F.lit("suggested").alias("source"), "id", "action", "start", "end", "target_time", F.lit(None).cast("double").alias("factor"), "reason", F.col("pos"))
    c = custom.select("plan_id", F.lit("custom").alias("source"), "id", "action", "start", "end", F.lit(None).cast("double").alias("target_time"), "factor", F.lit("Made in the editor").alias("reason"), "pos")
    order = W.partitionBy("plan_id").orderBy("start", F.desc("source"), "pos")
    return a.unionByName(c).withColumn("place", F.row_number().over(order)).drop("pos")


def top_edits(flags: DataFrame, k: int = 3) -> DataFrame:
    """(video_id, place, edit_id, flag_id): the video's best simulatable edits: high severity
    first, then the riskier flag."""
    e = flags.select("video_id", "flag_id", "severity", "risk_score", F.posexplode("edits").alias("n", "e")).where("e.simulatable")
    best = W.partitionBy("video_id").orderBy((F.col("severity") != "high").cast("int"), F.desc("risk_score"), F.col("e.start"), "flag_id", "n")
    return e.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("video_id", "place", F.col("e.id").alias("edit_id"), "flag_id")
