"""Registered queries for edit plans, simulation, comparison, gates and artifact sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stayline.operators import compare as cp, edits as op
from stayline.plans import views as v
from stayline.session import ensure_checkpoint_dir
from stayline.sources import manifest, sinks, watch_log


def _ops(spark, sf):
    return op.edit_ops(v.plan_edits(spark, sf), v.plan_custom(spark, sf), v.plans(spark, sf))


def edit_ops(spark, sf):
    x = _ops(spark, sf)
    return x.select("plan_id", F.transform("ops", lambda o: o["start"]).alias("starts"), F.transform("ops", lambda o: o["end"]).alias("ends"), "applied", "skipped", "applied_custom")


def plan_segments(spark, sf):
    """50 tiles of every plan's video with a planted rate and a band."""
    return v.plans(spark, sf).select("plan_id", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("idx")).select(
        "plan_id", "idx", (F.col("idx") * 12.0).alias("start"), (F.col("idx") * 12.0 + 12.0).alias("end"),
        ((F.col("plan_id") * 7 + F.col("idx") * 13) % 40 / 10000.0).alias("rate"),
        (-0.02 - (F.col("idx") % 5) / 100.0).alias("lo"), (0.03 + (F.col("idx") % 4) / 100.0).alias("hi"))


def kept_duration(spark, sf):
    x = op.kept_duration(plan_segments(spark, sf), _ops(spark, sf))
    return x.select("plan_id", "idx", F.round("saved", 6).alias("saved"), F.round("kept", 6).alias("kept"))


def simulate_exposure(spark, sf):
    return op.simulate_exposure(plan_segments(spark, sf), _ops(spark, sf), 0.8)


def simulate_conflicting(spark, sf):
    """The same with every plan's whole list of edits."""
    return op.simulate_exposure(plan_segments(spark, sf), _ops(spark, sf), 0.8)


def avg_retention(spark, sf):
    p = v.seg_points(spark, sf)
    return op.avg_retention(p, "video_id").select("video_id", F.round("avg_retention", 6).alias("avg_retention"), F.round("end_retention", 6).alias("end_retention"))


def retention_delta(spark, sf):
    none = v.plans(spark, sf).withColumn("ops", F.array().cast(op._OPS))
    before = op.simulate_exposure(plan_segments(spark, sf), none, 0.8)
    return op.retention_delta(before, op.simulate_exposure(plan_segments(spark, sf), _ops(spark, sf), 0.8), "plan_id")


def _suggested(spark, sf):
    return v.plan_edits(spark, sf).withColumn("simulatable", F.col("action").isin("CUT", "MOVE"))


def resolve_edits(spark, sf):
    return op.resolve_edits(_suggested(spark, sf))


def _resolved(spark, sf):
    """Every plan's edits that the older conflict rule keeps."""
    e = _suggested(spark, sf)
    kept = op.resolve_edits(e).select("plan_id", F.explode("kept").alias("id"))
    return e.join(kept, ["plan_id", "id"])


def _plan_words(spark, sf):
    return v.plans(spark, sf).select("plan_id", F.explode(F.sequence(F.lit(0), F.lit(299))).alias("word_idx")).select(
        "plan_id", "word_idx", F.concat(F.lit("w"), "word_idx").alias("text"), (F.col("word_idx") * 2.0 + 0.2).alias("start"), (F.col("word_idx") * 2.0 + 1.3).alias("end"))


def edit_blocks(spark, sf):
    x = op.edit_blocks(_resolved(spark, sf), v.plans(spark, sf))
    return x.select("plan_id", "place", "a", "b", F.round("new_start", 4).alias("new_start"))


def apply_edits(spark, sf):
    return op.apply_edits(_plan_words(spark, sf), _resolved(spark, sf), v.plans(spark, sf))


def edit_pieces(spark, sf):
    """The decision list of every plan's whole edits: cuts, speed-ups, trims and all moves."""
    x = op.edit_pieces(_ops(spark, sf), v.plan_edits(spark, sf).where("action = 'MOVE'"))
    part = lambda c: F.transform("pieces", lambda p: p[c])
    return x.select("plan_id", part("start").alias("starts"), part("end").alias("ends"), part("factor").alias("factors"), "moved", "output_duration_s", "plan_key")


def edit_pieces_full(spark, sf):
    return edit_pieces(spark, sf)


def skip_ranges(spark, sf):
    x = op.skip_ranges(v.plan_edits(spark, sf), v.plan_custom(spark, sf))
    return x.select("plan_id", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"))


def cut_seconds(spark, sf):
    x = op.skip_ranges(v.plan_edits(spark, sf), v.plan_custom(spark, sf))
    return x.groupBy("plan_id").agg(F.round(F.sum(F.col("end") - F.col("start")), 4).alias("cut_s"))


def export_edit_plan(spark, sf):
    return op.export_edit_plan(v.plan_edits(spark, sf), v.plan_custom(spark, sf)).select("plan_id", "place", "source", "id", "action", "start", "end", "target_time", "factor", "reason")


def top_edits(spark, sf):
    return op.top_edits(v.seg_flags(spark, sf))


def interp_at(spark, sf):
    x = cp.interp_at(v.seg_points(spark, sf), 67.5)
    return x.select("video_id", *[F.round(c, 6).alias(c) for c in ("retention", "lower", "upper")])


def _cuts(spark, sf):
    s = v.seg_features(spark, sf).where("k % 3 = 0")
    return s.groupBy("video_id").agg(F.array_sort(F.collect_list("start")).alias("cuts"))


def _signals(spark, sf):
    return cp.hook_signals(v.seg_points(spark, sf), v.seg_features(spark, sf), v.seg_checks(spark, sf), v.seg_ledger(spark, sf), v.seg_flags(spark, sf), _cuts(spark, sf))


def hook_signals(spark, sf):
    x = _signals(spark, sf)
    return x.select(*[F.round(c, 6).alias(c) if c.startswith("r") else F.col(c) for c in x.columns])


def _ab(spark, sf):
    pairs = _signals(spark, sf).select("video_id").where("video_id % 2 = 0").select(
        F.col("video_id").alias("pair_id"), F.col("video_id").alias("a"), (F.col("video_id") + 1).alias("b"))
    return cp.ab_compare(pairs, _signals(spark, sf))


def ab_compare(spark, sf):
    promise = F.col("key") == "promise"
    said = [F.when(promise, F.col(c)).alias(f"said_{c}") for c in ("a", "b")]
    numbers = [F.when(~promise, F.round(F.expr(f"try_cast({c} as double)"), 3)).alias(f"num_{c}") for c in ("a", "b")]
    return _ab(spark, sf).select("pair_id", "key", *said, *numbers, "better", "winner", "note")


def ab_summary(spark, sf):
    return cp.ab_summary(_ab(spark, sf))


def corpus_summary(spark, sf):
    return cp.corpus_summary(v.seg_features(spark, sf), v.seg_points(spark, sf), v.seg_checks(spark, sf), v.seg_words(spark, sf))


def flag_table(spark, sf):
    return cp.flag_table(v.seg_flags(spark, sf))


def src_media_manifest(spark, sf):
    """One media-probe JSON per order: frame rates, streams and durations vary with the row."""
    o = v.load(spark, sf, "orders")
    line = F.expr(
        "concat('{\"format\": {', if(o_orderkey % 3 = 0, '', concat('\"duration\": \"', o_orderkey % 1500, '.5\", ')), '\"format_name\": \"mov,mp4\"}, \"streams\": [',"
        " if(o_orderkey % 5 = 0, '', concat('{\"codec_type\": \"audio\", \"sample_rate\": \"', 16000 + o_custkey % 3 * 16000, '\", \"channels\": ', 1 + o_custkey % 2, ', \"duration\": \"7.25\"}')),"
        " if(o_orderkey % 5 = 0 or o_orderkey % 7 = 0, '', ', '),"
        " if(o_orderkey % 7 = 0, '', concat('{\"codec_type\": \"video\", \"avg_frame_rate\": \"', case o_custkey % 4 when 0 then '0/0' when 1 then '30000/1001' when 2 then '25/1' else '24' end, '\", \"width\": 1280, \"height\": 720, \"duration\": \"9.125\"}')), ']}')")
    return manifest.parse_media(o.select(F.col("o_orderkey").alias("video_id"), line.alias("value")))


def gate_duration(spark, sf):
    """Uploads of both kinds, sized and named after the orders."""
    o = v.load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("video_id"), F.when(F.col("o_custkey") % 3 == 0, "script").otherwise("video").alias("source_type"),
        F.expr("concat('f', o_orderkey, case o_orderkey % 5 when 0 then '.MP4' when 1 then '.mov' when 2 then '.txt' when 3 then '.md' else '.avi' end)").alias("filename"),
        (F.col("o_totalprice") / 300).alias("duration_s"), (F.col("o_orderkey") % 4 != 0).alias("has_audio"),
        (F.col("o_orderkey") * 1009 % 2000000).alias("n_bytes"), (F.col("o_orderkey") % 50 == 0).alias("has_nul"), (F.col("o_orderkey") % 40 == 0).alias("blank"))
    return manifest.gate(o).select("video_id", "status", "reasons", "warnings")


ARTIFACT = "video_id long, version string, created_at long, payload string, kind string"


def sink_artifacts(spark, sf):
    """Event records as artifacts, appended in two batches: the newest of each (video, kind) is read back."""
    e = v.load(spark, sf, "events").select(
        F.col("user_id").alias("video_id"), F.expr("concat('v', event_id % 3)").alias("version"),
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("created_at"), F.col("event_id").cast("string").alias("payload"), F.col("event_type").alias("kind"))
    store = f"{ensure_checkpoint_dir(spark)}/artifacts-{uuid.uuid4().hex}"
    for part in (0, 1):
        sinks.append_artifacts(e.where(F.expr(f"cast(payload as long) % 2 = {part}")), store)
    return sinks.read_artifacts(spark, store, ARTIFACT)


LIMITS = {"tol": v.LECTURE_TOL, "min_starters": 2, "min_s": 20.0, "max_s": 1500.0, "min_lines": 5, "k": 40}


def _built(spark, sf):
    """Watch logs, id map lines (some broken, several videos a lecture) and captions, as the curve build reads them."""
    from stayline.plans.watch_queries import _caption_lines

    users = v.load(spark, sf, "events").select("user_id").distinct()
    line = F.expr("concat('u', user_id, if(user_id % 17 = 0, '', concat(' ', user_id % 400)))").alias("value")
    captions = watch_log.parse_captions(_caption_lines(spark, sf))
    return captions, sinks.build_curves(v.lecture_watch(spark, sf), watch_log.parse_id_map(users.select(line)), captions, LIMITS)


def _stored(spark, sf):
    captions, (lectures, chosen, curve) = _built(spark, sf)
    chosen = chosen.persist()
    counts = {"viewers_read": v.lecture_watch(spark, sf).select("viewer_id").distinct().count(), "lectures_seen": lectures.count()}
    folder = f"{ensure_checkpoint_dir(spark)}/curves-{uuid.uuid4().hex}"
    sinks.store_curves(folder, curve, chosen, captions, counts, 0.2)
    return sinks.read_curves(spark, folder)


def sink_curves(spark, sf):
    """The stored curves of the qualifying lectures, read back."""
    return _stored(spark, sf)[0].select("video_id", "split", "n_starters", "n_viewers", "duration_s", "retention")


def sink_captions(spark, sf):
    """The stored captions of the same lectures."""
    return _stored(spark, sf)[1].select("ccid", F.round("duration_s", 4).alias("duration_s"), "lines", "text")


def sink_summary(spark, sf):
    """What the build read, saw and wrote."""
    return _stored(spark, sf)[2]


def curve_run_summary(spark, sf):
    from stayline.plans.watch_queries import lecture_curve
    from stayline.operators.watch import qualify_topk

    lec, _ = lecture_curve(spark, sf)
    return sinks.run_summary(v.lecture_watch(spark, sf), lec, qualify_topk(lec, 3, 180.0, 1500.0, 20, 40), 0.2)


QUERIES = {
    f.__name__: f
    for f in (
        edit_ops, kept_duration, simulate_exposure, simulate_conflicting, avg_retention, retention_delta, resolve_edits, edit_blocks,
        apply_edits, edit_pieces, edit_pieces_full, skip_ranges, cut_seconds, export_edit_plan, top_edits, interp_at, hook_signals,
        ab_compare, ab_summary, corpus_summary, flag_table, src_media_manifest, gate_duration, sink_artifacts, sink_curves, sink_captions, sink_summary, curve_run_summary,
    )
}
