"""Registered queries over watch logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayline.operators import watch as op
from stayline.plans import views as v
from stayline.sources import watch_log as src


def _r(c, n=6):
    return F.round(F.col(c), n).alias(c)


def src_watch_log(spark, sf):
    """Each event as a viewer's JSON line; lines of error events are cut off and must be skipped."""
    line = F.expr(
        "to_json(named_struct('id', cast(viewer_id as string), 'seq', array("
        "named_struct('video_id', video_id, 'segment', array(named_struct('start_point', start_point, 'end_point', end_point))),"
        "named_struct('video_id', 'none', 'segment', cast(array() as array<struct<start_point:double,end_point:double>>)))))"
    )
    broken = F.when(F.col("video_id") == "error", F.expr("left(l, length(l) - 5)")).otherwise(F.col("l"))
    lines = v.watch(spark, sf).select("video_id", line.alias("l")).select(broken.alias("value"))
    return src.parse_watch_lines(lines).select(
        "viewer_id", "entry", "video_id", _r("start_point"), _r("end_point")
    )


def src_id_map(spark, sf):
    lines = v.load(spark, sf, "orders").select(
        F.expr("concat(o_orderkey, '  ', o_orderpriority, ' ')").alias("value")
    )
    return src.parse_id_map(lines)


def _caption_lines(spark, sf):
    text = F.expr("split(text, '\n')")
    arrays = v.load(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("ccid"), text.alias("text"))
    return arrays.select(
        F.to_json(
            F.struct(
                "ccid",
                F.expr("transform(text, (x, i) -> i * 4.0D)").alias("start"),
                F.expr("transform(text, (x, i) -> i * 4.0D + length(x) / 10.0D)").alias("end"),
                "text",
            )
        ).alias("value")
    )


def src_captions(spark, sf):
    return src.parse_captions(_caption_lines(spark, sf)).select(
        "ccid", F.round("duration_s", 4).alias("duration_s"), "lines"
    )


def src_caption_words(spark, sf):
    """Per caption line of every document: characters spoken and their total times."""
    words = src.caption_words(src.parse_captions(_caption_lines(spark, sf)))
    return words.groupBy("video_id", "sent_idx").agg(
        F.count(F.lit(1)).alias("n_words"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.expr("min_by(text, pos)").alias("first_char"),
        F.expr("max_by(text, pos)").alias("last_char"),
    )


def _asr_lines(spark, sf):
    """Documents as recogniser output: a line is a segment, word times overlap and run backwards."""
    words = (
        "transform(filter(split(x, ' '), w -> w <> ''), (w, j) -> named_struct('word', if(j % 7 = 6, ' ', concat(' ', w)),"
        " 'start', i * 10D + j * 0.37D - (j % 4) * 0.5D, 'end', i * 10D + j * 0.37D + 0.3D - (j % 5) * 0.1D, 'probability', 0.5D + (j % 5) / 10D))"
    )
    segs = F.expr(rf"transform(split(text, '\n'), (x, i) -> named_struct('start', i * 10D, 'end', i * 10D + 9, 'text', x, 'words', {words}))")
    d = v.load(spark, sf, "documents").select(F.col("doc_id").alias("video_id"), segs.alias("segments"))
    return d.select("video_id", F.to_json(F.struct("segments")).alias("value"))


def src_asr_words(spark, sf):
    w = src.asr_words(_asr_lines(spark, sf))
    return w.select("video_id", "word_idx", "text", "start", "end", F.round("confidence", 2).alias("confidence"), "phrase_break")


def asr_confidence(spark, sf):
    return src.mean_confidence(src.asr_words(_asr_lines(spark, sf)))


def merge_intervals(spark, sf):
    m = op.merge_intervals(v.watch(spark, sf))
    return m.select("viewer_id", "video_id", _r("start"), _r("end"))


def anchor_start(spark, sf):
    m = op.anchor_start(op.merge_intervals(v.watch(spark, sf)), v.TOL)
    return m.select("viewer_id", "video_id", _r("start"), _r("end"))


def viewer_counts(spark, sf):
    return op.viewer_counts(v.watch(spark, sf), v.TOL)


def qualify_topk(spark, sf):
    lec = v.lectures_of(v.lecture_watch(spark, sf), v.LECTURE_TOL)
    top = op.qualify_topk(lec, 3, 180.0, 1500.0, 20, 40)
    return top.select("video_id", "n_starters", "n_viewers", _r("duration_s"), "lines")


def _curve(spark, sf):
    w = v.watch(spark, sf)
    lec = v.lectures_of(w, v.TOL)
    return lec, op.retention_curve(op.coverage_diff(w, lec, v.TOL), lec)


def lecture_curve(spark, sf):
    w = v.lecture_watch(spark, sf)
    lec = v.lectures_of(w, v.LECTURE_TOL)
    return lec, op.retention_curve(op.coverage_diff(w, lec, v.LECTURE_TOL), lec)


def lecture_tiles(spark, sf):
    """Fixed tiles of the user lectures with hazard, last-second retention, signed rate, split."""
    lec, curve = lecture_curve(spark, sf)
    t = op.segment_hazard(op.fixed_tiles(lec), curve)
    return t.withColumns(
        {
            "split": op.hash_split(F.col("video_id"), 0.2),
            "rel_start": F.col("start") / F.col("duration_s"),
            "rel_end": F.col("end") / F.col("duration_s"),
        }
    )


def coverage_diff(spark, sf):
    w = v.watch(spark, sf)
    return op.coverage_diff(w, v.lectures_of(w, v.TOL), v.TOL)


def retention_curve(spark, sf):
    return _curve(spark, sf)[1].select("video_id", "t", "watching", _r("retention"))


def hash_split(spark, sf):
    docs = v.load(spark, sf, "documents")
    return docs.select("doc_id", op.hash_split(F.col("doc_id"), 0.2).alias("split"))


def _tiles(spark, sf):
    lec, curve = _curve(spark, sf)
    return op.segment_hazard(op.fixed_tiles(lec), curve)


def segment_hazard(spark, sf):
    return _tiles(spark, sf).select("video_id", "idx", _r("start"), _r("end"), _r("hazard"))


def actual_at_end(spark, sf):
    return _tiles(spark, sf).select("video_id", "idx", _r("actual_r"))


def hazard_to_rate(spark, sf):
    t = _tiles(spark, sf)
    dur = F.col("end") - F.col("start")
    t = t.withColumn("rate", op.hazard_to_rate(F.col("hazard"), dur))
    back = op.rate_to_hazard(F.col("rate"), dur)
    return t.select("video_id", "idx", _r("rate"), F.round(back, 6).alias("hazard_back"))


def rate_to_hazard(spark, sf):
    t = _tiles(spark, sf)
    return t.select("video_id", "idx", F.round(op.rate_to_hazard(F.col("signed_rate"), F.col("end") - F.col("start")), 6).alias("hazard"))


def signed_rate(spark, sf):
    return _tiles(spark, sf).select("video_id", "idx", _r("signed_rate"))


def curve_from_hazard(spark, sf):
    return op.curve_from_hazard(_tiles(spark, sf)).select("video_id", "idx", _r("retention"))


QUERIES = {
    f.__name__: f
    for f in (
        src_watch_log, src_id_map, src_captions, src_caption_words, src_asr_words, asr_confidence, merge_intervals, anchor_start,
        viewer_counts, qualify_topk, coverage_diff, retention_curve, hash_split, segment_hazard,
        actual_at_end, hazard_to_rate, rate_to_hazard, signed_rate, curve_from_hazard,
    )
}
