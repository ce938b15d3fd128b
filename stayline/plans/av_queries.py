"""Registered queries over audio and picture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayline.operators import av as op
from stayline.plans import views as v

HOP, PITCH_HOP, LEN_S = 0.1, 0.05, 50.0
FPS = 0.5


def _r(c, n=4):
    return F.round(F.col(c), n).alias(c)


def frame_db(spark, sf):
    return op.frame_db(v.chunks(spark, sf), 16, 6).select("video_id", "k", _r("db"))


def silence_threshold(spark, sf):
    return op.loudness_stats(v.loudness(spark, sf)).select("video_id", _r("threshold_db"))


def snr(spark, sf):
    return op.loudness_stats(v.loudness(spark, sf)).select("video_id", "snr_db")


def segment_audio(spark, sf):
    frames = v.loudness(spark, sf)
    return op.segment_audio(frames, v.block_tiles(frames, LEN_S), HOP)


def clipping_ratio(spark, sf):
    c = v.chunks(spark, sf)
    return op.clipping_ratio(c, v.block_tiles(c, 5.0, 1.2), 640, 0.25)


def _voiced(spark, sf):
    return op.voiced_mask(v.pitch(spark, sf), v.loudness(spark, sf), PITCH_HOP, HOP)


def voiced_mask(spark, sf):
    return _voiced(spark, sf).select("video_id", "i", "voiced")


def smooth_pitch(spark, sf):
    return op.smooth_pitch(v.pitch(spark, sf)).select("video_id", "i", _r("semitone"))


def segment_pitch(spark, sf):
    p = op.smooth_pitch(_voiced(spark, sf))
    return op.segment_pitch(p, v.block_tiles(p, 25.0, 3.0), PITCH_HOP)


def pitch_median_hz(spark, sf):
    return op.pitch_median_hz(_voiced(spark, sf))


def frame_diffs(spark, sf):
    return op.frame_diffs(v.pictures(spark, sf)).select("video_id", "i", _r("diff", 6))


def _cuts(spark, sf):
    d = op.frame_diffs(v.pictures(spark, sf))
    return d, op.scene_cuts(d, FPS, 0.05, 1.1, 20.0, 5.0)


def scene_cuts(spark, sf):
    return _cuts(spark, sf)[1].select("video_id", F.posexplode("cuts").alias("n", "t"))


def segment_visual(spark, sf):
    d, cuts = _cuts(spark, sf)
    return op.segment_visual(d, cuts, v.block_tiles(d, 100.0), FPS, 0.055)


def _types(spark, sf):
    prompts = v.seg_emb(spark, sf).where("label < 7").select(F.expr("concat('type', label)").alias("key"), "emb")
    return op.type_vectors(prompts)


def classify_frames(spark, sf):
    out = op.classify_frames(v.pictures(spark, sf), _types(spark, sf), 20.0)
    return out.select("video_id", "i", "label", _r("confidence"))


def _labels(spark, sf):
    return v.pictures(spark, sf).withColumn("label", F.expr("concat('type', label div 4)"))


def label_islands(spark, sf):
    return op.label_islands(_labels(spark, sf), FPS)


def label_runs(spark, sf):
    return op.label_runs(_labels(spark, sf), FPS)


def segment_content(spark, sf):
    p = _labels(spark, sf)
    tiles = v.block_tiles(p, 100.0)
    first = p.where("i % 6 = 0").select("video_id", F.expr("cast(i div 6 as int)").alias("idx"), F.col("emb").alias("speech_emb"))
    tiles = tiles.join(first, ["video_id", "idx"], "left").withColumn(
        "speech_emb", F.when(F.col("kind") == "speech", F.col("speech_emb"))
    )
    return op.segment_content(p, tiles, FPS)


QUERIES = {
    f.__name__: f
    for f in (
        frame_db, silence_threshold, snr, segment_audio, clipping_ratio, voiced_mask, smooth_pitch,
        segment_pitch, pitch_median_hz, frame_diffs, scene_cuts, segment_visual, classify_frames,
        label_islands, label_runs, segment_content,
    )
}
