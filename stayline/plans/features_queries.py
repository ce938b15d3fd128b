"""Registered queries of the whole path: captions to segments, features, training rows, prediction."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from stayline.operators import features as op, model
from stayline.operators.watch import hash_split
from stayline.plans import text_queries as tq, views as v
from stayline.plans.watch_queries import _asr_lines, lecture_curve
from stayline.sources import watch_log as src

SCALARS = (
    "word_count", "words_per_second", "pace_ratio", "filler_count", "filler_ratio", "repeated_word_count", "question_count", "question_density",
    "claim_count", "claim_density", "semantic_novelty", "information_gain", "repetition_similarity", "repetition_match_segment", "repetition_count",
    "repeated_sentence_ratio", "topic_shift", "topic_boundary", "longest_pause_s", "longest_pause_at", "long_pause_count",
)


def _script_features(spark, sf):
    return op.text_features(tq.words(spark, sf), timed=False)


def text_features(spark, sf):
    """Every measure of every segment of every script; pauses are NULL, as script timing is estimated."""
    x = _script_features(spark, sf).segments
    return x.select("video_id", "idx", "kind", "start", "end", *SCALARS, "fillers", "repetition_matches", "phrase_repeats")


def text_features_timed(spark, sf):
    """The same of recognised speech, pauses included."""
    x = op.text_features(src.asr_words(_asr_lines(spark, sf))).segments
    return x.select("video_id", "idx", "kind", "start", "end", *SCALARS)


def text_topics(spark, sf):
    return _script_features(spark, sf).topics


def lecture_words(spark, sf):
    """A document as the captions of the lecture of its number, read at the pace that fills the lecture."""
    lectures, _ = lecture_curve(spark, sf)
    w = tq.words(spark, sf).withColumn("video_id", F.concat(F.lit("u"), "video_id"))
    last = F.max("end").over(W.partitionBy("video_id"))
    x = w.withColumn("_last", last).join(lectures.select("video_id", "duration_s"), "video_id")
    pace = F.greatest(F.col("duration_s") - 1, F.lit(0.5)) / F.col("_last")
    return x.withColumns({c: F.bround(F.col(c) * pace, 3) for c in ("start", "end")}).drop("_last", "duration_s")


def training_rows(spark, sf):
    """Segments of all lectures, cut from their captions, with features, observed drop and split; lectures without
    captions are one silence, cut at the longest length."""
    lectures, curve = lecture_curve(spark, sf)
    feats = op.text_features(lecture_words(spark, sf), lectures.select("video_id", F.bround("duration_s", 3).alias("duration_s")), timed=False)
    return op.training_rows(feats.segments, curve).withColumn("split", hash_split(F.col("video_id"), 0.2))


def training_features(spark, sf):
    x = training_rows(spark, sf)
    return x.select("video_id", "idx", "split", *[F.round(c, 6).alias(c) for c in ("hazard", "actual_r", "signed_rate", *model.FEATURES)])


def predict_from_captions(spark, sf):
    """Captions to features to fitted models to the curve, its band and the risk of every segment."""
    rows = op.kept(training_rows(spark, sf))
    rate, drop = model.boost.fit(model.labelled(rows.where("split = 'train'")), [model.rate_model(), model.drop_model()], model.settings())
    scored = model.with_rate(rows, rate).withColumn("score", drop.predict()).persist()
    curve, _ = model.calibrated_prediction(scored)
    base = model.drop_rate_by_position(scored.where("split = 'train'"))
    risk = model.risk_levels(scored, base).select("video_id", "idx", F.round("ratio", 6).alias("ratio"), "risk")
    return model.predict_curve(curve).join(risk, ["video_id", "idx"])


QUERIES = {f.__name__: f for f in (text_features, text_features_timed, text_topics, training_features, predict_from_captions)}
