"""Registered queries over segmentation and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayline.functions.arrays import spread
from stayline.operators import segments as seg, semantic as op, sentences as sen
from stayline.plans import text_queries as tq, views as v


def _r(c, n=6):
    return F.round(F.col(c), n).alias(c)


def split_long(spark, sf):
    """Units of every script: sentences, the long ones cut at pauses."""
    s = sen.sentences_with_words(tq.words(spark, sf))
    return seg.split_long(s).select("video_id", "sent_idx", "piece", "word_start", "word_end", "start", "end", "boundary")


def speech_runs(spark, sf):
    units = v.caption_units(spark, sf)
    runs = seg.run_extents(units, v.unit_videos(units))
    return runs.select("video_id", "run", F.size("us").alias("n_units"), "s", "e", "a", "b")


def silence_segments(spark, sf):
    units = v.caption_units(spark, sf)
    out = seg.silence_segments(seg.run_extents(units, v.unit_videos(units)))
    return out.select("video_id", _r("start", 4), _r("end", 4), "word_start")


def pack_windows(spark, sf):
    units = v.caption_units(spark, sf)
    out = seg.pack_windows(seg.run_extents(units, v.unit_videos(units)))
    return out.select("video_id", _r("start", 4), _r("end", 4), "word_start", "word_end", "boundary")


def script_segments(spark, sf):
    return seg.tile_segments(sen.sentences_with_words(tq.words(spark, sf)))


def tile_segments(spark, sf):
    return script_segments(spark, sf).drop("speech_start", "speech_end")


def tile_invariants(spark, sf):
    """Per video: gaps between segments, coverage of [0, duration] and of every word."""
    order = "partition by video_id order by idx"
    s = script_segments(spark, sf).select(
        "*", F.expr(f"lead(start) over ({order})").alias("nx"), F.expr(f"lead(word_start) over ({order})").alias("nw")
    )
    return s.groupBy("video_id").agg(
        F.count_if((F.col("nx") != F.col("end")) | (F.col("nw") != F.col("word_end"))).alias("gaps"),
        (F.min("start") == 0).alias("from_zero"),
        F.max(F.round("duration_s", 3)).alias("duration_s"),
        F.max("end").alias("covered_s"),
        F.max("word_end").alias("n_words"),
        F.count_if((F.col("end") - F.col("start") > 15.0001) & (F.size("sentence_ids") > 1)).alias("too_long"),
    )


def hash_embed(spark, sf):
    from stayline.operators import text

    t = text.sentence_features(v.turns(spark, sf))
    return op.hash_embed_sparse(t, ["video_id", "sent_idx"]).select("video_id", "sent_idx", "dim", _r("w"))


def cosine(spark, sf):
    """Each segment against the first segment of its video."""
    e = v.seg_emb(spark, sf)
    first = e.where("idx = 0").select("video_id", F.col("emb").alias("f"))
    return e.join(first, "video_id").select("video_id", "idx", F.round(op.cosine("emb", "f"), 6).alias("cosine"))


def script_items(s, *keep):
    """Script sentences as items for matching: hashed words as token buckets."""
    return s.select("video_id", F.col("sent_idx").alias("idx"), "start", "end", "eligible", op.dims(F.col("tokens")).alias("dims"), *keep)


def sentence_matches(spark, sf):
    # read by the usual videos and the longer ones; a test of `eligible` below would make the tokens once more
    items = script_items(tq.plain_sentences(spark, sf)).persist()
    return op.sentence_matches(items).select("video_id", "idx", "match", _r("sim"))


def segment_repetition(spark, sf):
    out = op.segment_repetition(v.seg_emb(spark, sf), 20.0, 0.3)
    return out.select("video_id", "idx", _r("sim"), "match", "n_similar")


def repeated_sentence_ratio(spark, sf):
    # one pass over the words: of a sentence its buckets and its words' starts are kept, for the items, times and words
    cut = sen.sentences_with_words(tq.words(spark, sf)).withColumn("at", F.transform("ws", lambda w: w["start"]))
    items = script_items(tq.with_tokens(cut, "at"), "at").persist()
    times = items.select("video_id", F.col("idx").alias("sent_idx"), "start", "end")
    spoken = spread(items, "at", "start", "video_id", "idx").select("video_id", F.col("idx").alias("sent_idx"), "start")
    out = op.repeated_sentences(v.tile_words(spoken), times, op.sentence_matches(items.drop("at")))
    return out.select("video_id", "idx", "repeated_sentence_ratio", F.size("repetition_matches").alias("n_matches"),
                      F.get("repetition_matches", F.lit(0))["similarity"].alias("top_similarity"))


def novelty(spark, sf):
    return op.novelty(v.seg_emb(spark, sf)).select("video_id", "idx", _r("novelty"))


def information_gain(spark, sf):
    return op.information_gain(v.seg_emb(spark, sf)).select("video_id", "idx", _r("information_gain"))


def topic_shift(spark, sf):
    return op.topic_shift(v.seg_emb(spark, sf)).select("video_id", "idx", _r("topic_shift"))


def topic_depths(spark, sf):
    return op.topic_depths(v.seg_emb(spark, sf)).select("video_id", "idx", _r("gap"), _r("depth"), "is_minimum")


def topic_boundaries(spark, sf):
    return op.topic_boundaries(v.seg_emb(spark, sf))


def topic_sections(spark, sf):
    f = v.seg_features(spark, sf)
    return op.topic_sections(f, f.where("topic_boundary").select("video_id", "idx"))


def model_features(spark, sf):
    m = op.model_features(v.seg_features(spark, sf))
    return m.select("video_id", "idx", *[_r(c) for c in m.columns if c not in ("video_id", "idx")])


QUERIES = {
    f.__name__: f
    for f in (
        split_long, speech_runs, silence_segments, pack_windows, tile_segments, tile_invariants,
        hash_embed, cosine, sentence_matches, segment_repetition, repeated_sentence_ratio, novelty,
        information_gain, topic_shift, topic_depths, topic_boundaries, topic_sections, model_features,
    )
}
