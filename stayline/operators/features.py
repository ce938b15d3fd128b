"""One path from timed words to the features of every segment and the model's matrix.

Words become sentences, sentences segments, and all measures are taken on these segments. Each of the three tables
is checkpointed once and read by what follows, so no step is computed twice; they are all placed by video. The
measures of a segment are joined on (video_id, idx); every segment of every video is kept, silent ones with NULL
where nothing can be measured.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stayline.functions.arrays import spread
from stayline.functions.textcols import tokens
from stayline.operators import segments as seg, semantic as sem, sentences as sen, text as txt, watch
from stayline.session import ensure_checkpoint_dir

PLACES = 4


@dataclass
class TextFeatures:
    """``segments``: a row per segment with all measures; ``topics``, ``phrases`` and ``videos`` beside it."""

    segments: DataFrame
    topics: DataFrame
    phrases: DataFrame
    videos: DataFrame


def kept(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def rounded(c: str | Column) -> Column:
    return F.bround(c, PLACES)


def segment_sentences(segments: DataFrame, sents: DataFrame) -> DataFrame:
    """(video_id, idx, sent_idx, n): how many words of a sentence lie in each segment that has some."""
    held = segments.select("video_id", "idx", F.col("word_start").alias("a"), F.col("word_end").alias("b"), F.explode("sentence_ids").alias("sent_idx"))
    x = held.join(sents.select("video_id", "sent_idx", "word_start", "word_end"), ["video_id", "sent_idx"])
    return x.select("video_id", "idx", "sent_idx", (F.least("b", "word_end") - F.greatest("a", "word_start")).alias("n"))


def segment_words(words: DataFrame, segments: DataFrame) -> DataFrame:
    """(video_id, idx, word_idx, start, end): each word's segment. Segments cover the words in order."""
    marks = segments.where("word_end > word_start").select(
        "video_id", F.col("word_start").alias("word_idx"), F.lit(0).alias("_kind"), F.col("idx").alias("_idx"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end")
    )
    asks = words.select("video_id", "word_idx", F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("_idx"), "start", "end")
    seen = W.partitionBy("video_id").orderBy("word_idx", "_kind").rowsBetween(W.unboundedPreceding, 0)
    return marks.unionByName(asks).withColumn("idx", F.last("_idx", ignorenulls=True).over(seen)).where("_kind = 1").select("video_id", "idx", "word_idx", "start", "end")


def semantic_features(speech: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Measures by place among a video's spoken segments, and the segments where a topic starts.
    ``speech``: video_id, idx (in the timeline), pos (among the spoken), start, end, emb."""
    items = speech.select("video_id", F.col("pos").alias("idx"), "start", "end", "emb")
    names = speech.select("video_id", "pos", "idx")
    place = ["video_id", "pos"]

    def by_pos(df: DataFrame) -> DataFrame:
        return df.withColumnRenamed("idx", "pos")

    again = by_pos(sem.segment_repetition(items)).select(*place, F.col("sim").alias("repetition_similarity"), F.col("match").alias("_match"), F.col("n_similar").cast("int").alias("repetition_count"))
    bounds = by_pos(sem.topic_boundaries(items)).withColumn("topic_boundary", F.lit(True))
    x = (
        names.join(by_pos(sem.novelty(items)).withColumnRenamed("novelty", "semantic_novelty"), place, "left")
        .join(by_pos(sem.information_gain(items)), place, "left")
        .join(again, place, "left")
        .join(by_pos(sem.topic_shift(items)), place, "left")
        .join(bounds, place, "left")
    )
    target = names.select("video_id", F.col("pos").alias("_match"), F.col("idx").alias("repetition_match_segment"))
    x = kept(x.join(target, ["video_id", "_match"], "left"))
    out = x.select(
        "video_id", "idx", *[rounded(c).alias(c) for c in ("semantic_novelty", "information_gain", "repetition_similarity", "topic_shift")],
        "repetition_match_segment", "repetition_count", "topic_boundary",
    )
    return out, x.where("topic_boundary").select("video_id", "idx")


def text_features(words: DataFrame, videos: DataFrame | None = None, timed: bool = True, hints: DataFrame | None = None) -> TextFeatures:
    """Text, semantic and pause measures of every segment, topics, and phrases said again.

    ``words``: as the sources give them. ``videos`` (video_id, duration_s) also brings videos without a word.
    ``timed=False`` says that word times are estimated, as for scripts: pauses are then NULL.
    """
    cut = kept(sen.sentences_with_words(words))
    segs = kept(seg.tile_segments(cut, videos, hints))
    sents = kept(txt.sentence_to_segment(txt.sentence_features(sen.sentence_table(cut)), segs))
    speech_order = W.partitionBy("video_id").orderBy("idx")
    spoken = segs.where("kind = 'speech'").withColumn("pos", F.row_number().over(speech_order) - 1)
    speech = kept(spoken.select("video_id", "idx", "pos", "start", "end", sem.hash_embed(tokens(F.col("text"))).alias("emb")))
    meaning, bounds = semantic_features(speech)

    lines = sents.select("video_id", F.col("sent_idx").alias("idx"), "start", "end", "eligible", sem.dims(F.col("tokens")).alias("dims"))
    repeats = sem.repeated_by_counts(segment_sentences(segs, sents), sents, kept(sem.sentence_matches(lines)))
    occurrences = kept(txt.phrase_occurrences(sents))
    phrases = txt.phrase_repeats(occurrences, sents).groupBy("video_id", "idx").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "phrase", "at", "count", "first_at"))), lambda p: F.struct(p["phrase"].alias("phrase"), p["at"].alias("at"), p["count"].alias("count"), p["first_at"].alias("first_at"))).alias("phrase_repeats")
    )
    own = txt.segment_text(sents, segs)
    key = ["video_id", "idx"]
    x = segs.select(*key, "segment_id", "duration_s", "word_start", "word_end", "speech_start", "speech_end", "text").join(own, key)
    for part in (meaning, repeats, phrases):
        x = x.join(part, key, "left")
    if timed:
        heard = spread(cut, "ws", "w", "video_id").select("video_id", "w.word_idx", "w.start", "w.end")
        x = x.join(txt.pauses(segment_words(heard, segs)), key, "left")
    else:
        x = x.withColumns({"longest_pause_s": F.lit(None).cast("double"), "longest_pause_at": F.lit(None).cast("double"), "long_pause_count": F.lit(None).cast("long")})
    struct = dict(repeats.dtypes)["repetition_matches"]
    x = x.withColumns(
        {
            "topic_boundary": F.coalesce("topic_boundary", F.lit(False)),
            "repetition_count": F.coalesce("repetition_count", F.lit(0)),
            "long_pause_count": F.coalesce("long_pause_count", F.lit(0)),
            "repetition_matches": F.coalesce("repetition_matches", F.expr(f"cast(array() as {struct})")),
            "phrase_repeats": F.coalesce("phrase_repeats", F.expr(f"cast(array() as {dict(phrases.dtypes)['phrase_repeats']})")),
        }
    )
    rate = F.when(F.col("kind") == "speech", (F.col("word_end") - F.col("word_start")) / F.greatest(F.col("end") - F.col("start"), F.lit(1e-6)))
    header = segs.groupBy("video_id").agg(F.max("duration_s").alias("duration_s"), rounded(F.percentile(rate, F.lit(0.5))).alias("baseline_words_per_second"))
    header = header.withColumn("timing_source", F.lit("recognised" if timed else "estimated"))
    return TextFeatures(x, sem.topic_sections(segs, bounds), txt.phrase_stats(occurrences, sents), header)


def training_rows(features: DataFrame, curves: DataFrame) -> DataFrame:
    """The model's columns of every segment of every lecture with its observed drop.

    ``curves``: a second of a lecture a row (video_id, t, retention, duration_s). Segments of lectures without a
    curve are left out, a lecture without words is one silence and stays.
    """
    observed = watch.segment_hazard(features.select("video_id", "idx", "start", "end"), curves)
    return sem.model_features(features).join(observed, ["video_id", "idx"])
