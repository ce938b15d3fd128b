"""Sentence and segment text features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stayline.functions import lexicon as lex
from stayline.functions.arrays import spread
from stayline.functions.textcols import (
    fillers, has_number_claim, is_question, ratio, repeated_words, tokens,
)

# Fixed values
NGRAM = 3
MIN_COUNT = 3
MAX_STOPWORDS = 1
MAX_PER_SEGMENT = 3
MAX_VIDEO_LIST = 10
MAX_TIMES = 10
LONG_PAUSE_S = 1.5
MIN_SENTENCE_WORDS = 4


def sentence_features(sentences: DataFrame) -> DataFrame:
    """Row-local: tokens, fillers, question and number-claim flags, match eligibility."""
    s = sentences.withColumn("tokens", tokens(F.col("text")))
    return s.withColumns(
        {
            "fillers": fillers(F.col("tokens")),
            "is_question": is_question(F.col("text")),
            "has_claim": has_number_claim(F.col("tokens")),
            "eligible": F.size("tokens") >= MIN_SENTENCE_WORDS,
        }
    )


def phrase_occurrences(sents: DataFrame) -> DataFrame:
    """(video_id, sent_idx, pos, phrase): word trigrams inside a sentence without fillers and
    with at most one stopword. Row-local."""
    # a filler outweighs the limit, a stopword counts one: a trigram is kept by its weight
    fill, stop = lex.flat(lex.FILLER_WORDS), lex.flat(lex.STOPWORDS)
    weight = F.transform("tokens", lambda t: F.when(t.isin(fill), MAX_STOPWORDS + 1).when(t.isin(stop), 1).otherwise(0))
    x = sents.select("video_id", "sent_idx", "tokens", weight.alias("_w"))
    last = F.size("tokens") - NGRAM
    at = F.when(last >= 0, F.sequence(F.lit(0), last))

    def total(i: Column) -> Column:
        return F.get("_w", i) + F.get("_w", i + 1) + F.get("_w", i + 2)

    kept = F.transform(
        F.filter(at, lambda i: total(i) <= MAX_STOPWORDS),
        lambda i: F.struct(i.alias("pos"), F.concat_ws(" ", F.get("tokens", i), F.get("tokens", i + 1), F.get("tokens", i + 2)).alias("phrase")),
    )
    return spread(x, kept, "x", "video_id", "sent_idx").select("video_id", "sent_idx", "x.pos", "x.phrase")


def ranked_occurrences(occ: DataFrame) -> DataFrame:
    """Occurrences of phrases said often enough, with the phrase's count, rank and position in
    its own list (``k``), and whether a better-ranked phrase sits one word away."""
    own = W.partitionBy("video_id", "phrase").orderBy("sent_idx", "pos")
    whole = own.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # one sort of the occurrences; few of them are said often enough to go on
    x = occ.withColumns({
        "count": F.count(F.lit(1)).over(whole),
        "first": F.first(F.struct("sent_idx", "pos")).over(whole),
        "k": F.row_number().over(own) - 1,
    }).where(F.col("count") >= MIN_COUNT)
    # all occurrences of a phrase share count, first and phrase, no other phrase does
    best = W.partitionBy("video_id").orderBy(F.desc("count"), "first", "phrase")
    x = x.withColumn("rank", F.dense_rank().over(best))
    line = W.partitionBy("video_id", "sent_idx").orderBy("pos")

    def beside(move, delta):
        return (move("pos").over(line) == F.col("pos") + delta) & (move("rank").over(line) < F.col("rank"))

    near = F.coalesce(beside(F.lag, -1), F.lit(False)) | F.coalesce(beside(F.lead, 1), F.lit(False))
    return x.withColumn("near", near)


def repeated_phrases(occ: DataFrame) -> DataFrame:
    """(video_id, phrase, count, rank, first): listed phrases; one whose every occurrence sits
    beside a better-ranked phrase is the same repeat and is dropped."""
    x = ranked_occurrences(occ)
    return (
        x.groupBy("video_id", "phrase")
        .agg(F.first("count").alias("count"), F.first("rank").alias("rank"), F.first("first").alias("first"),
             F.bool_and("near").alias("_covered"))
        .where("not _covered").drop("_covered")
    )


def phrase_stats(occ: DataFrame, sents: DataFrame) -> DataFrame:
    """Per video the top phrases with the first times they are said."""
    x = ranked_occurrences(occ)
    top = W.partitionBy("video_id").orderBy("rank")
    kept = (
        x.groupBy("video_id", "phrase", "count", "rank").agg(
            F.bool_and("near").alias("_c"),
            F.collect_list(F.when(F.col("k") < MAX_TIMES, F.struct("k", "sent_idx"))).alias("at"),
        ).where("not _c").withColumn("place", F.row_number().over(top)).where(F.col("place") <= MAX_VIDEO_LIST)
    )
    times = kept.select("video_id", "phrase", "count", "place", F.explode("at").alias("x")).select(
        "video_id", "phrase", "count", "place", "x.*"
    ).join(sents.select("video_id", "sent_idx", "start"), ["video_id", "sent_idx"])
    return times.groupBy("video_id", "phrase", "count", "place").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "start"))), lambda t: t["start"]).alias("times")
    )


def phrase_repeats(occ: DataFrame, sents: DataFrame) -> DataFrame:
    """(video_id, idx, phrase, at, count, first_at, place): listed phrases said again inside a
    segment, the top three. ``sents`` carries the segment ``idx`` of each sentence."""
    # as in repeated_phrases, in the same pass
    covered = F.bool_and("near").over(W.partitionBy("video_id", "phrase"))
    listed = ranked_occurrences(occ).withColumn("_covered", covered).where("not _covered").drop("_covered")
    said = listed.join(
        sents.select("video_id", "sent_idx", "idx", "start"), ["video_id", "sent_idx"]
    )
    first_at = F.min("start").over(W.partitionBy("video_id", "phrase"))
    again = (
        said.withColumn("first_at", first_at).where("k >= 1")
        .groupBy("video_id", "idx", "phrase", "count", "first_at").agg(F.min("start").alias("at"))
    )
    top = W.partitionBy("video_id", "idx").orderBy(F.desc("count"), "at", "phrase")
    return again.withColumn("place", F.row_number().over(top)).where(F.col("place") <= MAX_PER_SEGMENT)


def sentence_to_segment(sents: DataFrame, segments: DataFrame) -> DataFrame:
    """Adds ``idx``: the segment that holds the sentence's last word. Segments cover the words in
    order without overlap, so the segment is the last one that starts at or before that word."""
    marks = segments.where("word_end > word_start").select(
        "video_id", F.col("word_start").alias("_w"), F.lit(0).alias("_kind"), F.col("idx").alias("_idx"), F.lit(None).cast("int").alias("sent_idx")
    )
    asks = sents.select(
        "video_id", (F.col("word_end") - 1).alias("_w"), F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("_idx"), "sent_idx"
    )
    seen = W.partitionBy("video_id").orderBy("_w", "_kind").rowsBetween(W.unboundedPreceding, 0)
    placed = (
        marks.unionByName(asks).withColumn("idx", F.last("_idx", ignorenulls=True).over(seen))
        .where("_kind = 1").select("video_id", "sent_idx", "idx")
    )
    return sents.join(placed, ["video_id", "sent_idx"])


def pace(segments: DataFrame) -> DataFrame:
    """Adds words_per_second and pace_ratio (to the video's median over speech)."""
    words = F.col("word_end") - F.col("word_start")
    raw = words / F.greatest(F.col("end") - F.col("start"), F.lit(1e-6))
    x = segments.withColumn("_wps", raw)
    speech = F.when(F.col("kind") == "speech", F.col("_wps"))
    median = F.percentile(speech, F.lit(0.5)).over(W.partitionBy("video_id"))
    x = x.withColumn("_median", median)
    return x.withColumns(
        {
            "words_per_second": F.bround("_wps", 4),
            "pace_ratio": F.bround(F.try_divide(speech, F.nullif(F.col("_median"), F.lit(0.0))), 4),
        }
    ).drop("_wps", "_median")


def pauses(segment_words: DataFrame, long_s: float = LONG_PAUSE_S) -> DataFrame:
    """Per segment: longest gap between neighbouring words, where it starts (earliest on ties),
    and how many are long. NULL with fewer than two words; 0 when words touch."""
    order = W.partitionBy("video_id", "idx").orderBy("word_idx")
    gap = F.lead("start").over(order) - F.col("end")
    x = segment_words.withColumn("_gap", gap)
    open_gap = F.when(F.col("_gap") > 0, F.col("_gap"))
    return x.groupBy("video_id", "idx").agg(
        F.coalesce(F.bround(F.max(open_gap), 3), F.when(F.count(F.lit(1)) > 1, 0.0)).alias("longest_pause_s"),
        F.bround(F.max_by("end", F.when(open_gap.isNotNull(), F.struct(open_gap.alias("g"), (-F.col("end")).alias("t")))), 3).alias("longest_pause_at"),
        F.count_if(open_gap >= long_s).alias("long_pause_count"),
    )


def segment_text(sents: DataFrame, segments: DataFrame) -> DataFrame:
    """Counts, ratios and densities per segment; ``sents`` carries features and ``idx``."""
    toks = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("sent_idx", "tokens"))), lambda x: x["tokens"]))
    said = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("sent_idx", "fillers"))), lambda x: x["fillers"]))
    per = sents.groupBy("video_id", "idx").agg(
        F.count(F.lit(1)).alias("_n"),
        said.alias("fillers"),
        repeated_words(toks).alias("repeated_word_count"),
        F.count_if("is_question").alias("question_count"),
        F.count_if("has_claim").alias("claim_count"),
    )
    x = pace(segments).join(per, ["video_id", "idx"], "left")
    words = F.col("word_end") - F.col("word_start")
    count = F.coalesce(F.size("fillers"), F.lit(0))
    count = F.when(F.col("fillers").isNull(), 0).otherwise(count)

    def zero(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0)).alias(c)

    return x.select(
        "video_id", "idx", "start", "end", "kind", words.alias("word_count"),
        "words_per_second", "pace_ratio",
        count.alias("filler_count"), ratio(count, words).alias("filler_ratio"),
        F.coalesce("fillers", F.array().cast("array<string>")).alias("fillers"),
        zero("repeated_word_count"), zero("question_count"),
        ratio(F.col("question_count"), F.col("_n")).alias("question_density"),
        zero("claim_count"), ratio(F.col("claim_count"), F.col("_n")).alias("claim_density"),
    )
