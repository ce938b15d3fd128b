"""Registered queries over scripts and transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayline.functions import textcols as tc
from stayline.functions.arrays import spread
from stayline.operators import sentences as sen, text as op
from stayline.plans import views as v
from stayline.sources import scripts as src


def src_scripts(spark, sf):
    w = src.script_words(v.marked_up_scripts(spark, sf))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "text"))), lambda x: x["text"]), " ")
    return w.groupBy("video_id", "para_idx").agg(F.count(F.lit(1)).alias("n_words"), text.alias("text"))


def words(spark, sf):
    return src.script_words(v.scripts(spark, sf))


def script_timing(spark, sf):
    return words(spark, sf).select("video_id", "word_idx", "text", "start", "end", "paragraph_break")


def is_terminal(spark, sf):
    docs = v.load(spark, sf, "documents").select("doc_id", tc.words_of(F.col("text")).alias("w"))
    return docs.select(
        "doc_id",
        F.size("w").alias("n_tokens"),
        F.size(F.filter("w", lambda x: tc.is_terminal(F.concat(x, F.lit('")'))))).alias("n_terminal"),
    )


def join_tokens(spark, sf):
    docs = v.load(spark, sf, "documents").select("doc_id", F.translate("text", "etn", "。中文").alias("t"))
    return docs.select("doc_id", tc.join_tokens(tc.words_of(F.col("t"))).alias("text"))


def build_sentences_context_free(spark, sf):
    return sen.sentence_table(sen.sentences_with_words(words(spark, sf), soft=False))


def build_sentences(spark, sf):
    return sen.build_sentences(words(spark, sf))


def tokens(spark, sf):
    return v.turns(spark, sf).select("video_id", "sent_idx", tc.tokens(F.col("text")).alias("tokens"))


def _turn_features(spark, sf):
    return op.sentence_features(v.turns(spark, sf))


def fillers(spark, sf):
    return _turn_features(spark, sf).select("video_id", "sent_idx", "fillers")


def repeated_words(spark, sf):
    return _turn_features(spark, sf).select(
        "video_id", "sent_idx", tc.repeated_words(F.col("tokens")).alias("repeated_words")
    )


def questions(spark, sf):
    return _turn_features(spark, sf).select("video_id", "sent_idx", "is_question")


def number_claims(spark, sf):
    return _turn_features(spark, sf).select("video_id", "sent_idx", "has_claim")


def with_tokens(cut, *keep):
    """Sentences with their tokens only, and the columns to keep."""
    s = sen.sentence_table(cut, *keep)
    s = s.withColumn("tokens", tc.tokens(F.col("text"))).withColumn("eligible", F.size("tokens") >= op.MIN_SENTENCE_WORDS)
    return s.select("video_id", "sent_idx", "start", "end", "tokens", "eligible", *keep)


def plain_sentences(spark, sf):
    """Sentences of every script with their tokens only."""
    return with_tokens(sen.sentences_with_words(words(spark, sf)))


def script_sentences(spark, sf):
    """Sentences of every script with features and the tile that holds their last word."""
    cut = sen.sentences_with_words(words(spark, sf))
    # read by the tiles and the sentences: of a word its number and times are kept, its text in the sentence's
    at = F.transform("ws", lambda w: F.struct(w["word_idx"].alias("word_idx"), w["start"].alias("start"), w["end"].alias("end")))
    cut = sen.sentence_table(cut.withColumn("at", at), "at").persist()
    tiles = v.word_tiles(spread(cut, "at", "w", "video_id").select("video_id", "w.word_idx", "w.start", "w.end"))
    sents = op.sentence_features(cut.drop("at"))
    return tiles, op.sentence_to_segment(sents, tiles)


def sentence_to_segment(spark, sf):
    return script_sentences(spark, sf)[1].select("video_id", "sent_idx", "idx", "word_start", "word_end")


def pace(spark, sf):
    tiles = v.word_tiles(words(spark, sf))
    return op.pace(tiles).select("video_id", "idx", "words_per_second", "pace_ratio")


def pauses(spark, sf):
    return op.pauses(v.tile_words(words(spark, sf)), 0.8)


def phrase_occurrences(spark, sf):
    return op.phrase_occurrences(plain_sentences(spark, sf))


def repeated_phrases(spark, sf):
    occ = op.phrase_occurrences(plain_sentences(spark, sf))
    return op.repeated_phrases(occ).select(
        "video_id", "phrase", "count", "rank", F.col("first.sent_idx").alias("first_sent"), F.col("first.pos").alias("first_pos")
    )


def phrase_stats(spark, sf):
    sents = plain_sentences(spark, sf).persist()  # read by the occurrences and the times
    return op.phrase_stats(op.phrase_occurrences(sents), sents)


def phrase_repeats(spark, sf):
    sents = script_sentences(spark, sf)[1]
    return op.phrase_repeats(op.phrase_occurrences(sents), sents)


def segment_text_agg(spark, sf):
    tiles, sents = script_sentences(spark, sf)
    return op.segment_text(sents, tiles)


QUERIES = {
    f.__name__: f
    for f in (
        src_scripts, script_timing, is_terminal, join_tokens, build_sentences_context_free,
        build_sentences, tokens, fillers, repeated_words, questions, number_claims,
        sentence_to_segment, pace, pauses, phrase_occurrences, repeated_phrases, phrase_stats,
        phrase_repeats, segment_text_agg,
    )
}
