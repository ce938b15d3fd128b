"""Words -> sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from stayline.functions.arrays import spread
from stayline.functions.textcols import is_terminal, join_tokens

# Sentence rules, seconds
SILENCE_GAP_S = 2.0
PAUSE_GAP_S = 0.6
PAUSE_MIN_S = 3.0
PHRASE_MIN_S = 2.0
MAX_SENTENCE_S = 15.0


def hard_breaks(words: DataFrame) -> DataFrame:
    """Adds ``gap`` (to the next word) and ``hard``: the end reason that needs no history
    (end, punct, silence, paragraph pause), else NULL."""
    order = W.partitionBy("video_id").orderBy("word_idx")
    nxt = F.lead("start").over(order)
    return words.withColumn("gap", nxt - F.col("end")).withColumn(
        "hard",
        F.when(F.col("gap").isNull(), "end")
        .when(is_terminal(F.col("text")), "punct")
        .when(F.col("gap") >= SILENCE_GAP_S, "silence")
        .when(F.col("paragraph_break"), "pause"),
    )


def _soft_ends() -> str:
    """Pauses, phrase ends and the length limit count from the start of the running sentence, so
    the words of a hard run are folded in order; the state is one time and the breaks found."""
    reason = (
        f"case when w.gap >= {PAUSE_GAP_S}D and w.end - rs >= {PAUSE_MIN_S}D then 'pause'"
        f" when w.phrase_break and w.end - rs >= {PHRASE_MIN_S}D then 'phrase'"
        f" when w.end - rs >= {MAX_SENTENCE_S}D then 'max_length' end"
    )
    step = (
        f"transform(array(coalesce(a.rs, w.start)), rs -> transform(array({reason}), why -> named_struct("
        "'rs', if(why is null, rs, null), 'out', if(why is null, a.out, "
        "array_append(a.out, named_struct('word_idx', w.word_idx, 'why', why)))))[0])[0]"
    )
    may = (
        f"size(ws) > 1 and (element_at(ws, -1).end - ws[0].start >= {MAX_SENTENCE_S}D"
        f" or exists(ws, w -> w.gap >= {PAUSE_GAP_S}D or w.phrase_break))"
    )
    none = "cast(array() as array<struct<word_idx:int,why:string>>)"
    return (
        f"if({may}, aggregate(slice(ws, 1, size(ws) - 1), named_struct('rs', cast(null as double), 'out', {none}),"
        f" (a, w) -> {step}).out, {none})"
    )


def sentences_with_words(words: DataFrame, soft: bool = True) -> DataFrame:
    """(video_id, sent_idx, end_reason, ws): one row per sentence with its words as an array of
    (word_idx, start, end, gap, phrase_break, text). One pass: the words of a transcript are gathered in the order in
    which they pass, parted at the hard breaks, and each run between two of them is cut into sentences in place."""
    order = W.partitionBy("video_id").orderBy("word_idx")
    marked = hard_breaks(words).withColumn("_at", F.row_number().over(order) - 1)
    row = F.struct(F.col("word_idx").cast("int").alias("word_idx"), "start", "end", "gap", "phrase_break", "text")
    hard = F.when(F.col("hard").isNotNull(), F.struct(F.col("_at").alias("at"), F.col("hard").alias("why")))
    ends = _soft_ends() if soft else "cast(array() as array<struct<word_idx:int,why:string>>)"
    first = "if(i = 0, 0, e[i - 1].word_idx - ws[0].word_idx + 1)"
    run = (
        f"transform(array(array_append({ends}, named_struct('word_idx', element_at(ws, -1).word_idx, 'why', h.why))), e -> transform(e, (c, i) ->"
        f" named_struct('why', c.why, 'ws', slice(ws, {first} + 1, c.word_idx - ws[0].word_idx - {first} + 1))))[0]"
    )
    start = "if(k = 0, 0, v.hs[k - 1].at + 1)"
    # a part of the aggregate's result, where arrays are still lists of words and a slice costs its own length alone
    sents = (
        "transform(array(named_struct('ws', array_sort(collect_list(_word)), 'hs', array_sort(collect_list(_hard)))), v ->"
        f" flatten(transform(v.hs, (h, k) -> transform(array(slice(v.ws, {start} + 1, h.at - {start} + 1)), ws -> {run})[0])))[0]"
    )
    sents = marked.select("video_id", row.alias("_word"), hard.alias("_hard")).groupBy("video_id").agg(F.expr(sents).alias("sents"))
    x = spread(sents, "sents", "s", "video_id", pos="sent_idx")
    return x.select("video_id", F.col("s.why").alias("end_reason"), F.col("s.ws").alias("ws"), "sent_idx")


def word_sentences(words: DataFrame, soft: bool = True) -> DataFrame:
    """Words with ``sent_idx``."""
    x = spread(sentences_with_words(words, soft), "ws", "w", "video_id", "sent_idx")
    return x.select("video_id", "sent_idx", "w.*")


def sentence_table(sents: DataFrame, *keep: str) -> DataFrame:
    """(video_id, sent_idx, start, end, word_start, word_end, end_reason, text) and the columns to keep."""
    return sents.select(
        "video_id", "sent_idx",
        F.expr("ws[0].start").alias("start"),
        F.element_at("ws", -1)["end"].alias("end"),
        F.expr("ws[0].word_idx").alias("word_start"),
        (F.element_at("ws", -1)["word_idx"] + 1).alias("word_end"),
        "end_reason",
        join_tokens(F.transform("ws", lambda w: w["text"])).alias("text"),
        *keep,
    )


def build_sentences(words: DataFrame) -> DataFrame:
    return sentence_table(sentences_with_words(words))
