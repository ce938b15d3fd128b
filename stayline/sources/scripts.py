"""Script corpora (plain text or light mark-up) -> paragraphs -> timed words.

The documents are placed by ``video_id`` once, before anything is exploded; every later window
and join on ``video_id`` reuses that placement.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stayline.functions import lexicon as lex
from stayline.functions.textcols import SPACE, WS, bround3, is_terminal, strip

#: \r\n or one of these; as with ``SPACE`` one test rules out nearly all other characters
LINE_BREAK = r"[[^ -~\x{a0}-\x{2027}\x{202a}-\x{ffff}]&&[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]](?:(?<=\r)\n)?"
_DETACHED = r"[^\p{L}\p{N}" + WS[1:-1] + "]+"
#: first characters of a list item
LIST_STARTS = "-*+0123456789"


#: most bytes of text that a task explodes: a word's row takes some twenty times its text, and all words of a task are sorted
TASK_TEXT = 16_000_000


def place_by_video(df: DataFrame) -> DataFrame:
    """Hash-place compact rows by video before exploding them. The partition count is explicit:
    adaptive coalescing would size tasks by the unexploded bytes. It is the session's, or more where a task
    would get over TASK_TEXT, so that what a task holds does not grow with the corpus."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = df.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return df.repartition(max(n, math.ceil(size / TASK_TEXT)), "video_id")


def _first_in(text: Column, chars: str) -> Column:
    return F.substring(text, 1, 1).isin(list(chars))


def _alone(line: Column) -> Column:
    """A stripped line is a heading or a list item. Its first character settles most."""
    return line.startswith("#") | (_first_in(line, LIST_STARTS) & line.rlike(lex.LIST_ITEM))


def _spoken(rows: DataFrame) -> DataFrame:
    """``_line`` (stripped) without mark-up as ``_text``. Each expression runs only on lines that hold its sign."""

    def step(sign, made):
        return rows.withColumn("_text", F.when(sign, made).otherwise(F.col("_text")))

    text = F.col("_text")
    rows = rows.withColumn("_text", F.col("_line"))
    rows = step(text.startswith("#"), F.regexp_replace(text, lex.HEADING, ""))
    rows = step(_first_in(text, LIST_STARTS), F.regexp_replace(text, lex.LIST_ITEM, ""))
    rows = step(_first_in(text, "> "), F.regexp_replace(text, "^[> ]+", ""))
    rows = rows.withColumn("_text", strip(text))
    rows = step(text.contains("["), F.regexp_replace(text, lex.LINK, "$1"))
    marks = text.contains("*") | text.contains("__") | text.contains("`")
    rows = step(marks, F.regexp_replace(text, lex.EMPHASIS, ""))
    return rows.withColumn("_text", strip(text))


def script_lines(scripts: DataFrame) -> DataFrame:
    """(video_id, lang, line_no, para, tokens): one row per spoken line.

    Headings and list items stand alone, fenced code is not spoken, a blank line ends a paragraph.
    A token made of punctuation only is glued to the word before it, across lines if need be.
    """
    rows = place_by_video(scripts).select(
        "video_id", "lang", F.posexplode(F.split("text", LINE_BREAK)).alias("line_no", "raw")
    )
    order = W.partitionBy("video_id").orderBy("line_no")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select("video_id", "lang", "line_no", strip(F.col("raw")).alias("_line"))
    fence = F.col("_line").startswith("```")
    rows = rows.withColumns(
        {"_fence": fence, "_fences": F.sum(fence.cast("int")).over(upto)}
    )
    quiet = F.col("_fence") | (F.col("_fences") % 2 == 1) | (F.col("_line") == "")
    rows = rows.withColumn("_kind", F.when(quiet, "quiet").when(_alone(F.col("_line")), "alone").otherwise("text"))
    fresh = (F.col("_kind") == "alone") | F.coalesce(F.lag("_kind").over(order) != "text", F.lit(True))
    rows = rows.withColumn("_fresh", F.when((F.col("_kind") != "quiet") & fresh, 1).otherwise(0))
    rows = rows.withColumn("para", F.sum("_fresh").over(upto)).where("_kind <> 'quiet'")
    # detached punctuation: inside a line by text, at the start of a line moved to the line before
    rows = _spoken(rows).select(
        "video_id", "lang", "line_no", "para",
        F.regexp_replace("_text", f"{SPACE}+({_DETACHED})(?={SPACE}|$)", "$1").alias("_text"),
    )
    rows = rows.withColumn("_lead", F.regexp_extract("_text", f"^({_DETACHED})(?={WS}|$)", 1))
    rows = rows.withColumn("_rest", strip(F.expr("substr(_text, length(_lead) + 1)"))).drop("_text")
    real = F.col("_rest") != ""
    rows = rows.withColumn("_real", F.sum(real.cast("int")).over(upto)).where("_real > 0")
    # a spoken line with the mark-only lines that follow it, then the next spoken line's lead
    marks = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when(~real, F.struct("line_no", "_lead")))), lambda x: x["_lead"]), ""
    )
    spoken = F.max(F.when(real, F.struct("line_no", "para", "_rest", "_lead")))
    rows = rows.sortWithinPartitions("video_id", "_real", "lang", "line_no")
    rows = rows.groupBy("video_id", "_real", "lang").agg(spoken.alias("x"), marks.alias("_marks"))
    nxt = F.lead("x._lead").over(W.partitionBy("video_id").orderBy("_real"))
    # words part at white space and the last takes the marks, so they are put behind the text before it is split
    tail = F.concat("x._rest", "_marks", F.coalesce(nxt, F.lit("")))
    return rows.select("video_id", "lang", "x.line_no", "x.para", F.split(tail, SPACE + "+").alias("tokens"))


def script_words(scripts: DataFrame) -> DataFrame:
    """Spoken words with estimated times: one step per word at the language's speaking rate, a
    pause after a sentence end, a longer one after a paragraph.

    ``scripts``: video_id, text, lang."""
    lines = script_lines(scripts)
    order = W.partitionBy("video_id").orderBy("line_no")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    lines = lines.withColumns(
        {
            "_base": F.coalesce(F.sum(F.size("tokens")).over(before), F.lit(0)),
            "_last_line": F.coalesce(F.lead("para").over(order) != F.col("para"), F.lit(True)),
            "_n": F.size("tokens"),
            "para_idx": F.dense_rank().over(W.partitionBy("video_id").orderBy("para")) - 1,
        }
    )
    rates = F.create_map(*[F.lit(x) for kv in lex.WORDS_PER_SECOND.items() for x in kv])
    step = 1.0 / F.coalesce(rates[F.col("lang")], F.lit(lex.DEFAULT_WORDS_PER_SECOND))
    words = lines.withColumn("_step", step).select(
        "video_id", "lang", "para_idx", "_base", "_n", "_last_line", "_step", F.posexplode("tokens").alias("_k", "text")
    ).select(
        "video_id", "lang", "para_idx", "text", "_step",
        (F.col("_base") + F.col("_k")).cast("int").alias("word_idx"),
        (F.col("_last_line") & (F.col("_k") == F.col("_n") - 1)).alias("paragraph_break"),
    )
    soft = (~F.col("paragraph_break") & is_terminal(F.col("text"))).cast("int")
    past = W.partitionBy("video_id").orderBy("word_idx").rowsBetween(W.unboundedPreceding, -1)
    words = words.withColumn("_soft", F.coalesce(F.sum(soft).over(past), F.lit(0)))
    t = F.col("word_idx") * F.col("_step") + F.col("_soft") * SENTENCE_PAUSE_S + F.col("para_idx") * PARAGRAPH_PAUSE_S
    return words.select(
        "video_id", "lang", "word_idx", "text", "para_idx", "paragraph_break",
        F.lit(False).alias("phrase_break"),
        bround3(t).alias("start"),
        bround3(t + F.col("_step")).alias("end"),
    )


# Pauses of estimated timing, seconds
SENTENCE_PAUSE_S = 0.35
PARAGRAPH_PAUSE_S = 0.8
TAIL_S = 0.5
