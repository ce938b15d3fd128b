"""Watch logs, id maps and caption records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from stayline.functions.arrays import spread

WATCH_SCHEMA = (
    "id STRING, seq ARRAY<STRUCT<video_id STRING, "
    "segment ARRAY<STRUCT<start_point DOUBLE, end_point DOUBLE>>>>, _bad STRING"
)
CAPTION_SCHEMA = "ccid STRING, start ARRAY<DOUBLE>, end ARRAY<DOUBLE>, text ARRAY<STRING>, _bad STRING"
_JSON = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}

#: whitespace as Unicode defines it, spelled out so every regex engine agrees
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def parse_watch_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """One JSON viewer per line -> one row per watched interval. Broken lines are skipped;
    ``entry`` is the position in the viewer's list, entries without intervals vanish."""
    doc = lines.select(F.from_json(F.col(col), WATCH_SCHEMA, _JSON).alias("d"))
    doc = doc.where(F.col("d._bad").isNull() & F.col("d.seq").isNotNull())
    entries = doc.select(
        F.col("d.id").alias("viewer_id"), F.posexplode("d.seq").alias("entry", "item")
    )
    return entries.select(
        "viewer_id",
        "entry",
        F.col("item.video_id").alias("video_id"),
        F.explode("item.segment").alias("span"),
    ).select("viewer_id", "entry", "video_id", "span.start_point", "span.end_point")


def read_watch_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_watch_lines(spark.read.text(path))


def parse_id_map(lines: DataFrame, col: str = "value") -> DataFrame:
    """Two whitespace-separated tokens per line; other lines are ignored."""
    parts = F.filter(F.split(F.col(col), WS + "+"), lambda x: x != "")
    return (
        lines.select(parts.alias("p")).where(F.size("p") == 2)
        .select(F.col("p")[0].alias("video_id"), F.col("p")[1].alias("ccid"))
    )


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    return parse_id_map(spark.read.text(path))


def parse_captions(lines: DataFrame, col: str = "value") -> DataFrame:
    """Caption JSON lines -> arrays plus ``duration_s`` and ``lines``; records without ends drop."""
    doc = lines.select(F.from_json(F.col(col), CAPTION_SCHEMA, _JSON).alias("d"))
    return (
        doc.where(F.col("d._bad").isNull() & (F.size("d.end") > 0))
        .select("d.ccid", "d.start", "d.end", "d.text")
        .withColumn("duration_s", F.array_max("end"))
        .withColumn("lines", F.size("text"))
    )


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    return parse_captions(spark.read.text(path))


def caption_words(captions: DataFrame) -> DataFrame:
    """Caption lines -> one word per non-space character, times spread over the line. Lines are
    in (start, end, text) order, a line never starts before the previous one ended and lasts at
    least 0.01 s. Works on the arrays of one record, so nothing is shuffled."""
    lines = F.expr(
        "filter(array_sort(transform(arrays_zip(start, end, text), x -> named_struct("
        "'s', x.start, 'e', x.end, 't', x.text))), x -> x.e > x.s)"
    )
    strip = r"regexp_replace(x.t, '" + WS.replace("\\", "\\\\") + "', '')"
    usable = F.expr(
        f"filter(transform(_l, x -> named_struct('s', x.s, 'e', x.e, 't', {strip})), x -> x.t <> '')"
    )
    # the clamp depends on the previous clamped line: an ordered fold over the record's own lines
    clamped = F.expr(
        "aggregate(_l, named_struct('end', 0D, 'out', cast(array() as array<struct<s:double,e:double,t:string>>)),"
        " (a, x) -> transform(array(greatest(x.s, a.end)), s0 -> named_struct("
        "'end', round(greatest(x.e, s0 + 0.01D), 3), 'out', array_append(a.out, "
        "named_struct('s', s0, 'e', greatest(x.e, s0 + 0.01D), 't', x.t))))[0]).out"
    )
    rows = (
        captions.repartition(int(captions.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ccid")
        .select("ccid", lines.alias("_l"))
        .select("ccid", usable.alias("_l"))
    )
    rows = spread(rows, clamped, "line", "ccid", pos="sent_idx").select("ccid", "sent_idx", "line.*").withColumn("_n", F.length("t"))
    rows = spread(rows, F.split("t", ""), "text", "ccid", "sent_idx", "s", "e", "_n", pos="pos")
    step = (F.col("e") - F.col("s")) / F.col("_n")
    return rows.select(
        F.col("ccid").alias("video_id"),
        "sent_idx",
        "pos",
        "text",
        F.bround(F.col("s") + F.col("pos") * step, 3).alias("start"),
        F.bround(F.col("s") + (F.col("pos") + 1) * step, 3).alias("end"),
    )


ASR_SCHEMA = (
    "segments ARRAY<STRUCT<start DOUBLE, end DOUBLE, text STRING, "
    "words ARRAY<STRUCT<word STRING, start DOUBLE, end DOUBLE, probability DOUBLE>>>>"
)


def asr_words(results: DataFrame, col: str = "value") -> DataFrame:
    """Recogniser JSON (one row per video) -> words in time order: blank words dropped, no start
    before the previous one, no end before its start; the last word of every recogniser segment
    but the final one carries ``phrase_break``. The compact rows are placed by video once."""
    n = int(results.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = results.repartition(n, "video_id").select("video_id", F.from_json(F.col(col), ASR_SCHEMA).alias("d"))
    x = spread(x.withColumn("_n", F.size("d.segments")), "d.segments", "s", "video_id", "_n", pos="_seg")
    x = spread(x, "s.words", "w", "video_id", "_n", "_seg", pos="_pos")
    x = x.withColumn("text", F.regexp_replace("w.word", f"^{WS}+|{WS}+$", "")).where("text <> ''")
    order = W.partitionBy("video_id").orderBy("_seg", "_pos")
    start = F.max(F.bround("w.start", 3)).over(order.rowsBetween(W.unboundedPreceding, 0))
    nxt = F.lead("_seg").over(order)
    x = x.withColumns({"start": start, "word_idx": F.row_number().over(order) - 1, "_next": nxt})
    last = F.coalesce(F.col("_next") != F.col("_seg"), F.lit(True))
    return x.select(
        "video_id", "word_idx", "text", "start", F.greatest(F.bround("w.end", 3), "start").alias("end"),
        F.col("w.probability").alias("confidence"), F.lit(False).alias("paragraph_break"),
        (last & (F.col("_seg") < F.col("_n") - 1)).alias("phrase_break"),
    )


def mean_confidence(words: DataFrame) -> DataFrame:
    return words.groupBy("video_id").agg(F.bround(F.avg("confidence"), 4).alias("mean_confidence"))
