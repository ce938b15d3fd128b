"""Driver tables seen as the engine's input tables. Every view is a projection: no sampling, no
row limits. Timelines are bounded by construction (a document, or a fixed block of ids)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

VIDEO_S = 600.0
TOL = 30.0  # start tolerance on this data, seconds
LECTURE_TOL = 60.0


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"
_START = f"({_MICROS} % 600000000) / 1e6D"


def watch(spark, sf) -> DataFrame:
    """Events as watched intervals; the event type is the video, the user the viewer."""
    return load(spark, sf, "events").select(
        F.col("user_id").alias("viewer_id"),
        F.lit(0).alias("entry"),
        F.col("event_type").alias("video_id"),
        F.expr(_START).alias("start_point"),
        F.expr(f"least({_START} + value * 0.6D, 600D)").alias("end_point"),
    )


def lecture_watch(spark, sf) -> DataFrame:
    """Events as many small lectures: the user is the lecture, (type, weekday) the viewer."""
    return load(spark, sf, "events").select(
        F.expr("concat(event_type, '-', day(ts) % 7)").alias("viewer_id"),
        F.lit(0).alias("entry"),
        F.expr("concat('u', user_id)").alias("video_id"),
        F.expr(_START).alias("start_point"),
        F.expr(f"least({_START} + value * 0.6D, 600D)").alias("end_point"),
    )


def lectures_of(watch_df: DataFrame, tol: float) -> DataFrame:
    """video_id, n_viewers, n_starters, duration_s (last watched second), lines (log rows)."""
    per = watch_df.groupBy("viewer_id", "entry", "video_id").agg(
        F.min("start_point").alias("first"), F.max("end_point").alias("last"), F.count(F.lit(1)).alias("n")
    )
    return per.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n_viewers"),
        F.count_if(F.col("first") <= tol).alias("n_starters"),
        F.max("last").alias("duration_s"),
        F.sum("n").alias("lines"),
    )


# The invented prose has no fillers, cues or number words; these word swaps plant some.
SPICE = [
    (" the ", " you know "), (" and ", " um "), (" of ", " two "), (" la ", " matlab "),
    (" le ", " hai na "), (" les ", " toh toh "), (" que ", " in this video "), (" en ", " today we "),
    (" der ", " what "), (" in ", " we will "), (" un ", " i mean "),
]


def spiced(col: str = "text"):
    out = F.col(col)
    for a, b in SPICE:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def scripts(spark, sf) -> DataFrame:
    """Documents as scripts: one document is one video."""
    return load(spark, sf, "documents").select(
        F.col("doc_id").alias("video_id"), spiced().alias("text"), "lang"
    )


def marked_up_scripts(spark, sf) -> DataFrame:
    """Documents with headings, list items, code fences, links and emphasis on fixed lines."""
    line = F.expr(
        r"""array_join(transform(split(text, '\n'), (x, i) -> case
              when i % 7 = 3 then concat('```\n', x)
              when i % 5 = 1 then concat('## ', x)
              when i % 5 = 2 then concat(' - **', x, '** -- !')
              when i % 5 = 4 then concat('> ... [', x, '](http://x.y) ', '.')
              else concat(x, '\n') end), '\n')"""
    )
    return load(spark, sf, "documents").select(F.col("doc_id").alias("video_id"), line.alias("text"), "lang")


def turns(spark, sf) -> DataFrame:
    """Conversation turns as sentences; odd turns lose their final mark, every third asks."""
    text = F.expr(
        "case when turn % 3 = 0 then concat(rtrim('.!?', t), '?\"') when turn % 2 = 1 then rtrim('.!?', t) else t end"
    )
    return (
        load(spark, sf, "conversations")
        .select(F.col("conv_id").alias("video_id"), F.col("turn").cast("int").alias("sent_idx"), "role", "turn", spiced().alias("t"))
        .select("video_id", "sent_idx", "role", text.alias("text"))
    )


def tile_words(words: DataFrame, width: float = 12.0) -> DataFrame:
    """Words with the fixed tile they start in as ``idx``."""
    return words.withColumn("idx", F.floor(F.col("start") / width).cast("int"))


def word_tiles(words: DataFrame, width: float = 12.0) -> DataFrame:
    """The tiles that hold words, as segments."""
    per = tile_words(words, width).groupBy("video_id", "idx").agg(
        F.min("word_idx").alias("word_start"), (F.max("word_idx") + 1).alias("word_end"), F.max("end").alias("_end")
    )
    return per.withColumn("_last", F.max("_end").over(W.partitionBy("video_id"))).select(
        "video_id", "idx", F.lit("speech").alias("kind"),
        (F.col("idx") * width).alias("start"),
        F.least((F.col("idx") + 1) * width, F.round(F.col("_last") + 0.5, 3)).alias("end"),
        "word_start", "word_end",
    )


def caption_units(spark, sf) -> DataFrame:
    """Non-empty document lines as speech units on a 12 s grid; short lines leave long gaps."""
    rows = load(spark, sf, "documents").select(
        F.col("doc_id").alias("video_id"), F.posexplode(F.expr(r"split(text, '\n')")).alias("i", "x")
    )
    return rows.where("length(x) > 0").select(
        "video_id",
        F.col("i").alias("word_start"),
        (F.col("i") + 1).alias("word_end"),
        (F.col("i") * 12.0 + 2.0).alias("start"),
        F.expr("i * 12D + 2D + least(12D, length(x) / 40D)").alias("end"),
        F.col("i").alias("sent_idx"),
        F.expr("case i % 3 when 0 then 'sentence' when 1 then 'pause' else 'forced_split' end").alias("boundary"),
        F.col("x").alias("text"),
    )


def unit_videos(units: DataFrame) -> DataFrame:
    return units.groupBy("video_id").agg((F.max("word_start") * 12.0 + 20.0).alias("duration_s"))


def seg_emb(spark, sf) -> DataFrame:
    """Vectors as segments: every 50 neighbouring ids are one video of 12 s segments."""
    return load(spark, sf, "embeddings").select(
        F.expr("vec_id div 50").alias("video_id"),
        F.expr("cast(vec_id % 50 as int)").alias("idx"),
        F.expr("(vec_id % 50) * 12D").alias("start"),
        F.expr("(vec_id % 50) * 12D + 12D").alias("end"),
        "label",
        F.transform("embedding", lambda x: x.cast("double")).alias("emb"),
    )


#: segment measurements taken from the events: every 50 neighbouring ids are one video
SEG_FEATURES = """
 (select video_id, idx, k, value, kind, s, idx = 0 as is_first,
    s as start, s + 12 as end, 600 as duration_s,
    case when kind = 'speech' then s + 0.4 end as speech_start,
    case when kind = 'speech' then s + 11.4 end as speech_end,
    20 + k % 10 as word_count, k % 5 as filler_count,
    case when kind = 'speech' then 0.4 + (k * 19 % 100) / 100.0 end as pace_ratio,
    case when kind = 'speech' and idx > 0 then k / 100.0 end as semantic_novelty,
    case when kind = 'speech' and idx > 0 then (k * 7 % 100) / 100.0 end as information_gain,
    case when kind = 'speech' and idx > 1 then (k * 13 % 100) / 100.0 end as repetition_similarity,
    case when kind = 'speech' and idx > 1 then greatest(0, idx - 2 - k % 5) end as repetition_match_segment,
    case when kind = 'speech' then k % 4 else 0 end as repetition_count,
    case when kind = 'speech' then (k % 10) / 10.0 end as repeated_sentence_ratio,
    case when kind = 'speech' and idx > 0 then (k * 3 % 100) / 100.0 end as topic_shift,
    kind = 'speech' and idx > 0 and k % 8 = 0 as topic_boundary,
    case when kind = 'speech' then (k % 30) / 10.0 end as longest_pause_s,
    case when kind = 'speech' and k % 30 > 0 then s + 3 end as longest_pause_at,
    (k * 17 % 100) / 400.0 as p_drop,
    case when k * 17 % 100 >= 90 then 'high' when k * 17 % 100 >= 75 then 'medium' else 'low' end as risk,
    case when k % 9 > 0 then (k * 11 % 100) / 100.0 end as silence_ratio,
    (k * 11 % 160) / 10.0 - 12 as energy_db,
    case when k % 7 > 0 then (k * 5 % 60) / 10.0 end as energy_variation_db,
    (k % 6) / 500.0 as clipping_ratio,
    case when k % 4 > 0 then (k * 23 % 90) / 10.0 end as pitch_range_st,
    case when k % 4 > 0 then (k * 23 % 90) / 50.0 end as pitch_range_ratio,
    case when k % 11 > 0 then k * 7 % 10 end as cuts_per_minute,
    case when k % 11 > 0 then (k * 29 % 100) / 100.0 end as static_ratio,
    case when k % 11 > 0 then (k * 31 % 100) / 1000.0 end as visual_change_mean,
    case when k % 11 > 0 then k * 7 % 25 end as longest_static_s,
    k * 3 % 80 as seconds_since_cut,
    case k % 9 when 0 then 'unclear' when 1 then 'diagram' when 2 then 'chart' when 3 then 'slide_text'
      when 4 then 'talking_head' when 5 then 'screen' when 6 then 'broll' when 7 then 'blank' end as visual_type,
    case when k % 9 < 8 then 0.3 + (k * 37 % 70) / 100.0 end as visual_type_share,
    case when k % 5 > 0 then 0.6 + (k * 41 % 80) / 100.0 end as speech_match_ratio
  from (select {id} as video_id, {pos} as idx, {pos} * 12 as s, value, {k} as k,
          case when event_type = 'error' then 'silence' else 'speech' end as kind from events))"""

_DOUBLES = (
    "start end duration_s speech_start speech_end pace_ratio semantic_novelty information_gain "
    "repetition_similarity repeated_sentence_ratio topic_shift longest_pause_s longest_pause_at p_drop silence_ratio "
    "energy_db energy_variation_db clipping_ratio pitch_range_st pitch_range_ratio static_ratio visual_change_mean "
    "longest_static_s seconds_since_cut visual_type_share speech_match_ratio cuts_per_minute"
).split()


def seg_features(spark, sf, placed: bool = False) -> DataFrame:
    """Every event as one measured 12 s segment (speech, or silence for error events). ``placed``: the events are placed
    by video before they are measured, so all tasks measure and narrow rows are shuffled."""
    events = load(spark, sf, "events").select("event_id", "event_type", "value", "props")
    if placed:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # explicit, as in scripts.place_by_video
        events = events.repartition(n, F.expr("event_id div 50"))
    events.createOrReplaceTempView("stayline_events")
    inner = SEG_FEATURES.replace("{id}", "event_id div 50").replace("{pos}", "cast(event_id % 50 as int)").replace(
        "{k}", "cast(get_json_object(props, '$.k') as int)"
    )
    df = spark.sql("select * from " + inner.replace("from events", "from stayline_events"))
    df = df.withColumns({c: F.col(c).cast("double") for c in _DOUBLES})
    m = F.col("repetition_match_segment")
    match = F.struct(
        (F.col("start") + 1).alias("start"), (F.col("start") + 7 + F.col("k") % 3).alias("end"),
        (m * 12.0 + 1).alias("matched_start"), (m * 12.0 + 6).alias("matched_end"),
    )
    return df.withColumn("repetition_matches", F.when((F.col("k") % 3 > 0) & m.isNotNull(), F.array(match)).otherwise(F.array().cast("array<struct<start:double,end:double,matched_start:double,matched_end:double>>")))


def loudness(spark, sf) -> DataFrame:
    """Event values as loudness frames: every 500 neighbouring ids are one 50 s video."""
    return load(spark, sf, "events").select(
        F.expr("event_id div 500").alias("video_id"), F.expr("cast(event_id % 500 as int)").alias("k"),
        F.expr("10 * log10(value * value + 1e-10D)").alias("db"),
    )


def pitch(spark, sf) -> DataFrame:
    """Event values as pitch frames at twice the loudness rate; error events have no pitch."""
    return load(spark, sf, "events").select(
        F.expr("event_id div 500").alias("video_id"), F.expr("cast(event_id % 500 as int)").alias("i"),
        F.expr("case when event_type <> 'error' then 70 + value % 330 end").alias("f0"),
    )


def block_tiles(rows: DataFrame, length_s: float, width: float = 12.0) -> DataFrame:
    """Tiles of ``width`` over [0, length_s] for every video in ``rows``; every fourth is silence."""
    n = int(-(-length_s // width))
    tiles = rows.select("video_id").distinct().withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return tiles.select(
        "video_id", "idx", (F.col("idx") * width).alias("start"),
        F.least((F.col("idx") + 1) * width, F.lit(float(length_s))).alias("end"),
        F.when(F.col("idx") % 4 == 3, "silence").otherwise("speech").alias("kind"),
    )


def chunks(spark, sf) -> DataFrame:
    """Vectors as 64-sample audio chunks; 50 neighbouring ids are one recording."""
    return load(spark, sf, "embeddings").select(
        F.expr("vec_id div 50").alias("video_id"), F.expr("(vec_id % 50) * 64").alias("first"), F.col("embedding").alias("samples")
    )


def pictures(spark, sf) -> DataFrame:
    """Vectors as tiny grey pictures (0..255) with the vector itself as picture embedding."""
    return seg_emb(spark, sf).select(
        "video_id", F.col("idx").alias("i"), "emb", "label",
        F.expr("transform(emb, x -> cast(floor((x + 1) * 127.5D) as int))").alias("pixels"),
    )


def _segs(spark, sf, segs: DataFrame | None) -> DataFrame:
    """The measured segments as the caller keeps them, else from the events."""
    return seg_features(spark, sf) if segs is None else segs


def seg_words(spark, sf, segs: DataFrame | None = None) -> DataFrame:
    """Six words per measured speech segment."""
    return _segs(spark, sf, segs).where("kind = 'speech'").select("video_id", "idx", "start", F.explode(F.expr("sequence(0, 5)")).alias("j")).select(
        "video_id", (F.col("idx") * 6 + F.col("j")).alias("word_idx"), F.expr("concat('w', idx * 6 + j)").alias("text"),
        (F.col("start") + F.col("j") * 2 + 0.3).alias("start"), (F.col("start") + F.col("j") * 2 + 1.6).alias("end"),
    )


def seg_sentences(spark, sf, segs: DataFrame | None = None) -> DataFrame:
    """One sentence per measured speech segment."""
    return _segs(spark, sf, segs).where("kind = 'speech'").select(
        "video_id", F.col("idx").alias("sent_idx"), F.col("speech_start").alias("start"), F.col("speech_end").alias("end"), F.expr("concat('s', idx)").alias("text"))


def seg_checks(spark, sf, segs: DataFrame | None = None) -> DataFrame:
    """A title check per measured video: never addressed, or at a planted segment."""
    return _segs(spark, sf, segs).groupBy("video_id").agg(
        F.min_by("speech_start", F.when((F.col("k") % 10 == 3) & (F.col("kind") == "speech"), F.col("idx"))).alias("m")
    ).select(
        "video_id", F.expr("case when video_id % 4 < 3 then 'alpha beta gamma' else 'x y' end").alias("title"),
        F.expr("case when video_id % 3 > 0 then m end").alias("first_mention_s"), F.lit("s").alias("first_mention_text"),
        F.col("m").alias("best_match_s"), F.when(F.col("m").isNotNull(), 0.5).alias("best_similarity"))


def seg_ledger(spark, sf, segs: DataFrame | None = None) -> DataFrame:
    """Opening promises of the measured videos: kept, late or open."""
    x = _segs(spark, sf, segs).where("kind = 'speech' and idx < 6 and k % 2 = 0")
    late = "k % 3 = 1"
    return x.select(
        "video_id", F.col("idx").alias("sent_idx"), F.expr("concat('s', idx)").alias("text"), F.lit("intro").alias("source"),
        F.col("speech_start").alias("made_at"), F.col("speech_end").alias("made_end"),
        F.expr(f"case when {late} then speech_start + 100 + k end").alias("payoff_at"), F.expr(f"case when {late} then speech_start + 104 + k end").alias("payoff_end"),
        F.expr(f"case when {late} then 'paid' end").alias("payoff_text"), F.lit(0.5).alias("similarity"),
        F.expr(f"case when {late} then 100D + k end").alias("delay_s"), F.expr(f"case k % 3 when 0 then 'kept' when 1 then 'late' else 'open' end").alias("status"))


def seg_points(spark, sf) -> DataFrame:
    """A retention curve with a band for every measured video."""
    return seg_features(spark, sf).select(
        "video_id", "idx", F.col("end").alias("t"),
        F.expr("greatest(0.05D, 1 - end / 700 - p_drop / 10)").alias("retention"),
        F.expr("greatest(0.05D, 1 - end / 700 - p_drop / 10) - 0.05D - k / 2000D").alias("lower"),
        F.expr("greatest(0.05D, 1 - end / 700 - p_drop / 10) + 0.05D + k / 2000D").alias("upper"))


def seg_flags(spark, sf) -> DataFrame:
    """Planted flags on the measured videos."""
    x = seg_features(spark, sf).where("k % 6 = 0")
    none = F.lit(None)
    ev = F.array(F.struct(F.lit("Planted").alias("label"), F.col("k").cast("double").alias("value_num"), none.cast("string").alias("value_str"),
                          F.lit("s").alias("unit"), none.cast("double").alias("ref_start"), none.cast("double").alias("ref_end")))
    action = F.expr("case when k % 5 = 3 then 'ADD_VISUAL' when k % 12 = 0 then 'CUT' else 'SHORTEN' end")
    edits = F.array(F.struct(
        F.expr("concat('e', idx)").alias("id"), action.alias("action"), F.col("start").alias("start"), (F.col("start") + 5).alias("end"),
        none.cast("double").alias("target_time"), F.lit("planted").alias("reason"), none.cast("string").alias("rewrite_text"), (action == "CUT").alias("simulatable")))
    return x.select(
        "video_id", F.expr("concat('f', idx)").alias("flag_id"), F.col("start"), F.expr("start + 12 * (1 + k % 3 + idx % 2)").alias("end"),
        F.expr("case k % 5 when 0 then 'pacing' when 1 then 'low_information' when 2 then 'repetition' when 3 then 'visual_monotony' else 'payoff_delay' end").alias("category"),
        F.expr("case when k % 12 = 0 then 'high' else 'medium' end").alias("severity"), (F.col("k") % 10 / 10).alias("risk_score"),
        F.expr("case when k % 18 = 0 then 'model+rule' else 'rule' end").alias("source"), F.expr("concat('flag ', k)").alias("title"), F.lit("why").alias("explanation"),
        ev.alias("evidence"), edits.alias("edits"))


_DONE = "round((event_id * 37 % 5800) / 10D, 1)"


def plans(spark, sf) -> DataFrame:
    """Every 20 neighbouring events are one edit plan on a 600 s video."""
    return load(spark, sf, "events").select(F.expr("event_id div 20").alias("plan_id")).distinct().withColumn("duration_s", F.lit(600.0))


def plan_edits(spark, sf) -> DataFrame:
    """Suggested edits: CUT (clicks and views), MOVE (signups), SHORTEN (purchases)."""
    return load(spark, sf, "events").where("event_type <> 'error'").select(
        F.expr("event_id div 20").alias("plan_id"), F.expr("concat('e', event_id % 20)").alias("id"), F.expr("cast(event_id % 20 as int)").alias("pos"),
        F.expr("case when event_type in ('click', 'view') then 'CUT' when event_type = 'signup' then 'MOVE' else 'SHORTEN' end").alias("action"),
        F.expr(_DONE).alias("start"), F.expr(f"{_DONE} + 1 + event_id % 13").alias("end"),
        F.expr("case when event_type = 'signup' then round((event_id * 91 % 5900) / 10D, 1) end").alias("target_time"),
        F.expr("event_type in ('click', 'view')").alias("simulatable"), F.lit("planted").alias("reason"))


def plan_custom(spark, sf) -> DataFrame:
    """The editor's own edits (error events): speed-ups, cuts and trims."""
    return load(spark, sf, "events").where("event_type = 'error'").select(
        F.expr("event_id div 20").alias("plan_id"), F.expr("concat('c', event_id % 20)").alias("id"), F.expr("cast(event_id % 20 as int)").alias("pos"),
        F.expr("case event_id % 4 when 0 then 'SPEED' when 1 then 'CUT' when 2 then 'SPEED' else case when event_id % 8 = 3 then 'TRIM_START' else 'TRIM_END' end end").alias("action"),
        F.expr(f"case when event_id % 8 = 7 then 590D + event_id % 9 else {_DONE} end").alias("start"),
        F.expr(f"case when event_id % 8 = 3 then 1D + event_id % 11 else {_DONE} + 2 + event_id % 17 end").alias("end"),
        F.expr("1.25D + (event_id % 3) * 0.25D").alias("factor"))
