"""Segment score lanes, evidence texts, QA of written texts, and per-video roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stayline.functions.textcols import tokens, words_of
from stayline.functions.timeline import mmss
from stayline.operators.semantic import cosine, hash_embed

# Fixed values
REPEAT_FLOOR, REPEAT_PENALTY = 0.60, 0.6
CUTS_FULL, CLIP_SCALE, QUIET_DB, QUIET_PENALTY = 6.0, 100.0, -8.0, 20.0
EXCERPT_CHARS = 500
REWRITE_MIN_WORDS, REWRITE_MAX_RATIO, REWRITE_MIN_RATIO = 12, 0.8, 0.35
SCRIPT_TOLERANCE, MIN_SIMILARITY = 0.35, 0.70
NUMBER = r"(\p{Nd}+(?::\p{Nd}{2})?(?:\.\p{Nd}+)?%?)"
SOURCE_NUMBER = r"(\p{Nd}+(?:[.:]\p{Nd}+)?%?)"
ECHO = r"(?i)^\s*(?:lines\s*)?\(?\s*\d{1,2}:\d{2}(?:\s*[–—-]\s*\d{1,2}:\d{2})?\s*\)?\s*[:,.–—-]*\s*"
SMALL_NUMBERS = ["0", "1", "2", "3"]

def _video():
    return W.partitionBy("video_id")



def _share_at_or_below(c: Column) -> Column:
    """Share of the video's known values that are at or below this one."""
    known = W.partitionBy("video_id", c.isNull()).orderBy(c)
    return F.when(c.isNotNull(), F.cume_dist().over(known))


def segment_scores(segs: DataFrame) -> DataFrame:
    """Pacing, content, visual, audio and overall lanes, 0..100, relative to the video."""
    speech = F.col("kind") == "speech"
    x = segs.withColumns({f"_{c}": F.when(speech, F.col(c)) for c in ("semantic_novelty", "information_gain", "repetition_similarity")})
    shares = {
        "_p_nov": "_semantic_novelty", "_p_gain": "_information_gain", "_p_vis": "visual_change_mean",
        "_p_var": "energy_variation_db", "_p_pitch": "pitch_range_st",
    }
    x = x.withColumns({k: _share_at_or_below(F.col(v)) for k, v in shares.items()})
    x = x.withColumn("_thr", F.greatest(F.lit(REPEAT_FLOOR), F.percentile("_repetition_similarity", F.lit(0.9)).over(_video())))
    pacing = F.when(speech, 100 * (F.col("pace_ratio") - 0.5) / 0.6)
    content = F.when(speech, 100 * (0.5 * F.col("_p_nov") + 0.5 * F.col("_p_gain")))
    content = content * F.when(F.col("_repetition_similarity") >= F.col("_thr"), REPEAT_PENALTY).otherwise(1.0)
    visual = 100 * (
        0.4 * (1 - F.col("static_ratio"))
        + 0.3 * F.least(F.lit(1.0), F.coalesce("cuts_per_minute", F.lit(0.0)) / CUTS_FULL)
        + 0.3 * F.coalesce("_p_vis", F.lit(0.0))
    )
    audio = 100 * (
        0.35 * (1 - F.col("silence_ratio")) + 0.2 * F.coalesce("_p_var", F.lit(0.5)) + 0.2 * F.coalesce("_p_pitch", F.lit(0.5))
        + 0.25 * (1 - F.least(F.lit(1.0), F.coalesce("clipping_ratio", F.lit(0.0)) * CLIP_SCALE))
    ) - F.when(F.col("energy_db") < QUIET_DB, QUIET_PENALTY).otherwise(0.0)
    lanes = {"pacing": pacing, "content": content, "visual": visual, "audio": F.when(speech, audio)}
    x = x.withColumns({k: F.when(c.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), c))) for k, c in lanes.items()})
    known = F.array_compact(F.array(*lanes))
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, v: s + v), F.nullif(F.size(known), F.lit(0)))
    return x.withColumn("overall", mean).select("video_id", "idx", *[F.bround(F.round(c, 9), 1).alias(c) for c in (*lanes, "overall")])


def flag_evidence(flags: DataFrame, words: DataFrame) -> DataFrame:
    """(video_id, flag_id, excerpt, evidence_json): what a writer may use about a flag. Words are
    attached through the seconds a flag covers."""
    sec = F.explode(F.sequence(F.floor("start"), F.floor("end")))
    span = flags.select("video_id", "flag_id", F.col("start").alias("_a"), F.col("end").alias("_b"), sec.alias("_sec"))
    w = words.select("video_id", "word_idx", "text", F.col("start").alias("_t"), F.floor("start").alias("_sec"))
    said = span.join(w, ["video_id", "_sec"]).where((F.col("_a") <= F.col("_t")) & (F.col("_t") < F.col("_b")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "text"))), lambda z: z["text"]), " ")
    per = said.groupBy("video_id", "flag_id").agg(F.left(text, F.lit(EXCERPT_CHARS)).alias("excerpt"))
    x = flags.join(per, ["video_id", "flag_id"], "left").withColumn("excerpt", F.coalesce("excerpt", F.lit("")))
    items = F.transform("evidence", lambda e: F.struct(
        # numbers stay numbers
        e["label"].alias("label"), F.when(e["value_str"].isNotNull(), e["value_str"].cast("variant")).otherwise(e["value_num"].cast("variant")).alias("value"), e["unit"].alias("unit"),
        F.when(e["ref_start"].isNotNull() & e["ref_end"].isNotNull(), F.concat(mmss(e["ref_start"]), F.lit("–"), mmss(e["ref_end"]))).alias("matches")))
    edits = F.transform("edits", lambda e: F.struct(e["action"].alias("action"), mmss(e["start"]).alias("start"), mmss(e["end"]).alias("end"), e["reason"].alias("reason")))
    head = F.struct("category", "severity", "source", mmss(F.col("start")).alias("start"), mmss(F.col("end")).alias("end"), "title")
    body = F.to_json(F.struct(head.alias("flag"), items.alias("evidence"), edits.alias("suggested_edits"), F.col("excerpt").alias("transcript_excerpt")))
    return x.select("video_id", "flag_id", "excerpt", body.alias("evidence_json"))


def _numbers(text: Column, pattern: str = NUMBER) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _core(c: Column) -> Column:
    return F.rtrim(c, F.lit("%"))


def allowed_numbers(blob: Column, values: Column) -> Column:
    """Every way a number of the evidence may be written: as is, with 0-2 decimals, and shares
    also as percentages."""
    def forms(x: Column) -> Column:
        plain = F.array(*[F.format_string(f"%.{d}f", F.bround(x, d)) for d in (0, 1, 2)])
        pct = F.array(F.format_string("%.0f%%", F.bround(x * 100)), F.format_string("%.0f", F.bround(x * 100)), F.format_string("%.1f%%", F.bround(x * 100, 1)))
        return F.when(x.between(0, 1), F.concat(plain, pct)).otherwise(plain)

    own = F.concat(_numbers(blob), F.flatten(F.transform(values, forms)))
    return F.array_distinct(F.concat(own, F.transform(own, _core)))


def new_numbers(text: Column, allowed: Column) -> Column:
    """Numbers of the text that are not allowed (small counting words always are)."""
    return F.filter(_numbers(text), lambda n: ~(F.array_contains(allowed, n) | F.array_contains(allowed, _core(n)) | _core(n).isin(SMALL_NUMBERS)))


def devanagari_share(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.length(F.regexp_replace(text, r"[^\x{0900}-\x{097F}]", "")) / F.greatest(letters, F.lit(1))


def rewrite_gate(candidates: DataFrame) -> DataFrame:
    """Accept or refuse rewrites: shorter but not too short, no new numbers, same script, same
    meaning. ``candidates``: original, rewrite, words_per_second (the video's own pace)."""
    def count(c: str) -> Column:
        return F.size(words_of(F.col(c)))

    x = candidates.withColumn("rewrite", F.trim(F.regexp_replace(F.trim("rewrite"), ECHO, "")))
    x = x.withColumns({"original_words": count("original"), "rewrite_words": count("rewrite")})
    n, k = F.col("original_words"), F.col("rewrite_words")
    most = F.greatest(F.lit(REWRITE_MIN_WORDS // 2), F.floor(n * REWRITE_MAX_RATIO).cast("int"))
    least = F.greatest(F.lit(1), F.floor(n * REWRITE_MIN_RATIO).cast("int"))
    source = _numbers(F.col("original"), SOURCE_NUMBER)
    bad = new_numbers(F.col("rewrite"), F.concat(source, F.transform(source, _core)))
    x = x.withColumns({"_most": most, "_least": least, "_bad": bad})
    script = F.abs(devanagari_share(F.col("rewrite")) - devanagari_share(F.col("original"))) > SCRIPT_TOLERANCE
    first = F.array_compact(F.array(
        F.when(k > F.col("_most"), F.format_string("not shorter enough (%d words, limit %d)", k, F.col("_most"))),
        F.when(k < F.col("_least"), F.format_string("cut too much (%d words, at least %d)", k, F.col("_least"))),
        F.when(F.size("_bad") > 0, F.concat(F.lit("added numbers not in the original: "), F.array_join("_bad", ", "))),
        F.when(script, F.lit("wrong script for the video's language")),
    ))
    x = x.withColumn("_first", first)
    sim = F.bround(cosine(hash_embed(tokens(F.col("original"))), hash_embed(tokens(F.col("rewrite")))), 3)
    x = x.withColumn("meaning_similarity", F.when((F.size("_first") == 0) & (n >= REWRITE_MIN_WORDS), sim))
    far = F.when(
        F.col("meaning_similarity") < MIN_SIMILARITY,
        F.concat(F.lit("meaning changed (similarity "), F.col("meaning_similarity").cast("string"), F.lit(f", needs {MIN_SIMILARITY})")))
    why = F.when(n < REWRITE_MIN_WORDS, F.array(F.lit("too little text to rewrite"))).otherwise(F.array_compact(F.concat("_first", F.array(far))))
    x = x.withColumn("rejected", why)
    ok = F.size("rejected") == 0
    return x.withColumns({
        "accepted": ok,
        "est_seconds_saved": F.when(ok & (F.col("words_per_second") > 0), F.bround((n - k) / F.col("words_per_second"), 1)),
    }).drop("_most", "_least", "_bad", "_first")


def report_rollup(flags: DataFrame, segs: DataFrame, scores: DataFrame, ledger: DataFrame, points: DataFrame) -> DataFrame:
    """One row per video: flags, high flags, broken promises, fillers, mean lanes, end retention."""
    base = segs.groupBy("video_id").agg(F.count(F.lit(1)).alias("segments"), F.sum("filler_count").alias("fillers"))
    f = flags.groupBy("video_id").agg(F.count(F.lit(1)).alias("flags"), F.count_if(F.col("severity") == "high").alias("high_flags"))
    lane = scores.groupBy("video_id").agg(*[F.avg(c).alias(c) for c in ("pacing", "content", "visual", "audio")])
    broken = ledger.where("status <> 'kept'").groupBy("video_id").agg(F.count(F.lit(1)).alias("broken_promises"))
    end = points.groupBy("video_id").agg(F.max_by(F.struct("retention", "lower", "upper"), "t").alias("e"))
    x = base
    for part in (f, lane, broken, end):
        x = x.join(part, "video_id", "left")
    return x.select(
        "video_id", "segments", "fillers",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("flags", "high_flags", "broken_promises")],
        "pacing", "content", "visual", "audio",
        F.col("e.retention").alias("end_retention"), F.col("e.lower").alias("end_lower"), F.col("e.upper").alias("end_upper"),
    )


def display_order(flags: DataFrame) -> DataFrame:
    """Adds ``place``: high severity first, then by time."""
    return flags.withColumn("place", F.row_number().over(_video().orderBy((F.col("severity") != "high").cast("int"), "start", "flag_id")))
