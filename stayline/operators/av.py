"""Audio and visual features over decoded samples, loudness frames, pitch frames and pictures."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stayline.functions.timeline import frames_of
from stayline.operators.semantic import cosine

# Fixed values
SILENCE_BELOW_P95_DB = 35.0
ENERGY_FLOOR = 1e-10
CLIP_LEVEL = 0.99
SMOOTH_FRAMES = 5
MIN_VOICED_S = 2.0
CUT_THRESHOLD = 0.12
CUT_VS_LOCAL = 3.0
LOCAL_WINDOW_S = 5.0
MIN_CUT_GAP_S = 1.0
STATIC_THRESHOLD = 0.012
TEMPERATURE = 100.0
MIN_CONFIDENCE = 0.35
MIN_RUN_S = 3.0


def frame_db(chunks: DataFrame, frame: int, hop: int) -> DataFrame:
    """(video_id, k, db): energy of every full frame of ``frame`` samples, one per ``hop``.

    ``chunks``: video_id, first (index of the first sample), samples ARRAY<FLOAT>. Each chunk is
    reduced in place to sums over blocks of gcd(frame, hop) samples; only block sums are shuffled,
    and a frame is a sliding sum of blocks."""
    g = gcd(frame, hop)
    blocks = F.expr(
        f"transform(sequence(first div {g}, (first + size(samples) - 1) div {g}), b -> transform(array("
        f"slice(samples, cast(greatest(b * {g} - first, 0) as int) + 1,"
        f" cast((b + 1) * {g} - greatest(b * {g}, first) as int))), x -> named_struct("
        "'b', b, 'n', size(x), 'sq', aggregate(x, 0D, (s, v) -> s + cast(v as double) * v)))[0])"
    )
    per = chunks.select("video_id", F.explode(blocks).alias("x")).groupBy("video_id", F.col("x.b").alias("b")).agg(
        F.sum("x.n").alias("n"), F.sum("x.sq").alias("sq")
    )
    ahead = W.partitionBy("video_id").orderBy("b").rangeBetween(0, frame // g - 1)
    full = per.withColumns({"_n": F.sum("n").over(ahead), "_sq": F.sum("sq").over(ahead)})
    return full.where((F.col("_n") == frame) & (F.col("b") % (hop // g) == 0)).select(
        "video_id", (F.col("b") / (hop // g)).cast("int").alias("k"),
        (10 * F.log10(F.col("_sq") / frame + ENERGY_FLOOR)).alias("db"),
    )


def loudness_stats(frames: DataFrame) -> DataFrame:
    """(video_id, threshold_db, voiced_median, snr_db) per video."""
    thr = frames.groupBy("video_id").agg(
        (F.percentile("db", F.lit(0.95)) - SILENCE_BELOW_P95_DB).alias("threshold_db"),
        F.percentile("db", F.lit(0.05)).alias("_p5"),
    )
    med = (
        frames.join(thr, "video_id").where("db >= threshold_db").groupBy("video_id")
        .agg(F.percentile("db", F.lit(0.5)).alias("voiced_median"))
    )
    return thr.join(med, "video_id", "left").select(
        "video_id", "threshold_db", F.coalesce("voiced_median", F.lit(0.0)).alias("voiced_median"),
        F.bround(F.col("voiced_median") - F.col("_p5"), 2).alias("snr_db"),
    )


def segment_audio(frames: DataFrame, segments: DataFrame, hop_s: float, frame_s: float = 0.025) -> DataFrame:
    """Silent share, loudness against the video's usual level, and its spread. A frame belongs to
    the segment that holds its centre."""

    def first(t: Column) -> Column:
        return F.ceil((t - frame_s / 2) / hop_s - 1e-9)

    ids = frames_of(segments, first(F.col("start")), first(F.col("end")))
    x = ids.join(frames, ["video_id", "k"]).join(loudness_stats(frames), "video_id")
    loud = F.when(F.col("db") >= F.col("threshold_db"), F.col("db"))
    return x.groupBy("video_id", "idx").agg(
        F.bround(1 - F.count(loud) / F.count(F.lit(1)), 4).alias("silence_ratio"),
        F.bround(F.avg(loud) - F.first("voiced_median"), 3).alias("energy_db"),
        F.bround(F.when(F.count(loud) > 1, F.stddev_pop(loud)), 3).alias("energy_variation_db"),
    )


def clipping_ratio(chunks: DataFrame, segments: DataFrame, rate: int, level: float = CLIP_LEVEL) -> DataFrame:
    """Share of full-scale samples per segment. Each chunk reports, per segment it touches,
    how many samples it has there and how many clip; the samples are never exploded."""
    cells = F.expr(
        "transform(idxs, s -> transform(array(slice(samples, cast(greatest(s.a - first, 0) as int) + 1,"
        " cast(least(s.b, first + size(samples)) - greatest(s.a, first) as int))), x -> named_struct('idx', s.idx, 'n', size(x),"
        f" 'hit', size(filter(x, v -> abs(v) >= cast({level} as float)))))[0])"
    )
    bounds = segments.groupBy("video_id").agg(
        F.array_sort(F.collect_list(F.struct("idx", F.floor(F.col("start") * rate).alias("a"), F.floor(F.col("end") * rate).alias("b")))).alias("segs")
    )
    x = chunks.join(bounds, "video_id").withColumn(
        "idxs", F.expr("filter(segs, s -> s.a < first + size(samples) and s.b > first)")
    )
    return x.select("video_id", F.explode(cells).alias("c")).groupBy("video_id", F.col("c.idx").alias("idx")).agg(
        F.bround(F.sum("c.hit") / F.nullif(F.sum("c.n"), F.lit(0)), 5).alias("clipping_ratio")
    )


def voiced_mask(pitch: DataFrame, frames: DataFrame, pitch_hop_s: float, hop_s: float) -> DataFrame:
    """Pitch frames with ``voiced``: a pitch was found and the loudness frame there is not silent."""
    last = frames.groupBy("video_id").agg(F.max("k").alias("_last"))
    at = F.least(F.floor(F.col("i") * pitch_hop_s / hop_s).cast("int"), F.col("_last"))
    loud = frames.join(loudness_stats(frames).select("video_id", "threshold_db"), "video_id").select(
        "video_id", F.col("k").alias("_k"), (F.col("db") >= F.col("threshold_db")).alias("_loud")
    )
    x = pitch.join(last, "video_id").withColumn("_k", at).join(loud, ["video_id", "_k"], "left")
    return x.withColumn("voiced", F.col("f0").isNotNull() & F.coalesce("_loud", F.lit(False))).drop("_k", "_last", "_loud")


def smooth_pitch(pitch: DataFrame, frames: int = SMOOTH_FRAMES) -> DataFrame:
    """``semitone`` against 100 Hz, median over the neighbouring frames that have a pitch."""
    near = W.partitionBy("video_id").orderBy("i").rowsBetween(-(frames // 2), frames // 2)
    x = pitch.withColumn("_st", 12 * F.log2(F.col("f0") / 100))
    return x.withColumn("semitone", F.when(F.col("_st").isNotNull(), F.percentile("_st", F.lit(0.5)).over(near))).drop("_st")


def segment_pitch(pitch: DataFrame, segments: DataFrame, hop_s: float, min_voiced_s: float = MIN_VOICED_S) -> DataFrame:
    """Pitch range per segment and its ratio to the video's usual range over speech.
    ``pitch`` carries semitone and voiced."""
    ids = frames_of(segments, F.ceil(F.col("start") / hop_s - 1e-9), F.ceil(F.col("end") / hop_s - 1e-9), "i")
    voiced = ids.join(pitch.where("voiced"), ["video_id", "i"])
    per = voiced.groupBy("video_id", "idx").agg(
        F.bround(F.count(F.lit(1)) * hop_s, 2).alias("_s"),
        (F.percentile("semitone", F.lit(0.9)) - F.percentile("semitone", F.lit(0.1))).alias("_range"),
    )
    x = segments.select("video_id", "idx", "kind").join(per, ["video_id", "idx"], "left")
    x = x.withColumn("pitch_range_st", F.when(F.col("_s") >= min_voiced_s, F.bround("_range", 3)))
    usual = F.percentile(F.when(F.col("kind") == "speech", F.col("pitch_range_st")), F.lit(0.5)).over(W.partitionBy("video_id"))
    return x.withColumn("_m", usual).select(
        "video_id", "idx", "pitch_range_st",
        F.bround(F.try_divide("pitch_range_st", F.nullif("_m", F.lit(0.0))), 3).alias("pitch_range_ratio"),
    )


def pitch_median_hz(pitch: DataFrame) -> DataFrame:
    return pitch.where("voiced").groupBy("video_id").agg(F.bround(F.percentile("f0", F.lit(0.5)), 1).alias("pitch_median_hz"))


def frame_diffs(pictures: DataFrame) -> DataFrame:
    """(video_id, i, diff): mean absolute change from the previous picture, 0..1; first is 0."""
    prev = F.lag("pixels").over(W.partitionBy("video_id").orderBy("i"))
    x = pictures.withColumn("_p", prev)
    change = F.aggregate(F.zip_with("pixels", "_p", lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda s, v: s + v)
    return x.select("video_id", "i", F.coalesce(change / F.size("pixels") / 255.0, F.lit(0.0)).alias("diff"))


def scene_cuts(
    diffs: DataFrame, fps: float, threshold: float = CUT_THRESHOLD, vs_local: float = CUT_VS_LOCAL,
    window_s: float = LOCAL_WINDOW_S, min_gap_s: float = MIN_CUT_GAP_S,
) -> DataFrame:
    """(video_id, cuts ARRAY<DOUBLE>): jumps that also stand out from the local median, spaced
    at least ``min_gap_s``. Only jump candidates are gathered per video."""
    half = max(1, round(window_s * fps / 2))
    order = W.partitionBy("video_id").orderBy("i")
    known = F.when(F.col("i") > 0, F.col("diff"))
    x = diffs.withColumn("_d", known)
    around = F.concat(
        F.collect_list("_d").over(order.rowsBetween(-half, -1)), F.collect_list("_d").over(order.rowsBetween(1, half))
    )
    x = x.withColumn("_near", F.array_sort(around)).withColumn("_m", F.size("_near"))
    median = F.expr("if(_m = 0, 0D, (_near[(_m - 1) div 2] + _near[_m div 2]) / 2)")
    jumps = x.where((F.col("i") > 0) & (F.col("diff") >= threshold) & (F.col("diff") >= vs_local * median))
    fold = F.expr(
        f"aggregate(array_sort(ts), cast(array() as array<double>), (acc, t) -> if(size(acc) > 0 and t - element_at(acc, -1) < {min_gap_s}D, acc, array_append(acc, t)))"
    )
    return jumps.groupBy("video_id").agg(F.collect_list(F.bround(F.col("i") / fps, 3)).alias("ts")).select("video_id", fold.alias("cuts"))


def segment_visual(diffs: DataFrame, cuts: DataFrame, segments: DataFrame, fps: float, static: float = STATIC_THRESHOLD) -> DataFrame:
    """Cuts, change, static share, longest static stretch and time since the last cut."""
    ids = frames_of(segments, F.ceil(F.col("start") * fps - 1e-9), F.ceil(F.col("end") * fps - 1e-9), "i")
    x = ids.join(diffs.where("i > 0"), ["video_id", "i"]).withColumn("_s", F.col("diff") < static)
    order = W.partitionBy("video_id", "idx").orderBy("i")
    x = x.withColumn("_run", F.sum(F.when(F.col("_s"), 0).otherwise(1)).over(order))
    runs = x.groupBy("video_id", "idx", "_run").agg(
        F.count_if("_s").alias("_len"), F.count(F.lit(1)).alias("_n"), F.sum("diff").alias("_d")
    )
    per = runs.groupBy("video_id", "idx").agg(
        (F.sum("_d") / F.sum("_n")).alias("_mean"), (F.sum("_len") / F.sum("_n")).alias("_static"), F.max("_len").alias("_longest")
    )
    y = per.join(segments.select("video_id", "idx", "start", "end"), ["video_id", "idx"]).join(cuts, "video_id", "left")
    y = y.withColumn("_cuts", F.coalesce("cuts", F.array().cast("array<double>")))
    inside = F.size(F.filter("_cuts", lambda c: (c >= F.col("start")) & (c < F.col("end"))))
    last = F.coalesce(F.array_max(F.filter("_cuts", lambda c: c < F.col("end"))), F.lit(0.0))
    return y.select(
        "video_id", "idx", inside.alias("scene_cut_count"),
        F.bround(inside * 60 / F.greatest(F.col("end") - F.col("start"), F.lit(1e-6)), 4).alias("cuts_per_minute"),
        F.bround("_mean", 5).alias("visual_change_mean"), F.bround("_static", 4).alias("static_ratio"),
        F.bround(F.col("_longest") / fps, 3).alias("longest_static_s"),
        F.bround(F.col("end") - last, 3).alias("seconds_since_cut"),
    )


def type_vectors(prompts: DataFrame) -> list[tuple[str, list[float]]]:
    """Mean prompt vector per content type, re-normalised: one small row per configured type."""
    mean = prompts.select("key", F.posexplode("emb").alias("d", "x")).groupBy("key", "d").agg(F.avg("x").alias("x"))
    rows = mean.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v")).orderBy("key").collect()
    out = []
    for row in rows:
        v = [e["x"] for e in row["v"]]
        size = sum(x * x for x in v) ** 0.5 + 1e-12
        out.append((row["key"], [x / size for x in v]))
    return out


def classify_frames(
    pictures: DataFrame, types: list[tuple[str, list[float]]], temperature: float = TEMPERATURE, min_conf: float = MIN_CONFIDENCE
) -> DataFrame:
    """Adds ``label`` and ``confidence``: softmax over the similarities to the type vectors."""
    def vector(v: list[float]) -> Column:
        return F.array(*[F.lit(float(x)) for x in v])

    logits = F.array(*[temperature * cosine("emb", vector(v)) for _, v in types])
    x = pictures.withColumn("_z", logits).withColumn("_top", F.array_max("_z"))
    total = F.aggregate(F.transform("_z", lambda z: F.exp(z - F.col("_top"))), F.lit(0.0), lambda s, v: s + v)
    names = F.array(*[F.lit(k) for k, _ in types])
    best = F.get(names, (F.array_position("_z", F.col("_top")) - 1).cast("int"))
    x = x.withColumn("confidence", 1 / total)
    return x.withColumn("label", F.when(F.col("confidence") >= min_conf, best).otherwise("unclear")).drop("_z", "_top")


def label_islands(labels: DataFrame, fps: float) -> DataFrame:
    """(video_id, start, end, label): stretches of equal labels."""
    order = W.partitionBy("video_id").orderBy("i")
    new = F.when(F.coalesce(F.lag("label").over(order) != F.col("label"), F.lit(True)), 1).otherwise(0)
    x = labels.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return x.groupBy("video_id", "_run", "label").agg(
        (F.min("i") / fps).alias("start"), ((F.max("i") + 1) / fps).alias("end")
    ).drop("_run")


def label_runs(labels: DataFrame, fps: float, min_run_s: float = MIN_RUN_S) -> DataFrame:
    """Stretches with the short ones merged into the one before; a short first one merges
    forward. The merge depends on what was kept so far: an ordered fold per video."""
    runs = label_islands(labels, fps).groupBy("video_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("rs")
    )
    grow = (
        "aggregate(rs, cast(array() as array<struct<start:double,end:double,label:string>>), (acc, r) -> "
        f"if(size(acc) > 0 and (r.end - r.start < {min_run_s}D or r.label = element_at(acc, -1).label),"
        " array_append(slice(acc, 1, size(acc) - 1), named_struct('start', element_at(acc, -1).start, 'end', r.end, 'label', element_at(acc, -1).label)),"
        " array_append(acc, r)))"
    )
    forward = (
        f"if(size(m) > 1 and m[0].end - m[0].start < {min_run_s}D,"
        " concat(array(named_struct('start', 0D, 'end', m[1].end, 'label', m[1].label)), slice(m, 3, size(m))), m)"
    )
    out = runs.withColumn("m", F.expr(grow)).select("video_id", F.explode(F.expr(forward)).alias("r"))
    return out.select("video_id", F.bround("r.start", 2).alias("start"), F.bround("r.end", 2).alias("end"), F.col("r.label").alias("label"))


def segment_content(pictures: DataFrame, segments: DataFrame, fps: float) -> DataFrame:
    """Most common label (alphabetical on ties), its share, mean picture-text match and the ratio
    to the video's median match. ``segments`` may carry ``speech_emb`` (NULL: no text)."""
    ids = frames_of(segments, F.ceil(F.col("start") * fps - 1e-9), F.ceil(F.col("end") * fps - 1e-9), "i")
    x = ids.join(pictures, ["video_id", "i"]).join(segments.select("video_id", "idx", "speech_emb"), ["video_id", "idx"])
    per = x.groupBy("video_id", "idx", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(cosine("emb", "speech_emb")).alias("dot")
    )
    order = F.row_number().over(W.partitionBy("video_id", "idx").orderBy(F.desc("n"), "label"))
    top = per.withColumn("_r", order).groupBy("video_id", "idx").agg(
        F.max(F.when(F.col("_r") == 1, F.col("label"))).alias("visual_type"),
        F.bround(F.max("n") / F.sum("n"), 3).alias("visual_type_share"),
        F.bround(F.sum("dot") / F.sum("n"), 4).alias("speech_match"),
    )
    usual = F.percentile("speech_match", F.lit(0.5)).over(W.partitionBy("video_id"))
    return top.withColumn("_m", usual).withColumn(
        "speech_match_ratio", F.bround(F.try_divide("speech_match", F.nullif("_m", F.lit(0.0))), 3)
    ).drop("_m")
