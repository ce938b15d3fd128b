"""Watch intervals -> per-second retention -> segment drop rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stayline.functions.timeline import merge_spans

ENTRY = ["viewer_id", "entry", "video_id"]
CHUNK_S = 60.0  # start-time chunk that spreads one hot log entry over tasks


def _entry(df: DataFrame) -> DataFrame:
    return df if "entry" in df.columns else df.withColumn("entry", F.lit(0))


def merge_intervals(watch: DataFrame, chunk_s: float = CHUNK_S) -> DataFrame:
    """Per log entry: reversed points normalised, touching or overlapping intervals merged.
    ``first_raw`` keeps the smallest logged start of the entry's part for the starter test."""
    spans = _entry(watch).select(
        *ENTRY,
        F.least("start_point", "end_point").alias("s"),
        F.greatest("start_point", "end_point").alias("e"),
        F.col("start_point").alias("first_raw"),
    )
    merged = merge_spans(spans, ENTRY, chunk_s, [F.min("first_raw").alias("first_raw")])
    return merged.select(*ENTRY, F.col("s").alias("start"), F.col("e").alias("end"), "first_raw")


def anchor_start(merged: DataFrame, tol: float) -> DataFrame:
    """A viewer whose first watched point is within ``tol`` started at 0."""
    first = F.row_number().over(W.partitionBy(*ENTRY).orderBy("start")) == 1
    return merged.withColumn("_first", first).withColumn(
        "start", F.when(F.col("_first") & (F.col("start") <= tol), 0.0).otherwise(F.col("start"))
    ).drop("_first")


def viewer_counts(watch: DataFrame, tol: float) -> DataFrame:
    """Viewers and starters per video, one count per log entry."""
    per = _entry(watch).groupBy(*ENTRY).agg(F.min("start_point").alias("first"))
    return per.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n_viewers"), F.count_if(F.col("first") <= tol).alias("n_starters")
    )


def qualify_topk(
    lectures: DataFrame, min_starters: int, min_s: float, max_s: float, min_lines: int, k: int
) -> DataFrame:
    """The k most-watched lectures that pass the size limits (ties by id)."""
    ok = (
        (F.col("n_starters") >= min_starters)
        & F.col("duration_s").between(min_s, max_s)
        & (F.col("lines") >= min_lines)
    )
    return lectures.where(ok).orderBy(F.desc("n_starters"), "video_id").limit(k)


def coverage_diff(watch: DataFrame, lectures: DataFrame, tol: float) -> DataFrame:
    """(video, t, delta): +1 where a starter's interval begins, -1 after it ends. Two rows per
    merged interval, summed map-side before lectures are joined, so a popular video shuffles and
    joins at most one row per second."""
    spans = anchor_start(merge_intervals(watch), tol)
    started = F.min("first_raw").over(W.partitionBy(*ENTRY)) <= tol
    spans = spans.withColumn("_st", started).where("_st")
    size = lectures.select("video_id", F.ceil("duration_s").cast("int").alias("n"))
    spans = spans.select(
        "video_id",
        F.greatest(F.lit(0), F.floor("start").cast("int")).alias("a"),
        F.ceil("end").cast("int").alias("b"),
    )
    steps = F.explode(F.expr("array(struct(a as t, 1L as d), struct(b as t, -1L as d))"))
    sums = (
        spans.where("b > a").select("video_id", steps.alias("x"))
        .groupBy("video_id", F.col("x.t").alias("t")).agg(F.sum("x.d").alias("delta"))
    )
    # what lies past the end meets at the end; intervals wholly past it cancel out there
    return (
        sums.join(size, "video_id").groupBy("video_id", "n", F.least("t", "n").alias("t"))
        .agg(F.sum("delta").alias("delta")).where("t < n OR delta <> 0").select("video_id", "t", "delta")
    )


def retention_curve(deltas: DataFrame, lectures: DataFrame) -> DataFrame:
    """(video, t, watching, retention) for every second; a window holds at most one video's seconds."""
    grid = lectures.select(
        "video_id",
        F.greatest("n_starters", F.lit(1)).alias("_base"),
        F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("duration_s").cast("int") - 1, F.lit(0)))).alias("t"),
    )
    w = W.partitionBy("video_id").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    return (
        grid.join(deltas, ["video_id", "t"], "left")
        .withColumn("watching", F.sum(F.coalesce("delta", F.lit(0))).over(w))
        .select("video_id", "t", "watching", (F.col("watching") / F.col("_base")).alias("retention"))
    )


def hash_split(video_id: Column, fraction: float) -> Column:
    """Stable test/train label from the first 32 bits of SHA-256 of the id."""
    h = F.conv(F.substring(F.sha2(video_id.cast("string"), 256), 1, 8), 16, 10).cast("long")
    return F.when(h % 10000 < fraction * 10000, "test").otherwise("train")


def curve_arrays(curve: DataFrame) -> DataFrame:
    """One row per video with its retention as an array (bounded by the longest video in seconds)."""
    return curve.groupBy("video_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("t", "retention"))), lambda x: x["retention"]).alias("r")
    )


def _ends(segments: DataFrame, curve: DataFrame) -> DataFrame:
    return segments.join(curve_arrays(curve), "video_id").withColumns(
        {
            "_r0": F.expr("get(r, least(size(r) - 1, cast(start as int)))"),
            "_r1": F.expr("get(r, least(size(r) - 1, greatest(0, cast(ceil(end) as int) - 1)))"),
        }
    ).drop("r")


def segment_hazard(segments: DataFrame, curve: DataFrame) -> DataFrame:
    """Adds ``hazard`` (share of the segment's viewers lost, clipped), ``actual_r`` (retention in
    the segment's last second) and ``signed_rate`` (per-second log loss, re-watching kept)."""
    x = _ends(segments, curve)
    return x.withColumns(
        {
            "hazard": F.expr("if(_r0 <= 0, 0D, greatest(0D, least(1D, 1 - try_divide(_r1, _r0))))"),
            "actual_r": F.col("_r1"),
            "signed_rate": F.expr(
                "ln(greatest(_r0, 1e-3D) / greatest(_r1, 1e-3D)) / greatest(end - start, 1e-3D)"
            ),
        }
    ).drop("_r0", "_r1")


def hazard_to_rate(hazard: Column, duration: Column) -> Column:
    h = F.greatest(F.lit(0.0), F.least(F.lit(0.999), hazard))
    return -F.log1p(-h) / F.greatest(duration, F.lit(1e-3))


def rate_to_hazard(rate: Column, duration: Column) -> Column:
    return 1 - F.exp(-F.greatest(rate, F.lit(0.0)) * F.greatest(duration, F.lit(0.0)))


def curve_from_hazard(df: DataFrame, hazard: str = "hazard", out: str = "retention") -> DataFrame:
    """Running product of the kept share, in segment order."""
    w = W.partitionBy("video_id").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    kept = 1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(hazard)))
    return df.withColumn(out, F.product(kept).over(w))


def fixed_tiles(lectures: DataFrame, width: float = 12.0) -> DataFrame:
    """Equal tiles over [0, duration] per video."""
    n = F.greatest(F.ceil(F.col("duration_s") / width).cast("int"), F.lit(1))
    return lectures.select(
        "video_id", "duration_s", F.explode(F.sequence(F.lit(0), n - 1)).alias("idx")
    ).select(
        "video_id",
        "idx",
        "duration_s",
        (F.col("idx") * width).alias("start"),
        F.least((F.col("idx") + 1) * width, F.col("duration_s")).alias("end"),
    )
