"""Interval helpers shared by the operators: islands, merging, overlap tests, clock text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def islands(df: DataFrame, keys: list[str], extra: list[Column] = ()) -> DataFrame:
    """Merge touching or overlapping [s, e] rows of one key. Streams in start order."""
    order = W.partitionBy(*keys).orderBy("s", "e")
    seen = order.rowsBetween(W.unboundedPreceding, -1)
    return (
        df.withColumn("_reach", F.max("e").over(seen))
        .withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("s") > F.col("_reach")), 1).otherwise(0))
        .withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*keys, "_island")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"), *extra)
        .drop("_island")
    )


def merge_spans(df: DataFrame, keys: list[str], chunk_s: float, extra: list[Column] = ()) -> DataFrame:
    """Union of intervals per key in two steps. Merging is associative, so each key is first
    merged inside start-time chunks, which spreads a hot key over many tasks; the second step
    only sees the surviving islands."""
    chunked = df.withColumn("_chunk", F.floor(F.col("s") / F.lit(float(chunk_s))))
    return islands(islands(chunked, [*keys, "_chunk"], extra).drop("_chunk"), keys, extra)


def flag_runs(df: DataFrame, keys: list[str], order: str, cond: Column) -> DataFrame:
    """Rows where ``cond`` holds, numbered by run of consecutive rows (``run``) inside each key."""
    w = W.partitionBy(*keys).orderBy(order)
    hit = F.coalesce(cond, F.lit(False))
    return (
        df.withColumn("_hit", hit)
        .withColumn("_start", F.when(F.col("_hit") & ~F.coalesce(F.lag("_hit").over(w), F.lit(False)), 1).otherwise(0))
        .withColumn("run", F.sum("_start").over(w.rowsBetween(W.unboundedPreceding, 0)))
        .where("_hit")
        .drop("_hit", "_start")
    )


def mmss(seconds: Column) -> Column:
    """Seconds as MM:SS text, half-even rounding, negatives shown as 00:00."""
    t = F.greatest(F.lit(0), F.bround(seconds).cast("long"))
    return F.when(seconds.isNotNull(), F.format_string("%02d:%02d", F.floor(t / 60).cast("long"), t % 60))


def frames_of(segments: DataFrame, first: Column, past: Column, name: str = "k") -> DataFrame:
    """(video_id, idx, k): the frame numbers [first, past) of every segment, for an equi-join
    with the frames. Segments do not overlap, so this is at most one row per frame."""
    lo, hi = F.greatest(F.lit(0), first.cast("int")), past.cast("int") - 1
    return segments.select("video_id", "idx", F.explode(F.when(hi >= lo, F.sequence(lo, hi))).alias(name))


def overlap_join(left: DataFrame, right: DataFrame, tol: float = 0.0, bucket_s: float = 60.0, closed: bool = True) -> DataFrame:
    """Pairs of rows of one video whose [start, end] lie within ``tol`` of each other.

    Both sides are placed in the time buckets they touch and joined on (video_id, bucket), so the
    work grows with neighbouring rows, not with pairs per video; a pair is kept only in the first
    bucket both sides share. Left columns keep their names, right ones get the suffix ``_r``.
    ``closed=False`` asks for a true overlap (touching does not count)."""

    def buckets(a: Column, b: Column) -> Column:
        lo, hi = F.floor(a / bucket_s), F.floor(b / bucket_s)
        return F.sequence(lo, F.greatest(lo, hi))

    lf = left.withColumn("_bs", buckets(F.col("start") - tol, F.col("end") + tol)).withColumn("_b", F.explode("_bs"))
    r = right.select(*[F.col(c).alias(c if c == "video_id" else f"{c}_r") for c in right.columns])
    r = r.withColumn("_br", buckets(F.col("start_r"), F.col("end_r"))).withColumn("_b", F.explode("_br"))
    x = lf.join(r, ["video_id", "_b"]).where(F.col("_b") == F.greatest(F.col("_bs")[0], F.col("_br")[0]))
    if closed:
        near = (F.col("start") - tol <= F.col("end_r")) & (F.col("start_r") <= F.col("end") + tol)
    else:
        near = (F.col("start") < F.col("end_r") + tol) & (F.col("start_r") < F.col("end") + tol)
    return x.where(near).drop("_b", "_bs", "_br")
