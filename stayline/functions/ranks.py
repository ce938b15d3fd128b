"""Exact corpus-wide ranks, quantiles and running totals that never use a single-task window.

Equal values are counted first (map-side combine), distinct values are cut into value buckets at
approximate quantiles, running totals are taken inside each bucket, and the bucket totals (at most
``buckets`` rows per group) are carried over with a join. A value that holds a third of all rows is
one row after the first step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: fewest value buckets; a session with more shuffle partitions gets as many as these
LEAST_BUCKETS = 64


def _cut_points(df: DataFrame, value: str, buckets: int) -> list[float]:
    """At most ``buckets`` numbers; they only balance the work, results never depend on them."""
    shares = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(F.col(value), shares, max(1000, 10 * buckets)).alias("cuts")).first()
    return sorted(set(row["cuts"] or []))


def cumulative(
    df: DataFrame,
    value: str,
    measures: dict[str, Column],
    by: tuple[str, ...] = (),
    buckets: int | None = None,
) -> DataFrame:
    """One row per distinct (by, value): each measure's sum, its sum over smaller values
    (``<m>_below``) and its group total (``<m>_total``)."""
    if buckets is None:
        buckets = max(LEAST_BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = _cut_points(df, value, buckets)
    counts = df.groupBy(*by, value).agg(*[F.sum(c).alias(m) for m, c in measures.items()])
    bucket = F.lit(0)
    if cuts:
        points = F.array(*[F.lit(float(c)) for c in cuts])
        bucket = F.size(F.filter(points, lambda c: c <= F.col(value)))
    counts = counts.withColumn("_bucket", bucket)
    inside = W.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    local = counts.select(
        "*", *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"_{m}_in") for m in measures]
    )
    totals = counts.groupBy(*by, "_bucket").agg(*[F.sum(m).alias(f"_{m}_b") for m in measures])
    # at most `buckets` rows per group from here on
    whole = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    before = whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        *by,
        "_bucket",
        *[F.coalesce(F.sum(f"_{m}_b").over(before), F.lit(0)).alias(f"_{m}_c") for m in measures],
        *[F.sum(f"_{m}_b").over(whole).alias(f"{m}_total") for m in measures],
    )
    return local.join(carried, [*by, "_bucket"]).select(
        *by,
        value,
        *measures,
        *[(F.col(f"_{m}_c") + F.col(f"_{m}_in")).alias(f"{m}_below") for m in measures],
        *[f"{m}_total" for m in measures],
    )


def average_ranks(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, value, rank): 1-based rank, ties share their mean."""
    table = cumulative(df, value, {"n": F.lit(1)}, by)
    return table.select(*by, value, (F.col("n_below") + (F.col("n") + 1) / 2).alias("rank"))


def quantiles(
    df: DataFrame, value: str, shares: list[float], by: tuple[str, ...] = ()
) -> DataFrame:
    """(by, q, quantile): exact, linearly interpolated between neighbouring order statistics."""
    table = cumulative(df.where(F.col(value).isNotNull()), value, {"n": F.lit(1)}, by)
    asked = table.withColumn("q", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    pos = F.col("q") * (F.col("n_total") - 1)
    asked = asked.withColumn("_lo", F.floor(pos)).withColumn("_hi", F.ceil(pos))
    first, last = F.col("n_below"), F.col("n_below") + F.col("n") - 1
    hit_lo = F.col("_lo").between(first, last)
    hit_hi = F.col("_hi").between(first, last)
    picked = asked.where(hit_lo | hit_hi).groupBy(*by, "q").agg(
        F.max(F.when(hit_lo, F.col(value))).alias("_a"),
        F.max(F.when(hit_hi, F.col(value))).alias("_b"),
        F.max(pos - F.floor(pos)).alias("_f"),
    )
    return picked.select(*by, "q", F.expr("_a + (_b - _a) * _f").alias("quantile"))
