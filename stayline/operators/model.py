"""Fitting, scoring and validating the retention model. One small aggregate per step; corpus-wide
ranks and quantiles come from ``functions.ranks`` and never sit in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stayline.functions import ranks
from stayline.functions.timeline import overlap_join
from stayline.operators import boost
from stayline.operators.watch import curve_from_hazard, hazard_to_rate, rate_to_hazard

# Fixed values
FEATURES = [
    "rel_start", "rel_end", "log_start_s", "is_first", "is_silence", "pace_ratio", "semantic_novelty",
    "information_gain", "repetition_similarity", "repeated_sentence_ratio", "repetition_count", "topic_shift",
    "topic_boundary", "novelty_prev3_mean", "gain_prev3_mean", "s_since_topic_start",
]
GROUPS = {
    "position": ["rel_start", "rel_end", "log_start_s", "is_first"],
    "pacing": ["pace_ratio", "is_silence"],
    "novelty": ["semantic_novelty", "information_gain", "novelty_prev3_mean", "gain_prev3_mean"],
    "repetition": ["repetition_similarity", "repeated_sentence_ratio", "repetition_count"],
    "topics": ["topic_shift", "topic_boundary", "s_since_topic_start"],
}
DIRECTION = {
    "repetition_similarity": 1, "repeated_sentence_ratio": 1, "repetition_count": 1, "semantic_novelty": -1,
    "information_gain": -1, "novelty_prev3_mean": -1, "gain_prev3_mean": -1, "pace_ratio": -1,
}
MAX_ITER, STEP, MAX_LEAVES, MIN_LEAF, L2 = 300, 0.05, 15, 40, 1.0
BAND_QUANTILES, BAND_BINS, POSITION_BINS = (0.1, 0.9), 10, 20
MAJOR_DROP, TOLERANCE_S = 0.05, 10.0
HIGH_Q, MEDIUM_Q = 0.90, 0.75


def position_bin(rel: Column, bins: int) -> Column:
    return F.least(F.lit(bins - 1), F.floor(rel * bins).cast("int"))


def _all_bins(df: DataFrame, bins: int) -> DataFrame:
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))


# ---------------------------------------------------------------- baseline and calibration


def position_baseline(train: DataFrame) -> DataFrame:
    """(bin, rate): mean per-second rate by relative position; bin -1 is the first segment,
    empty bins take the overall mean of the others."""
    rate = hazard_to_rate(F.col("hazard"), F.col("end") - F.col("start"))
    x = train.select(
        F.when(F.col("idx") == 0, -1).otherwise(position_bin(F.col("rel_start"), POSITION_BINS)).alias("bin"), rate.alias("rate")
    )
    per = x.groupBy("bin").agg(F.sum("rate").alias("s"), F.count(F.lit(1)).alias("n"))
    bins = _all_bins(train, POSITION_BINS).unionByName(train.sparkSession.range(1).select(F.lit(-1).alias("bin")))
    rest = F.when(F.col("bin") >= 0, F.col("s")), F.when(F.col("bin") >= 0, F.col("n"))
    whole = W.partitionBy(F.lit(0))  # one row per bin
    joined = bins.join(per, "bin", "left")
    overall = F.sum(rest[0]).over(whole) / F.sum(rest[1]).over(whole)
    return joined.select("bin", F.coalesce(F.col("s") / F.col("n"), overall).alias("rate"))


def baseline_predict(tiles: DataFrame, table: DataFrame) -> DataFrame:
    """Adds ``rate`` and ``p`` (segment drop probability) from the position table (21 rows)."""
    key = F.when(F.col("idx") == 0, -1).otherwise(position_bin(F.col("rel_start"), POSITION_BINS))
    x = tiles.withColumn("bin", key).join(F.broadcast(table), "bin", "left").drop("bin")
    return x.withColumn("p", rate_to_hazard(F.col("rate"), F.col("end") - F.col("start")))


def calibrate_k(train: DataFrame) -> DataFrame:
    """(k, mse): the exponent 0.1..2.0 that brings the predicted curve closest to the actual one.
    ``train`` carries p and actual_r. 191 groups, combined before the shuffle."""
    x = curve_from_hazard(train, "p", "raw").select("raw", "actual_r")
    grid = F.expr("transform(sequence(0, 190), i -> 0.1D + i * 0.01D)")
    off = x.select("actual_r", "raw", F.explode(grid).alias("k")).select("k", (F.pow("raw", "k") - F.col("actual_r")).alias("d"))
    per = off.groupBy("k").agg(F.avg(F.col("d") * F.col("d")).alias("mse"))
    return per.agg(F.min_by("k", F.struct("mse", "k")).alias("k"), F.min("mse").alias("mse"))


def calibrated_curve(tiles: DataFrame, k: float, duration: Column | None = None) -> DataFrame:
    """Adds ``r``: monotone calibrated retention at each segment end, from ``rate``."""
    length = F.col("end") - F.col("start") if duration is None else duration
    x = curve_from_hazard(tiles.withColumn("_h", rate_to_hazard(F.col("rate"), length)), "_h", "_raw")
    order = W.partitionBy("video_id").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.pow("_raw", F.lit(float(k)))))
    return x.withColumn("_c", clipped).withColumn("r", F.min("_c").over(order)).drop("_h", "_raw", "_c")


def band_offsets(train: DataFrame) -> DataFrame:
    """(bin, lo, hi): quantiles of actual - calibrated retention by position; empty bins get 0.
    ``train`` carries r and actual_r."""
    x = train.select(position_bin(F.col("rel_end"), BAND_BINS).alias("bin"), (F.col("actual_r") - F.col("r")).alias("d"))
    q = ranks.quantiles(x, "d", list(BAND_QUANTILES), ("bin",)).groupBy("bin").agg(
        F.min(F.when(F.col("q") == BAND_QUANTILES[0], F.col("quantile"))).alias("lo"),
        F.max(F.when(F.col("q") == BAND_QUANTILES[1], F.col("quantile"))).alias("hi"),
    )
    return _all_bins(train, BAND_BINS).join(q, "bin", "left").select(
        "bin", F.coalesce("lo", F.lit(0.0)).alias("lo"), F.coalesce("hi", F.lit(0.0)).alias("hi")
    )


def with_band(tiles: DataFrame, band: DataFrame) -> DataFrame:
    """Adds lo / hi offsets by relative end (10 rows are broadcast)."""
    x = tiles.withColumn("bin", position_bin(F.col("rel_end"), BAND_BINS))
    return x.join(F.broadcast(band), "bin", "left").drop("bin")


def drop_rate_by_position(train: DataFrame) -> DataFrame:
    """(bin, base): how often a non-first segment at this position is a major drop, floor 1e-3."""
    x = train.where("idx > 0").groupBy(position_bin(F.col("rel_start"), POSITION_BINS).alias("bin")).agg(
        F.avg((F.col("hazard") >= MAJOR_DROP).cast("double")).alias("b")
    )
    return _all_bins(train, POSITION_BINS).join(x, "bin", "left").select(
        "bin", F.greatest(F.coalesce("b", F.lit(0.0)), F.lit(1e-3)).alias("base")
    )


def risk_levels(tiles: DataFrame, base: DataFrame) -> DataFrame:
    """Adds ``ratio`` (score against the usual rate here) and ``risk``; the two cuts are quantiles
    over the non-first training segments. ``tiles`` carries score and split."""
    x = tiles.withColumn("bin", position_bin(F.col("rel_start"), POSITION_BINS)).join(F.broadcast(base), "bin").drop("bin")
    x = x.withColumn("ratio", F.col("score") / F.col("base"))
    cuts = {r["q"]: r["quantile"] for r in ranks.quantiles(x.where("idx > 0 and split = 'train'"), "ratio", [HIGH_Q, MEDIUM_Q]).collect()}
    level = F.when(F.col("ratio") >= cuts[HIGH_Q], "high").when(F.col("ratio") >= cuts[MEDIUM_Q], "medium").otherwise("low")
    return x.withColumn("risk", level).drop("base")


# ---------------------------------------------------------------- curve


def _clip(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def predict_curve(curve: DataFrame) -> DataFrame:
    """Per segment: retention with its band at the end, and the drop it implies with a range.
    The lowest drop comes from the upper curve and the other way round. ``curve`` has r, lo, hi."""
    order = W.partitionBy("video_id").orderBy("idx")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    x = curve.withColumn("_l", F.min(_clip(F.col("r") + F.col("lo"))).over(upto)).withColumn("_h", _clip(F.col("r") + F.col("hi")))

    def implied(c: str) -> Column:
        prev = F.coalesce(F.lag(c).over(order), F.lit(1.0))
        return _clip(1 - F.col(c) / F.greatest(prev, F.lit(1e-9)))

    x = x.withColumns({"_p": implied("r"), "_pl": implied("_h"), "_ph": implied("_l")})
    return x.select(
        "video_id", "idx", F.col("end").alias("t"),
        F.bround("r", 4).alias("retention"),
        F.bround(F.least("_l", "r"), 4).alias("lower"),
        F.bround(F.greatest("_h", "r"), 4).alias("upper"),
        F.bround("_p", 4).alias("p_drop"),
        F.bround(F.least("_pl", "_p"), 4).alias("p_drop_low"),
        F.bround(F.greatest("_ph", "_p"), 4).alias("p_drop_high"),
    )


def curve_points(predicted: DataFrame) -> DataFrame:
    """(video_id, t, retention, lower, upper) with the starting point (0, 1, 1, 1)."""
    start = predicted.select("video_id").distinct().select(
        "video_id", F.lit(0.0).alias("t"), F.lit(1.0).alias("retention"), F.lit(1.0).alias("lower"), F.lit(1.0).alias("upper")
    )
    return start.unionByName(predicted.select("video_id", "t", "retention", "lower", "upper"))


# ---------------------------------------------------------------- metrics


def _corr(a: str, b: str) -> Column:
    """Correlation, NULL without spread in a column (Spark's own then divides by zero)."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``rho``: correlation of average ranks. Equal pairs are counted before ranks are
    attached, so a value shared by many rows is joined once."""
    pairs = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    ra = ranks.average_ranks(df, a).withColumnRenamed("rank", "_ra")
    rb = ranks.average_ranks(df, b).withColumnRenamed("rank", "_rb")
    x = pairs.join(ra, a).join(rb, b)
    size = df.count()
    mid = (size + 1) / 2
    x = x.select("n", (F.col("_ra") - mid).alias("x"), (F.col("_rb") - mid).alias("y"))
    return x.agg(
        F.try_divide(F.sum(F.expr("n * x * y")), F.sqrt(F.sum(F.expr("n * x * x")) * F.sum(F.expr("n * y * y")))).alias("rho")
    )


def within_video_spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``rho``: mean over videos with more than two rows and spread in both columns."""
    whole = W.partitionBy("video_id")

    def rank(c: str) -> Column:
        return F.rank().over(whole.orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy("video_id", c)) - 1) / 2

    x = df.select("video_id", rank(a).alias("x"), rank(b).alias("y"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    per = x.groupBy("video_id").agg(
        _corr("x", "y").alias("rho"), F.count(F.lit(1)).alias("n"), F.stddev_pop("_a").alias("sa"), F.stddev_pop("_b").alias("sb")
    )
    return per.where("n > 2 and sa > 0 and sb > 0").agg(F.avg("rho").alias("rho"))


def curve_metrics(tiles: DataFrame, pred: str = "p") -> DataFrame:
    """One row: mae, rmse, pearson, spearman of the curve; hazard rank correlation pooled and
    within videos (first segments excluded)."""
    x = curve_from_hazard(tiles, pred, "_c").select("video_id", "idx", "actual_r", "hazard", pred, "_c")
    x = x.withColumns({"_c": F.round("_c", 12), "_a": F.round("actual_r", 12), "_h": F.round("hazard", 12), "_p": F.round(pred, 12)})
    err = F.col("_c") - F.col("_a")
    base = x.agg(
        F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), _corr("_a", "_c").alias("pearson")
    )
    later = x.where("idx > 0")
    parts = [
        base,
        spearman(x, "_a", "_c").withColumnRenamed("rho", "spearman"),
        spearman(later, "_h", "_p").withColumnRenamed("rho", "hazard_spearman_pooled"),
        within_video_spearman(later, "_h", "_p").withColumnRenamed("rho", "hazard_spearman_within"),
    ]
    one_row = reduce(lambda a, b: a.join(b, "_k"), [p.withColumn("_k", F.lit(1)) for p in parts])
    return one_row.drop("_k")


def detection_curve(tiles: DataFrame, score: str, thresholds: list[float], major: float = MAJOR_DROP, tol: float = TOLERANCE_S) -> DataFrame:
    """(threshold, detected, total, hits, predicted, precision, recall, f1) for every threshold at
    once. An actual drop is found at a threshold iff the best score near it reaches it, so one
    neighbour join and counts per threshold step serve all thresholds."""
    cuts = F.array(*[F.lit(float(t)) for t in sorted(thresholds)])

    def steps(c: Column) -> Column:
        return F.size(F.filter(cuts, lambda t: t <= c))

    later = tiles.where("idx > 0")
    cols = later.select("video_id", "idx", "start", "end", F.col(score).alias("score"))
    actual = later.where(F.col("hazard") >= major).select("video_id", "idx", "start", "end")
    near = overlap_join(actual, cols, tol)
    found = near.groupBy("video_id", "idx").agg(F.max("score_r").alias("best"))
    hit = near.select("video_id", F.col("idx_r").alias("idx"), F.lit(True).alias("_near")).distinct()
    pred = cols.join(hit, ["video_id", "idx"], "left")
    by_pred = pred.groupBy(steps(F.col("score")).alias("s")).agg(F.count(F.lit(1)).alias("predicted"), F.count("_near").alias("hits"))
    by_act = found.groupBy(steps(F.col("best")).alias("s")).agg(F.count(F.lit(1)).alias("detected"))
    total = actual.groupBy(F.lit(-1).alias("s")).agg(F.count(F.lit(1)).alias("total"))
    counts = by_pred.unionByName(by_act, allowMissingColumns=True).unionByName(total, allowMissingColumns=True)
    # a row of step s counts at the s lowest thresholds
    rows = counts.withColumn("at", F.when(F.col("s") < 0, F.sequence(F.lit(1), F.lit(len(thresholds)))).when(F.col("s") > 0, F.sequence(F.lit(1), "s")))
    per = rows.select("*", F.explode("at").alias("i")).groupBy("i").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("detected", "total", "hits", "predicted")]
    )
    p = F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0))
    r = F.coalesce(F.try_divide("detected", "total"), F.lit(0.0))
    x = per.withColumns({"threshold": F.get(cuts, F.col("i") - 1), "_p": p, "_r": r})
    return x.select(
        "threshold", "detected", "total", "hits", "predicted", F.round("_p", 3).alias("precision"), F.round("_r", 3).alias("recall"),
        F.round(F.coalesce(F.try_divide(2 * F.col("_p") * F.col("_r"), F.col("_p") + F.col("_r")), F.lit(0.0)), 3).alias("f1"),
    )


def median_delay(tiles: DataFrame, score: str, threshold: float, major: float = MAJOR_DROP, tol: float = TOLERANCE_S) -> DataFrame:
    """One row ``median_delay_s``: distance from each found drop to the nearest predicted start."""
    later = tiles.where("idx > 0")
    actual = later.where(F.col("hazard") >= major).select("video_id", "idx", "start", "end")
    pred = later.where(F.col(score) >= threshold).select("video_id", "start", "end")
    d = overlap_join(actual, pred, tol).groupBy("video_id", "idx").agg(F.min(F.abs(F.col("start_r") - F.col("start"))).alias("d"))
    return ranks.quantiles(d, "d", [0.5]).select(F.round("quantile", 1).alias("median_delay_s"))


def pick_threshold(train: DataFrame, score: str) -> DataFrame:
    """(threshold, f1): best F1 among 50 quantiles of the non-first training scores, lower on ties."""
    shares = [0.5 + i * 0.01 for i in range(50)]
    qs = [r["quantile"] for r in ranks.quantiles(train.where("idx > 0"), score, shares).collect()]
    curve = detection_curve(train, score, sorted(set(qs)))
    return curve.agg(F.max_by("threshold", F.struct("f1", (-F.col("threshold")).alias("t"))).alias("threshold"), F.max("f1").alias("f1"))


def band_coverage(test: DataFrame) -> DataFrame:
    """One row: share of points inside the band, median final retention actual / predicted."""
    # compared at nine digits: the offsets are themselves differences of these columns
    off = F.round(F.col("actual_r") - F.col("r"), 9)
    inside = off.between(F.round("lo", 9), F.round("hi", 9))
    cover = test.agg(F.avg(inside.cast("double")).alias("coverage"))
    ends = test.groupBy("video_id").agg(F.max_by("actual_r", "idx").alias("a"), F.max_by("r", "idx").alias("p"))
    out = cover.withColumn("_k", F.lit(1))
    for col, name in (("a", "median_end_actual"), ("p", "median_end_predicted")):
        q = ranks.quantiles(ends, col, [0.5]).select(F.col("quantile").alias(name), F.lit(1).alias("_k"))
        out = out.join(q, "_k")
    return out.drop("_k")


# ---------------------------------------------------------------- points


def topk_points(tiles: DataFrame, score: str, k: int) -> DataFrame:
    """(video_id, rank, t): midpoints of the k best non-first segments."""
    best = W.partitionBy("video_id").orderBy(F.desc(score), "idx")
    x = tiles.where("idx > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return x.select("video_id", "rank", ((F.col("start") + F.col("end")) / 2).alias("t"))


def score_points(points: DataFrame, tiles: DataFrame, by: tuple[str, ...] = (), major: float = MAJOR_DROP, tol: float = TOLERANCE_S) -> DataFrame:
    """(by, video_id, hits, found, total, named): points within ``tol`` of a real drop, and drops
    that some point found. ``points``: video_id, rank (unique per video and ``by``), t."""
    p = points.withColumns({"start": F.col("t"), "end": F.col("t")})
    drops = tiles.where((F.col("idx") > 0) & (F.col("hazard") >= major)).select("video_id", "idx", "start", "end")
    near = overlap_join(p, drops, tol)
    keys = [*by, "video_id"]
    got = near.groupBy(*keys).agg(F.countDistinct("rank").alias("hits"), F.countDistinct("idx_r").alias("found"))
    named = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("named"))
    total = drops.groupBy("video_id").agg(F.count(F.lit(1)).alias("total"))
    x = named.join(got, keys, "left").join(total, "video_id", "left")
    return x.select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("hits", "found", "total", "named")])


def method_comparison(scored: DataFrame) -> DataFrame:
    """Micro precision and recall per method."""
    x = scored.groupBy("method").agg(*[F.sum(c).alias(c) for c in ("hits", "found", "total", "named")])
    return x.select(
        "method",
        F.round(F.coalesce(F.try_divide("hits", "named"), F.lit(0.0)), 3).alias("precision"),
        F.round(F.coalesce(F.try_divide("found", "total"), F.lit(0.0)), 3).alias("recall"),
        F.col("found").alias("drops_found"), F.col("total").alias("drops_total"), F.col("named").alias("points_named"),
    )


def parse_point_replies(replies: DataFrame, k: int) -> DataFrame:
    """Adds ``points``: numbers of the reply's JSON list, else any numbers in the text, inside
    [0, duration_s], the first k. ``replies``: reply, duration_s."""
    body = F.regexp_extract("reply", r"(?s)\{.*\}", 0)
    listed = F.expr(
        "transform(filter(try_variant_get(try_parse_json(_body), '$.drop_seconds', 'array<variant>'),"
        " x -> schema_of_variant(x) rlike '^(BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)'), x ->"
        " if(schema_of_variant(x) = 'BOOLEAN', if(try_variant_get(x, '$', 'boolean'), 1D, 0D), try_variant_get(x, '$', 'double')))"
    )
    loose = F.transform(F.regexp_extract_all("reply", F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))
    x = replies.withColumn("_body", body).withColumn("_listed", F.coalesce(listed, F.array().cast("array<double>")))
    vals = F.when(F.size("_listed") > 0, F.col("_listed")).otherwise(loose)
    kept = F.filter(vals, lambda t: (t >= 0) & (t <= F.col("duration_s")))
    return x.withColumn("points", F.slice(kept, 1, k)).drop("_body", "_listed")


# ---------------------------------------------------------------- score pairs


def pair_auc(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n_pos, n_neg, auc): chance that a positive outscores a negative, ties count half."""
    m = {"pos": F.col("label").cast("long"), "neg": (1 - F.col("label")).cast("long")}
    t = ranks.cumulative(scored, "score", m, by)
    won = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    x = t.groupBy(*by).agg(F.max("pos_total").alias("n_pos"), F.max("neg_total").alias("n_neg"), won.alias("_w"))
    return x.select(*by, "n_pos", "n_neg", F.try_divide("_w", F.col("n_pos") * F.col("n_neg")).alias("auc"))


def best_f1(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, f1, threshold, precision, recall): best cut among the observed scores, lowest on ties."""
    m = {"pos": F.col("label").cast("long"), "neg": (1 - F.col("label")).cast("long")}
    t = ranks.cumulative(scored, "score", m, by)
    tp, fp = F.col("pos_total") - F.col("pos_below"), F.col("neg_total") - F.col("neg_below")
    t = t.withColumns({"precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, F.col("pos_total"))})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    t = t.withColumn("f1", F.round(f1, 12))
    best = F.max_by(F.struct("f1", F.col("score").alias("threshold"), "precision", "recall"), F.struct("f1", (-F.col("score")).alias("s")))
    return t.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def pair_groups(items: DataFrame) -> DataFrame:
    """Per group of (anchor, repeat, progress) vectors: mean / min / max similarities. The mean
    over all anchors against all other items' texts needs no pairs: it is the product of the
    vector sums minus the matching products."""
    from stayline.operators.semantic import cosine

    x = items.withColumns({"rep": cosine("anchor", "repeat"), "prog": cosine("anchor", "progress")})
    stats = x.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"), F.avg("rep").alias("mean_repeat"), F.avg("prog").alias("mean_progress"),
        F.min("rep").alias("min_repeat"), F.max("prog").alias("max_progress"), F.sum(F.col("rep") + F.col("prog")).alias("_own"),
    )
    dims = items.select("group", F.posexplode(F.arrays_zip("anchor", "repeat", "progress")).alias("d", "z")).groupBy("group", "d").agg(
        F.sum("z.anchor").alias("a"), F.sum(F.col("z.repeat") + F.col("z.progress")).alias("b")
    )
    cross = dims.groupBy("group").agg(F.sum(F.col("a") * F.col("b")).alias("_all"))
    y = stats.join(cross, "group")
    return y.select(
        "group", "n", "mean_repeat", "mean_progress",
        F.try_divide(F.col("_all") - F.col("_own"), 2 * F.col("n") * (F.col("n") - 1)).alias("mean_unrelated"),
        (F.col("mean_repeat") - F.col("mean_progress")).alias("margin"), "min_repeat", "max_progress",
    )


def choose_model(results: DataFrame, slack: float = 0.01) -> DataFrame:
    """Fewest parameters among the models within ``slack`` of the best AUC (one row per model)."""
    best = F.max("auc").over(W.partitionBy(F.lit(0)))
    return results.withColumn("_b", best).where(F.col("_b") - F.col("auc") <= slack).orderBy("params", "model").limit(1).drop("_b")


# ---------------------------------------------------------------- learned models


def settings(rounds: int = MAX_ITER) -> boost.Settings:
    return boost.Settings(rounds, STEP, MAX_LEAVES, MIN_LEAF, L2)


def rate_model(name: str = "rate", without: tuple[str, ...] = ()) -> boost.Model:
    """The signed per-second rate; columns with a direction can only raise or only lower it."""
    kept = [f for f in FEATURES if f not in without]
    return boost.Model(name, kept, "signed_rate", directions={f: DIRECTION[f] for f in kept if f in DIRECTION})


def drop_model() -> boost.Model:
    """Whether a segment is a major drop, first segments left out (a null label)."""
    return boost.Model("drop", FEATURES, "major", "log")


def labelled(tiles: DataFrame) -> DataFrame:
    return tiles.withColumn("major", F.when(F.col("idx") > 0, (F.col("hazard") >= MAJOR_DROP).cast("double")))


def fit_rate(train: DataFrame, rounds: int = MAX_ITER) -> boost.Forest:
    """Boosted trees with directions on the signed per-second rate."""
    return boost.fit(train, [rate_model()], settings(rounds))[0]


def fit_drop_clf(train: DataFrame, rounds: int = MAX_ITER) -> boost.Forest:
    """Boosted trees on "this segment is a major drop"."""
    return boost.fit(labelled(train), [drop_model()], settings(rounds))[0]


def fit_models(train: DataFrame, rounds: int = MAX_ITER) -> dict[str, boost.Forest]:
    """Rate and drop model, and the rate model without each feature group, all from the same passes."""
    models = [rate_model(), drop_model(), *[rate_model(group, tuple(names)) for group, names in GROUPS.items()]]
    return {f.name: f for f in boost.fit(labelled(train), models, settings(rounds))}


def with_rate(tiles: DataFrame, forest: boost.Forest, rate: str = "rate", p: str = "p") -> DataFrame:
    """Adds the predicted rate (0 or more) and the segment's drop probability that follows from it."""
    x = tiles.withColumn(rate, F.greatest(forest.predict(), F.lit(0.0)))
    return x.withColumn(p, rate_to_hazard(F.col(rate), F.col("end") - F.col("start")))


def ablation_scores(train: DataFrame, test: DataFrame, forests: dict[str, boost.Forest]) -> DataFrame:
    """(group, mae, hazard_spearman_pooled, detection_f1) of the rate models without each feature group."""
    out = None
    for group in GROUPS:
        # read by every step of the search for a threshold and by each metric
        seen, scored = with_rate(train, forests[group]).persist(), with_rate(test, forests[group]).persist()
        cut = pick_threshold(seen, "p").first()["threshold"]
        seen.unpersist()
        row = (
            curve_metrics(scored).select("mae", "hazard_spearman_pooled").withColumn("_k", F.lit(1))
            .join(detection_curve(scored, "p", [cut]).select(F.col("f1").alias("detection_f1"), F.lit(1).alias("_k")), "_k")
            .select(F.lit(group).alias("group"), F.round("mae", 4).alias("mae"), F.round("hazard_spearman_pooled", 3).alias("hazard_spearman_pooled"), "detection_f1")
        )
        out = row if out is None else out.unionByName(row)
    return out


def ablations(train: DataFrame, test: DataFrame, rounds: int = MAX_ITER) -> DataFrame:
    """As ablation_scores, the five models fitted in one run."""
    models = [rate_model(group, tuple(names)) for group, names in GROUPS.items()]
    return ablation_scores(train, test, {f.name: f for f in boost.fit(train, models, settings(rounds))})


# ---------------------------------------------------------------- the fitted model at work


def direction_steps(forest: boost.Forest, rows: DataFrame, grid: list[float]) -> DataFrame:
    """(feature, steps, violations): how each row's score moves while one directed feature goes up ``grid``.

    The row's other features keep their values; a step against the feature's direction is a violation.
    """
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(float(v)).alias("v")) for f in DIRECTION for v in sorted(grid)])
    x = rows.select("video_id", "idx", *FEATURES, F.inline(cells))
    x = x.select("video_id", "idx", "feature", "v", *[F.when(F.col("feature") == f, F.col("v")).otherwise(F.col(f)).alias(f) for f in FEATURES])
    x = x.select("video_id", "idx", "feature", "v", forest.score().alias("s"))
    up = F.col("feature").isin([f for f, way in DIRECTION.items() if way > 0])
    moved = F.col("s") - F.lag("s").over(W.partitionBy("video_id", "idx", "feature").orderBy("v"))
    x = x.withColumn("d", F.when(up, moved).otherwise(-moved))
    return x.groupBy("feature").agg(F.count("d").alias("steps"), F.count_if(F.col("d") < 0).alias("violations"))


def calibrated_prediction(rated: DataFrame) -> tuple[DataFrame, float]:
    """Calibrated curve with band of all tiles, and the exponent; both fitted on the training lectures."""
    k = calibrate_k(rated.where("split = 'train'")).first()["k"]
    curve = calibrated_curve(rated, k).persist()
    return with_band(curve, band_offsets(curve.where("split = 'train'"))), k


def implied_drop(curve: DataFrame) -> DataFrame:
    """Adds ``p_curve``: the share of viewers that the calibrated curve loses in each segment."""
    before = F.coalesce(F.lag("r").over(W.partitionBy("video_id").orderBy("idx")), F.lit(1.0))
    return curve.withColumn("p_curve", _clip(1 - F.col("r") / F.greatest(before, F.lit(1e-9))))


def model_report(scored: DataFrame, curve: DataFrame, baseline: DataFrame) -> DataFrame:
    """(section, metric, value): curve quality of model and baseline, detection of both at the thresholds
    picked on training lectures, band and level, on the test lectures. ``scored`` has p_major, ``baseline`` p."""
    test = "split = 'test'"

    def rows(section: str, one: DataFrame) -> DataFrame:
        cells = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one.columns]
        return one.select(F.lit(section).alias("section"), F.inline(F.array(*cells)))

    def detected(df: DataFrame, score: str) -> DataFrame:
        cut = pick_threshold(df.where("split = 'train'"), score).first()["threshold"]
        late = median_delay(df.where(test), score, cut).withColumn("_k", F.lit(1))
        return detection_curve(df.where(test), score, [cut]).withColumn("_k", F.lit(1)).join(late, "_k", "left").drop("_k")

    parts = [
        rows("model", curve_metrics(implied_drop(curve).where(test), "p_curve")), rows("baseline", curve_metrics(baseline.where(test), "p")),
        rows("detection", detected(scored, "p_major")), rows("baseline_detection", detected(baseline, "p")), rows("band", band_coverage(curve.where(test))),
    ]
    return reduce(DataFrame.unionByName, parts)
