"""Registered queries for fitting, prediction and validation. Lectures are the users' timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayline.operators import model as op, semantic
from stayline.plans import views as v
from stayline.plans.watch_queries import lecture_curve, lecture_tiles
from stayline.functions.textcols import words_of


def _r(c, n=6):
    return F.round(F.col(c), n).alias(c)


def baseline_tiles(spark, sf):
    """Tiles of all lectures with the baseline's rate and drop probability (fitted on train) and
    a varied score for the threshold steps."""
    # one row per 12 s of video, used by every later step: kept, the raw log is not read again
    tiles = lecture_tiles(spark, sf).persist()
    table = op.position_baseline(tiles.where("split = 'train'"))
    x = op.baseline_predict(tiles, table)
    noise = F.conv(F.substring(F.md5(F.concat("video_id", F.lit(":"), F.col("idx").cast("string"))), 1, 8), 16, 10).cast("long") % 1000
    return x.withColumn("score", F.col("p") * (0.5 + noise / 1000)).persist()


def calibrated(spark, sf):
    x = baseline_tiles(spark, sf)
    k = op.calibrate_k(x.where("split = 'train'")).first()["k"]
    return op.calibrated_curve(x, k)


def banded(spark, sf):
    x = calibrated(spark, sf)
    return op.with_band(x, op.band_offsets(x.where("split = 'train'")))


def position_baseline(spark, sf):
    return op.position_baseline(lecture_tiles(spark, sf).where("split = 'train'")).select("bin", _r("rate"))


def calibrate_k(spark, sf):
    return op.calibrate_k(baseline_tiles(spark, sf).where("split = 'train'")).select(_r("k", 3), _r("mse"))


def band_offsets(spark, sf):
    return op.band_offsets(calibrated(spark, sf).where("split = 'train'")).select("bin", _r("lo"), _r("hi"))


def band_lookup(spark, sf):
    return banded(spark, sf).select("video_id", "idx", _r("lo"), _r("hi"))


def drop_rate_by_position(spark, sf):
    return op.drop_rate_by_position(lecture_tiles(spark, sf).where("split = 'train'")).select("bin", _r("base"))


def risk_levels(spark, sf):
    x = baseline_tiles(spark, sf)
    base = op.drop_rate_by_position(x.where("split = 'train'"))
    return op.risk_levels(x, base).select("video_id", "idx", _r("ratio"), "risk")


def predict_curve(spark, sf):
    return op.predict_curve(banded(spark, sf))


def curve_points(spark, sf):
    return op.curve_points(op.predict_curve(banded(spark, sf)))


def curve_metrics(spark, sf):
    m = op.curve_metrics(baseline_tiles(spark, sf).where("split = 'test'"))
    return m.select(*[_r(c, 5) for c in m.columns])


def drop_detection(spark, sf):
    x = baseline_tiles(spark, sf).where("split = 'test'")
    d = op.detection_curve(x, "score", [0.12]).withColumn("_k", F.lit(1))
    delay = op.median_delay(x, "score", 0.12).withColumn("_k", F.lit(1))
    return d.join(delay, "_k").drop("_k")


def detection_curve(spark, sf):
    """The same counts at many thresholds in one pass."""
    x = baseline_tiles(spark, sf).where("split = 'train'")
    return op.detection_curve(x, "score", [i / 50 for i in range(1, 16)])


def pick_threshold(spark, sf):
    out = op.pick_threshold(baseline_tiles(spark, sf).where("split = 'train'"), "score")
    return out.select(_r("threshold"), "f1")


def band_coverage(spark, sf):
    c = op.band_coverage(banded(spark, sf).where("split = 'test'"))
    return c.select(*[_r(x, 5) for x in c.columns])


def validation_report(spark, sf):
    """The six most-watched test lectures with actual and predicted curve and their drops."""
    x = calibrated(spark, sf).where("split = 'test'")
    lec = lecture_curve(spark, sf)[0].select("video_id", "n_starters")
    top = lec.join(x.select("video_id").distinct(), "video_id", "left_semi").orderBy(F.desc("n_starters"), "video_id").limit(6)
    per = x.join(F.broadcast(top), "video_id").groupBy("video_id", "n_starters").agg(
        F.array_sort(F.collect_list(F.struct("idx", "end", F.round("actual_r", 4).alias("actual"), F.round("r", 4).alias("predicted"), ((F.col("idx") > 0) & (F.col("hazard") >= 0.05)).alias("drop")))).alias("p")
    )
    text = F.array_join(F.transform("p", lambda z: F.format_string("%d:%.4f:%.4f:%s", z["idx"], z["actual"], z["predicted"], z["drop"].cast("string"))), " ")
    return per.select("video_id", "n_starters", F.size("p").alias("n_points"), text.alias("points"))


def topk_points(spark, sf):
    return op.topk_points(baseline_tiles(spark, sf), "score", 5)


def score_points(spark, sf):
    x = baseline_tiles(spark, sf)
    return op.score_points(op.topk_points(x, "score", 5), x)


def replies(spark, sf):
    """One written reply per event: a JSON list, a sentence with numbers, or nothing useful."""
    return v.load(spark, sf, "events").select(
        "event_id",
        F.expr("concat('u', user_id)").alias("video_id"),
        F.expr(
            "case event_type when 'view' then concat('Sure: {\"drop_seconds\": [', cast(value as int), ', \"x\", ', event_id % 700, '.5, 999]}')"
            " when 'click' then concat('I think ', event_id % 900, ' and ', cast(value as int), '.25 or 31')"
            " when 'error' then '{\"drop_seconds\": [' else 'no idea' end"
        ).alias("reply"),
        F.lit(600.0).alias("duration_s"),
    )


def parse_point_replies(spark, sf):
    return op.parse_point_replies(replies(spark, sf), 3).select("event_id", "points")


def method_comparison(spark, sf):
    x = baseline_tiles(spark, sf)
    said = op.parse_point_replies(replies(spark, sf), 5).select("video_id", "event_id", F.posexplode("points").alias("n", "t"))
    said = said.select("video_id", F.concat("event_id", F.lit("-"), "n").alias("rank"), "t", F.lit("replies").alias("method"))
    points = said
    for name, col in (("position", "p"), ("score", "score")):
        best = op.topk_points(x, col, 5).withColumn("rank", F.col("rank").cast("string")).withColumn("method", F.lit(name))
        points = points.unionByName(best.select("video_id", "rank", "t", "method"))
    return op.method_comparison(op.score_points(points, x, ("method",)))


def scored(spark, sf):
    """Documents with a quality label, scored by their average word length; without a word that is no number for an
    empty text and beyond all numbers for white space."""
    docs = v.load(spark, sf, "documents").select("doc_id", "lang", F.length("text").alias("_n"), F.size(words_of(F.col("text"))).alias("_words"))
    wordless = F.when(F.col("_n") > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    docs = docs.withColumn("raw", F.when(F.col("_words") == 0, wordless).otherwise(F.try_divide("_n", "_words")))
    x = docs.join(v.load(spark, sf, "labels"), "doc_id").select("doc_id", F.col("lang").alias("group"), F.round("raw", 2).alias("score"), F.col("quality").alias("label"))
    return x.persist()  # a few numbers a document, read by the cut points and the counts


def pair_auc(spark, sf):
    s = scored(spark, sf)
    whole = op.pair_auc(s).select(F.lit("all").alias("group"), "n_pos", "n_neg", "auc")
    return whole.unionByName(op.pair_auc(s, ("group",))).select("group", "n_pos", "n_neg", _r("auc"))


def best_f1(spark, sf):
    b = op.best_f1(scored(spark, sf))
    return b.select(*[_r(c) for c in ("f1", "threshold", "precision", "recall")])


def pair_groups(spark, sf):
    """Every three neighbouring vectors are one anchor / repeat / progress item, ten items a group."""
    e = v.load(spark, sf, "embeddings").select(F.expr("vec_id div 3").alias("item"), F.expr("vec_id % 3").alias("role"), F.transform("embedding", lambda x: x.cast("double")).alias("emb"))
    items = e.groupBy("item").agg(*[F.max(F.when(F.col("role") == i, F.col("emb"))).alias(n) for i, n in enumerate(("anchor", "repeat", "progress"))])
    full = items.where("anchor is not null and repeat is not null and progress is not null").withColumn("group", F.expr("item div 10"))
    g = op.pair_groups(full)
    return g.select("group", "n", *[_r(c) for c in g.columns if c not in ("group", "n")])


def choose_model(spark, sf):
    r = op.pair_auc(scored(spark, sf), ("group",)).select(F.col("group").alias("model"), F.round("auc", 6).alias("auc"), (F.col("n_pos") + F.col("n_neg")).alias("params"))
    return op.choose_model(r, 0.1)


def training_matrix(spark, sf):
    """Every segment of every lecture with its observed drop; measured features where a video of its name has them.
    Position features are the lecture's own."""
    tiles = lecture_tiles(spark, sf)
    own = {"rel_start", "rel_end", "log_start_s", "is_first"}
    feats = semantic.model_features(v.seg_features(spark, sf)).drop(*own, "seg_duration_s").withColumn("video_id", F.concat(F.lit("u"), "video_id"))
    tiles = tiles.withColumns({"log_start_s": F.log1p("start"), "is_first": (F.col("idx") == 0).cast("double")})
    return tiles.join(feats, ["video_id", "idx"], "left")


def training_set(spark, sf):
    m = training_matrix(spark, sf)
    return m.select("video_id", "idx", "split", _r("hazard"), _r("actual_r"), _r("signed_rate"), *[_r(f) for f in op.FEATURES])


def fixed_forest(name="fixed", trees=12):
    """A forest by rule, to check the walk of forests: three splits a tree, on features in turn."""
    out = []
    for t in range(trees):
        a, b, c = (op.FEATURES[(t * k) % len(op.FEATURES)] for k in (1, 3, 5))
        cut = lambda f, k: (t * k % 10) / 10 if f not in ("log_start_s", "s_since_topic_start") else float(t * k % 7)  # noqa: B023, E731
        out.append([
            (a, cut(a, 3), t % 2 == 0, 1, 2, None), (b, cut(b, 7), t % 3 == 0, 3, 4, None), (c, cut(c, 9), t % 3 != 0, 5, 6, None),
            *[(None, None, None, None, None, ((t * 7 + leaf * 5) % 11 - 4) / 8192) for leaf in range(4)],
        ])
    return op.boost.Forest(name, 0.0078125, "square", out)


def forest_scores(spark, sf):
    """A given forest walked over every segment's features."""
    m = training_matrix(spark, sf)
    return m.select("video_id", "idx", fixed_forest().score().alias("score"))


def forest_curve(spark, sf):
    """The curve of every lecture that follows from a given forest's rates, calibrated and with its band."""
    rated = op.with_rate(training_matrix(spark, sf), fixed_forest()).persist()
    curve, _ = op.calibrated_prediction(rated)
    return op.predict_curve(curve)


def _split(spark, sf):
    m = training_matrix(spark, sf).persist()
    return m.where("split = 'train'"), m.where("split = 'test'")


def fit_rate(spark, sf):
    """The fitted per-second rate, 0 or more, of every test segment."""
    train, test = _split(spark, sf)
    return op.with_rate(test, op.fit_rate(train)).select("video_id", "idx", "rate", "p")


def fit_rate_directions(spark, sf):
    """Steps against a feature's direction, over every test segment and a grid of values: none may be."""
    train, test = _split(spark, sf)
    return op.direction_steps(op.fit_rate(train), test, [i / 8 for i in range(9)]).select("feature", (F.col("violations") == 0).alias("kept"))


def fit_drop_clf(spark, sf):
    """The fitted probability that a test segment is a major drop."""
    train, test = _split(spark, sf)
    return test.select("video_id", "idx", op.fit_drop_clf(train).predict().alias("p_major"))


def ablations(spark, sf):
    train, test = _split(spark, sf)
    return op.ablations(train, test)


def _fitted(spark, sf):
    """All lectures with fitted rate, drop probability, calibrated curve and band."""
    train, test = _split(spark, sf)
    rate, drop = op.boost.fit(op.labelled(train), [op.rate_model(), op.drop_model()], op.settings())
    scored = op.with_rate(train.unionByName(test), rate).withColumn("p_major", drop.predict()).persist()
    return scored, op.calibrated_prediction(scored)[0]


def predict_fitted(spark, sf):
    """The fitted curve of every lecture with band, drops and risk levels."""
    scored, curve = _fitted(spark, sf)
    base = op.drop_rate_by_position(scored.where("split = 'train'"))
    risk = op.risk_levels(scored.withColumn("score", F.col("p_major")), base).select("video_id", "idx", _r("ratio"), "risk")
    return op.predict_curve(curve).join(risk, ["video_id", "idx"])


def model_report(spark, sf):
    """Metrics of the fitted models and of the position baseline on the test lectures."""
    scored, curve = _fitted(spark, sf)
    table = op.position_baseline(scored.where("split = 'train'"))
    baseline = op.baseline_predict(scored.drop("rate", "p"), table)
    return op.model_report(scored, curve, baseline).select("section", "metric", _r("value", 4))


QUERIES = {
    f.__name__: f
    for f in (
        position_baseline, calibrate_k, band_offsets, band_lookup, drop_rate_by_position, risk_levels, predict_curve,
        curve_points, curve_metrics, drop_detection, detection_curve, pick_threshold, band_coverage, validation_report,
        topk_points, score_points, parse_point_replies, method_comparison, pair_auc, best_f1, pair_groups, choose_model,
        training_set, forest_scores, forest_curve, fit_rate, fit_rate_directions, fit_drop_clf, ablations, predict_fitted, model_report,
    )
}
