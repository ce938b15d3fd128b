"""The registered fits: all rounds and limits, and what follows from the fitted forests on small sets."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stayline.operators import boost, model as op
from stayline.operators.watch import curve_from_hazard


def test_settings_are_the_whole_fit():
    s = op.settings()
    assert (s.rounds, s.rate, s.leaves, s.least, s.l2) == (300, 0.05, 15, 40, 1.0)
    assert op.rate_model().directions == op.DIRECTION and op.rate_model().features == op.FEATURES
    assert op.drop_model().loss == "log" and op.drop_model().directions == {}
    for group, names in op.GROUPS.items():
        m = op.rate_model(group, tuple(names))
        assert set(m.features) == set(op.FEATURES) - set(names) and set(m.directions) == set(op.DIRECTION) - set(names)


@pytest.fixture(scope="module")
def lectures(spark):
    """Forty lectures of twenty segments; slow and repeating ones lose viewers."""
    rng = random.Random(3)
    rows = []
    for v in range(40):
        left = 1.0
        for i in range(20):
            pace, again = rng.random(), None if i < 2 else rng.random()
            rate = max(-0.002, 0.004 * (1 - pace) + 0.006 * (again or 0) + rng.gauss(0, 0.001))
            hazard = 1 - math.exp(-max(rate, 0) * 12)
            left *= 1 - hazard
            f = dict.fromkeys(op.FEATURES)
            f |= {"rel_start": i / 20, "rel_end": (i + 1) / 20, "log_start_s": math.log1p(i * 12), "is_first": float(i == 0), "pace_ratio": pace, "repetition_similarity": again}
            rows.append((f"u{v}", i, "test" if v % 4 == 0 else "train", i * 12.0, i * 12.0 + 12, hazard, left, rate, *f.values()))
    names = ", ".join(f"{f} double" for f in op.FEATURES)
    return spark.createDataFrame(rows, f"video_id string, idx int, split string, start double, end double, hazard double, actual_r double, signed_rate double, {names}").persist()


@pytest.fixture(scope="module")
def fitted(lectures):
    return op.fit_models(lectures.where("split = 'train'"), 20)


def test_one_run_gives_the_same_as_single_fits(lectures, fitted):
    train = lectures.where("split = 'train'")
    assert fitted["rate"] == op.fit_rate(train, 20) and fitted["drop"] == op.fit_drop_clf(train, 20)
    assert set(fitted) == {"rate", "drop", *op.GROUPS}


def test_no_step_against_a_direction(lectures, fitted):
    got = op.direction_steps(fitted["rate"], lectures.where("split = 'test'"), [i / 8 for i in range(9)]).collect()
    assert {r["feature"] for r in got} == set(op.DIRECTION)
    assert all(r["steps"] == 200 * 8 and r["violations"] == 0 for r in got)


def test_ablations(lectures, fitted):
    train, test = lectures.where("split = 'train'"), lectures.where("split = 'test'")
    got = {r["group"]: r for r in op.ablation_scores(train, test, fitted).collect()}
    assert set(got) == set(op.GROUPS) and all(0 <= r["mae"] <= 1 for r in got.values())
    whole = op.curve_metrics(op.with_rate(test, fitted["rate"])).first()["mae"]
    assert got["repetition"]["mae"] > whole and got["repetition"]["hazard_spearman_pooled"] < got["position"]["hazard_spearman_pooled"]


def test_report_and_curve(lectures, fitted):
    scored = op.with_rate(lectures, fitted["rate"]).withColumn("p_major", fitted["drop"].predict()).persist()
    curve, k = op.calibrated_prediction(scored)
    baseline = op.baseline_predict(scored.drop("rate", "p"), op.position_baseline(scored.where("split = 'train'")))
    report = {(r["section"], r["metric"]): r["value"] for r in op.model_report(scored, curve, baseline).collect()}
    assert {s for s, _ in report} == {"model", "baseline", "detection", "baseline_detection", "band"}
    assert report["model", "mae"] < report["baseline", "mae"] and report["detection", "f1"] > report["baseline_detection", "f1"]
    assert 0.1 <= k <= 2.0 and report["detection", "total"] == lectures.where("split = 'test' AND idx > 0 AND hazard >= 0.05").count()
    drops = op.implied_drop(curve)
    again = curve_from_hazard(drops, "p_curve", "r2").where(F.abs(F.col("r") - F.col("r2")) > 1e-9).count()
    assert again == 0


def test_probabilities(lectures, fitted):
    p = [r[0] for r in lectures.select(fitted["drop"].predict()).collect()]
    assert all(0 < x < 1 for x in p) and isinstance(fitted["drop"], boost.Forest)


def test_metrics_of_videos_without_spread(spark):
    """A video whose hazards are all equal has no rank correlation; it is left out, and nothing divides by zero."""
    flat = [("a", i, 0.9, 0.1, 0.1 + i / 100) for i in range(4)]
    more = [("b", i, 1 - i / 10, 0.1 * i, 0.2 * i) for i in range(4)]
    tiles = spark.createDataFrame(flat + more, "video_id string, idx int, actual_r double, hazard double, p double")
    got = op.curve_metrics(tiles).first()
    assert abs(got["hazard_spearman_within"] - 1.0) < 1e-9
    alone = op.curve_metrics(tiles.where("video_id = 'a'")).first()
    assert alone["hazard_spearman_within"] is None and alone["pearson"] is None and alone["spearman"] is None
