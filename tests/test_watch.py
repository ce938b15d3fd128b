"""Exact small inputs for watch logs, curves and rates."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from stayline.functions import ranks
from stayline.operators import watch as op
from stayline.sources import watch_log as src


LOG = "viewer_id long, video_id string, start_point double, end_point double"


def viewings(seed, viewers=40, length=90):
    """Random viewers of two videos: points on a quarter-second grid, some reversed, repeated, touching or past the end."""
    rnd = random.Random(seed)
    rows = []
    for v in range(viewers):
        for video in rnd.sample(["p", "q"], rnd.randint(1, 2)):
            at = rnd.choice([0.0, 0.25, 3.0, 6.5, 20.0, 55.0])
            for _ in range(rnd.randint(1, 6)):
                to = at + rnd.randint(0, 100) / 4
                rows.append((v, video, *rnd.choice([(at, to), (at, to), (to, at)])))
                at = rnd.choice([to, at, max(0.0, to - 2.25), to + rnd.randint(1, 60) / 4, rnd.randint(0, 4 * length) / 4])
    return rows


def unions(rows):
    """{(viewer, video): merged intervals}, from the quarter seconds that each of them covers, ends told apart from gaps."""
    out = {}
    for viewer, video in {r[:2] for r in rows}:
        mine = [(round(4 * min(a, b)), round(4 * max(a, b))) for v, x, a, b in rows if (v, x) == (viewer, video)]
        # even cells are points of the grid, odd ones the stretches between two of them
        cells = sorted({c for a, b in mine for c in range(2 * a, 2 * b + 1)})
        spans = []
        for c in cells:
            if spans and c == spans[-1][1] + 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
        out[viewer, video] = [(a / 8, b / 8) for a, b in spans]
    return out


def by_viewer(df):
    out = {}
    for r in df.orderBy("start").collect():
        out.setdefault((r["viewer_id"], r["video_id"]), []).append((r["start"], r["end"]))
    return out


@pytest.mark.parametrize("seed, chunk", [(1, 1.0), (2, 37.0), (3, 1000.0)])
def test_merged_intervals_are_the_union(spark, seed, chunk):
    rows = viewings(seed)
    assert by_viewer(op.merge_intervals(spark.createDataFrame(rows, LOG), chunk)) == unions(rows)


@pytest.mark.parametrize("tol", [0.0, 6.5, 30.0])
def test_early_starts_move_to_zero(spark, tol):
    rows = viewings(4)
    want = {k: [(0.0 if i == 0 and a <= tol else a, b) for i, (a, b) in enumerate(u)] for k, u in unions(rows).items()}
    assert by_viewer(op.anchor_start(op.merge_intervals(spark.createDataFrame(rows, LOG)), tol)) == want


@pytest.mark.parametrize("seed, tol", [(5, 3.0), (6, 20.0)])
def test_curve_counts_the_viewers_of_each_second(spark, seed, tol):
    rows = viewings(seed)
    df = spark.createDataFrame(rows, LOG)
    sizes = {"p": 61.5, "q": 90.0}
    counts = {r["video_id"]: (r["n_viewers"], r["n_starters"]) for r in op.viewer_counts(df, tol).collect()}
    starters = {k for k in unions(rows) if min(a for v, x, a, _ in rows if (v, x) == k) <= tol}
    assert counts == {x: (sum(k[1] == x for k in unions(rows)), sum(k[1] == x for k in starters)) for x in counts}
    lec = spark.createDataFrame([(x, d, counts[x][1]) for x, d in sizes.items()], "video_id string, duration_s double, n_starters int")
    got = {(r["video_id"], r["t"]): r["retention"] for r in op.retention_curve(op.coverage_diff(df, lec, tol), lec).collect()}
    for x, duration in sizes.items():
        for t in range(math.ceil(duration)):
            seen = 0
            for k in starters:
                spans = [(0.0 if i == 0 and a <= tol else a, b) for i, (a, b) in enumerate(unions(rows)[k])]
                seen += k[1] == x and any(math.floor(a) <= t < math.ceil(b) for a, b in spans)
            assert abs(got[x, t] - seen / counts[x][1]) < 1e-12
        assert (x, math.ceil(duration)) not in got


def test_rates_do_not_depend_on_how_time_is_cut(spark):
    rnd = random.Random(7)
    df = spark.createDataFrame([(rnd.uniform(0, 0.95), rnd.uniform(0.5, 40), rnd.uniform(0.1, 0.9)) for _ in range(200)], "h double, d double, part double")
    rate = op.hazard_to_rate(F.col("h"), F.col("d"))
    left = 1 - op.rate_to_hazard(rate, F.col("d") * F.col("part"))
    right = 1 - op.rate_to_hazard(rate, F.col("d") * (1 - F.col("part")))
    x = df.select("h", op.rate_to_hazard(rate, F.col("d")).alias("back"), (1 - left * right).alias("cut"))
    assert x.where("abs(h - back) > 1e-9 OR abs(h - cut) > 1e-9").count() == 0


def test_split_follows_the_hash(spark):
    names = [f"lecture {i}/{i % 7}" for i in range(3000)]
    got = {r["v"]: r["s"] for r in spark.createDataFrame([(n,) for n in names], "v string").select("v", op.hash_split(F.col("v"), 0.3).alias("s")).collect()}
    assert got == {n: "test" if int(hashlib.sha256(n.encode()).hexdigest()[:8], 16) % 10000 < 3000 else "train" for n in names}


def test_log_lines(spark):
    good = '{"id": "u1", "seq": [{"video_id": "a", "segment": [{"start_point": 1.0, "end_point": 2.0}]}, {"video_id": "b", "segment": []}]}'
    df = spark.createDataFrame([(good,), (good[:-6],), ("",)], "value string")
    assert [tuple(r) for r in src.parse_watch_lines(df).collect()] == [("u1", 0, "a", 1.0, 2.0)]


def test_caption_clamp(spark):
    rec = '{"ccid": "c", "start": [3.0, 0.0, 4.0], "end": [5.0, 4.0, 4.001], "text": ["cd", "a b", "x"]}'
    rows = src.caption_words(src.parse_captions(spark.createDataFrame([(rec,)], "value string"))).orderBy("sent_idx", "pos").collect()
    assert [(r["text"], r["start"], r["end"]) for r in rows] == [
        ("a", 0.0, 2.0), ("b", 2.0, 4.0), ("c", 4.0, 4.5), ("d", 4.5, 5.0), ("x", 5.0, 5.01)]


def test_recogniser_words(spark):
    raw = ('{"segments": [{"words": [{"word": " Namaste", "start": 0.5, "end": 0.9, "probability": 0.9}, {"word": " ", "start": 0.9, "end": 0.95, "probability": 0.1},'
           ' {"word": " doston.", "start": 0.85, "end": 0.84, "probability": 0.7}]}, {"words": []}]}')
    w = src.asr_words(spark.createDataFrame([(1, raw)], "video_id int, value string"))
    assert [(r["text"], r["start"], r["end"], r["phrase_break"]) for r in w.orderBy("word_idx").collect()] == [
        ("Namaste", 0.5, 0.9, False), ("doston.", 0.85, 0.85, True)]
    assert src.mean_confidence(w).first()["mean_confidence"] == 0.8


def test_quantiles_and_ranks_are_exact(spark):
    rnd = random.Random(5)
    data = [float(rnd.choice([0.0, 0.0, 0.0, rnd.randint(0, 40)])) for _ in range(997)]
    df = spark.createDataFrame([(x,) for x in data], "x double")
    got = {r["q"]: r["quantile"] for r in ranks.quantiles(df, "x", [0.1, 0.5, 0.93]).collect()}
    s = sorted(data)
    for q, v in got.items():
        pos = q * (len(s) - 1)
        lo = int(pos)
        want = s[lo] + (s[min(lo + 1, len(s) - 1)] - s[lo]) * (pos - lo)
        assert abs(v - want) < 1e-9
    rank = {r["x"]: r["rank"] for r in ranks.average_ranks(df, "x").collect()}
    for v, r in rank.items():
        below, same = sum(x < v for x in s), s.count(v)
        assert r == below + (same + 1) / 2
