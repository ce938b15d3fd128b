"""Exact small inputs for vectors, pictures, loudness and labels."""

import math

import numpy as np
from pyspark.sql import functions as F

from stayline.operators import av, semantic as op


def items(spark, vectors, starts=None, ends=None):
    rows = []
    for i, v in enumerate(vectors):
        v = np.array(v, float)
        rows.append((1, i, float(starts[i] if starts else i * 12), float(ends[i] if ends else i * 12 + 12), [float(x) for x in v / np.linalg.norm(v)]))
    return spark.createDataFrame(rows, "video_id int, idx int, start double, end double, emb array<double>")


def test_segment_repetition(spark):
    x = items(spark, [[0, 0, 2], [0.03, 0, 1], [1, 1, 0], [0, 0.01, 1]], [0, 8, 30, 60], [8, 16, 40, 70])
    got = {r["idx"]: r for r in op.segment_repetition(x, 20, 0.95).collect()}
    assert got[1]["sim"] is None and got[2]["match"] == 0 and got[2]["n_similar"] == 0
    assert got[3]["match"] == 0 and abs(got[3]["sim"] - 1 / math.sqrt(1.0001)) < 1e-8 and got[3]["n_similar"] == 2


def test_blocks_do_not_change_results(spark):
    rnd = np.random.default_rng(1)
    x = items(spark, rnd.normal(size=(60, 8)).tolist()).withColumn("eligible", F.col("idx") % 7 != 3)
    whole = sorted(map(tuple, op.best_earlier(x, 20.0, 0.3).collect()))
    small = sorted(map(tuple, op.best_earlier(x, 20.0, 0.3, block=7).collect()))
    assert whole == small


def test_novelty_and_gain(spark):
    vectors = [[3, 4], [4, 3], [-4, 3]]
    nov = {r["idx"]: r["novelty"] for r in op.novelty(items(spark, vectors)).collect()}
    assert nov[0] is None and abs(nov[1] - 0.04) < 1e-8 and abs(nov[2] - 1) < 1e-8
    x = items(spark, vectors, [0, 6, 20], [6, 20, 26])
    for chunk in (600.0, 10.0):
        gain = {r["idx"]: r["information_gain"] for r in op.information_gain(x, 15.0, chunk).collect()}
        assert len(gain) == 3 and math.isnan(gain[0] if gain[0] is not None else math.nan)
        assert abs(gain[1] - 0.04) < 1e-9 and abs(gain[2] - (1 + 0.2 / math.sqrt(2))) < 1e-9


def test_topic_boundaries(spark):
    lake, fire = [2, 1, 0], [0, 1, 3]
    x = items(spark, [lake, lake, [2, 1.1, 0], lake, lake, fire, fire, [0, 1.1, 3], fire])
    assert [r["idx"] for r in op.topic_boundaries(x).collect()] == [5]


def peak(values):
    """The largest of the stretch from the first value on that does not fall."""
    fall = next((k for k in range(1, len(values)) if values[k] < values[k - 1]), len(values))
    return max(values[:fall])


def test_topic_depths_against_peaks(spark):
    rnd = np.random.default_rng(4)
    rows = op.topic_depths(items(spark, rnd.normal(size=(40, 5)).tolist())).orderBy("idx").collect()
    assert [r["idx"] for r in rows] == list(range(rows[0]["idx"], rows[0]["idx"] + len(rows)))
    gaps = [r["gap"] for r in rows]
    for i, r in enumerate(rows):
        assert abs(r["depth"] - (peak(gaps[i::-1]) + peak(gaps[i:]) - 2 * gaps[i])) < 1e-8


def frames(spark, levels):
    rows = [(1, i, [int(v)] * 4) for i, v in enumerate(levels)]
    return spark.createDataFrame(rows, "video_id int, i int, pixels array<int>")


def test_scene_cuts(spark):
    d = av.frame_diffs(frames(spark, [35] * 16 + [190] * 12 + [35] * 14))
    assert av.scene_cuts(d, 2.0).first()["cuts"] == [8.0, 14.0]
    slow = av.frame_diffs(frames(spark, [40 + i * 4 for i in range(50)]))
    assert av.scene_cuts(slow, 2.0).count() == 0


def test_segment_visual(spark):
    d = av.frame_diffs(frames(spark, [35] * 18 + [190] * 40))
    segs = spark.createDataFrame([(1, 0, 0.0, 15.0), (1, 1, 15.0, 27.0), (1, 2, 90.0, 99.0)], "video_id int, idx int, start double, end double")
    got = {r["idx"]: r for r in av.segment_visual(d, av.scene_cuts(d, 2.0), segs, 2.0).collect()}
    assert (got[1]["scene_cut_count"], got[1]["static_ratio"], got[1]["longest_static_s"], got[1]["seconds_since_cut"]) == (0, 1.0, 12.0, 18.0)
    assert (got[0]["scene_cut_count"], got[0]["cuts_per_minute"]) == (1, 4.0)
    assert 2 not in got


def test_loudness(spark):
    rate = 1600
    for amp in (0.5, 0.01):
        t = np.arange(15 * rate) / rate
        x = amp * np.sin(2 * np.pi * 200 * t)
        x[5 * rate: 10 * rate] = 0
        chunks = [(1, int(i), [float(v) for v in x[i:i + 999]]) for i in range(0, len(x), 999)]
        c = spark.createDataFrame(chunks, "video_id int, first long, samples array<float>")
        db = av.frame_db(c, 40, 16)
        assert db.count() == (len(x) - 40) // 16 + 1
        seg = spark.createDataFrame([(1, 0, 0.0, 15.0)], "video_id int, idx int, start double, end double")
        assert abs(av.segment_audio(db, seg, 0.01).first()["silence_ratio"] - 1 / 3) < 0.01


def labels(spark, runs):
    flat = [lab for lab, n in runs for _ in range(n)]
    return spark.createDataFrame([(1, i, lab) for i, lab in enumerate(flat)], "video_id int, i int, label string")


def test_label_runs(spark):
    x = labels(spark, [("face", 7), ("table", 2), ("face", 4), ("chart", 6)])
    got = [(r["start"], r["end"], r["label"]) for r in av.label_runs(x, 1.0).orderBy("start").collect()]
    assert got == [(0.0, 13.0, "face"), (13.0, 19.0, "chart")]
    short_first = av.label_runs(labels(spark, [("a", 1), ("b", 9)]), 1.0).collect()
    assert [(r["start"], r["end"], r["label"]) for r in short_first] == [(0.0, 10.0, "b")]


def test_segment_content(spark):
    x = labels(spark, [("diagram", 6), ("slide_text", 2)]).withColumn("emb", F.array(F.lit(0.6), F.lit(0.8)))
    segs = spark.createDataFrame([(1, 0, 0.0, 8.0, [1.0, 0.0]), (1, 1, 50.0, 60.0, [1.0, 0.0])], "video_id int, idx int, start double, end double, speech_emb array<double>")
    rows = av.segment_content(x, segs, 1.0).collect()
    assert [(r["visual_type"], r["visual_type_share"], r["speech_match"]) for r in rows] == [("diagram", 0.75, 0.6)]
