"""Edit plans, points, snapping and prediction invariants."""

import random

from pyspark.sql import functions as F

from stayline.operators import edits as op, model, rules
from tests.conftest import SMALL

EDITS = "plan_id int, id string, pos int, action string, start double, end double, target_time double, simulatable boolean"
CUSTOM = "plan_id int, pos int, id string, action string, start double, end double, factor double"


def plan(spark, suggested, custom, duration=60.0):
    e = spark.createDataFrame([(1, i, n, a, float(s), float(t), m, a == "CUT") for n, (i, a, s, t, m) in enumerate(suggested)], EDITS)
    c = spark.createDataFrame([(1, n, f"c{n}", a, float(s), float(t), float(f)) for n, (a, s, t, f) in enumerate(custom)], CUSTOM)
    p = spark.createDataFrame([(1, duration)], "plan_id int, duration_s double")
    return e, c, p


def pieces(spark, suggested, custom):
    e, c, p = plan(spark, suggested, custom)
    row = op.edit_pieces(op.edit_ops(e, c, p), e.where("action = 'MOVE'")).first()
    return [(x["start"], x["end"], x["factor"]) for x in row["pieces"]], row


def test_cut_and_speed(spark):
    got, row = pieces(spark, [("e1", "CUT", 10, 20, None)], [("SPEED", 30, 40, 2.0)])
    assert got == [(0, 10, 1), (20, 30, 1), (30, 40, 2), (40, 60, 1)] and row["output_duration_s"] == 45


def test_trims(spark):
    got, _ = pieces(spark, [], [("TRIM_START", 0, 5, 1.0), ("TRIM_END", 50, 55, 1.0)])
    assert got == [(5, 50, 1)]


def test_moves(spark):
    got, row = pieces(spark, [("e1", "MOVE", 40, 50, 10.0)], [])
    assert got == [(0, 10, 1), (40, 50, 1), (10, 40, 1), (50, 60, 1)] and row["moved"] == ["e1"]
    same, row = pieces(spark, [("e1", "MOVE", 40, 50, 45.0), ("e2", "CUT", 0.2, 5, None)], [])
    assert same == [(5, 60, 1)] and row["moved"] == []


def test_resolve(spark):
    e, _, _ = plan(spark, [("e1", "CUT", 10, 20, None), ("e2", "CUT", 15, 25, None), ("e3", "REWRITE", 30, 40, None), ("e4", "MOVE", 50, 55, 12.0)], [])
    e = e.withColumn("simulatable", F.col("action").isin("CUT", "MOVE"))
    assert op.resolve_edits(e).first()["kept"] == ["e1"]


def test_ops_against_greedy(spark):
    rnd = random.Random(9)
    cuts = [(f"e{n:02d}", "CUT", a, a + rnd.uniform(1, 8), None) for n, a in enumerate(rnd.uniform(0, 50) for _ in range(12))]
    own = [("CUT", a, a + 3, 1.0) for a in (rnd.uniform(0, 55) for _ in range(6))]
    e, c, p = plan(spark, cuts, own)
    taken = []
    for a, b, name in [(s, t, i) for i, _, s, t, _ in sorted(cuts, key=lambda x: (x[2], x[0]))] + [(s, min(60.0, t), f"c{n}") for n, (_, s, t, _f) in enumerate(own)]:
        if b > a and not any(a < y and b > x for x, y, _ in taken):
            taken.append((a, b, name))
    row = op.edit_ops(e, c, p).first()
    assert sorted(row["applied"] + row["applied_custom"]) == sorted(n for *_, n in taken)
    assert [o["start"] for o in row["ops"]] == sorted(x for x, *_ in taken)


def test_simulation_prefix_and_gain(spark):
    segs = spark.createDataFrame([(1, i, i * 12.0, i * 12.0 + 12, 0.01, -0.05, 0.05) for i in range(5)], "plan_id int, idx int, start double, end double, rate double, lo double, hi double")
    def run(cuts):
        e, c, p = plan(spark, cuts, [])
        return {r["idx"]: r for r in op.simulate_exposure(segs, op.edit_ops(e, c, p), 0.9).collect()}
    base, cut = run([("e1", "MOVE", 1, 2, 9.0)]), run([("e1", "CUT", 24, 36, None)])
    assert 2 not in cut and all(base[i]["retention"] == cut[i]["retention"] for i in (0, 1)) and cut[4]["retention"] > base[4]["retention"]
    assert cut[4]["t"] == 48.0


def test_points(spark):
    tiles = spark.createDataFrame([("v", i, i * 12.0, i * 12.0 + 12, h, s) for i, (h, s) in enumerate(zip([.3, .01, .08, .02, .06], [.9, .1, .8, .2, .7]))],
                                  "video_id string, idx int, start double, end double, hazard double, score double")
    def score(ts):
        p = spark.createDataFrame([("v", n, float(t)) for n, t in enumerate(ts)], "video_id string, rank int, t double")
        r = model.score_points(p, tiles, tol=0.0).first()
        return r["hits"], r["found"], r["total"]
    assert score([30, 5]) == (1, 1, 2) and score([30, 50, 31]) == (3, 2, 2)
    assert [r["t"] for r in model.topk_points(tiles, "score", 2).orderBy("rank").collect()] == [30.0, 54.0]


def test_replies(spark):
    df = spark.createDataFrame([('{"drop_seconds": [30, 50, 999]}', 60.0), ("I think 30 and 55", 60.0), ("no idea", 60.0)], "reply string, duration_s double")
    assert [r["points"] for r in model.parse_point_replies(df, 5).collect()] == [[30.0, 50.0], [30.0, 55.0], []]


def test_snap(spark):
    w = spark.createDataFrame([(1, i, float(s), float(e)) for i, (s, e) in enumerate([(1, 2), (2.4, 3), (5, 6)])], "video_id int, word_idx int, start double, end double")
    p = spark.createDataFrame([(1, str(t), t) for t in (0.5, 4.0, 1.9, 2.5)], "video_id int, point_id string, t double")
    got = {r["t"]: r["snapped"] for r in rules.snap_to_pause(p, w, 1.5).collect()}
    assert got == {0.5: 0.5, 4.0: 4.0, 1.9: 2.2, 2.5: 2.2}


def test_curve_is_monotone_and_inside_its_band(spark):
    from stayline.plans import model_queries as q

    rows = q.predict_curve(spark, SMALL).orderBy("video_id", "idx").collect()
    assert rows
    for a, b in zip(rows, rows[1:]):
        assert b["lower"] <= b["retention"] <= b["upper"]
        if a["video_id"] == b["video_id"]:
            assert b["retention"] <= a["retention"]


def test_every_flag_has_evidence(spark):
    from stayline.plans import detect_queries as q

    rows = q.detect_flags(spark, SMALL).collect()
    assert rows and all(r["n_evidence"] > 0 for r in rows)
    assert len({(r["video_id"], r["flag_id"]) for r in rows}) == len(rows)


def test_rows_of_plans_are_not_broadcast(spark):
    """Words and segments, a row of a plan times 300 or 50, look as small as the plans; sent to the driver, they fill it."""
    import __spark_entry__ as entry

    for name in ("apply_edits", "kept_duration", "simulate_exposure", "simulate_conflicting", "retention_delta"):
        plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString().splitlines()
        sent = None  # depth of the broadcast that the line lies under
        for line in plan:
            depth = line.find("+- ") if "+- " in line else line.find(":- ")
            if sent is not None and depth <= sent:
                sent = None
            assert sent is None or "Generate explode(org.apache" not in line, name
            if sent is None and "BroadcastExchange" in line:
                sent = depth
