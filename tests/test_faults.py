"""Cases that once gave wrong answers: frames across holes, blank titles, unmeasured pictures."""

from pyspark.sql import functions as F

from stayline.operators import av, promises, rules, watch


def test_no_frame_across_a_hole(spark):
    chunks = spark.createDataFrame(
        [("a", 0, [0.1] * 8), ("a", 16, [0.1] * 8)], "video_id string, first long, samples array<float>"
    )
    got = sorted(r["k"] for r in av.frame_db(chunks, 8, 4).collect())
    assert got == [0, 4]


def test_blank_title_is_no_promise(spark):
    axis = [1.0, 0.0]
    titles = spark.createDataFrame(
        [("a", "  ", axis), ("b", "red kites", axis)], "video_id string, title string, title_emb array<double>"
    )
    sentences = spark.createDataFrame(
        [(v, 1, 4.0, "kites", axis) for v in "ab"],
        "video_id string, sent_idx int, start double, text string, emb array<double>",
    )
    got = {r["video_id"]: r for r in promises.promise_check(titles, sentences).collect()}
    assert got["a"]["first_mention_s"] is None and got["a"]["best_similarity"] is None
    assert got["b"]["first_mention_s"] == 4.0 and got["b"]["best_similarity"] == 1.0


def test_intervals_past_the_end(spark):
    """Deltas are clamped to the video; an interval wholly past its end leaves no row."""
    log = [("u", "a", 0.0, 3.0), ("v", "a", 0.0, 50.0), ("v", "a", 60.0, 70.0), ("w", "b", 0.0, 2.0), ("w", "b", 30.0, 40.0)]
    spans = spark.createDataFrame(log, "viewer_id string, video_id string, start_point double, end_point double")
    lectures = spark.createDataFrame([("a", 10.0), ("b", 5.0)], "video_id string, duration_s double")
    got = {(r["video_id"], r["t"]): r["delta"] for r in watch.coverage_diff(spans, lectures, 1.0).collect()}
    assert got == {("a", 0): 2, ("a", 3): -1, ("a", 10): -1, ("b", 0): 1, ("b", 2): -1}


def test_unmeasured_speech_is_not_counted(spark):
    flag = [("a", "f1", "pacing", "rule", 0.0, 36.0, 0.5)]
    head = "video_id string, flag_id string, category string, source string, start double, end double, risk_score double"
    flags = spark.createDataFrame(flag, head).withColumn("evidence", F.array(rules.evidence(F.lit("x"), F.lit(1.0))))
    segs = spark.createDataFrame(
        [("a", i, 12.0 * i, 12.0 * i + 12, "speech", 9.0 if i == 0 else None, None, None, None) for i in range(3)],
        "video_id string, idx int, start double, end double, kind string, cuts_per_minute double, visual_type string,"
        " visual_type_share double, speech_match_ratio double",
    )
    got = rules.visual_compensation(flags, segs, ["video_id", "flag_id"]).first()
    assert got["risk_score"] < 0.5 and len(got["evidence"]) == 2
