"""Flag detection measures and places its segments once."""

from pyspark.sql import functions as F

from stayline.plans import detect_queries as dq, views as v
from stayline.session import configure
from tests.conftest import SMALL


def test_the_events_are_read_for_the_segments_only(spark, monkeypatch):
    reads = []
    load = v.load
    monkeypatch.setattr(v, "load", lambda *a: reads.append(a[2]) or load(*a))
    dq.detect_flags(configure(spark), SMALL)
    assert reads == ["events"]


def test_placed_segments_are_the_same_and_their_windows_shuffle_nothing_again(spark):
    segs = v.seg_features(configure(spark), SMALL, placed=True)
    plain = v.seg_features(spark, SMALL)
    assert segs.exceptAll(plain).count() == 0 == plain.exceptAll(segs).count()
    plan = segs.groupBy("video_id").agg(F.count("idx"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
