"""Stored curves and artifacts: what is read back, and what a dead writer leaves."""

import pytest
from pyspark.errors import AnalysisException

from stayline.sources import sinks

ROW = "video_id long, kind string, version string, created_at long, payload string"
SCHEMA = "video_id long, version string, created_at long, payload string, kind string"


def rows(spark, *r):
    return spark.createDataFrame(list(r), ROW)


def read(spark, path, kinds=None):
    return sorted((r["video_id"], r["kind"], r["payload"]) for r in sinks.read_artifacts(spark, path, SCHEMA, kinds).collect())


def test_newest_wins_over_appends(spark, tmp_path):
    path = str(tmp_path)
    assert read(spark, path) == []
    sinks.append_artifacts(rows(spark, (1, "flags", "v1", 10, "a"), (1, "segments", "v1", 10, "b"), (2, "flags", "v1", 30, "c")), path)
    sinks.append_artifacts(rows(spark, (1, "flags", "v2", 20, "d"), (2, "flags", "v2", 25, "old"), (3, "flags", "v2", 1, "e")), path)
    want = [(1, "flags", "d"), (1, "segments", "b"), (2, "flags", "c"), (3, "flags", "e")]
    assert read(spark, path) == want
    assert read(spark, path, ["segments"]) == [want[1]] and read(spark, path, ["none"]) == []
    sinks.compact_artifacts(spark, path, SCHEMA)
    assert read(spark, path) == want and len(sinks.batches(spark, path)) == 1
    sinks.append_artifacts(rows(spark, (3, "flags", "v3", 2, "f")), path)
    assert read(spark, path) == want[:3] + [(3, "flags", "f")] and len(sinks.batches(spark, path)) == 2


def test_a_dead_writer_leaves_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    sinks.append_artifacts(rows(spark, (1, "flags", "v1", 10, "a")), path)

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(sinks, "commit", dies)
        with pytest.raises(RuntimeError):
            sinks.append_artifacts(rows(spark, (1, "flags", "v2", 99, "half"), (5, "flags", "v2", 99, "half")), path)
        with pytest.raises(RuntimeError):
            sinks.compact_artifacts(spark, path, SCHEMA)
    assert read(spark, path) == [(1, "flags", "a")]
    sinks.append_artifacts(rows(spark, (1, "flags", "v3", 11, "b")), path)
    assert read(spark, path) == [(1, "flags", "b")]


@pytest.fixture()
def built(spark):
    """Three videos, two of one lecture; one without captions and one without an id."""
    seen = [("ann", 0, "v1", 0.0, 4.0), ("ann", 1, "v2", 0.0, 2.0), ("bob", 0, "v1", 1.0, 3.0), ("bob", 0, "v1", 3.0, 9.0), ("cat", 0, "v2", 5.0, 8.0), ("dan", 0, "v3", 0.0, 9.0), ("eve", 0, "v4", 0.0, 5.0), ("eve", 1, "v5", 0.0, 5.0)]
    watch = spark.createDataFrame(seen, "viewer_id string, entry int, video_id string, start_point double, end_point double")
    ids = spark.createDataFrame([("v1", "x"), ("v2", "x"), ("v3", "y"), ("v4", "nocaption")], "video_id string, ccid string")
    captions = spark.createDataFrame([("x", [0.0, 3.0], [3.0, 6.5], ["a", "b"], 6.5, 2), ("y", [0.0], [4.0], ["c"], 4.0, 1), ("z", [0.0], [4.0], ["d"], 4.0, 1)], "ccid string, start array<double>, end array<double>, text array<string>, duration_s double, lines int")
    limits = {"tol": 2.0, "min_starters": 1, "min_s": 1.0, "max_s": 100.0, "min_lines": 2, "k": 5}
    return watch, captions, sinks.build_curves(watch, ids, captions, limits)


def test_curve_build(built):
    _, _, (lectures, chosen, curve) = built
    assert {(r["video_id"], r["n_viewers"], r["n_starters"]) for r in lectures.collect()} == {("x", 4, 3), ("y", 1, 1)}
    assert [r["video_id"] for r in chosen.collect()] == ["x"]
    # ann twice: 0-4 and 0-2; bob starts in time, so from 0 to the end; cat starts late
    got = [r["watching"] for r in curve.orderBy("t").collect()]
    assert got == [3, 3, 2, 2, 1, 1, 1]


def test_store_and_read(spark, tmp_path, built, monkeypatch):
    _, captions, (lectures, chosen, curve) = built
    folder = f"{tmp_path}/run"
    sinks.store_curves(folder, curve, chosen, captions, {"lectures_seen": lectures.count()}, 0.2)
    curves, said, summary = sinks.read_curves(spark, folder)
    row = curves.first()
    assert row["video_id"] == "x" and row["retention"] == [1.0, 1.0, 0.6667, 0.6667, 0.3333, 0.3333, 0.3333] and row["split"] in ("train", "test")
    assert [r["ccid"] for r in said.collect()] == ["x"]
    assert summary.first().asDict() | {"train": 0, "test": 0} == {"lectures_seen": 2, "lectures_used": 1, "train": 0, "test": 0, "seconds": 7, "captions": 1, "caption_lines": 2}
    assert summary.first()["train"] + summary.first()["test"] == 1


def test_an_unfinished_folder_is_refused(spark, tmp_path, built, monkeypatch):
    _, captions, (_, chosen, curve) = built
    folder = f"{tmp_path}/run"

    def dies(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(sinks, "chosen_captions", dies)
    with pytest.raises(RuntimeError):
        sinks.store_curves(folder, curve, chosen, captions, {}, 0.2)
    with pytest.raises(AnalysisException):
        sinks.read_curves(spark, folder)
