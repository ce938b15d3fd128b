"""Tables written by the jobs."""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from stayline.operators.watch import coverage_diff, curve_arrays, hash_split, qualify_topk, retention_curve, viewer_counts


def curve_rows(curve: DataFrame, chosen: DataFrame, fraction: float) -> DataFrame:
    """One row per chosen lecture: split, counts, duration and the rounded curve."""
    arrays = curve_arrays(curve)
    return chosen.join(arrays, "video_id").select(
        "video_id", hash_split(F.col("video_id"), fraction).alias("split"), "n_starters", "n_viewers",
        F.bround("duration_s", 3).alias("duration_s"), F.transform("r", lambda x: F.bround(x, 4)).alias("retention"))


def chosen_captions(captions: DataFrame, chosen: DataFrame) -> DataFrame:
    """Captions of the chosen lectures only."""
    return captions.join(chosen.select(F.col("video_id").alias("ccid")), "ccid", "left_semi")


def captioned(watch: DataFrame, id_map: DataFrame, captions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Watch intervals under their caption ids, and (video_id, duration_s, lines) of the captions.

    Intervals of videos without a caption id, or whose captions are not there, are left out. Several videos may
    share one caption id; each viewing stays an entry of its own.
    """
    meta = captions.select(F.col("ccid").alias("video_id"), "duration_s", "lines")
    ids = id_map.select(F.col("video_id").alias("_video"), F.col("ccid").alias("video_id")).join(meta.select("video_id"), "video_id", "left_semi")
    entry = F.concat_ws(":", F.col("_video"), F.col("entry").cast("string"))
    x = watch.withColumnRenamed("video_id", "_video").join(ids, "_video")
    return x.select("viewer_id", entry.alias("entry"), "video_id", "start_point", "end_point"), meta


def build_curves(watch: DataFrame, id_map: DataFrame, captions: DataFrame, limits: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lectures, chosen, curve): logs, id map and captions to the curves of the chosen lectures.

    ``limits``: tol, min_starters, min_s, max_s, min_lines, k. Only intervals of chosen lectures, few by
    definition, are merged into curves.
    """
    own, meta = captioned(watch, id_map, captions)
    lectures = viewer_counts(own, limits["tol"]).join(meta, "video_id")
    chosen = qualify_topk(lectures, limits["min_starters"], limits["min_s"], limits["max_s"], limits["min_lines"], limits["k"])
    held = own.join(F.broadcast(chosen.select("video_id")), "video_id")  # at most k ids
    return lectures, chosen, retention_curve(coverage_diff(held, chosen, limits["tol"]), chosen)


def store_curves(folder: str, curve: DataFrame, chosen: DataFrame, captions: DataFrame, counts: dict, fraction: float) -> None:
    """Write curves by split, the captions of the same lectures, and one summary row with what the writes counted.

    ``counts`` go into the summary. The summary is written last: a folder without one is not finished, and
    ``read_curves`` refuses it, so a writer that dies leaves nothing that is taken for a result.
    """
    spark = curve.sparkSession
    written, said = Observation(), Observation()
    rows = curve_rows(curve, chosen, fraction).observe(
        written, F.count(F.lit(1)).alias("lectures_used"), F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test"),
        F.coalesce(F.sum(F.size("retention")), F.lit(0)).alias("seconds"),
    )
    rows.write.mode("overwrite").partitionBy("split").parquet(f"{folder}/curves")
    lines = chosen_captions(captions, chosen).observe(said, F.count(F.lit(1)).alias("captions"), F.coalesce(F.sum(F.size("text")), F.lit(0)).alias("caption_lines"))
    lines.write.mode("overwrite").parquet(f"{folder}/captions")
    summary = {k: int(v) for k, v in {**counts, **written.get, **said.get}.items()}
    spark.createDataFrame([tuple(summary.values())], ", ".join(f"{k} long" for k in summary)).coalesce(1).write.mode("overwrite").parquet(f"{folder}/summary")


def read_curves(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(curves, captions, summary) of a finished folder; ``split`` prunes the curves."""
    summary = spark.read.parquet(f"{folder}/summary")
    return spark.read.parquet(f"{folder}/curves"), spark.read.parquet(f"{folder}/captions"), summary


def run_summary(watch: DataFrame, lectures: DataFrame, chosen: DataFrame, fraction: float) -> DataFrame:
    """One row: viewers read, lectures seen and used, split sizes."""
    read = watch.groupBy("viewer_id").agg(F.lit(1).alias("one")).agg(F.count(F.lit(1)).alias("viewers_read"), F.lit(1).alias("_k"))
    seen = lectures.agg(F.count(F.lit(1)).alias("lectures_seen"), F.lit(1).alias("_k"))
    split = hash_split(F.col("video_id"), fraction)
    used = chosen.agg(
        F.count(F.lit(1)).alias("lectures_used"), F.count_if(split == "train").alias("train"), F.count_if(split == "test").alias("test"), F.lit(1).alias("_k"))
    return read.join(seen, "_k").join(used, "_k").drop("_k")


def latest_artifacts(artifacts: DataFrame) -> DataFrame:
    """The newest row of every (video_id, kind); a missing artifact has no row. One aggregate, so
    a kind that is rewritten often is reduced before the shuffle."""
    rest = [c for c in artifacts.columns if c not in ("video_id", "kind")]
    newest = F.max(F.struct("created_at", *[c for c in rest if c != "created_at"])).alias("x")
    return artifacts.groupBy("video_id", "kind").agg(newest).select("video_id", "kind", "x.*")


# ---------------------------------------------------------------- artifact store

#: a row for each finished append: its folder, order, kinds, and whether it replaces all before it
LOG = "batch string, at long, kinds array<string>, snapshot boolean"


def append_artifacts(artifacts: DataFrame, path: str, snapshot: bool = False) -> None:
    """Add artifact rows (video_id, kind, version, created_at, ...) as one batch.

    The rows go to a folder of their own; only then a log row names it, in one file. Readers follow the log, so a
    writer that dies before, or a task that runs again, leaves nothing that is read.
    """
    batch = uuid.uuid4().hex
    seen = Observation()
    rows = artifacts.observe(seen, F.collect_set("kind").alias("kinds"))
    rows.write.partitionBy("kind").parquet(f"{path}/data/batch={batch}")
    commit(artifacts.sparkSession, path, (batch, time.time_ns(), sorted(seen.get["kinds"]), snapshot))


def commit(spark: SparkSession, path: str, entry: tuple) -> None:
    spark.createDataFrame([entry], LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")


def batches(spark: SparkSession, path: str) -> list:
    """Log rows that count, oldest first: the last snapshot and what came after it. Bounded by `compact_artifacts`."""
    try:
        log = spark.read.schema(LOG).parquet(f"{path}/log").orderBy("at", "batch").collect()
    except AnalysisException:  # nothing was ever appended
        return []
    last = max((i for i, r in enumerate(log) if r["snapshot"]), default=0)
    return log[last:]


def read_artifacts(spark: SparkSession, path: str, schema: str, kinds: list[str] | None = None) -> DataFrame:
    """The newest row of every (video_id, kind) of the finished batches; other kinds and batches are not opened."""
    live = [r["batch"] for r in batches(spark, path) if kinds is None or set(kinds) & set(r["kinds"])]
    if not live:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*[f"{path}/data/batch={b}" for b in live]).drop("batch")
    rows = rows if kinds is None else rows.where(F.col("kind").isin(kinds))
    return latest_artifacts(rows)


def compact_artifacts(spark: SparkSession, path: str, schema: str) -> None:
    """Replace all batches by one that holds the newest rows."""
    append_artifacts(read_artifacts(spark, path, schema), path, snapshot=True)
