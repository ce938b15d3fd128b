"""Media-probe records and upload checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values
MIN_S, MAX_S = 60.0, 1200.0
TESTED_MIN_S, TESTED_MAX_S = 300.0, 900.0
MAX_SCRIPT_BYTES, MAX_UPLOAD_BYTES = 1_048_576, 4_294_967_296
VIDEO_EXTENSIONS, SCRIPT_EXTENSIONS = [".mp4", ".mov"], [".txt", ".md"]
PROBE_SCHEMA = (
    "format STRUCT<duration STRING, format_name STRING>, streams ARRAY<STRUCT<codec_type STRING, avg_frame_rate STRING, "
    "width INT, height INT, sample_rate STRING, channels INT, duration STRING>>"
)


def parse_media(probes: DataFrame, col: str = "value") -> DataFrame:
    """Probe JSON -> typed columns from the first video and first audio stream."""
    x = probes.withColumn("_d", F.from_json(F.col(col), PROBE_SCHEMA))

    def first(kind: str) -> Column:
        return F.get(F.filter("_d.streams", lambda s: s["codec_type"] == kind), F.lit(0))

    x = x.withColumns({"_v": first("video"), "_a": first("audio")})
    parts = F.split("_v.avg_frame_rate", "/")
    num, den = F.get(parts, F.lit(0)).try_cast("double"), F.coalesce(F.get(parts, F.lit(1)), F.lit("1")).try_cast("double")
    fps = F.when(F.col("_v.avg_frame_rate") != "0/0", F.bround(F.try_divide(num, den), 3))
    length = F.coalesce("_d.format.duration", F.coalesce("_v", "_a")["duration"], F.lit("0")).cast("double")
    return x.select(
        *[c for c in probes.columns if c != col],
        F.bround(length, 3).alias("duration_s"), F.col("_a").isNotNull().alias("has_audio"), F.col("_v").isNotNull().alias("has_video"),
        fps.alias("fps"), F.col("_v.width").alias("width"), F.col("_v.height").alias("height"),
        F.col("_a.sample_rate").cast("int").alias("audio_sample_rate"), F.col("_a.channels").alias("audio_channels"),
        F.col("_d.format.format_name").alias("container"))


def gate(uploads: DataFrame) -> DataFrame:
    """Adds status (accepted / rejected), reasons and warnings. ``uploads``: source_type, filename,
    duration_s, has_audio, n_bytes, has_nul, blank."""
    ext = F.lower(F.regexp_extract("filename", r"(\.[^.]*)$", 1))
    video, d = F.col("source_type") == "video", F.col("duration_s")
    secs = F.bround(d).cast("long").cast("string")
    reasons = F.array_compact(F.array(
        F.when(video & ~ext.isin(VIDEO_EXTENSIONS), F.concat(F.lit("unsupported video type '"), ext, F.lit("'; use MP4 or MOV"))),
        F.when(video & (F.col("n_bytes") > MAX_UPLOAD_BYTES), F.lit("file too large")),
        F.when(video & ~F.col("has_audio"), F.lit("video has no audio track")),
        F.when(video & (d < MIN_S), F.concat(F.lit("too short: "), secs, F.lit(f"s (minimum {MIN_S:.0f}s)"))),
        F.when(video & (d > MAX_S), F.concat(F.lit("too long: "), secs, F.lit(f"s (maximum {MAX_S:.0f}s)"))),
        F.when(~video & ~ext.isin(SCRIPT_EXTENSIONS), F.concat(F.lit("unsupported script type '"), ext, F.lit("'; use TXT or MD"))),
        F.when(~video & (F.col("n_bytes") > MAX_SCRIPT_BYTES), F.lit("script too large")),
        F.when(~video & F.col("has_nul"), F.lit("script is not a text file")),
        F.when(~video & F.col("blank"), F.lit("script is empty")),
    ))
    x = uploads.withColumn("reasons", reasons).withColumn("status", F.when(F.size("reasons") == 0, "accepted").otherwise("rejected"))
    minutes = F.bround(d / 60, 1).cast("string")
    outside = (F.col("status") == "accepted") & ~d.between(TESTED_MIN_S, TESTED_MAX_S)
    what = F.when(video, "Duration ").otherwise("Estimated spoken length ")
    warn = F.concat(what, minutes, F.lit(" min is outside the tested 5–15 min range; results may be less reliable."))
    return x.withColumn("warnings", F.array_compact(F.array(F.when(outside, warn))))
