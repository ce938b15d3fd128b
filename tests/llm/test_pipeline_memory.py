"""The executor's memory that the pipeline's Python steps may take."""

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as cp


def test_every_stage_sends_texts_in_small_batches(spark):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"))
    many = spark.range(0, 3000, 1, 1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for name, stage in cp.STAGES[:-1]:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
            stage(spark, docs, "")
            got = many.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int32())], names=["n"]) for b in batches), "n int")
            assert max(r["n"] for r in got.collect()) == cp.BATCH_ROWS, name
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
