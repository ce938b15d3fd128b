"""Helpers shared by the operators: tables, lineage cuts, ranks without hot tasks, components."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: a table joined by broadcast is counted first and may hold this many bytes at most
BROADCAST_BYTES = 32 << 20
#: ranges in which ranks are counted apart
SLICES = 4096
#: white space of the word contracts, as a regular expression class
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; one of our own only on one machine, if unset."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if configured is None and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    return configured or sc.getCheckpointDir()


def reliable(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the shared folder; executors may come and go."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def maybe_broadcast(df: DataFrame, row_bytes: int) -> DataFrame:
    """Mark a checkpointed table for broadcast if its counted size is small; else leave it to a shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def spread_rank(df: DataFrame, key: str, ident: Column) -> DataFrame:
    """Add `_rank`, from 0, of each row among those with its key, in the order of md5(ident).

    Ranks are counted inside 4096 md5 prefixes and carried over, so a key that holds a third of all
    rows is ranked by many tasks. `df` is read twice and must give the same rows each time.
    """
    marked = df.withColumn("_md5", F.md5(ident.cast("string"))).withColumn("_slice", F.substring("_md5", 1, 3))
    return _sliced_rank(marked, key, "_md5").drop("_md5")


def ordered_rank(df: DataFrame, key: str, by: str, *then: str) -> DataFrame:
    """Add `_rank`, from 0, of each row among those with its key, in the order of `by` (whole numbers from 0) and `then`.

    As spread_rank, with equal ranges of `by` for the prefixes.
    """
    width = (df.agg(F.max(by)).first()[0] or 0) // SLICES + 1
    return _sliced_rank(df.withColumn("_slice", F.expr(f"`{by}` div {width}")), key, by, *then)


def _sliced_rank(marked: DataFrame, key: str, *order: str) -> DataFrame:
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        marked.groupBy(key, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(key, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = F.row_number().over(Window.partitionBy(key, "_slice").orderBy(*order))
    return (
        marked.withColumn("_inside", inside)
        .join(sizes, [key, "_slice"])
        .withColumn("_rank", F.col("_before") + F.col("_inside") - 1)
        .drop("_slice", "_inside", "_before")
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over `edges` (a, b), for every node in them.

    Large-star and small-star steps in turn (each halves the depth) until the edge set stays as it
    is; only edge counts and a checksum come to the driver. Loops and nulls are ignored.
    """
    e = reliable(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    mark = None
    while True:
        found = e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("xxhash64(v, u) % 1000003"))).first()
        if found == mark or found[0] == 0:
            break
        mark = found
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = reliable(small.union(least.select("u", F.col("m").alias("v"))).distinct())
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def slices(batches, rows: int = 500):
    """Arrow batches cut so small that a Python worker holds few texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(batch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def with_row(docs: DataFrame, *needed: str) -> DataFrame:
    """All columns as one struct `row` beside those needed, so that no name of theirs can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *needed)
