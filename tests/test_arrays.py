"""Arrays to rows, and what the optimizer makes of it."""

import re

from pyspark.sql import functions as F

from stayline.functions.arrays import spread
from stayline.operators import segments as seg, text as txt


def _plan(df):
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", 10000)
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_spread_is_explode(spark):
    df = spark.createDataFrame([(1, ["a", None, "b"]), (2, []), (3, None)], "id int, xs array<string>")
    got = sorted(map(tuple, spread(df, "xs", "x", "id", pos="at").collect()))
    assert got == sorted(map(tuple, df.select("id", F.posexplode("xs").alias("at", "x")).select("id", "at", "x").collect()))
    assert spread(df, "xs", "x", "id").columns == ["id", "x"]


def _units(spark, n):
    return spark.range(n).selectExpr(
        "1 as video_id", "cast(id as int) as word_start", "cast(id + 1 as int) as word_end", "id * 4D as start", "id * 4D + 3.9D as end",
        "cast(id as int) as sent_idx", "'pause' as boundary", "'x' as text")


def test_costs_of_a_run_are_made_once(spark):
    """A run's edges and costs stand once in the plan, not once more for each use (which grew with the cube of a run)."""
    for packed in (seg.pack_windows(seg.run_extents(_units(spark, 5), None)), seg._packed(seg.run_extents(_units(spark, 5), None), None)):
        assert len(re.findall("forced_split", _plan(packed))) == 1
    got = seg.pack_windows(seg.run_extents(_units(spark, 600), None)).agg(F.count("*"), F.min("start"), F.max("end")).first()
    assert tuple(got) == (200, 0.0, 599 * 4 + 3.9 + 0.5)


def test_weights_of_a_sentence_are_made_once(spark):
    sents = spark.createDataFrame([(1, 0, ["alpha", "beta", "gamma", "delta"])], "video_id int, sent_idx int, tokens array<string>")
    occ = txt.phrase_occurrences(sents.repartition(2))
    assert _plan(occ).count("concat_ws") == 1
    assert [r["phrase"] for r in occ.orderBy("pos").collect()] == ["alpha beta gamma", "beta gamma delta"]
