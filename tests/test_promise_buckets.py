"""Promises compared by token buckets instead of dense vectors."""

from pyspark.sql import functions as F

from stayline.operators import promises as pr, semantic as sem
from stayline.plans import detect_queries as dq

LINES = [
    (1, 0, 0.0, 4.0, "today we will build a red kite"), (1, 1, 5.0, 9.0, "nothing of that here"), (1, 2, 40.0, 44.0, "so build a red kite today"),
    (1, 3, 50.0, 55.0, ""), (1, 4, 60.0, 66.0, "kite kite red wind"), (2, 0, 0.0, 3.0, "build a boat"), (2, 1, 30.0, 33.0, "the boat floats"),
]
TITLES = [(1, "Build a red kite"), (2, "")]


def _tables(spark, vec, make):
    s = spark.createDataFrame(LINES, "video_id int, sent_idx int, start double, end double, text string").withColumn("tokens", F.filter(F.split("text", " "), lambda x: x != ""))
    t = spark.createDataFrame(TITLES, "video_id int, title string").withColumn(f"title_{vec}", make(F.filter(F.split(F.lower("title"), " "), lambda x: x != "")))
    return t, s.withColumn(vec, make(F.col("tokens")))


def test_buckets_give_what_vectors_give(spark):
    found = []
    for vec, make in (("emb", sem.hash_embed), ("dims", sem.dims)):
        titles, sents = _tables(spark, vec, make)
        check = pr.promise_check(titles, sents)
        ledger = pr.promise_ledger(sents, check)
        found.append((sorted(map(tuple, check.collect())), sorted(map(repr, ledger.collect()))))
    assert found[0] == found[1]
    assert found[1][0][0][2] == 40.0 or found[1][0][0][2] == 0.0
    assert found[1][0][1][2] is None


def test_script_sentences_carry_no_vectors(spark):
    s, titles = dq.script_lines(spark, "/root/testdata/sf0.001")
    assert "array<double>" not in {t for df in (s, titles) for _, t in df.dtypes}
