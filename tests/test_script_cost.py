"""Steps of the script path that every text query pays for."""

import pytest
from pyspark.sql import functions as F

from stayline.functions import textcols as tc
from stayline.operators import sentences as sen
from stayline.plans import semantic_queries as sq, text_queries as tq
from stayline.session import configure
from stayline.sources import scripts as src


@pytest.fixture
def told(spark):
    return configure(spark)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_run_is_gathered_as_it_passes(told):
    text = "# A head\nOne two. Three --\n-- four? Mr. Five\n\n- six"
    words = src.script_words(told.createDataFrame([(1, text, "en")], "video_id long, text string, lang string"))
    out = sen.build_sentences(words)
    assert "ObjectHashAggregate" not in plan(out)
    rows = [(r["sent_idx"], r["text"], r["end_reason"]) for r in out.orderBy("sent_idx").collect()]
    assert rows == [(0, "A head", "pause"), (1, "One two.", "punct"), (2, "Three---- four?", "punct"), (3, "Mr. Five", "pause"), (4, "six", "end")]


def test_the_words_are_made_once(told, tmp_path):
    told.createDataFrame([(1, "One two three four. " * 9, "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    out = sq.repeated_sentence_ratio(told, str(tmp_path))
    out.collect()
    reads = out._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert {reads.apply(i).getClass().getSimpleName() for i in range(reads.size())} == {"InMemoryRelation"}


def test_thousandths_as_bround(told):
    at = [0.0, -0.0, -0.0001, 0.0005, 0.0015, 1.0005, 2.0015, 0.1235, 17.6665, 1 / 3, 1e5 + 0.0005, 1e7 + 0.0005, 123456.7895, -2.0005, float("nan"), None]
    df = told.createDataFrame([(x,) for x in at], "t double").unionByName(told.range(200_000).select((F.col("id") / 2000 + F.col("id") * 0.4).alias("t")))
    df = df.unionByName(told.range(200_000).select((F.col("id") / 2000).alias("t")))
    assert df.where(~tc.bround3(F.col("t")).eqNullSafe(F.bround("t", 3))).count() == 0


def test_terminal_tokens(told):
    words = ["one.", 'two."', "three", "mr.", 'Mr.")', '"', "", "...", "end।", "e.g.", "four?)", "a.b", None]
    got = [r["x"] for r in told.createDataFrame([(w,) for w in words], "w string").select(tc.is_terminal(F.col("w")).alias("x")).collect()]
    assert got == [True, True, False, False, False, False, False, True, True, False, True, False, None]


def test_joined_texts(told):
    df = told.createDataFrame([(["a", "b"],), (["中", "文", "a"],), (["é", "b"],), ([],), (None,)], "w array<string>")
    assert [r["x"] for r in df.select(tc.join_tokens(F.col("w")).alias("x")).collect()] == ["a b", "中文 a", "é b", "", None]


@pytest.mark.parametrize("soft", [True, False])
def test_words_are_sorted_once(told, soft):
    """Runs, and then sentences with their words, were each sorted anew, which large partitions could not hold."""
    words = src.script_words(told.createDataFrame([(1, "One two. Three", "en")], "video_id long, text string, lang string"))
    above = plan(sen.sentences_with_words(words, soft)).split("posexplode(tokens")[0]
    assert above.count("Sort [") == 1


def test_a_transcript_with_missing_numbers(told):
    """Word numbers may leave gaps between runs; a run without an end mark is cut where it gets too long."""
    rows = [(1, n, f"w{n}" + ("." if n == 12 else ""), n * 1.0, n + 0.9, False, False) for n in [*range(3, 13), *range(20, 45)]]
    words = told.createDataFrame(rows, "video_id long, word_idx int, text string, start double, end double, paragraph_break boolean, phrase_break boolean")
    got = [(r["sent_idx"], r["word_start"], r["word_end"], r["end_reason"]) for r in sen.build_sentences(words).orderBy("sent_idx").collect()]
    assert got == [(0, 3, 13, "punct"), (1, 20, 36, "max_length"), (2, 36, 45, "end")]


def test_tasks_by_the_size_of_the_texts(told, monkeypatch):
    """With a fixed number of tasks each got more words to sort as the corpus grew."""
    df = told.createDataFrame([(i, "word " * 20, "en") for i in range(50)], "video_id long, text string, lang string")
    n = int(told.conf.get("spark.sql.shuffle.partitions"))
    assert src.place_by_video(df).rdd.getNumPartitions() == n
    monkeypatch.setattr(src, "TASK_TEXT", 400)
    assert src.place_by_video(df).rdd.getNumPartitions() == 13
    assert src.place_by_video(df.where("false")).rdd.getNumPartitions() == n


def test_kept_sentences_hold_each_text_once(told, tmp_path):
    told.createDataFrame([(1, "One two three four. Five", "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    out = tq.segment_text_agg(told, str(tmp_path))
    kept = [x for x in plan(out).split("InMemoryRelation [")[1:]]
    assert kept and all("at#" in x.split("]")[0] and "ws#" not in x.split("]")[0] for x in kept)
    assert [(r["idx"], r["word_count"]) for r in out.collect()] == [(0, 5)]
