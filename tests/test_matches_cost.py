"""Matching sentences: made once, and told apart by cheaper expressions with the same meaning."""

from pyspark.sql import functions as F

from stayline.functions.textcols import SPACE, WS
from stayline.operators.semantic import dims
from stayline.plans import semantic_queries as sq
from stayline.session import configure
from stayline.sources.scripts import LINE_BREAK


def test_the_sentences_are_made_once(spark, tmp_path):
    told = configure(spark)
    told.createDataFrame([(1, "One two three four five. " * 40, "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    out = sq.sentence_matches(told, str(tmp_path))
    assert out.count() > 0
    reads = out._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert {reads.apply(i).getClass().getSimpleName() for i in range(reads.size())} == {"InMemoryRelation"}


def test_white_space_and_line_breaks_as_before(spark):
    each = spark.createDataFrame([(chr(i),) for i in [*range(0x3100), *range(0xD700, 0xD800), *range(0xFE00, 0x10100)]], "c string")
    assert each.where(F.col("c").rlike(f"^{SPACE}$") != F.col("c").rlike(f"^{WS}$")).count() == 0
    plain = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
    for around in ("a{}b", "a\r{}b", "a{}\nb", "\r\n{}\r\n\n\r"):
        before, after = around.split("{}")
        text = F.concat(F.lit(before), F.col("c"), F.lit(after))
        assert each.where(~F.split(text, LINE_BREAK).eqNullSafe(F.split(text, plain))).count() == 0


def test_buckets_are_the_first_32_bits_modulo_256(spark):
    words = spark.range(5000).select(F.array(F.col("id").cast("string"), F.lit("é")).alias("t"))
    plain = F.transform("t", lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % 256).cast("int"))
    assert words.where(~dims(F.col("t")).eqNullSafe(plain)).count() == 0
