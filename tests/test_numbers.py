"""Numbers in the digits of any script are guarded."""

from pyspark.sql import functions as F

from stayline.operators.scores import NUMBER


def test_digits_of_any_script(spark):
    row = spark.createDataFrame([("४५% and 45%",)], "t string").select(F.regexp_extract_all("t", F.lit(NUMBER), F.lit(1)).alias("n")).first()
    assert row["n"] == ["४५%", "45%"]
