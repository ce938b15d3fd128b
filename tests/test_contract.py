"""The driver contract: names line up and the flagship query runs."""

import __spark_entry__ as entry


def test_sql_only_for_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["video_id", "t", "watching", "retention"] and df.count() > 0
