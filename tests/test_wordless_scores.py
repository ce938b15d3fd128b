"""Documents without a word among the scored ones: nothing divides by zero, and they rank as in the SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

DOCS = [(1, "aa bb", "en", "s", 5), (2, "", "en", "s", 0), (3, " \t ", "en", "s", 3), (4, "abc", "en", "s", 3), (5, "no label", "de", "s", 8)]
LABELS = [(1, 1, 0), (2, 0, 0), (3, 1, 0), (4, 0, 0)]
WANT = {"pair_auc": [("all", 2, 2, 0.25), ("en", 2, 2, 0.25)], "best_f1": [(0.666667, 2.5, 0.5, 1.0)], "choose_model": [("en", 0.25, 4)]}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("wordless")
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame(LABELS, "doc_id long, quality long, toxic long").write.parquet(str(at / "labels.parquet"))
    return str(at)


@pytest.mark.parametrize("name", WANT)
def test_wordless_documents(spark, folder, name):
    got = sorted(map(tuple, entry.queries()[name](spark, folder).collect()))
    assert got == WANT[name]
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    assert sorted(con.execute(entry.oracle_sql()[name]).fetchall()) == WANT[name]
