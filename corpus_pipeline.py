"""A training-text pipeline: each stage works on all that its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the columns of documents; mixing adds
each document's place, mix_slot and mix_offset, by which packing deals the pieces and numbers the sequences.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from stayline.llm import language, lines, mixing, near, packing
from stayline.llm.common import shared_folder, table, with_row
from stayline.llm.queries import tokenizer_path

#: an ambiguous document goes only if no codeword is nearer than this
REJECT_LOSS = 0.75
#: documents that share this many of 100 shingles are near copies (op8 has its own threshold)
NEAR_ALIKE = 80
#: rows sent to Python at once; a batch of texts is held by the executor and by its worker
BATCH_ROWS = 1000


def in_small_batches(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return wraps(stage)(run_stage)


@in_small_batches
def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without a letter, or near to no codeword, go."""
    model = language.train(language.not_held_out(docs))
    known = language.identify(with_row(docs), model, "row")
    far = F.col("ambiguous") & (F.col("loss") >= REJECT_LOSS)
    return known.where((F.col("lang_pred") != "und") & ~far).select("row.*")


@in_small_batches
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines seen earlier; one that loses all its lines goes, one that was blank stays."""
    got = lines.drop_lines(with_row(docs, "doc_id", "text")).where(r"_n_dropped = 0 OR _kept RLIKE '\\S'")
    fresh = {"text": F.col("_kept")}
    if "n_chars" in docs.columns:
        length = F.length("_kept").cast(docs.schema["n_chars"].dataType)
        fresh["n_chars"] = F.when(F.col("_n_dropped") > 0, length).otherwise(F.col("row.n_chars"))
    return got.select(*[fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


@in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near.keep_first(with_row(docs, "doc_id", "text"), NEAR_ALIKE).select("row.*")


@in_small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their places in an order in which the sources come at their target weights."""
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in mixing.PLACE]
    return mixing.mixed(with_row(docs, "doc_id", "source")).select(*kept, *mixing.PLACE)


@in_small_batches
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences, which come in the order of mixing."""
    return packing.pack(docs, tokenizer_path(), order=F.col("mix_slot") * mixing.BLOCK + F.col("mix_offset"))


STAGES = [
    ("language_id", keep_known_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: hashed n-gram classifiers and a tokenizer decide the rows; no SQL expresses them
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
