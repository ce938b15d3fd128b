"""The registered queries opN_<name>: each operator on its whole table, with the digest columns derived here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stayline.llm import decontaminate, divergence, fingerprint, html, language, lines, mixing, near, packing, search, substrings, toxicity, vectors
from stayline.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = language.train(language.not_held_out(docs))
    held_out = F.expr("coalesce(crc32(cast(doc_id AS string)) % 3 = 1, false)").alias("held_out")
    return language.identify(docs, model, "doc_id").select("doc_id", held_out, "lang_pred", "score", "ambiguous")


def op2_document_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf, "documents"))


def op3_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.drop_repeats(table(spark, sf, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf, "embeddings"))


def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels").where("crc32(cast(doc_id AS string)) % 4 <> 2").select("doc_id", "toxic")
    model = toxicity.train(docs, labels)
    got = toxicity.scored(docs, model)
    return got.select(
        "doc_id",
        F.expr("coalesce(crc32(cast(doc_id AS string)) % 4 = 2, false)").alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


def op6_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    got = html.extracted(pages, html.train(pages))
    return got.withColumn("n_chars", F.length("text").cast("long"))


def op7_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    got = lines.drop_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return got.select(
        "doc_id",
        F.col("_n_lines").cast("long").alias("n_lines"),
        F.col("_n_dropped").cast("long").alias("n_dropped"),
        F.sha2(F.coalesce("_kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def op8_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    got = near.near_classes(table(spark, sf, "documents"), near.ALIKE)
    return got.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op9_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), tokenizer_path())


def op10_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents").select("doc_id", "source"))


def op11_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    got = decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return got.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op12_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.divergence(table(spark, sf, "documents"))


def op13_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_document_fingerprints, op3_suffix_array_dedup, op4_embedding_near_dedup, op5_toxicity, op6_html_extraction,
        op7_line_dedup, op8_minhash_near_dedup, op9_best_fit_packing, op10_source_mixing, op11_benchmark_decontamination, op12_source_divergence,
        op13_ranked_search, pipeline,
    )
}
