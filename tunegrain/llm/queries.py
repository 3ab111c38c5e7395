"""The registered queries of the operators, and their SQL twins where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunegrain.llm import (
    curve_search, embedding_dups, jaccard_join, language_id, license_scan, mixing, packing, source_audit, suffix_dedup, topk, toxicity,
    url_filter, va_clusters,
)
from tunegrain.llm.oracles import ORACLES as ORACLES


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _remainder(divisor: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(_read(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict", "odds")


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = _read(spark, folder, "documents")
    found = language_id.predict(documents, language_id.learn(documents, _remainder(4) != 2))
    return found.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_embedding_near_dups(spark: SparkSession, folder: str) -> DataFrame:
    found = embedding_dups.near_duplicates(_read(spark, folder, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = _read(spark, folder, "documents")
    model = toxicity.learn(documents, _read(spark, folder, "labels"), _remainder(5) != 0)
    held = F.coalesce(_remainder(5) == 0, F.lit(False))
    return toxicity.score(documents, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op5_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard_join.join(_read(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    facts, _ = suffix_dedup.dedup(_read(spark, folder, "documents"))
    return facts.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.col("sha").alias("kept_sha256"))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.select(_read(spark, folder, "documents"))


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = license_scan.scan(_read(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "digest", "license", "line_licenses")


def op9_topk_products(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(_read(spark, folder, "embeddings"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_read(spark, folder, "documents"))


def op11_curve_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return curve_search.search(_read(spark, folder, "embeddings"))


def op12_source_audit(spark: SparkSession, folder: str) -> DataFrame:
    return source_audit.audit(_read(spark, folder, "documents"))


def op13_va_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return va_clusters.cluster(_read(spark, folder, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_language_id, op3_embedding_near_dups, op4_toxicity, op5_ngram_jaccard, op6_suffix_dedup, op7_mixing,
        op8_license_scan, op9_topk_products, op10_packing, op11_curve_neighbours, op12_source_audit, op13_va_clusters,
    )
}
