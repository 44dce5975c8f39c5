"""One query for each operator of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import arc_warc, embedding_join, html_extract, importance, language_id, license_scan, media_jpeg, merge_dropout, ngram_jaccard, oracles, packing, quality_rules, spelling, substring_dedup
from graphloom.llm.sparkkit import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op3_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_jpeg.stored_features(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return license_scan.scan(docs.withColumn("path", F.expr(license_scan.DOCUMENT_PATH)))


def op7_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc_warc.convert(table(spark, sf_dir, "pages")).drop("url")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op9_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dropout.encoded(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_best_fit_packing, op2_ngram_jaccard, op3_progressive_jpeg, op4_html_extraction, op5_quality_rules, op6_license_scan, op7_arc_to_warc, op8_language_id, op9_merge_dropout, op10_substring_dedup, op11_importance_resampling, op12_spelling_variants, op13_embedding_dedup)
}

ORACLE_SQL: dict[str, str] = {"op2_ngram_jaccard": oracles.jaccard(), "op5_quality_rules": oracles.quality(), "op6_license_scan": license_scan.oracle(), "op7_arc_to_warc": oracles.archives(), "op11_importance_resampling": oracles.resampled(), "op12_spelling_variants": oracles.spelling(), "op13_embedding_dedup": oracles.near_embeddings()}
