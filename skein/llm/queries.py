"""The subpackage's queries for __spark_entry__.py: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.llm import bpe, context_mixing, gif, knn_quality, language_id, lexical, license_scan, mixing, oracles, pii, quality_rules, simhash, substring, vector_codes
from skein.llm.text import documents


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(documents(spark, sf_dir))


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.digest(documents(spark, sf_dir))


def op3_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_quality.digest(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.digest(documents(spark, sf_dir))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(documents(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(documents(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(documents(spark, sf_dir))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(documents(spark, sf_dir))


def op11_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.digest(documents(spark, sf_dir))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring": op1_substring,
        "op2_context_mixing": op2_context_mixing,
        "op3_knn_quality": op3_knn_quality,
        "op4_gif": op4_gif,
        "op5_simhash": op5_simhash,
        "op6_pii": op6_pii,
        "op7_license_scan": op7_license_scan,
        "op8_mixing": op8_mixing,
        "op9_bpe": op9_bpe,
        "op10_quality_rules": op10_quality_rules,
        "op11_ppm_language": op11_ppm_language,
        "op12_lexical_search": op12_lexical_search,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.SQL
