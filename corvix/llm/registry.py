"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common, decontaminate, language, linededup, neardup, packing, ppm, sharding, toxicity, vafile, wavelet


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _common.bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op2_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(_table(spark, sf_dir, "documents"))


def op3_family_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.digest(_table(spark, sf_dir, "documents"))


def op4_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(_table(spark, sf_dir, "documents"))


def op5_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.digest(_table(spark, sf_dir, "documents"))


def op9_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.digest(_table(spark, sf_dir, "embeddings"))


def op10_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {
        "op1_superminhash": op1_superminhash,
        "op2_two_pass_shuffle": op2_two_pass_shuffle,
        "op3_family_svm": op3_family_svm,
        "op4_line_bitmaps": op4_line_bitmaps,
        "op5_suffix_automaton": op5_suffix_automaton,
        "op6_tiered_packing": op6_tiered_packing,
        "op7_wavelet_matrix": op7_wavelet_matrix,
        "op8_ppm": op8_ppm,
        "op9_va_file": op9_va_file,
        "op10_boosted_toxicity": op10_boosted_toxicity,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_superminhash": neardup.ORACLE_SQL,
        "op4_line_bitmaps": linededup.ORACLE_SQL,
        "op5_suffix_automaton": decontaminate.ORACLE_SQL,
        "op9_va_file": vafile.ORACLE_SQL,
    }
