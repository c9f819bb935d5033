"""A corpus pipeline: toxicity filter, line dedup, near-dedup, decontamination and packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return
the columns of documents. Rows that share a doc_id are parts of one document for the line and near-dedup stages and
rows of their own for the others; null texts and empty tables pass; columns that documents doesn't have are left out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvix.llm import decontaminate, linededup, neardup, packing, toxicity
from corvix.llm._common import bounded_batches, written

#: Parts of texts whose ids a packing worker keeps: fewer than it may alone, as executors hold what other stages left.
KEPT = 300_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, doesn't predict to be toxic."""
    bounded_batches(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; lines found in three or more of them stay in the one with the largest doc_id only."""
    out = linededup.dedup_lines(docs.select(*COLUMNS))
    changed = F.col("n_dropped") > 0
    return out.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group linked by a similarity of 0.8 or more.

    Rows that share a doc_id are one document; rows without one stay.
    """
    bounded_batches(spark)
    found = neardup.near_duplicates(docs, percent=80).where("kept").select("doc_id").distinct()
    kept = docs.select(*COLUMNS).join(found, "doc_id", "left_semi")
    return kept.unionByName(docs.select(*COLUMNS).where("doc_id is null")).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stands in passages of test items, without these passages."""
    bounded_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = decontaminate.remove_spans(docs.select(*COLUMNS, F.col("text").alias("_before")), benchmark)
    changed = ~F.col("text").eqNullSafe(F.col("_before"))
    return out.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, packed into sequences."""
    bounded_batches(spark)
    return packing.digest(docs, public_tokenizers.path("byte_bpe_50k.json"), kept=KEPT)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what a stage returns is written before the next one starts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
