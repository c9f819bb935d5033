"""Merging, deduplicating and reranking result lists (qid, id, score[, metadata])."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import distance, shown
from .scan import ranked


def dedup(results: DataFrame) -> DataFrame:
    """One row for each (qid, id): its lowest score and, if there is metadata, that of this row."""
    best = [F.min("score").alias("score")]
    if "metadata" in results.columns:
        best.append(F.min_by("metadata", F.struct("score", "metadata")).alias("metadata"))
    return results.groupBy("qid", "id").agg(*best)


def merge(lists: list[DataFrame], k: int) -> DataFrame:
    """The k best of several lists, each id once, by (score, id); nothing for k = 0."""
    return ranked(dedup(reduce(DataFrame.unionByName, lists)), k)


def rerank(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, metric: str, k: int | None = None, keep_missing: bool = False) -> DataFrame:
    """Candidates with exact scores, by (score, id).

    Those without a vector are dropped, or keep their score with keep_missing.
    """
    stored = vectors.select("id", "data")
    joined = dedup(candidates).join(stored, "id", "left" if keep_missing else "inner").join(queries.select("qid", "q"), "qid")
    exact = distance(metric, F.col("q"), F.col("data"))
    score = F.when(F.col("data").isNull(), F.col("score")).otherwise(exact) if keep_missing else exact
    return ranked(joined.withColumn("score", score).drop("data", "q"), k)


def rerank_target(k: int, rerank_limit: int | None, oversample: int, reranking: bool) -> int:
    """Candidates to fetch: rerank_limit or k * oversample, k at least; just k without a reranker."""
    if not reranking:
        return k
    return max(k, rerank_limit if rerank_limit is not None else k * oversample)


def with_metadata(results: DataFrame, metadata: DataFrame) -> DataFrame:
    """results with metadata (id, metadata) where theirs is null."""
    own = F.col("metadata") if "metadata" in results.columns else F.lit(None).cast("string")
    joined = results.withColumn("_own", own).drop("metadata").join(metadata.select("id", "metadata"), "id", "left")
    return joined.withColumn("metadata", F.coalesce("_own", "metadata")).drop("_own")


def final(results: DataFrame) -> DataFrame:
    return results.withColumn("score", shown(F.col("score")))
