"""Blending vector and lexical result lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scores import minmax
from ..functions.vectors import shown
from ..plans.config import HybridRankingPolicy
from .merge import dedup
from .scan import ranked


def normalized(results: DataFrame) -> DataFrame:
    """results with norm, each query's scores scaled to 0 (best) to 1."""
    return results.withColumn("norm", minmax(F.col("score"), W.partitionBy("qid")))


def blend(vector: DataFrame, lexical: DataFrame, policy: HybridRankingPolicy | None = None, k: int = 10) -> DataFrame:
    """(qid, rank, id, score[, metadata]): weighted mean of both lists' normalised scores, the k best.

    An id that a list lacks counts as 1.0 there. Ids are made unique in each list first; metadata is the vector
    list's, else the lexical one's.
    """
    policy = policy or HybridRankingPolicy()
    wv, wb = policy.vector_weight, policy.bm25_weight
    columns = [c for c in ("metadata",) if c in vector.columns or c in lexical.columns]

    def side(df: DataFrame, name: str) -> DataFrame:
        own = df.select("qid", "id", "score", *[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])
        return normalized(dedup(own)).select("qid", "id", F.col("norm").alias(f"n_{name}"), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    both = side(vector, "v").join(side(lexical, "b"), ["qid", "id"], "full_outer")
    score = (F.coalesce("n_v", F.lit(1.0)) * wv + F.coalesce("n_b", F.lit(1.0)) * wb) / (wv + wb)
    blended = both.select("qid", "id", score.alias("score"), *[F.coalesce(f"{c}_v", f"{c}_b").alias(c) for c in columns])
    return ranked(blended, k).select("qid", "rank", "id", shown(F.col("score")).alias("score"), *columns)
