"""Recall, precision, balance, routing accuracy, hotness and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import ivf


def hits(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(qid, hits, n_truth, n_found) over the ids of two result lists; repeated ids count once."""
    t = truth.select("qid", "id").distinct().withColumn("_t", F.lit(1))
    f = found.select("qid", "id").distinct().withColumn("_f", F.lit(1))
    both = t.join(f, ["qid", "id"], "full_outer")
    return both.groupBy("qid").agg(F.count_if(F.col("_t").isNotNull() & F.col("_f").isNotNull()).alias("hits"), F.count("_t").alias("n_truth"), F.count("_f").alias("n_found"))


def recall(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(qid, recall); 1.0 where there is nothing to find."""
    return hits(truth, found).select("qid", F.when(F.col("n_truth") == 0, F.lit(1.0)).otherwise(F.col("hits") / F.col("n_truth")).alias("recall"))


def precision(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(qid, precision); 0.0 where nothing was found."""
    return hits(truth, found).select("qid", scores.rate(F.col("hits"), F.col("n_found")).alias("precision"))


def quality(name: str, truth: DataFrame, found: DataFrame) -> DataFrame:
    """One row: name, queries, mean recall and precision."""
    h = hits(truth, found)
    r = F.when(F.col("n_truth") == 0, F.lit(1.0)).otherwise(F.col("hits") / F.col("n_truth"))
    return h.agg(F.count("*").alias("queries"), F.round(F.avg(r), 6).alias("recall"), F.round(F.avg(scores.rate(F.col("hits"), F.col("n_found"))), 6).alias("precision")).select(F.lit(name).alias("name"), "queries", "recall", "precision")


def distribution(sizes: DataFrame, num_shards: int | None = None) -> DataFrame:
    """One row of shard sizes (shard_id, vector_count): least, largest, mean, population deviation, imbalance."""
    n = F.lit(num_shards).cast("long") if num_shards else F.count("*")
    out = sizes.agg(F.min("vector_count").alias("min_size"), F.max("vector_count").alias("max_size"), n.alias("num_shards"), F.sum("vector_count").alias("total"), F.stddev_pop("vector_count").alias("std_dev"))
    mean = F.col("total") / F.col("num_shards")
    return out.select("num_shards", "total", "min_size", "max_size", F.round(mean, 6).alias("mean_size"), F.round("std_dev", 6).alias("std_dev"), F.round(F.col("max_size") / mean, 6).alias("imbalance"))


def hotness(shards: DataFrame, routes: DataFrame, queries: int) -> DataFrame:
    """(shard_id, probes, hotness): probes a query of every shard, those never probed too."""
    joined = shards.select("shard_id").distinct().join(routes.select("qid", "shard_id"), "shard_id", "left")
    return joined.groupBy("shard_id").agg(F.count("qid").alias("probes")).withColumn("hotness", F.round(F.col("probes") / F.lit(max(1, queries)), 6))


def routing_accuracy(truth: DataFrame, vectors: DataFrame, centroids: DataFrame, routes: DataFrame) -> DataFrame:
    """One row: share of queries whose true nearest vector is nearest to the centroid of a routed shard."""
    first = truth.where("rank = 1").select("qid", "id")
    wanted = vectors.select("id", "data").join(first.select("id").distinct(), "id", "left_semi")
    placed = first.join(ivf.assign(wanted, centroids).select("id", "shard_id"), "id")
    hit = placed.join(routes.select("qid", "shard_id", F.lit(1).alias("_hit")), ["qid", "shard_id"], "left")
    return hit.agg(F.count("*").alias("queries"), F.count("_hit").alias("correct"), F.round(F.coalesce(F.avg(F.coalesce("_hit", F.lit(0))), F.lit(0.0)), 6).alias("routing_accuracy"))


def prefetch(probes: DataFrame, min_query_count: int) -> DataFrame:
    """(shard_id, queries) of shards that are probed often enough to be loaded ahead."""
    return probes.groupBy("shard_id").agg(F.count("*").alias("queries")).where(F.col("queries") >= min_query_count)


def latency_histogram(latencies: DataFrame, column: str, bounds: list[float]) -> DataFrame:
    """(le, count): how many values are at most each bound, and +Inf."""
    total = latencies.select(*[F.sum(F.when(F.col(column) <= b, 1).otherwise(0)).alias(str(i)) for i, b in enumerate(bounds)], F.count(column).alias("inf"))
    pairs = [F.struct(F.lit(str(b)).alias("le"), F.coalesce(F.col(str(i)), F.lit(0)).cast("long").alias("count")) for i, b in enumerate(bounds)]
    return total.select(F.explode(F.array(*pairs, F.struct(F.lit("+Inf").alias("le"), F.col("inf").alias("count")))).alias("r")).select("r.*")


def cost(n: int, dims: int, disk_bytes: int, m: int | None = None, k: int | None = None) -> dict[str, float]:
    """Memory, disk and compression ratio of an index, saturating at the largest 64-bit number."""
    most = 2**63 - 1
    if m is None:
        return {"memory_bytes": min(most, n * dims * 4), "disk_bytes": disk_bytes, "compression_ratio": 1.0}
    memory = min(most, n * m + m * k * (dims // m) * 4)
    return {"memory_bytes": memory, "disk_bytes": disk_bytes, "compression_ratio": dims * 4 / m}
