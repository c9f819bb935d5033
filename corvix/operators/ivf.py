"""K-means partitions: centroids, assignment, compaction, routing and routed search."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..errors import ConfigError
from ..plans.config import FanOutPolicy
from .scan import PAIRS, Exact, knn, matrix, ranked, scan

#: Centroids that one pass compares vectors with.
CENTROID_BLOCK = 16_384
DIGITS = 9


def mean_centroids(vectors: DataFrame, by: str = "label") -> DataFrame:
    """(shard_id, centroid): the mean of each group's vectors, rounded to nine digits."""
    parts = vectors.select(F.col(by).cast("int").alias("shard_id"), F.posexplode(F.col("data").cast("array<double>")).alias("i", "x"))
    means = parts.groupBy("shard_id", "i").agg(F.round(F.avg("x"), DIGITS).alias("x"))
    return means.groupBy("shard_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def seeds(vectors: DataFrame, k: int, seed: int) -> DataFrame:
    """k different rows by the order of md5("seed:id"): a draw without replacement that doesn't depend on partitions."""
    return vectors.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))), "id").limit(k)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the nearest centroid of each row and the squared distance; at most PAIRS distances are held at once."""
    at, best, own = np.zeros(len(x), np.int64), np.zeros(len(x)), (c * c).sum(1)
    step = max(1, PAIRS // max(1, len(c)))
    for a in range(0, len(x), step):
        some = x[a : a + step]
        near = (some * some).sum(1)[:, None] - 2 * (some @ c.T) + own
        at[a : a + step] = near.argmin(1)
        best[a : a + step] = near[np.arange(len(some)), at[a : a + step]]
    return at, best


def _nearest(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, c = shared.value
        for batch in batches:
            given = batch["data"]
            there = given.is_valid().to_numpy(zero_copy_only=False)
            d, number = np.full(len(there), np.nan), np.zeros(len(there), np.int32)
            if there.any():
                at, d[there] = nearest(matrix(given.drop_null()), c)
                number[there] = names[at]
            out = [*batch.columns, pa.array(d, mask=~there), pa.array(number, pa.int32(), mask=~there)]
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names, "_d", "_c"])

    return run


def assign(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """vectors (id, data, ...) with shard_id, that of the nearest centroid by squared L2; ties go to the lowest. Null vectors have none."""
    from pyspark.sql import types as T

    spark = vectors.sparkSession
    out = vectors.drop("shard_id")
    schema, first = out.schema, True
    parts = max(1, math.ceil(centroids.count() / CENTROID_BLOCK))
    ordered = centroids.withColumn("_part", (F.row_number().over(W.orderBy("shard_id")) - 1) % parts) if parts > 1 else centroids
    for part in range(parts):
        rows = sorted((r.shard_id, r.centroid) for r in (ordered.where(F.col("_part") == part) if parts > 1 else ordered).select("shard_id", "centroid").collect())
        if not rows:
            raise ConfigError("there is no centroid")
        shared = spark.sparkContext.broadcast((np.array([i for i, _ in rows], np.int32), np.array([c for _, c in rows], np.float64)))
        kind = T.StructType([*out.schema.fields, T.StructField("_d", T.DoubleType()), T.StructField("_c", T.IntegerType())])
        out = out.mapInArrow(_nearest(shared), kind)
        if first:
            out, first = out.withColumnsRenamed({"_d": "_best", "_c": "shard_id"}), False
        else:
            nearer = F.struct("_d", "_c") < F.struct("_best", "shard_id")
            out = out.withColumn("shard_id", F.when(nearer, F.col("_c")).otherwise(F.col("shard_id"))).withColumn("_best", F.least("_d", "_best")).drop("_d", "_c")
    return out.select(*schema.names, "shard_id")


def _sums(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, c = shared.value
        total, n = np.zeros_like(c), np.zeros(len(c), np.int64)
        for batch in batches:
            x = matrix(batch["data"].drop_null())
            if len(x):
                at, _ = nearest(x, c)
                np.add.at(total, at, x)
                n += np.bincount(at, minlength=len(c))
        used = np.flatnonzero(n)
        yield pa.record_batch([pa.array(names[used], pa.int32()), pa.array(n[used]), pa.array(list(total[used]), pa.list_(pa.float64()))], names=["cid", "n", "total"])

    return run


def lloyd_step(vectors: DataFrame, centroids: list[tuple[int, list[float]]]) -> list[tuple[int, list[float]]]:
    """Means of the vectors nearest to each centroid, rounded to nine digits; a centroid without any stays.

    Each task sums up its vectors, so k rows of it are shuffled and k collected.
    """
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast((np.array([i for i, _ in centroids], np.int32), np.array([c for _, c in centroids], np.float64)))
    parts = vectors.select("data").mapInArrow(_sums(shared), "cid int, n long, total array<double>")
    sums = parts.select("cid", "n", F.posexplode("total").alias("i", "x")).groupBy("cid", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    means = sums.groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.round(F.col("x") / F.col("n"), DIGITS).alias("x")))), lambda s: s["x"]).alias("c"))
    moved = {r.cid: list(r.c) for r in means.collect()}
    return [(i, moved.get(i, c)) for i, c in centroids]


def kmeans(vectors: DataFrame, k: int, iterations: int, seed: int, sample: int | None = None) -> DataFrame:
    """(shard_id, centroid) of Lloyd's algorithm; stops when no centroid moves.

    Seeds are k rows by seeds(); fewer rows give fewer centroids. With `sample`, that many rows train. Null vectors
    teach nothing.
    """
    if k < 1:
        raise ConfigError("k must be at least 1")
    spark = vectors.sparkSession
    vectors = vectors.where("data is not null")
    train = vectors.select("id", "data") if sample is None else seeds(vectors.select("id", "data"), sample, seed + 1)
    first = seeds(train, k, seed).select("data").collect()
    centroids = [(i, [float(x) for x in r.data]) for i, r in enumerate(first)]
    for _ in range(iterations):
        moved = lloyd_step(train, centroids)
        if moved == centroids:
            break
        centroids = moved
    return spark.createDataFrame(centroids, "shard_id int, centroid array<double>")


def compact(assigned: DataFrame, centroids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assigned rows and centroids without empty shards, numbered from 0 without gaps."""
    used = assigned.groupBy("shard_id").count().select("shard_id")
    dense = used.withColumn("dense", (F.row_number().over(W.orderBy("shard_id")) - 1).cast("int"))  # one row a shard
    number = lambda df: df.join(dense, "shard_id").drop("shard_id").withColumnRenamed("dense", "shard_id")
    return number(assigned), number(centroids)


def positioned(assigned: DataFrame, order: str = "pos") -> DataFrame:
    """Assigned rows with shard_pos, their place in the shard by `order`, and shard_size.

    Rows are placed within buckets of the order first, so no task sorts a whole shard.
    """
    within = W.partitionBy("shard_id", "_bucket").orderBy(order, "id")
    bucketed = assigned.withColumn("_bucket", F.floor(F.col(order) / 100_000))
    sizes = bucketed.groupBy("shard_id", "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy("shard_id").orderBy("_bucket")
    starts = sizes.withColumn("_start", F.sum("_n").over(before) - F.col("_n")).withColumn("shard_size", F.sum("_n").over(W.partitionBy("shard_id")))
    placed = bucketed.withColumn("_at", F.row_number().over(within) - 1).join(starts, ["shard_id", "_bucket"])
    return placed.withColumn("shard_pos", F.col("_start") + F.col("_at")).drop("_bucket", "_n", "_start", "_at")


def summary(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("shard_id").agg(F.count("*").alias("vector_count"))


def route(queries: DataFrame, centroids: DataFrame, policy: FanOutPolicy) -> DataFrame:
    """(qid, shard_id, probe_rank): shards of the nearest centroids, by squared L2 whatever the metric.

    Equal distances go to the lower centroid_id (shard_id, where there is none). A shard is taken once, at its first
    centroid; of these the first candidate_shards stay.
    """
    number = "centroid_id" if "centroid_id" in centroids.columns else "shard_id"
    given = centroids.select(F.col(number).cast("long").alias("id"), F.col("centroid").alias("data"), F.col("shard_id").alias("shard"))
    probes = ranked(scan(given, queries, policy.candidate_centroids, Exact("squared_l2")), policy.candidate_centroids)
    shards = probes.join(given.select("id", F.col("shard").alias("shard_id")), "id").groupBy("qid", "shard_id").agg(F.min("rank").alias("probe_rank"))
    if policy.candidate_shards:
        order = W.partitionBy("qid").orderBy("probe_rank")
        shards = shards.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= policy.candidate_shards).drop("_n")
    return shards


def capped(shards: DataFrame, policy: FanOutPolicy) -> DataFrame:
    """Shard rows that a query may read: the first max_vectors_per_shard of each in stored order."""
    return shards.where(F.col("shard_pos") < policy.max_vectors_per_shard) if policy.max_vectors_per_shard else shards


def strided(pos: Column, size: Column, probes: Column) -> Column:
    """Whether a place is one of `probes` evenly strided ones: i * (size - 1) div (probes - 1)."""
    i = F.ceil(pos * (probes - 1) / (size - 1))
    place = F.floor((i * (size - 1)) / (probes - 1))
    return F.when(size <= probes, F.lit(True)).when(probes <= 1, pos == 0).otherwise(place == pos)


def search(shards: DataFrame, centroids: DataFrame, queries: DataFrame, metric: str, k: int, policy: FanOutPolicy | None = None) -> DataFrame:
    """(qid, rank, id, score) from the routed shards only."""
    policy = policy or FanOutPolicy()
    return knn(capped(shards, policy), queries, metric, k, routes=route(queries, centroids, policy))


def strided_search(shards: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, beam: int = 64, policy: FanOutPolicy | None = None) -> DataFrame:
    """Euclidean search over evenly strided rows of the routed shards, max(k, beam) of each at most."""
    policy = policy or FanOutPolicy()
    size = F.least("shard_size", F.lit(policy.max_vectors_per_shard)) if policy.max_vectors_per_shard else F.col("shard_size")
    some = capped(shards, policy).where(strided(F.col("shard_pos"), size, F.least(size, F.lit(max(k, beam)))))
    return knn(some, queries, "euclidean", k, routes=route(queries, centroids, policy))
