"""Builds in three steps: plan which worker owns which shards, execute, merge the outputs with checks."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, MergeError
from ..operators import ivf
from ..sources.ingest import read_dataset
from ..sources.layout import key
from ..sources.manifest import DatasetManifest, IndexManifest
from ..sources.store import HadoopStore
from . import build as building
from .build import BuildParams


@dataclass(frozen=True)
class WorkerPlan:
    index_version: str
    num_workers: int
    num_shards: int
    centroids: list[list[float]]


def assignments(shards: DataFrame, workers: int) -> DataFrame:
    """(shard_id, worker_id): round robin."""
    if workers < 1:
        raise ConfigError("there must be a worker")
    return shards.select("shard_id", F.pmod("shard_id", F.lit(workers)).cast("int").alias("worker_id"))


def _assigned(version: str) -> str:
    return f"indexes/{version}/workers/assigned"


def plan(store: HadoopStore, dataset: DatasetManifest, params: BuildParams, workers: int) -> WorkerPlan:
    """Train and compact centroids, and share shards out; no more workers than shards. Product codes aren't made this way.

    Vectors are assigned here, once; they are stored by shard, so that a worker reads its own only.
    """
    building.check(dataset, params)
    if params.pq:
        raise ConfigError("builds by workers take no product quantisation")
    if workers < 1:
        raise ConfigError("there must be a worker")
    vectors = read_dataset(store, dataset)
    trained = ivf.kmeans(vectors, params.num_shards, params.kmeans_iters, params.kmeans_seed, params.kmeans_sample_size)
    assigned, centroids = ivf.compact(ivf.assign(vectors, trained), trained)
    assigned.hint("rebalance", F.col("shard_id")).write.mode("overwrite").partitionBy("shard_id").parquet(store.path(_assigned(params.index_version)))
    rows = [list(r.centroid) for r in centroids.orderBy("shard_id").collect()]
    out = WorkerPlan(params.index_version, min(workers, len(rows)), len(rows), rows)
    store.put_json(key("worker_plan", params.index_version), asdict(out))
    return out


def centroid_table(store: HadoopStore, plan: WorkerPlan) -> DataFrame:
    return store.spark.createDataFrame(list(enumerate(plan.centroids)), "shard_id int, centroid array<double>")


def execute(store: HadoopStore, dataset: DatasetManifest, plan: WorkerPlan, worker: int) -> dict:
    """Write the rows of a worker's own shards; returns and stores what was written."""
    if not 0 <= worker < plan.num_workers:
        raise ConfigError(f"there is no worker {worker}")
    own = [s for s in range(plan.num_shards) if s % plan.num_workers == worker]
    assigned = store.spark.read.parquet(store.path(_assigned(plan.index_version))).where(F.col("shard_id").isin(own))
    path = f"{store.root}/indexes/{plan.index_version}/workers/{worker:04d}/shards"
    ivf.positioned(assigned).write.mode("overwrite").partitionBy("shard_id").parquet(path)
    counts = store.spark.read.parquet(path).groupBy("shard_id").count().orderBy("shard_id").collect()
    out = {"worker_id": worker, "index_version": plan.index_version, "path": path, "shards": [{"shard_id": r[0], "vector_count": r[1]} for r in counts]}
    store.put_json(key("worker_output", plan.index_version, worker=worker), out)
    return out


def faults(expected: DataFrame, outputs: DataFrame) -> DataFrame:
    """(kind, worker_id, shard_id) of outputs (worker_id, shard_id) that don't fit the expected assignment."""
    e = expected.select("shard_id", F.col("worker_id").alias("planned"))
    missing = e.join(outputs, "shard_id", "left_anti").select(F.lit("missing_shard").alias("kind"), F.col("planned").alias("worker_id"), "shard_id")
    extra = outputs.join(e, "shard_id", "left_anti").select(F.lit("unknown_shard").alias("kind"), "worker_id", "shard_id")
    wrong = outputs.join(e, "shard_id").where("worker_id != planned").select(F.lit("wrong_worker").alias("kind"), "worker_id", "shard_id")
    twice = outputs.groupBy("shard_id").agg(F.count("*").alias("n"), F.min("worker_id").alias("worker_id")).where("n > 1").select(F.lit("duplicate_shard").alias("kind"), "worker_id", "shard_id")
    workers = e.select(F.col("planned").alias("worker_id")).distinct()
    absent = workers.join(outputs.select("worker_id").distinct(), "worker_id", "left_anti").select(F.lit("missing_worker").alias("kind"), "worker_id", F.lit(None).cast("int").alias("shard_id"))
    return missing.unionByName(extra).unionByName(wrong).unionByName(twice).unionByName(absent)


def merge(store: HadoopStore, dataset: DatasetManifest, plan: WorkerPlan, params: BuildParams, outputs: list[dict]) -> IndexManifest:
    """Check the workers' outputs and make one index of them, by one job; the plan's assigned vectors go then."""
    import time

    started = time.time()
    if not outputs:
        raise MergeError("there is no output")
    if any(o["index_version"] != plan.index_version for o in outputs):
        raise MergeError("an output is of another index version")
    ids = [o["worker_id"] for o in outputs]
    if len(set(ids)) < len(ids):
        raise MergeError("a worker has two outputs")
    if any(not 0 <= i < plan.num_workers for i in ids):
        raise MergeError("an output is of an unknown worker")
    spark = store.spark
    expected = assignments(spark.range(plan.num_shards).select(F.col("id").cast("int").alias("shard_id")), plan.num_workers)
    rows = [(o["worker_id"], s["shard_id"]) for o in outputs for s in o["shards"]]
    bad = faults(expected, spark.createDataFrame(rows, "worker_id int, shard_id int")).collect()
    if bad:
        raise MergeError("; ".join(f"{r.kind} (worker {r.worker_id}, shard {r.shard_id})" for r in bad))
    centroids = centroid_table(store, plan)
    centroids.write.mode("overwrite").parquet(store.path(key("index_centroids", plan.index_version)))
    path = store.path(key("index_shards", plan.index_version))
    every = reduce(DataFrame.unionByName, [spark.read.parquet(o["path"]) for o in sorted(outputs, key=lambda o: o["worker_id"])])
    every.hint("rebalance", F.col("shard_id")).sortWithinPartitions("shard_id", "shard_pos").write.mode("overwrite").partitionBy("shard_id").parquet(path)
    manifest = building.describe(dataset, params, spark.read.parquet(path), centroids, started)
    manifest.save(store)
    store.delete(_assigned(plan.index_version))
    return manifest


def run(store: HadoopStore, dataset: DatasetManifest, params: BuildParams, workers: int) -> IndexManifest:
    """Plan, execute and merge within one session."""
    planned = plan(store, dataset, params, workers)
    return merge(store, dataset, planned, params, [execute(store, dataset, planned, w) for w in range(planned.num_workers)])
