"""Benchmarks of a searcher: quality against the exact answer, latency, throughput and cost."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..operators import bm25
from ..operators.hybrid import blend
from ..operators.scan import knn
from ..plans.config import FanOutPolicy, HybridRankingPolicy, QueryConfig
from ..plans.pipeline import Searcher
from ..sources.ingest import read_dataset
from ..sources.manifest import DatasetManifest
from . import metrics


@dataclass(frozen=True)
class Report:
    name: str
    queries: int
    recall: float
    precision: float
    mean_us: float
    p99_us: float
    qps: float
    disk_bytes: int = 0
    memory_bytes: int = 0
    compression_ratio: float = 1.0


def nearest_rank(values: list[float], share: float) -> float:
    return sorted(values)[math.ceil(len(values) * share) - 1] if values else 0.0


def sample_queries(vectors: DataFrame, n: int) -> DataFrame:
    """(qid, q): the first n vectors in stored order."""
    return vectors.orderBy("pos").limit(n).select(F.col("id").alias("qid"), F.col("data").alias("q"))


def ground_truth(vectors: DataFrame, queries: DataFrame, metric: str, k: int) -> DataFrame:
    return knn(vectors, queries, metric, k)


def timed(search: Callable[[DataFrame], DataFrame], queries: DataFrame, workload: str = "mixed") -> tuple[DataFrame, list[float], float]:
    """Results, microseconds of each query by itself, and queries a second.

    cold clears Spark's cache before each query, warm runs all once untimed, mixed does neither.
    """
    if workload not in ("cold", "warm", "mixed"):
        raise ConfigError(f"unknown workload {workload}")
    spark = queries.sparkSession
    rows = queries.collect()
    one = lambda r: spark.createDataFrame([(r.qid, [float(x) for x in r.q])], "qid long, q array<double>")
    if workload == "warm":
        for r in rows:
            search(one(r)).collect()
    took, found, began = [], [], time.perf_counter()
    for r in rows:
        if workload == "cold":
            spark.catalog.clearCache()
        at = time.perf_counter()
        found += [(x.qid, x.rank, x.id, float(x.score)) for x in search(one(r)).select("qid", "rank", "id", "score").collect()]
        took.append((time.perf_counter() - at) * 1e6)
    wall = time.perf_counter() - began
    return spark.createDataFrame(found, "qid long, rank long, id long, score double"), took, len(rows) / wall if wall else 0.0


def report(name: str, truth: DataFrame, found: DataFrame, took: list[float], qps: float, **cost: float) -> Report:
    q = metrics.quality(name, truth, found).first()
    mean = sum(took) / len(took) if took else 0.0
    return Report(name, q.queries, q.recall or 0.0, q.precision or 0.0, mean, nearest_rank(took, 0.99), qps, **cost)


def _parts(searcher: Searcher) -> tuple[DataFrame, DatasetManifest]:
    dataset = DatasetManifest.load(searcher.store, searcher.manifest.dataset_version)
    return read_dataset(searcher.store, dataset), dataset


def eval_ann(searcher: Searcher, max_queries: int = 100, k: int = 10, nprobe: int = 2, workload: str = "mixed", truth: DataFrame | None = None) -> Report:
    """Recall, precision, latency and cost of one index."""
    vectors, _ = _parts(searcher)
    queries = sample_queries(vectors, max_queries).persist()
    truth = truth or ground_truth(vectors, queries, searcher.metric.value, k)
    config = QueryConfig(top_k=k, fan_out=FanOutPolicy(nprobe))
    found, took, qps = timed(lambda q: searcher.search(q, config), queries, workload)
    m = searcher.manifest
    disk = searcher.store.sizes(f"indexes/{m.index_version}").agg(F.sum("length")).first()[0] or 0
    pq = (m.params["pq_num_subspaces"], m.params["pq_codebook_size"]) if m.codec else (None, None)
    return report(m.family.value, truth, found, took, qps, **metrics.cost(m.vector_count, m.dims, disk, *pq))


def compare_ann(searchers: list[Searcher], max_queries: int = 100, k: int = 10, nprobe: int = 2) -> list[Report]:
    """Reports of several indexes of one dataset and metric against one ground truth."""
    if len({(s.manifest.dataset_version, s.manifest.metric) for s in searchers}) != 1:
        raise ConfigError("indexes to compare have one dataset and one metric")
    vectors, _ = _parts(searchers[0])
    queries = sample_queries(vectors, max_queries)
    truth = ground_truth(vectors, queries, searchers[0].metric.value, k).persist()
    return [eval_ann(s, max_queries, k, nprobe, truth=truth) for s in searchers]


def eval_hybrid(searcher: Searcher, index: bm25.Bm25Index, texts: DataFrame, max_queries: int = 100, k: int = 10, nprobe: int = 2, policy: HybridRankingPolicy | None = None) -> list[Report]:
    """Reports of vector, lexical and hybrid search against the exact vector answer; texts is (qid, text)."""
    vectors, _ = _parts(searcher)
    queries = sample_queries(vectors, max_queries).persist()
    truth = ground_truth(vectors, queries, searcher.metric.value, k).persist()
    policy = policy or HybridRankingPolicy(0.7, 0.3)
    config = QueryConfig(top_k=k, fan_out=FanOutPolicy(nprobe))
    by_vector = lambda q: searcher.search(q, config).select("qid", "rank", "id", "score")
    by_text = lambda q: bm25.search(index, texts.join(F.broadcast(q.select("qid")), "qid", "left_semi"), k)
    modes = {"vector": by_vector, "bm25": by_text, "hybrid": lambda q: blend(by_vector(q), by_text(q), policy, k)}
    return [report(name, truth, *timed(search, queries)) for name, search in modes.items()]


def evaluate_partitioning(searcher: Searcher, max_queries: int = 100, k: int = 10, nprobe: int = 2) -> dict[str, DataFrame]:
    """Balance, routing accuracy, hotness and recall of an index's partitions."""
    vectors, _ = _parts(searcher)
    queries = sample_queries(vectors, max_queries).persist()
    truth = ground_truth(vectors, queries, searcher.metric.value, k).persist()
    centroids, policy = searcher.tables.centroids, FanOutPolicy(nprobe)
    from ..operators import ivf

    routes = ivf.route(queries, centroids, policy).persist()
    sizes = ivf.summary(searcher.shards)
    found = searcher.search(queries, QueryConfig(top_k=k, fan_out=policy))
    return {
        "distribution": metrics.distribution(sizes),
        "sizes": sizes,
        "hotness": metrics.hotness(sizes, routes, queries.count()),
        "routing_accuracy": metrics.routing_accuracy(truth, vectors, centroids, routes),
        "quality": metrics.quality("partitioning", truth, found),
    }
