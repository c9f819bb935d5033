"""Requests in, responses out: what the HTTP server and the command line call."""

from __future__ import annotations

import bisect
import re
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..operators import bm25
from ..operators.hybrid import blend
from .cache import CacheMetrics
from .config import DistanceMetric, FanOutPolicy, HybridRankingPolicy, QueryConfig, QueryMode
from .pipeline import QueryPlan, Searcher

# Upper bounds of the latency histogram, in seconds.
BOUNDS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


@dataclass(frozen=True)
class QueryRequest:
    """A query; nprobe is an older name of candidate_centroids, which wins if both are given.

    Vector queries ignore a text, lexical ones a vector and reranking, and all a rerank_limit without rerank.
    """

    # The fields' names, as clients send them.
    vector: list[float] | None = None
    k: int = 10
    query_mode: str = "vector"
    query_text: str | None = None
    nprobe: int | None = None
    candidate_centroids: int | None = None
    candidate_shards: int | None = None
    max_vectors_per_shard: int | None = None
    distance_metric: str | None = None
    rerank: bool | None = False
    rerank_limit: int | None = None


@dataclass(frozen=True)
class QueryResponse:
    results: list[dict]
    index_version: str
    mode: str


@dataclass
class Service:
    """One index, with its lexical index if there is one; counts its requests."""

    searcher: Searcher
    lexical: bm25.Bm25Index | None = None
    defaults: FanOutPolicy = field(default_factory=FanOutPolicy)
    counts: dict[str, int] = field(default_factory=dict)
    seconds: list[int] = field(default_factory=lambda: [0] * (len(BOUNDS) + 1))
    total_seconds: float = 0.0
    debug: bool = False

    def resolve(self, r: QueryRequest) -> QueryConfig:
        """The checked configuration of a request, or ConfigError."""
        try:
            mode = QueryMode(r.query_mode or "vector")
            metric = DistanceMetric(r.distance_metric) if r.distance_metric else None
        except ValueError as e:
            raise ConfigError(str(e)) from None
        if r.k < 1:
            raise ConfigError("k must be at least 1")
        if mode != QueryMode.LEXICAL and not r.vector:
            raise ConfigError(f"{mode} queries need a vector")
        if mode != QueryMode.VECTOR:
            if not re.search(r"[^\W_]", r.query_text or ""):
                raise ConfigError(f"{mode} queries need a text with a word")
            if self.lexical is None:
                raise ConfigError("the index has no lexical part")
        if r.rerank_limit is not None and r.rerank_limit < 1:
            raise ConfigError("rerank_limit must be at least 1")
        if metric and self.searcher.manifest.codec and metric != self.searcher.metric:
            raise ConfigError("a compressed index has one metric")
        d = self.defaults
        first = next((x for x in (r.candidate_centroids, r.nprobe) if x is not None), d.candidate_centroids)
        rows = d.max_vectors_per_shard if r.max_vectors_per_shard is None else r.max_vectors_per_shard
        shards = d.candidate_shards if r.candidate_shards is None else r.candidate_shards
        return QueryConfig(mode, r.k, FanOutPolicy(first, shards, rows), r.rerank_limit, metric)

    def _vectors(self, r: QueryRequest, config: QueryConfig, k: int) -> DataFrame:
        spark = self.searcher.store.spark
        queries = spark.createDataFrame([(0, [float(x) for x in r.vector])], "qid long, q array<double>")
        fetched = QueryConfig(config.mode, k, config.fan_out, None, config.distance_metric)
        found = self.searcher.search(queries, fetched)
        return self.searcher.rerank(found, queries, config.distance_metric) if r.rerank else found

    def query(self, r: QueryRequest) -> QueryResponse:
        self.counts["requests"] = self.counts.get("requests", 0) + 1
        began = time.perf_counter()
        try:
            config = self.resolve(r)
            # more candidates only where they are reranked, in hybrid queries too
            k = max(r.k, r.rerank_limit or r.k) if r.rerank else r.k
            spark = self.searcher.store.spark
            if config.mode == QueryMode.VECTOR:
                out = self._vectors(r, config, k)
            else:
                text = spark.createDataFrame([(0, r.query_text)], "qid long, text string")
                out = bm25.search(self.lexical, text, r.k if config.mode == QueryMode.LEXICAL else k)
                if config.mode == QueryMode.HYBRID:
                    out = blend(self._vectors(r, config, k), out, HybridRankingPolicy(), r.k)
        except Exception:
            self.counts["errors"] = self.counts.get("errors", 0) + 1
            raise
        names = [c for c in ("id", "score", "metadata") if c in out.columns]
        rows = out.where(F.col("rank") <= r.k).orderBy("rank").select(*names).collect()
        took = time.perf_counter() - began
        self.seconds[bisect.bisect_left(BOUNDS, took)] += 1
        self.total_seconds += took
        self.counts["results"] = self.counts.get("results", 0) + len(rows)
        return QueryResponse([x.asDict() for x in rows], self.searcher.manifest.index_version, config.mode.value)

    def query_plan(self, r: QueryRequest) -> QueryPlan:
        """What a vector query would read."""
        config = self.resolve(r)
        if config.mode != QueryMode.VECTOR:
            raise ConfigError("only vector queries have a plan")
        queries = self.searcher.store.spark.createDataFrame([(0, [float(x) for x in r.vector])], "qid long, q array<double>")
        return self.searcher.plan(queries, config)

    def health(self) -> dict:
        return {"status": "ok", "index_version": self.searcher.manifest.index_version}

    def metrics(self) -> dict[str, int]:
        return dict(self.counts)

    def plan_response(self, r: QueryRequest) -> dict:
        """query_plan() as plain values."""
        plan = self.query_plan(r)
        tables = {"centroids": plan.centroids, "shards": plan.shards, "candidates": plan.candidates}
        return {"plan": {k: [x.asDict() for x in v.collect()] for k, v in tables.items()}, "index_version": self.searcher.manifest.index_version}

    def prometheus(self) -> str:
        """Counters, the cache's gauges and the latency histogram in Prometheus' text format."""
        loaded = self.searcher.loaded
        m = loaded.metrics if loaded else CacheMetrics()
        below, buckets = 0, []
        for bound, n in zip([*map(str, BOUNDS), "+Inf"], self.seconds):
            below += n
            buckets.append(f'corvix_query_duration_seconds_bucket{{le="{bound}"}} {below}')
        counters = {"queries_total": below, "query_results_total": self.counts.get("results", 0)}
        gauges = {"shard_cache_hits_total": m.hits, "shard_cache_misses_total": m.misses, "shard_load_count_total": m.misses, "shard_load_latency_ns_total": m.load_ns, "shard_cache_retained_bytes": loaded.retained_bytes() if loaded else 0}
        lines = ["# TYPE corvix_query_duration_seconds histogram", *buckets, f"corvix_query_duration_seconds_sum {self.total_seconds:.6f}", f"corvix_query_duration_seconds_count {below}"]
        for kind, values in (("counter", counters), ("gauge", gauges)):
            for name, n in values.items():
                lines += [f"# TYPE corvix_{name} {kind}", f"corvix_{name} {n}"]
        return "\n".join([*lines, ""])
