"""Queries as stages: embed, route, load, search, merge, rerank; and a searcher over a published index."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.vectors import shown
from ..operators import ivf
from ..operators.backends import Backend, Flat, IndexTables, resolve
from ..operators.merge import merge, rerank, rerank_target, with_metadata
from ..operators.pq import reconstruct
from ..sources.ingest import read_dataset, read_metadata
from ..sources.layout import key
from ..sources.manifest import DatasetManifest, IndexManifest
from ..sources.store import HadoopStore
from .cache import LoadedShards
from .config import AnnFamily, DistanceMetric, PrefetchPolicy, QueryConfig

Embed = Callable[[DataFrame], DataFrame]
Rerank = Callable[[DataFrame, DataFrame, str, int], DataFrame]


def identity(queries: DataFrame) -> DataFrame:
    return queries


@dataclass(frozen=True)
class QueryPlan:
    """What a search chose: probed centroids, searched shards and candidates, as tables."""

    centroids: DataFrame
    shards: DataFrame
    candidates: DataFrame


@dataclass(frozen=True)
class QueryPipeline:
    """A search as replaceable stages; make variants with replace() or with_().

    Queries are tables (qid, q). max_vectors_per_shard isn't a limit of this path, but of Searcher.
    """

    tables: IndexTables
    metric: DistanceMetric = DistanceMetric.COSINE
    embed: Embed = identity
    backend: Backend = Flat()
    vectors: DataFrame | None = None
    reranks: bool = False
    oversample: int = 1
    metadata: DataFrame | None = None

    def with_(self, **stages: object) -> QueryPipeline:
        return replace(self, **stages)

    def routes(self, queries: DataFrame, config: QueryConfig) -> DataFrame:
        return ivf.route(self.embed(queries), self.tables.centroids, replace(config.fan_out, max_vectors_per_shard=0))

    def run(self, queries: DataFrame, config: QueryConfig | None = None) -> DataFrame:
        config = config or QueryConfig()
        metric = config.distance_metric or self.metric
        asked = self.embed(queries)
        target = rerank_target(config.top_k, config.rerank_limit, self.oversample, self.reranks)
        policy = replace(config.fan_out, max_vectors_per_shard=0)
        out = merge([self.backend.search(self.tables, asked, metric, target, policy).select("qid", "id", "score")], target)
        if self.reranks:
            if self.vectors is None:
                raise ConfigError("reranking needs the stored vectors")
            out = rerank(out.select("qid", "id", "score"), self.vectors, asked, metric.value, config.top_k)
        out = out.select("qid", "rank", "id", shown(F.col("score")).alias("score"))
        return with_metadata(out, self.metadata) if self.metadata is not None else out

    def plan(self, queries: DataFrame, config: QueryConfig | None = None) -> QueryPlan:
        return plan(self.tables, self.backend, self.embed(queries), config or QueryConfig(), (config and config.distance_metric) or self.metric)


def plan(tables: IndexTables, backend: Backend, queries: DataFrame, config: QueryConfig, metric: DistanceMetric) -> QueryPlan:
    policy = config.fan_out
    probes = ivf.route(queries, tables.centroids, replace(policy, candidate_shards=0))
    shards = ivf.route(queries, tables.centroids, policy)
    return QueryPlan(probes, shards, backend.search(tables, queries, metric, config.top_k, policy))


class Searcher:
    """Searches one published index; tables are read lazily and only routed shards are scanned.

    With a capacity, that many of the shards used last stay in memory: for a server's queries, a few at a time, as
    their routes come to the driver. With a prefetch policy, shards that were routed to often are loaded ahead.
    """

    def __init__(self, store: HadoopStore, manifest: IndexManifest, cached: bool = False, capacity: int | None = None, prefetch: PrefetchPolicy | None = None) -> None:
        self.store, self.manifest = store, manifest
        spark = store.spark
        shards = spark.read.parquet(store.path(key("index_shards", manifest.index_version)))
        self.shards = shards.persist() if cached else shards
        codebook = spark.read.parquet(store.path(manifest.codebook_key)) if manifest.codebook_key else None
        more = {"beam": manifest.params["beam"]} if "beam" in manifest.params else {}
        self.backend = resolve(manifest.algorithm, manifest.codec, **more)
        rows = self.shards
        if codebook is not None and self.backend.family != AnnFamily.IVF_PQ:  # other families scan approximate vectors
            rows = reconstruct(rows, codebook)
        self.tables = IndexTables(rows, spark.read.parquet(store.path(manifest.centroids_key)), codebook)
        self.metric = DistanceMetric(manifest.metric)
        self.loaded = LoadedShards(rows, {s.shard_id: s.bytes for s in manifest.shards}, capacity) if capacity else None
        self.prefetch, self.probes = prefetch or PrefetchPolicy(), Counter()

    def _routed(self, queries: DataFrame, config: QueryConfig) -> IndexTables:
        """The tables, with the routed shards from the cache, if there is one."""
        if self.loaded is None:
            return self.tables
        shards = [r.shard_id for r in ivf.route(queries, self.tables.centroids, config.fan_out).select("qid", "shard_id").collect()]
        self.probes.update(shards)
        if self.prefetch.enabled:
            often = [s for s, n in self.probes.most_common(self.loaded.cache.capacity) if n >= self.prefetch.min_query_count]
            for shard in often:
                if shard not in self.loaded.cache.held:
                    self.loaded.load(shard)
        return IndexTables(self.loaded.routed(shards), self.tables.centroids, self.tables.codebook)

    def _dataset(self) -> DatasetManifest:
        return DatasetManifest.load(self.store, self.manifest.dataset_version)

    def vectors(self) -> DataFrame:
        return self.shards if self.manifest.codec is None else read_dataset(self.store, self._dataset())

    def metadata(self) -> DataFrame:
        return read_metadata(self.store, self._dataset())

    def search(self, queries: DataFrame, config: QueryConfig | None = None) -> DataFrame:
        """(qid, rank, id, score, metadata) by (score, id)."""
        config = config or QueryConfig()
        metric = config.distance_metric or self.metric
        if self.manifest.codec and metric != self.metric:
            raise ConfigError("a compressed index has one metric")
        found = self.backend.search(self._routed(queries, config), queries, metric, config.top_k, config.fan_out)
        return with_metadata(found, self.metadata())

    def rerank(self, results: DataFrame, queries: DataFrame, metric: DistanceMetric | None = None) -> DataFrame:
        """All results with exact scores; those without a vector keep theirs."""
        return rerank(results, self.vectors(), queries, (metric or self.metric).value, keep_missing=True)

    def plan(self, queries: DataFrame, config: QueryConfig | None = None) -> QueryPlan:
        config = config or QueryConfig()
        return plan(self.tables, self.backend, queries, config, config.distance_metric or self.metric)
