"""Enums and validated parameters."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from enum import StrEnum

from ..errors import ConfigError


class _Named(StrEnum):
    @classmethod
    def _missing_(cls, value: object):
        plain = str(value).lower().replace("-", "_")
        return next((m for m in cls if m.value == plain or m.value == plain.replace("disk_ann", "diskann")), None)


class DistanceMetric(_Named):
    COSINE = "cosine"
    EUCLIDEAN = "euclidean"
    INNER_PRODUCT = "inner_product"


class AnnFamily(_Named):
    IVF_FLAT = "ivf_flat"
    IVF_PQ = "ivf_pq"
    HNSW = "hnsw"
    DISKANN = "diskann"


class QueryMode(_Named):
    VECTOR = "vector"
    LEXICAL = "lexical"
    HYBRID = "hybrid"


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ConfigError(what)


@dataclass(frozen=True)
class FanOutPolicy:
    """How much a query reads: centroids probed, shards kept of these and rows of each (0: all)."""

    candidate_centroids: int = 2
    candidate_shards: int = 0
    max_vectors_per_shard: int = 0

    def __post_init__(self) -> None:
        _need(self.candidate_centroids >= 1, "candidate_centroids must be at least 1")
        _need(self.candidate_shards >= 0 and self.max_vectors_per_shard >= 0, "limits can't be negative")


@dataclass(frozen=True)
class QueryConfig:
    mode: QueryMode = QueryMode.VECTOR
    top_k: int = 10
    fan_out: FanOutPolicy = field(default_factory=FanOutPolicy)
    rerank_limit: int | None = None
    distance_metric: DistanceMetric | None = None

    def __post_init__(self) -> None:
        _need(self.top_k >= 1, "top_k must be at least 1")
        _need(self.rerank_limit is None or self.rerank_limit >= 1, "rerank_limit must be at least 1")


@dataclass(frozen=True)
class PrefetchPolicy:
    enabled: bool = False
    min_query_count: int = 3

    def __post_init__(self) -> None:
        _need(not self.enabled or self.min_query_count >= 1, "min_query_count must be at least 1")


@dataclass(frozen=True)
class HybridRankingPolicy:
    vector_weight: float = 0.5
    bm25_weight: float = 0.5

    def __post_init__(self) -> None:
        w = (self.vector_weight, self.bm25_weight)
        _need(not any(math.isnan(x) for x in w), "weights can't be NaN")
        _need(min(w) >= 0 and max(w) > 0, "weights can't be negative, nor both zero")


@dataclass(frozen=True)
class HnswConfig:
    """Recorded with an index; the scan of a shard is exact whatever these are."""

    m: int = 16
    ef_construction: int = 200
    ef_search: int = 50

    def __post_init__(self) -> None:
        _need(self.m >= 1 and self.ef_construction >= self.m and self.ef_search >= 1, "m >= 1, ef_construction >= m and ef_search >= 1 are needed")


@dataclass(frozen=True)
class BM25Params:
    k1: float = 1.5
    b: float = 0.75


@dataclass(frozen=True)
class PqParams:
    num_subspaces: int = 8
    codebook_size: int = 256

    def check(self, dims: int) -> None:
        _need(self.num_subspaces >= 1, "num_subspaces must be at least 1")
        _need(1 <= self.codebook_size <= 256, "codebook_size must be from 1 to 256")
        _need(dims % self.num_subspaces == 0, "num_subspaces must divide the dimensions")


@dataclass(frozen=True)
class SystemConfig:
    storage_root: str = "./data"
    num_shards: int = 4
    kmeans_iters: int = 20
    kmeans_seed: int = 0xDEADBEEF
    kmeans_sample_size: int | None = None
    recall_sample_size: int | None = None
    recall_k: int = 10
    nprobe: int = 2
    candidate_shards: int = 0
    max_vectors_per_shard: int = 0
    pq_enabled: bool = False
    pq_num_subspaces: int = 8
    pq_codebook_size: int = 256
    shard_cache_capacity: int = 128
    prefetch: PrefetchPolicy = field(default_factory=PrefetchPolicy)

    def __post_init__(self) -> None:
        _need(self.num_shards >= 1, "num_shards must be at least 1")
        _need(self.kmeans_sample_size is None or self.kmeans_sample_size >= 1, "kmeans_sample_size must be at least 1")
        _need(self.shard_cache_capacity >= 1, "shard_cache_capacity must be at least 1")

    def fan_out(self) -> FanOutPolicy:
        return FanOutPolicy(self.nprobe, self.candidate_shards, self.max_vectors_per_shard)


def check_metric(family: AnnFamily, metric: DistanceMetric) -> None:
    """Compressed and strided searches know squared distances only."""
    _need(family not in (AnnFamily.IVF_PQ, AnnFamily.DISKANN) or metric == DistanceMetric.EUCLIDEAN, f"{family} needs the euclidean metric")
