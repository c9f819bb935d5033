"""Index families by name, and how each searches the routed shards."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame

from ..errors import ConfigError
from ..plans.config import AnnFamily, DistanceMetric, FanOutPolicy, HnswConfig, PqParams, check_metric
from . import ivf, pq


@dataclass(frozen=True)
class IndexTables:
    """What a search reads: shard rows with shard_pos and shard_size, centroids and, where compressed, the codebook."""

    shards: DataFrame
    centroids: DataFrame
    codebook: DataFrame | None = None


class Backend(Protocol):
    family: AnnFamily

    def validate(self, dims: int, metric: DistanceMetric) -> None: ...

    def search(self, tables: IndexTables, queries: DataFrame, metric: DistanceMetric, k: int, policy: FanOutPolicy) -> DataFrame: ...


@dataclass(frozen=True)
class Flat:
    """Exact scan of the routed shards; any metric."""

    family: AnnFamily = AnnFamily.IVF_FLAT

    def validate(self, dims: int, metric: DistanceMetric) -> None:
        check_metric(self.family, metric)

    def search(self, tables: IndexTables, queries: DataFrame, metric: DistanceMetric, k: int, policy: FanOutPolicy) -> DataFrame:
        return ivf.search(tables.shards, tables.centroids, queries, metric.value, k, policy)


@dataclass(frozen=True)
class Hnsw(Flat):
    """Recorded graph parameters over the same exact scan."""

    family: AnnFamily = AnnFamily.HNSW
    config: HnswConfig = HnswConfig()


@dataclass(frozen=True)
class Compressed:
    """Table lookups over codes; scores are squared L2."""

    params: PqParams = PqParams()
    family: AnnFamily = AnnFamily.IVF_PQ

    def validate(self, dims: int, metric: DistanceMetric) -> None:
        check_metric(self.family, metric)
        self.params.check(dims)

    def search(self, tables: IndexTables, queries: DataFrame, metric: DistanceMetric, k: int, policy: FanOutPolicy) -> DataFrame:
        if tables.codebook is None:
            raise ConfigError("a compressed index has a codebook")
        routes = ivf.route(queries, tables.centroids, policy)
        return pq.adc_topk(ivf.capped(tables.shards, policy), tables.codebook, queries, k, routes)


@dataclass(frozen=True)
class Strided:
    """Evenly strided rows of the routed shards, max(k, beam) of each; euclidean only."""

    beam: int = 64
    family: AnnFamily = AnnFamily.DISKANN

    def validate(self, dims: int, metric: DistanceMetric) -> None:
        check_metric(self.family, metric)
        if self.beam < 1:
            raise ConfigError("beam must be at least 1")

    def search(self, tables: IndexTables, queries: DataFrame, metric: DistanceMetric, k: int, policy: FanOutPolicy) -> DataFrame:
        return ivf.strided_search(tables.shards, tables.centroids, queries, k, self.beam, policy)


REGISTRY = {AnnFamily.IVF_FLAT: Flat, AnnFamily.HNSW: Hnsw, AnnFamily.IVF_PQ: Compressed, AnnFamily.DISKANN: Strided}


def families() -> list[str]:
    return sorted(f.value for f in REGISTRY)


def exists(name: str) -> bool:
    try:
        return AnnFamily(name) in REGISTRY
    except ValueError:
        return False


def backend(name: str, **params: object) -> Backend:
    """The backend of a family, made with its own parameters."""
    if not exists(name):
        raise ConfigError(f"no index family is called {name}")
    return REGISTRY[AnnFamily(name)](**params)


def resolve(algorithm: str, codec: str | None, **params: object) -> Backend:
    """The backend for what a manifest says: hnsw and diskann by name, then 8-bit codes, else flat."""
    plain = algorithm.replace("-", "_")
    if plain in ("hnsw", "diskann", "disk_ann"):
        return backend(plain, **params)
    return backend("ivf_pq" if codec == "pq8" else "ivf_flat", **params)
