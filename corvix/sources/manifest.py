"""Documents that describe datasets and indexes, their rules, and aliases."""

from __future__ import annotations

import datetime as dt
from dataclasses import asdict, dataclass, field

from ..errors import ManifestError
from ..plans.config import AnnFamily, DistanceMetric
from .layout import key
from .store import HadoopStore

VERSION = 4


def _need(ok: object, what: str) -> None:
    if not ok:
        raise ManifestError(what)


def now() -> str:
    return dt.datetime.now(dt.UTC).isoformat(timespec="seconds")


@dataclass
class DatasetManifest:
    dataset_version: str
    embedding_version: str
    dims: int
    vector_count: int
    vectors_key: str
    metadata_key: str
    ingested_at: str = field(default_factory=now)
    source: str = ""
    manifest_version: int = 1

    def validate(self) -> None:
        for name in ("dataset_version", "embedding_version", "vectors_key", "metadata_key"):
            _need(getattr(self, name), f"{name} is empty")
        _need(self.dims >= 1, "dims must be at least 1")
        _need(self.vector_count >= 1, "vector_count must be at least 1")
        _need(self.manifest_version in (0, 1), f"manifest version {self.manifest_version} is unknown")

    def save(self, store: HadoopStore) -> None:
        self.validate()
        store.put_json(key("dataset_info", self.dataset_version), asdict(self))

    @classmethod
    def load(cls, store: HadoopStore, version: str) -> DatasetManifest:
        """Documents without a version are version 0; there `count` stands for vector_count."""
        raw = store.get_json(key("dataset_info", version))
        raw.setdefault("manifest_version", 0)
        if "count" in raw:
            raw["vector_count"] = raw.pop("count")
        known = {k: v for k, v in raw.items() if k in cls.__dataclass_fields__}
        out = cls(**known)
        out.validate()
        return out


@dataclass
class ShardDef:
    shard_id: int
    vector_count: int
    fingerprint: str
    centroid: list[float]
    bytes: int = 0


@dataclass
class IndexManifest:
    index_version: str
    dataset_version: str
    embedding_version: str
    dims: int
    metric: str
    algorithm: str
    vector_count: int
    shards: list[ShardDef]
    alias: str = "latest"
    variant: str = ""
    params: dict = field(default_factory=dict)
    codec: str | None = None
    codebook_key: str | None = None
    centroids_key: str | None = None
    lexical_key: str | None = None
    recall_estimate: dict | None = None
    built_at: str = field(default_factory=now)
    build_seconds: float = 0.0
    manifest_version: int = VERSION

    def validate(self) -> None:
        for name in ("index_version", "dataset_version", "embedding_version", "algorithm"):
            _need(getattr(self, name), f"{name} is empty")
        _need(1 <= self.manifest_version <= VERSION, f"manifest version {self.manifest_version} is unknown")
        _need(self.dims >= 1, "dims must be at least 1")
        try:
            DistanceMetric(self.metric)
        except ValueError:
            raise ManifestError(f"unknown metric {self.metric}") from None
        _need(self.shards, "an index has at least one shard")
        ids = [s.shard_id for s in self.shards]
        _need(len(set(ids)) == len(ids), "shard ids repeat")
        _need(all(s.vector_count >= 1 for s in self.shards), "a shard is empty")
        _need(all(len(s.centroid) == self.dims for s in self.shards), "a centroid has other dimensions")
        _need(sum(s.vector_count for s in self.shards) == self.vector_count, "shards don't add up to vector_count")
        _need(self.centroids_key or self.manifest_version < 4, "an index has a table of centroids")
        _need(self.codec is None or self.codec == "pq8", f"unknown codec {self.codec}")
        _need((self.codec is None) == (self.codebook_key is None), "a codebook goes with a codec")
        if self.recall_estimate is not None:
            _need(0 <= self.recall_estimate.get("recall", -1) <= 1, "recall is a share")

    def save(self, store: HadoopStore) -> None:
        """Saved in the current version, whichever it was loaded in."""
        self.manifest_version = VERSION
        self.validate()
        store.put_json(key("index_manifest", self.index_version), asdict(self))

    @classmethod
    def load(cls, store: HadoopStore, version: str) -> IndexManifest:
        raw = store.get_json(key("index_manifest", version))
        raw.setdefault("manifest_version", 1)
        known = {k: v for k, v in raw.items() if k in cls.__dataclass_fields__}
        known["shards"] = [ShardDef(**s) for s in raw.get("shards", [])]
        out = cls(**known)
        out.validate()
        return out

    @property
    def family(self) -> AnnFamily:
        plain = self.algorithm.replace("-", "_")
        if plain in ("hnsw", "diskann"):
            return AnnFamily(plain)
        return AnnFamily.IVF_PQ if self.codec == "pq8" else AnnFamily.IVF_FLAT

    def fits_dims(self, dims: int) -> bool:
        return self.dims == dims

    def fits_dataset(self, version: str) -> bool:
        return self.dataset_version == version

    def fits_algorithm(self, algorithm: str, variant: str | None = None, params: dict | None = None) -> bool:
        """Same algorithm and variant, and every given parameter as recorded."""
        same = self.algorithm == algorithm and (variant is None or self.variant == variant)
        return same and all(self.params.get(k) == v for k, v in (params or {}).items())


def publish(store: HadoopStore, alias: str, index_version: str) -> None:
    """Point an alias at an index that can be loaded."""
    IndexManifest.load(store, index_version)
    store.put_json(key("alias", alias), {"alias": alias, "index_version": index_version})


def resolve(store: HadoopStore, alias: str) -> IndexManifest:
    return IndexManifest.load(store, store.get_json(key("alias", alias))["index_version"])
