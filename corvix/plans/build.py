"""Building an index: train, assign, compact, encode, write, estimate recall, describe."""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, DimensionMismatch
from ..evaluation.metrics import recall
from ..functions.scores import pq_shard_bytes, raw_shard_bytes
from ..operators import bm25, ivf, pq
from ..operators.backends import Backend, IndexTables, backend
from ..operators.scan import knn
from ..sources.ingest import dim_violations, read_dataset
from ..sources.layout import key
from ..sources.manifest import DatasetManifest, IndexManifest, ShardDef
from ..sources.store import HadoopStore
from .config import AnnFamily, BM25Params, DistanceMetric, FanOutPolicy, PqParams, check_metric


@dataclass(frozen=True)
class BuildParams:
    index_version: str
    metric: DistanceMetric = DistanceMetric.COSINE
    family: AnnFamily = AnnFamily.IVF_FLAT
    num_shards: int = 4
    kmeans_iters: int = 20
    kmeans_seed: int = 0xDEADBEEF
    kmeans_sample_size: int | None = None
    recall_sample_size: int | None = None
    recall_k: int = 10
    nprobe: int = 2
    pq: PqParams | None = None
    family_params: dict = field(default_factory=dict)


def check(dataset: DatasetManifest, params: BuildParams) -> None:
    if params.num_shards < 1:
        raise ConfigError("num_shards must be at least 1")
    if params.family == AnnFamily.IVF_PQ and params.pq is None or params.family == AnnFamily.IVF_FLAT and params.pq is not None:
        raise ConfigError("ivf_pq has pq parameters, ivf_flat has none")
    if params.pq:
        params.pq.check(dataset.dims)
        check_metric(AnnFamily.IVF_PQ, params.metric)
    made_for(params).validate(dataset.dims, params.metric)


def made_for(params: BuildParams) -> Backend:
    return backend(params.family, **({"params": params.pq} if params.family == AnnFamily.IVF_PQ else params.family_params))


def fingerprints(rows: DataFrame, payload: str) -> DataFrame:
    """(shard_id, vector_count, fingerprint): an order-free digest of each shard's rows."""
    digest = F.expr(f"conv(substr(sha2(concat_ws('|', cast(id as string), array_join({payload}, ',')), 256), 1, 15), 16, 10)").cast("decimal(38,0)")
    return rows.groupBy("shard_id").agg(F.count("*").alias("vector_count"), F.sum(digest).cast("string").alias("fingerprint"))


def write_shards(store: HadoopStore, assigned: DataFrame, version: str) -> DataFrame:
    """Rows with shard_pos and shard_size, partitioned by shard; large shards are several files."""
    path = store.path(key("index_shards", version))
    placed = ivf.positioned(assigned)
    spread = placed.repartition("shard_id", F.floor(F.col("shard_pos") / 1_000_000)).sortWithinPartitions("shard_id", "shard_pos")
    spread.write.mode("overwrite").partitionBy("shard_id").parquet(path)
    return store.spark.read.parquet(path)


def describe(dataset: DatasetManifest, params: BuildParams, shards: DataFrame, centroids: DataFrame, started: float) -> IndexManifest:
    """The manifest of written shards; one row a shard comes to the driver."""
    payload = "codes" if params.pq else "data"
    dims = F.lit(dataset.dims).cast("long")
    size = pq_shard_bytes(F.lit(1), F.col("vector_count"), dims, F.lit(params.pq.num_subspaces)) if params.pq else raw_shard_bytes(F.lit(1), F.col("vector_count"), dims)
    rows = fingerprints(shards, payload).withColumn("bytes", size).join(centroids, "shard_id").orderBy("shard_id").collect()
    defs = [ShardDef(r.shard_id, r.vector_count, r.fingerprint, list(r.centroid), r.bytes) for r in rows]
    v = params.index_version
    algorithm = {AnnFamily.IVF_FLAT: "ivf-flat", AnnFamily.IVF_PQ: "ivf-flat"}.get(params.family, params.family.value)
    more = {"num_shards": params.num_shards, "kmeans_iters": params.kmeans_iters, "kmeans_seed": params.kmeans_seed, **params.family_params}
    if params.pq:
        more |= {"pq_num_subspaces": params.pq.num_subspaces, "pq_codebook_size": params.pq.codebook_size}
    return IndexManifest(
        v, dataset.dataset_version, dataset.embedding_version, dataset.dims, params.metric.value, algorithm, sum(d.vector_count for d in defs), defs,
        params=more, codec="pq8" if params.pq else None, codebook_key=key("index_codebook", v) if params.pq else None,
        centroids_key=key("index_centroids", v), build_seconds=round(time.time() - started, 3),
    )


def build(store: HadoopStore, dataset: DatasetManifest, params: BuildParams) -> IndexManifest:
    started = time.time()
    check(dataset, params)
    vectors = read_dataset(store, dataset)
    bad = dim_violations(vectors, dataset.dims).first()
    if bad:
        raise DimensionMismatch(f"vector {bad.id} has {bad.dims} components, not {dataset.dims}")
    trained = ivf.kmeans(vectors, params.num_shards, params.kmeans_iters, params.kmeans_seed, params.kmeans_sample_size)
    assigned, centroids = ivf.compact(ivf.assign(vectors, trained), trained)
    v = params.index_version
    centroids.write.mode("overwrite").parquet(store.path(key("index_centroids", v)))
    if params.pq:
        codebook = pq.train(vectors, params.pq, params.kmeans_iters, params.kmeans_seed, params.kmeans_sample_size)
        codebook.write.mode("overwrite").parquet(store.path(key("index_codebook", v)))
        assigned = pq.encode(assigned, tables_codebook(store, v)).drop("data")
    shards = write_shards(store, assigned, v)
    centroids = store.spark.read.parquet(store.path(key("index_centroids", v)))
    manifest = describe(dataset, params, shards, centroids, started)
    if params.recall_sample_size:
        tables = IndexTables(shards, centroids, tables_codebook(store, v) if params.pq else None)
        manifest.recall_estimate = recall_estimate(vectors, tables, params)
    manifest.save(store)
    return manifest


def tables_codebook(store: HadoopStore, version: str) -> DataFrame:
    return store.spark.read.parquet(store.path(key("index_codebook", version)))


def recall_estimate(vectors: DataFrame, tables: IndexTables, params: BuildParams) -> dict:
    """Mean recall of sampled vectors as queries against the exact answer."""
    queries = ivf.seeds(vectors, params.recall_sample_size, params.kmeans_seed + 2).select(F.col("id").alias("qid"), F.col("data").alias("q"))
    truth = knn(vectors, queries, params.metric.value, params.recall_k)
    if tables.codebook is not None and params.family != AnnFamily.IVF_PQ:
        tables = replace(tables, shards=pq.reconstruct(tables.shards, tables.codebook))
    found = made_for(params).search(tables, queries, params.metric, params.recall_k, FanOutPolicy(params.nprobe))
    value = recall(truth, found).agg(F.avg("recall")).first()[0]
    return {"recall": value, "k": params.recall_k, "nprobe": params.nprobe, "sample_size": params.recall_sample_size}


def build_lexical(store: HadoopStore, docs: DataFrame, version: str, params: BM25Params | None = None) -> bm25.Bm25Index:
    """Write the inverted index of docs (id, text) beside an index, and read it back; frequent terms are several files."""
    made = bm25.build(docs, params)
    root = store.path(key("index_lexical", version))
    made.postings.hint("rebalance", F.col("term")).sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{root}/postings")
    made.doc_lengths.write.mode("overwrite").parquet(f"{root}/doc_lengths")
    made.stats.write.mode("overwrite").parquet(f"{root}/stats")
    return load_lexical(store, version, made.params)


def load_lexical(store: HadoopStore, version: str, params: BM25Params | None = None) -> bm25.Bm25Index:
    root = store.path(key("index_lexical", version))
    read = store.spark.read.parquet
    return bm25.Bm25Index(read(f"{root}/postings"), read(f"{root}/doc_lengths"), read(f"{root}/stats"), params or BM25Params())
