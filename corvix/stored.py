"""Queries that go through stored artifacts: datasets, indexes, manifests, lexical indexes, worker builds and a service.

Each call has a new folder below spark.checkpoint.dir. Indexes are built by two k-means steps into four shards.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .evaluation import harness
from .operators import bm25
from .operators.backends import IndexTables
from .plans import build as building
from .plans import distributed, validation
from .plans.config import DistanceMetric, FanOutPolicy, QueryConfig, SystemConfig
from .plans.pipeline import QueryPipeline, Searcher
from .plans.service import QueryRequest, Service
from .queries import SEED, asked, centroids, documents, shards, table, texts, vectors
from .sources import generate, ingest
from .sources.layout import key
from .sources.manifest import DatasetManifest, IndexManifest, publish, resolve
from .sources.store import HadoopStore, scratch

PARAMS = building.BuildParams("i1", DistanceMetric.EUCLIDEAN, num_shards=4, kmeans_iters=2, kmeans_seed=SEED, recall_sample_size=20)


def records(spark: SparkSession, sf: str) -> DataFrame:
    """The embeddings as records; those of label 0 have no metadata."""
    meta = F.when(F.col("label") != 0, F.to_json(F.struct("label")))
    return vectors(spark, sf).select("id", "data", meta.alias("metadata"))


def stored(spark: SparkSession, sf: str) -> tuple[HadoopStore, DatasetManifest]:
    store = scratch(spark)
    return store, ingest.write_dataset(store, records(spark, sf), "d1")


def built(spark: SparkSession, sf: str) -> tuple[HadoopStore, IndexManifest]:
    store, dataset = stored(spark, sf)
    building.build(store, dataset, PARAMS)
    publish(store, "latest", "i1")
    return store, resolve(store, "latest")


def q_ingest_jsonl(spark, sf):
    """Vectors written as JSON lines, ingested and read back, component by component."""
    store = scratch(spark)
    ingest.write_jsonl(records(spark, sf), f"{store.root}/lines")
    ingest.ingest(spark, store, f"{store.root}/lines", "v1")
    made = DatasetManifest.load(store, "v1")
    rows = ingest.read_dataset(store, made).join(ingest.read_metadata(store, made), "id", "left")
    return rows.select("id", "metadata", F.posexplode("data").alias("i", "x")).withColumn("x", F.col("x").cast("double"))


def q_ingest_bad_lines(spark, sf):
    """Documents as lines, of which those in French have no vector and those in German a word in theirs."""
    store = scratch(spark)
    vector = F.when(F.col("lang") == "fr", "[]").when(F.col("lang") == "de", '[1, "a"]').otherwise("[1, 0.5]")
    line = F.format_string('{"id": %d, "vector": %s}', "doc_id", vector)
    table(spark, sf, "documents").select(line.alias("value")).write.text(f"{store.root}/lines")
    return ingest.read_jsonl(spark, f"{store.root}/lines").groupBy("ok").agg(F.count("*").alias("lines"))


def q_index_shards(spark, sf):
    """What the published manifest says of the shards."""
    _, manifest = built(spark, sf)
    return spark.createDataFrame([(s.shard_id, s.vector_count, s.bytes) for s in manifest.shards], "shard_id int, vector_count long, bytes long")


def q_index_manifest(spark, sf):
    _, m = built(spark, sf)
    kind = "alias string, index_version string, dataset_version string, dims long, metric string, algorithm string, vector_count long, num_shards long"
    return spark.createDataFrame([(m.alias, m.index_version, m.dataset_version, m.dims, m.metric, m.algorithm, m.vector_count, len(m.shards))], kind)


def q_index_recall_estimate(spark, sf):
    _, manifest = built(spark, sf)
    found = manifest.recall_estimate
    return spark.createDataFrame([(round(found["recall"], 6), found["k"], found["nprobe"], found["sample_size"])], "recall double, k long, nprobe long, sample_size long")


def q_index_search(spark, sf):
    store, manifest = built(spark, sf)
    return Searcher(store, manifest).search(asked(vectors(spark, sf)), QueryConfig()).select("qid", "rank", "id", "score", "metadata")


def q_worker_merge(spark, sf):
    """Shards of a build by three workers, merged: each worker's number, rows and first shard."""
    store, dataset = stored(spark, sf)
    made = distributed.run(store, dataset, PARAMS, 3)
    rows = store.spark.read.parquet(store.path(key("index_shards", made.index_version)))
    sizes = rows.groupBy("shard_id").agg(F.count("*").alias("n")).join(distributed.assignments(rows.select("shard_id").distinct(), 3), "shard_id")
    return sizes.groupBy("worker_id").agg(F.count("*").alias("num_shards"), F.sum("n").alias("vector_count"), F.min("shard_id").alias("first_shard"))


def q_index_validate(spark, sf):
    """Faults of an index of which shard 1 has another centroid, and of a dataset that lost its metadata."""
    store, manifest = built(spark, sf)
    moved = spark.read.parquet(store.path(manifest.centroids_key)).withColumn("centroid", F.when(F.col("shard_id") == 1, F.transform("centroid", lambda x: x + 1)).otherwise(F.col("centroid")))
    moved.write.parquet(f"{store.root}/moved")
    spark.read.parquet(f"{store.root}/moved").write.mode("overwrite").parquet(store.path(manifest.centroids_key))
    store.delete(key("dataset_metadata", "d1"))
    return validation.validate_index(store, "i1").unionByName(validation.validate_dataset(store, "d1"))


def q_store_objects(spark, sf):
    """Regions as small objects, listed and read back; that of Asia is deleted."""
    store = scratch(spark)
    for r in table(spark, sf, "region").collect():
        store.put_json(f"regions/{r.r_name.lower()}.json", {"key": r.r_regionkey})
    store.delete("regions/asia.json")
    return spark.createDataFrame([(k, store.get_json(k)["key"]) for k in store.list("regions")], "key string, value long")


def q_lexical_index(spark, sf):
    """Search of a stored inverted index, with all test items."""
    return bm25.search(building.build_lexical(scratch(spark), documents(spark, sf), "i1"), texts(spark, sf), 10)


def q_pipeline_stages(spark, sf):
    """A pipeline that embeds a query as its negative and reranks twice as many candidates."""
    v = vectors(spark, sf)
    c = centroids(v)
    negative = lambda q: q.withColumn("q", F.transform("q", lambda x: -x))
    line = QueryPipeline(IndexTables(shards(v, c), c), DistanceMetric.EUCLIDEAN).with_(embed=negative, vectors=v, reranks=True, oversample=2)
    return line.run(asked(v), QueryConfig(fan_out=FanOutPolicy(2)))


def q_service_modes(spark, sf):
    """Answers of a service to vector 0 and the first test item, in each mode."""
    store, manifest = built(spark, sf)
    service = Service(Searcher(store, manifest), building.build_lexical(store, documents(spark, sf), "i1"))
    vector = list(asked(vectors(spark, sf)).where("qid = 0").first().q)
    text = texts(spark, sf).where("qid = 0").first().text
    out = []
    for mode in ("vector", "lexical", "hybrid"):
        found = service.query(QueryRequest(vector=vector, query_text=text, query_mode=mode)).results
        out += [(mode, n, x["id"], float(x["score"])) for n, x in enumerate(found, 1)]
    return spark.createDataFrame(out, "mode string, rank long, id long, score double")


def q_eval_report(spark, sf):
    """Quality and cost of the index, by the harness with three queries."""
    store, manifest = built(spark, sf)
    r = harness.eval_ann(Searcher(store, manifest), 3)
    return spark.createDataFrame([(r.name, r.queries, r.recall, r.precision, r.memory_bytes, r.compression_ratio)], "name string, queries long, recall double, precision double, memory_bytes long, compression_ratio double")


def q_config_defaults(spark, sf):
    given = asdict(SystemConfig())
    given |= {f"prefetch.{k}": v for k, v in given.pop("prefetch").items()}
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in given.items()], "name string, value string")


def q_generate_gaussian(spark, sf):
    return generate.gaussian(spark, 1000, 16).select("id", "metadata", F.posexplode("data").alias("i", "x")).withColumn("x", F.round(F.col("x").cast("double"), 4) + F.lit(0.0))


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q_")}
