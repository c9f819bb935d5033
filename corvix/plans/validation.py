"""Integrity checks of a stored index; every fault is reported, not the first alone."""

from __future__ import annotations

from enum import StrEnum

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.errors import PySparkException

from ..errors import CorvixError
from ..operators.pq import bad_codes
from ..sources.layout import key
from ..sources.manifest import DatasetManifest, IndexManifest
from ..sources.store import HadoopStore
from .build import fingerprints

FAULT = "kind string, key string, expected string, actual string"


class Fault(StrEnum):
    MANIFEST_INVALID = "manifest_invalid"
    ARTIFACT_MISSING = "artifact_missing"
    FINGERPRINT_MISMATCH = "fingerprint_mismatch"
    SHARD_DIMENSION_MISMATCH = "shard_dimension_mismatch"
    SHARD_VECTOR_COUNT_MISMATCH = "shard_vector_count_mismatch"
    SHARD_CENTROID_MISMATCH = "shard_centroid_mismatch"
    STORAGE_ERROR = "storage_error"
    SHARD_PARSE_ERROR = "shard_parse_error"
    CENTROIDS_INVALID = "centroids_invalid"


def shard_faults(shards: DataFrame, expected: DataFrame, dims: int) -> DataFrame:
    """Faults of rows (shard_id, data) against expected (shard_id, vector_count)."""
    facts = shards.groupBy("shard_id").agg(F.count("*").alias("n"), F.min(F.size("data")).alias("lo"), F.max(F.size("data")).alias("hi"))
    both = expected.select("shard_id", F.col("vector_count").alias("want")).join(facts, "shard_id", "full_outer")
    name = F.format_string("shard-%04d", "shard_id")
    counts = both.where(~F.col("want").eqNullSafe(F.col("n"))).select(F.lit(Fault.SHARD_VECTOR_COUNT_MISMATCH.value).alias("kind"), name.alias("key"), F.coalesce(F.col("want").cast("string"), F.lit("absent")).alias("expected"), F.coalesce(F.col("n").cast("string"), F.lit("absent")).alias("actual"))
    worst = F.when(F.col("lo") != dims, F.col("lo")).otherwise(F.col("hi"))
    sizes = both.where((F.col("lo") != dims) | (F.col("hi") != dims)).select(F.lit(Fault.SHARD_DIMENSION_MISMATCH.value).alias("kind"), name.alias("key"), F.lit(str(dims)).alias("expected"), worst.cast("string").alias("actual"))
    return counts.unionByName(sizes)


def centroid_faults(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Shards whose centroids (shard_id, centroid) differ in any component, or are in one table only."""
    both = expected.select("shard_id", F.col("centroid").alias("a")).join(actual.select("shard_id", F.col("centroid").alias("b")), "shard_id", "full_outer")
    state = lambda c: F.when(F.col(c).isNull(), F.lit("absent")).otherwise(F.lit("present"))
    bad = both.where(~F.col("a").eqNullSafe(F.col("b")))
    return bad.select(F.lit(Fault.SHARD_CENTROID_MISMATCH.value).alias("kind"), F.format_string("shard-%04d", "shard_id").alias("key"), state("a").alias("expected"), state("b").alias("actual"))


def _one(store: HadoopStore, kind: Fault, name: str, expected: str, actual: str) -> DataFrame:
    return store.spark.createDataFrame([(kind.value, name, expected, actual)], FAULT)


def _found(faults: DataFrame) -> DataFrame:
    """Faults worked out now, so that files that can't be read show; there are some for each shard at most."""
    return faults.sparkSession.createDataFrame(faults.collect(), FAULT)


def validate_index(store: HadoopStore, version: str) -> DataFrame:
    """(kind, key, expected, actual) of all faults of an index; no row if it is whole."""
    spark = store.spark
    none = spark.createDataFrame([], FAULT)
    try:
        manifest = IndexManifest.load(store, version)
    except FileNotFoundError:
        return _one(store, Fault.ARTIFACT_MISSING, key("index_manifest", version), "present", "absent")
    except (CorvixError, ValueError, TypeError, KeyError) as e:
        return _one(store, Fault.MANIFEST_INVALID, key("index_manifest", version), "valid", str(e))
    out = none
    wanted = [key("index_shards", version), manifest.centroids_key, manifest.codebook_key]
    for name in filter(None, wanted):
        if not store.exists(name):
            out = out.unionByName(_one(store, Fault.ARTIFACT_MISSING, name, "present", "absent"))
    expected = spark.createDataFrame([(s.shard_id, s.vector_count, s.fingerprint, s.centroid) for s in manifest.shards], "shard_id int, vector_count long, fingerprint string, centroid array<double>")
    if store.exists(wanted[0]):
        payload = "codes" if manifest.codec else "data"
        try:
            rows = spark.read.parquet(store.path(wanted[0]))
            size = manifest.params["pq_num_subspaces"] if manifest.codec else manifest.dims
            found = shard_faults(rows.withColumnRenamed(payload, "data"), expected, size)
            prints = expected.alias("e").join(fingerprints(rows, payload).alias("a"), "shard_id").where("e.fingerprint != a.fingerprint")
            name = F.format_string("shard-%04d", "shard_id")
            found = found.unionByName(prints.select(F.lit(Fault.FINGERPRINT_MISMATCH.value).alias("kind"), name.alias("key"), F.col("e.fingerprint").alias("expected"), F.col("a.fingerprint").alias("actual")))
            if manifest.codec:
                wrong = bad_codes(rows, manifest.params["pq_codebook_size"]).groupBy("shard_id").count()
                found = found.unionByName(wrong.select(F.lit(Fault.SHARD_PARSE_ERROR.value).alias("kind"), name.alias("key"), F.lit("0").alias("expected"), F.col("count").cast("string").alias("actual")))
            out = out.unionByName(_found(found))
        except (PySparkException, Py4JJavaError) as e:
            out = out.unionByName(_one(store, Fault.SHARD_PARSE_ERROR, wanted[0], "readable", str(e)[:200]))
    if manifest.centroids_key and store.exists(manifest.centroids_key):
        try:
            out = out.unionByName(_found(centroid_faults(expected, spark.read.parquet(store.path(manifest.centroids_key)))))
        except (PySparkException, Py4JJavaError) as e:
            out = out.unionByName(_one(store, Fault.CENTROIDS_INVALID, manifest.centroids_key, "readable", str(e)[:200]))
    return out


def validate_dataset(store: HadoopStore, version: str) -> DataFrame:
    """Faults of a dataset: its document and the tables it names."""
    out = store.spark.createDataFrame([], FAULT)
    try:
        manifest = DatasetManifest.load(store, version)
    except FileNotFoundError:
        return _one(store, Fault.ARTIFACT_MISSING, key("dataset_info", version), "present", "absent")
    except (CorvixError, ValueError, TypeError, KeyError) as e:
        return _one(store, Fault.MANIFEST_INVALID, key("dataset_info", version), "valid", str(e))
    for name in (manifest.vectors_key, manifest.metadata_key):
        if not store.exists(name):
            out = out.unionByName(_one(store, Fault.ARTIFACT_MISSING, name, "present", "absent"))
    return out
