"""JSON-lines input, stored datasets and their profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidRecord
from .layout import key
from .manifest import DatasetManifest
from .store import HadoopStore

MAX_DIMS = 2**32 - 1
LINES = "id long, vector array<double>, data array<double>, _bad string"


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(id, data, metadata, ok) of lines {id, vector[, metadata]}; blank lines are skipped.

    metadata is the JSON text of that field, null if it is absent; a written null stays "null". ok is false for
    lines that can't be read: ids that are no unsigned integers of 63 bits, vectors that are empty or not all numbers.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", LINES, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    given = lines.select("value", parsed.alias("r")).select("value", "r.*")
    held = F.expr("try_parse_json(value)")
    vector = F.coalesce("vector", "data")
    metadata = F.expr("to_json(try_variant_get(try_parse_json(value), '$.metadata', 'variant'))")
    ok = held.isNotNull() & F.col("_bad").isNull() & F.col("id").isNotNull() & (F.col("id") >= 0) & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull())
    return given.select("id", vector.cast("array<float>").alias("data"), metadata.alias("metadata"), F.coalesce(ok, F.lit(False)).alias("ok"))


def profile(records: DataFrame) -> DataFrame:
    """One row on records (id, data, metadata): counts, least and most components, repeated ids."""
    size = F.size("data").cast("long")
    per_id = records.groupBy("id").agg(F.count("*").alias("n"), F.min(size).alias("lo"), F.max(size).alias("hi"), F.count("metadata").alias("m"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per_id.agg(total("n").alias("vector_count"), F.min("lo").alias("min_dims"), F.max("hi").alias("max_dims"), total("m").alias("with_metadata"), F.count_if(F.col("n") > 1).alias("repeated_ids"))


def dim_violations(records: DataFrame, dims: int) -> DataFrame:
    """(id, dims) of records with other than `dims` components."""
    return records.where(F.size("data") != dims).select("id", F.size("data").cast("long").alias("dims"))


def write_dataset(store: HadoopStore, records: DataFrame, version: str, embedding_version: str | None = None, source: str = "") -> DatasetManifest:
    """Store records (id, data, metadata) as a dataset; rows are numbered in the order of their ids."""
    facts = profile(records).first()
    if not facts.vector_count:
        raise InvalidRecord("there is no record")
    if facts.min_dims != facts.max_dims or not 1 <= facts.max_dims <= MAX_DIMS:
        raise InvalidRecord(f"records have from {facts.min_dims} to {facts.max_dims} components")
    if facts.repeated_ids:
        raise InvalidRecord(f"{facts.repeated_ids} ids repeat")
    vectors, metadata = key("dataset_vectors", version), key("dataset_metadata", version)
    records.select("id", "data", F.col("id").alias("pos")).write.mode("overwrite").parquet(store.path(vectors))
    records.where("metadata is not null").select("id", "metadata").write.mode("overwrite").parquet(store.path(metadata))
    out = DatasetManifest(version, embedding_version or version, facts.max_dims, facts.vector_count, vectors, metadata, source=source)
    out.save(store)
    return out


def ingest(spark: SparkSession, store: HadoopStore, path: str, version: str, embedding_version: str | None = None) -> DatasetManifest:
    """Read JSON lines, check them and store them; the first bad line's number of companions is reported."""
    records = read_jsonl(spark, path)
    bad = records.where(~F.col("ok")).count()
    if bad:
        raise InvalidRecord(f"{bad} lines can't be read")
    return write_dataset(store, records.drop("ok"), version, embedding_version, path)


def read_dataset(store: HadoopStore, manifest: DatasetManifest) -> DataFrame:
    return store.spark.read.parquet(store.path(manifest.vectors_key))


def read_metadata(store: HadoopStore, manifest: DatasetManifest) -> DataFrame:
    """(id, metadata), without rows where no record had any."""
    if not store.exists(manifest.metadata_key):
        return store.spark.createDataFrame([], "id long, metadata string")
    return store.spark.read.schema("id long, metadata string").parquet(store.path(manifest.metadata_key))


def write_jsonl(records: DataFrame, path: str) -> None:
    """Lines {id, data, metadata}, as a dataset's records are exchanged."""
    line = F.to_json(F.struct("id", "data"), {"ignoreNullFields": "false"})
    whole = F.concat(F.expr("left(line, length(line) - 1)"), F.lit(',"metadata":'), F.coalesce("metadata", F.lit("null")), F.lit("}"))
    records.withColumn("line", line).select(whole.alias("value")).write.mode("overwrite").text(path)
