"""Synthetic vectors that don't depend on how rows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError


def _uniform(*parts: Column) -> Column:
    """A number in [-1, 1) from the first 52 bits of an MD5 hash of the parts, joined by colons."""
    return _bits(*parts).cast("double") / (1 << 51) - 1


def _bits(*parts: Column) -> Column:
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def clustered(spark: SparkSession, num_vectors: int = 1000, dims: int = 128, num_clusters: int = 10, seed: int = 0xDEADBEEF, spread: float = 0.1) -> DataFrame:
    """(id, data, metadata): random centroids in [-1, 1], vectors within `spread` of theirs; ids from 1."""
    if min(num_vectors, dims, num_clusters) < 1 or spread < 0:
        raise ConfigError("sizes must be at least 1 and spread not negative")
    rows = spark.range(1, num_vectors + 1).withColumn("cluster", F.pmod(_bits(F.lit(seed), F.lit("cluster"), F.col("id")), F.lit(num_clusters)))

    def component(i: Column) -> Column:
        center = _uniform(F.lit(seed), F.lit("center"), F.col("cluster"), i)
        return (center + _uniform(F.lit(seed), F.lit("vector"), F.col("id"), i) * spread).cast("float")

    data = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), component)
    return rows.select("id", data.alias("data"), F.format_string('{"cluster":%d}', "cluster").alias("metadata"))


def gaussian(spark: SparkSession, count: int, dims: int, seed: int = 42) -> DataFrame:
    """(id, data, metadata): standard normal components by the Box-Muller rule; ids from 0."""
    if min(count, dims) < 1:
        raise ConfigError("sizes must be at least 1")

    def component(i: Column) -> Column:
        u = (_uniform(F.lit(seed), F.lit("u"), F.col("id"), i) + 1) / 2
        v = (_uniform(F.lit(seed), F.lit("v"), F.col("id"), i) + 1) / 2
        return (F.sqrt(F.log(F.lit(1.0) - u) * -2) * F.cos(v * 6.283185307179586)).cast("float")

    data = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), component)
    return spark.range(count).select("id", data.alias("data"), F.format_string('{"idx":%d}', "id").alias("metadata"))
