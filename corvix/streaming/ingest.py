"""Additions beyond the batch operators, for data that arrives continuously."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ivf


def assign_stream(vectors: DataFrame, centroids: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append arriving vectors (id, data) to shard_id= partitions under path, by their nearest centroid."""

    def put(batch: DataFrame, epoch: int) -> None:
        ivf.assign(batch, centroids).withColumn("epoch", F.lit(epoch)).write.mode("append").partitionBy("shard_id").parquet(path)

    return vectors.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()


def probe_counts(probes: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, shard_id, probes) of a stream of probes (ts, shard_id); later rows than `late` are left out."""
    counted = probes.withWatermark("ts", late).groupBy(F.window("ts", window), "shard_id").agg(F.count("*").alias("probes"))
    return counted.select(F.col("window.start").alias("start"), "shard_id", "probes")
