"""Sharding by a two-pass external shuffle: a uniform scatter into buckets, then Fisher-Yates within each."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import new_path

SHARDS = 8
#: Bytes of text in a bucket, which one task holds.
BUCKET_BYTES = 16 << 20
#: Tasks of the second pass at most; each takes its buckets one after another.
TASKS = 20_000
SEED = 20240229


def fisher_yates(n: int, seed: tuple[int, ...]) -> list[int]:
    """A uniform permutation of range(n): each place from the last swaps with one up to itself."""
    out = list(range(n))
    picks = (np.random.default_rng(seed).random(n) * np.arange(1, n + 1)).astype(np.int64).tolist()
    for i in range(n - 1, 0, -1):
        k = picks[i]
        out[i], out[k] = out[k], out[i]
    return out


def _size():
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1


def shuffle_to_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write docs in uniformly random order, as `shards` shards of equal row counts; returns the written table.

    Pass 1 scatters rows by a seeded hash into as many buckets as keep each near bucket_bytes. Pass 2
    takes one bucket at a time, orders it by that hash, shuffles it by Fisher-Yates with a generator
    seeded by the bucket's number, and writes it. A row's place in the order is its place in its bucket plus
    the sizes of the buckets before (of earlier tasks: counted beforehand); shard s holds an s-th part of the places, so counts differ by one at
    most. The result doesn't depend on how the input is partitioned, so a task that runs again writes
    the same rows.

    The table has docs' columns, and shard and slot, which is gapless from 0 in each shard; the files are
    partitioned by shard. Null texts and null ids are rows like others. Equal rows have the same hash and so share
    a bucket; which of them gets which place makes no difference. Columns named shard, slot or those that
    start with _at are replaced. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot", "_at", "_at_bucket")
    hashed = docs.withColumn("_at", F.xxhash64(F.lit(seed), "doc_id", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    total = docs.select(F.sum(_size())).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    scattered = hashed.withColumn("_at_bucket", F.pmod("_at", F.lit(buckets)).cast("int"))
    tasks = min(buckets, TASKS)
    task = F.floor(F.col("_at_bucket").cast("long") * tasks / buckets).cast("int")
    counts = [0] * tasks
    for r in scattered.groupBy(task.alias("task")).count().collect():  # a number for each task
        counts[r[0]] = r[1]
    starts = np.concatenate(([0], np.cumsum(counts))).tolist()
    rows = starts[-1]
    bounds = [-(-rows * s // shards) for s in range(shards + 1)]
    shared = spark.sparkContext.broadcast((starts, bounds))
    schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def emit(number: int, rows: pa.Table, start: int, bounds: list) -> Iterator[pa.RecordBatch]:
        order = fisher_yates(rows.num_rows, (seed, number))
        place = start + np.arange(rows.num_rows)
        shard = np.searchsorted(bounds, place, "right") - 1
        slot = place - np.array(bounds)[shard]
        out = rows.select(names).take(pa.array(order, pa.int64()))
        out = out.append_column("shard", pa.array(shard, pa.int32())).append_column("slot", pa.array(slot, pa.int64()))
        yield from out.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, bounds = shared.value
        held: list[pa.RecordBatch] = []
        number, place = None, 0
        for batch in batches:
            of = batch["_at_bucket"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if number is None:
                    place = starts[int(of[a]) * tasks // buckets]
                elif of[a] != number:
                    rows = pa.Table.from_batches(held)
                    yield from emit(number, rows, place, bounds)
                    place += rows.num_rows
                    held = []
                number = int(of[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from emit(number, pa.Table.from_batches(held), place, bounds)

    names = docs.columns
    path = new_path(spark, "shards")
    dealt = scattered.repartitionById(tasks, task)
    dealt = dealt.sortWithinPartitions("_at_bucket", "_at", "doc_id", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    dealt.mapInArrow(run, schema).write.partitionBy("shard").parquet(path)
    return spark.read.schema(schema).parquet(path)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document, from the written shards."""
    out = shuffle_to_shards(docs.select("doc_id", "text"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return out.select("doc_id", _size().alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
