"""What several operators share: the cluster's folder, joins that survive hot keys, and grouping of sorted batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key is hot if it holds more than this share of the rows, or more rows than a task should have.
HOT_SHARE, TASK_ROWS = 512, 1_000_000
#: Below this many rows no key is hot, however few rows there are in all.
HOT_FLOOR = 200
#: Hot keys at most, as they are broadcast; beyond TASK_ROWS times as many rows in all, tasks have more rows.
HOT_KEYS = 1 << 20
#: Parts that the rows of a hot key are dealt to at least.
SALTS = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is named by spark.checkpoint.dir. Where that is unset a temporary folder serves, on a single
    machine only.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
        if not found:
            found = tempfile.mkdtemp(prefix="corvix-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corvix/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._corvix_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def dropped(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._corvix_path)


def purge(spark: SparkSession) -> None:
    """Delete all tables of written(), of this session and others; results that read them are void."""
    _delete(spark, f"{shared_dir(spark)}/corvix")


def hot_threshold(total: int) -> int:
    """Rows that a key has at most if it isn't hot, of `total` rows in all: so there are fewer hot keys than HOT_KEYS."""
    return max(HOT_FLOOR, min(total // HOT_SHARE, TASK_ROWS), total // HOT_KEYS)


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], n: str, salt_by: list[str], total: int, how: str = "inner") -> DataFrame:
    """Equi-join in which no key of `big` lands in one task.

    small has each key once, with the number `n` of big's rows that have it. Keys with more rows than
    hot_threshold() are marked in `big` by a broadcast (of 2**20 keys at most) and dealt to parts by salt_by: 64, or as
    many as keep a part at the threshold; their rows of `small` are repeated for each part. `n` is not returned.
    With an empty salt_by rows are dealt by their place, for a `big` that is read from a table.
    """
    most = hot_threshold(total)
    parts = F.greatest(F.lit(SALTS), F.ceil(F.col(n) / most)).cast("int")
    hot = F.broadcast(small.where(F.col(n) > most).select(*keys, parts.alias("_parts")))
    place = F.xxhash64(*salt_by) if salt_by else F.monotonically_increasing_id()
    big = big.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(place, F.col("_parts"))).cast("int")).drop("_parts")
    dealt = F.when(F.col(n) > most, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))
    small = small.withColumn("_salt", F.explode(dealt)).drop(n)
    return big.join(small, [*keys, "_salt"], how).drop("_salt")


def least_hashed(rows: DataFrame, group: str, most: int) -> DataFrame:
    """The `most` rows of each group (not null) whose doc_ids have the smallest hashes, and `at`, their place from 1 on.

    rows is a table, read three times, with each (group, doc_id) once. A count of the groups tells the share of the
    hashes below which twice as many rows and 64 more are expected, and only these are ranked; that fewer than `most`
    are there has a chance of less than 1e-20. So the task that ranks a group gets as many of its rows at any size.
    Groups of less than a 65,536th of the rows are ranked as they are, as the counts are broadcast.
    """
    enough = 2 * most + 64
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
    large = F.broadcast(sizes.where(F.col("_n") > max(enough, rows.count() >> 16)))
    order = F.xxhash64(F.lit("sample"), "doc_id")
    low = (order / 2.0**64 + 0.5) * F.col("_n") < enough
    few = rows.join(large, group, "left").where(F.col("_n").isNull() | low).drop("_n")
    at = F.row_number().over(Window.partitionBy(group).orderBy(order, "doc_id"))
    return few.withColumn("at", at).where(F.col("at") <= most)


#: What makes a worker forget things that it keeps for its next tasks.
FORGET: list[Callable[[], None]] = []


def trimmed() -> None:
    """Give memory that a worker no longer uses back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released() -> None:
    """Forget what a worker keeps for tasks of another kind, such as token ids; called as a task begins."""
    for forget in FORGET:
        forget()
    trimmed()


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """The rows of each key, from batches sorted by it; only one key's rows are held."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row[key] != rows[0][key]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a text column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def each_text(column: pa.Array | pa.ChunkedArray, rows: int = 256) -> Iterator[bytes | None]:
    """as_bytes(), some rows at a time."""
    for at in range(0, len(column), rows):
        yield from as_bytes(column.slice(at, rows))


def estimated_bytes(df: DataFrame) -> int:
    """Bytes of a table by Spark's own estimate, that of its files for one that is read from files; 0 if there is none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def bounded_batches(spark: SparkSession) -> None:
    """Let workers of this session get rows in batches of 8 MB (Spark's default: 64) or one row; results are the same."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def local_table(spark: SparkSession, columns: dict[str, pa.Array]) -> DataFrame:
    """A small table from the driver's memory. Made from Arrow, it needs no Python worker on the executors."""
    return spark.createDataFrame(pa.table(columns))
