"""Product quantisation: codebooks, codes and asymmetric distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError
from ..functions.vectors import shown
from ..plans.config import PqParams
from .ivf import DIGITS, nearest, seeds
from .scan import PAIRS, matrix, ranked, scan


def _sums(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        width = book.shape[2]
        total, n = np.zeros(book.shape), np.zeros(book.shape[:2], np.int64)
        for batch in batches:
            x = matrix(batch["data"].drop_null())
            for m, own in enumerate(book if len(x) else ()):
                part = x[:, m * width : (m + 1) * width]
                at, _ = nearest(part, own)
                np.add.at(total[m], at, part)
                n[m] += np.bincount(at, minlength=len(own))
        m, code = np.nonzero(n)
        yield pa.record_batch([pa.array(m, pa.int32()), pa.array(code, pa.int32()), pa.array(n[m, code]), pa.array(list(total[m, code]), pa.list_(pa.float64()))], names=["m", "code", "n", "total"])

    return run


def lloyd_step(vectors: DataFrame, book: np.ndarray) -> np.ndarray:
    """One step of k-means in all sub-spaces of book [m, code, i] at once; a code without any vector stays.

    The vectors are read once; each task sums them up, so a codebook of it is shuffled and one collected.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(book)
    parts = vectors.select("data").mapInArrow(_sums(shared), "m int, code int, n long, total array<double>")
    sums = parts.select("m", "code", "n", F.posexplode("total").alias("i", "x")).groupBy("m", "code", "i").agg(F.round(F.sum("x") / F.sum("n"), DIGITS).alias("x"))
    out = book.copy()
    for r in sums.collect():
        out[r.m, r.code, r.i] = r.x
    return out


def train(vectors: DataFrame, params: PqParams, iterations: int, seed: int, sample: int | None = None) -> DataFrame:
    """codebook (m, code, centroid): k-means of each sub-space from rows drawn by seed + m; null vectors teach nothing.

    With `sample`, that many rows train, the same ones in all sub-spaces.
    """
    spark = vectors.sparkSession
    rows = vectors.where("data is not null").select("id", "data")
    dims = len(rows.select("data").first().data)
    params.check(dims)
    width = dims // params.num_subspaces
    if sample is not None:
        rows = seeds(rows, sample, seed + 1)
    drawn = [[r.id for r in seeds(rows.select("id"), params.codebook_size, seed + m).collect()] for m in range(params.num_subspaces)]
    wanted = spark.createDataFrame([(i,) for i in sorted({i for own in drawn for i in own})], "id long")
    data = {r.id: np.array(r.data, np.float64) for r in rows.join(F.broadcast(wanted), "id", "left_semi").collect()}
    book = np.array([[data[i][m * width : (m + 1) * width] for i in own] for m, own in enumerate(drawn)])
    for _ in range(iterations):
        moved = lloyd_step(rows, book)
        if (moved == book).all():
            break
        book = moved
    return table(spark, book)


def table(spark: SparkSession, book: np.ndarray) -> DataFrame:
    """book [m, code, i] as a codebook."""
    return spark.createDataFrame([(m, code, x.tolist()) for m, own in enumerate(book) for code, x in enumerate(own)], "m int, code int, centroid array<double>")


def loaded(codebook: DataFrame) -> np.ndarray:
    """The codebook as [m, code, i]: at most as many numbers as 256 vectors have."""
    rows = codebook.select("m", "code", "centroid").collect()
    if not rows:
        raise ConfigError("the codebook is empty")
    m, k = 1 + max(r.m for r in rows), 1 + max(r.code for r in rows)
    if k > 256:
        raise ConfigError("a codebook has 256 codes at most")
    out = np.full((m, k, len(rows[0].centroid)), np.inf)
    for r in rows:
        out[r.m, r.code] = r.centroid
    return out


def encode(vectors: DataFrame, codebook: DataFrame) -> DataFrame:
    """vectors (id, data, ...) with codes: the nearest code of each sub-space, the lowest of equal ones."""
    shared = vectors.sparkSession.sparkContext.broadcast(loaded(codebook))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        width = book.shape[2]
        step = max(1, PAIRS // book[0].size)
        for batch in batches:
            x = matrix(batch["data"])
            codes = np.zeros((len(x), len(book)), np.int16)
            for a in range(0, len(x), step):
                for m, own in enumerate(book):
                    gap = x[a : a + step, None, m * width : (m + 1) * width] - own[None]
                    codes[a : a + step, m] = np.round((gap * gap).sum(2), 12).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(codes), pa.list_(pa.int16()))], names=[*batch.schema.names, "codes"])

    given = vectors.drop("codes")
    return given.mapInArrow(run, T.StructType([*given.schema.fields, T.StructField("codes", T.ArrayType(T.ShortType()))]))


def reconstruct(coded: DataFrame, codebook: DataFrame) -> DataFrame:
    """coded (id, codes, ...) with data, the chosen sub-centroids one after another; unknown codes are an error."""
    shared = coded.sparkSession.sparkContext.broadcast(loaded(codebook))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        for batch in batches:
            codes = matrix(batch["codes"]).astype(int)
            if codes.size and (codes.shape[1] != len(book) or codes.max() >= book.shape[1] or codes.min() < 0):
                raise ConfigError("codes don't fit the codebook")
            data = book[np.arange(len(book)), codes].reshape(len(codes), -1) if codes.size else np.zeros((0, 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(data), pa.list_(pa.float64()))], names=[*batch.schema.names, "data"])

    given = coded.drop("data")
    return given.mapInArrow(run, T.StructType([*given.schema.fields, T.StructField("data", T.ArrayType(T.DoubleType()))]))


def distance_table(queries: DataFrame, codebook: DataFrame) -> DataFrame:
    """(qid, m, code, d): squared L2 of each query's sub-vectors to each code."""
    shared = queries.sparkSession.sparkContext.broadcast(loaded(codebook))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        m, k, width = book.shape
        step = max(1, PAIRS // book.size)
        for batch in (whole.slice(a, step) for whole in batches for a in range(0, whole.num_rows, step)):
            q = matrix(batch["q"])
            gap = q.reshape(len(q), m, 1, width) - book[None]
            d = (gap * gap).sum(3).ravel()
            names = np.repeat(batch["qid"].to_numpy(zero_copy_only=False), m * k)
            columns = [pa.array(names, pa.int64()), pa.array(np.tile(np.repeat(np.arange(m), k), len(q)), pa.int32()), pa.array(np.tile(np.arange(k), m * len(q)), pa.int32()), pa.array(d)]
            yield pa.RecordBatch.from_arrays(columns, names=["qid", "m", "code", "d"])

    given = queries.select(F.col("qid").cast("long").alias("qid"), F.col("q").cast("array<double>").alias("q"))
    return given.mapInArrow(run, "qid long, m int, code int, d double").where(F.col("d") < float("inf"))


class Lookup:
    """Squared distances of queries to coded rows, by a table of each query's distances to the codes."""

    payload = "codes"

    def __init__(self, book: np.ndarray) -> None:
        self.book = book

    def prepare(self, batch: pa.RecordBatch) -> np.ndarray:
        return matrix(batch[self.payload]).astype(int)

    def rough(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        width = self.book.shape[2]
        out = np.zeros((len(q), len(rows)))
        for m, own in enumerate(self.book):
            gap = q[:, None, m * width : (m + 1) * width] - own[None]
            out += (gap * gap).sum(2)[:, rows[:, m]]
        return out

    def slack(self, q: np.ndarray, rows: np.ndarray) -> None:
        return None

    def exact(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.rough(q[None], rows)[0]


def adc_topk(coded: DataFrame, codebook: DataFrame, queries: DataFrame, k: int, routes: DataFrame | None = None) -> DataFrame:
    """(qid, rank, id, score): the k lowest squared distances to the coded rows (id, codes)."""
    found = scan(coded, queries, k, Lookup(loaded(codebook)), routes)
    return ranked(found, k).select("qid", "rank", "id", shown(F.col("score")).alias("score"))


def bad_codes(coded: DataFrame, codes: int) -> DataFrame:
    """Rows with a code that the codebook doesn't have."""
    return coded.where(F.exists("codes", lambda c: (c < 0) | (c >= codes)))
