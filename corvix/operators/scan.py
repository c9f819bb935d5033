"""Blocked top-k scans: queries are broadcast in blocks, candidates stay where they are."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..errors import DimensionMismatch
from ..functions.vectors import shown

#: Queries that one job broadcasts, and pairs of which distances are worked out at once.
QUERY_BLOCK, PAIRS = 8192, 1 << 22
#: Up to this many routed shards are named in the scan's filter, which prunes partitions.
NAMED_SHARDS = 1000
DIGITS = 9

FOUND = "qid long, id long, score double"


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, all as long as the first."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes != sizes[0]).any():
        raise DimensionMismatch(f"vectors of {int(sizes.min())} and {int(sizes.max())} components")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def distances(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of each query to each row."""
    if q.shape[1] != x.shape[1]:
        raise DimensionMismatch(f"queries have {q.shape[1]} components, vectors {x.shape[1]}")
    if metric == "inner_product":
        return -(q @ x.T)
    if metric == "cosine":
        nq, nx = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
        zero = (nq[:, None] == 0) | (nx[None] == 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(zero, 1.0, 1.0 - q @ x.T / (nq[:, None] * nx[None]))
    out = np.empty((len(q), len(x)))
    step = max(1, PAIRS // max(1, x.size))
    for at in range(0, len(q), step):
        gap = q[at : at + step, None, :] - x[None]
        out[at : at + step] = (gap * gap).sum(2)
    return out if metric == "squared_l2" else np.sqrt(out)


class Best:
    """The k lowest (score, id) of each query so far."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.ids = [np.zeros(0, np.int64)] * queries
        self.scores = [np.zeros(0)] * queries

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(scores) > self.k:
            near = np.round(scores, DIGITS)
            least = np.partition(near, self.k - 1)[self.k - 1]
            if not np.isnan(least):
                kept = np.flatnonzero(near <= least)
                ids, scores = ids[kept], scores[kept]
        ids, scores = np.concatenate((self.ids[query], ids)), np.concatenate((self.scores[query], scores))
        at = np.lexsort((ids, np.round(scores, DIGITS)))[: self.k]
        self.ids[query], self.scores[query] = ids[at], scores[at]

    def rows(self, qids: np.ndarray) -> pa.RecordBatch:
        n = [len(x) for x in self.ids]
        return pa.record_batch([pa.array(np.repeat(qids, n), pa.int64()), pa.array(np.concatenate(self.ids), pa.int64()), pa.array(np.concatenate(self.scores), pa.float64())], names=["qid", "id", "score"])


class Scorer(Protocol):
    """Scores queries against rows of a batch; `payload` is the column it reads."""

    payload: str

    def prepare(self, batch: pa.RecordBatch) -> np.ndarray: ...

    def rough(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Scores of each query and prepared row, or numbers in their order but for slack()."""

    def slack(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray | None:
        """How far rough numbers of each query may be off; None if they are the scores."""

    def exact(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Scores of one query and each row."""


@dataclass(frozen=True)
class Exact:
    """Distances to the vectors in `data`.

    Rough Euclidean distances are squares from one matrix product; only rows that could be among the k best by
    these have their differences summed up.
    """

    metric: str
    payload: str = "data"

    def prepare(self, batch: pa.RecordBatch) -> np.ndarray:
        return matrix(batch[self.payload])

    def rough(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if self.metric in ("cosine", "inner_product"):
            return distances(self.metric, q, rows)
        if q.shape[1] != rows.shape[1]:
            raise DimensionMismatch(f"queries have {q.shape[1]} components, vectors {rows.shape[1]}")
        return (q * q).sum(1)[:, None] - 2 * (q @ rows.T) + (rows * rows).sum(1)

    def slack(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray | None:
        if self.metric in ("cosine", "inner_product"):
            return None
        return 1e-7 * (1 + (q * q).sum(1) + (rows * rows).sum(1).max(initial=0))

    def exact(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return distances(self.metric, q[None], rows)[0]


def _run(shared, k: int, scorer: Scorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q, routes = shared.value
        best = Best(len(qids), k)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch["id"].to_numpy(zero_copy_only=False), scorer.prepare(batch)
            if routes is None:
                groups = [(None, np.arange(len(qids)))]
            else:
                shards = batch["shard_id"].to_numpy(zero_copy_only=False)
                groups = [(np.flatnonzero(shards == s), routes[s]) for s in np.unique(shards).tolist() if s in routes]
            for rows, asked in groups:
                own_ids, own = (ids, x) if rows is None else (ids[rows], x[rows])
                step = max(1, PAIRS // max(1, len(own)))
                for at in range(0, len(asked), step):
                    some = asked[at : at + step]
                    rough, slack = scorer.rough(q[some], own), scorer.slack(q[some], own)
                    for n, query in enumerate(some.tolist()):
                        if slack is None:
                            best.add(query, own_ids, rough[n])
                            continue
                        near = np.arange(len(own))
                        if len(own) > k:
                            near = np.flatnonzero(~(rough[n] > np.partition(rough[n], k - 1)[k - 1] + 2 * slack[n]))
                        best.add(query, own_ids[near], scorer.exact(q[query], own[near]))
        if len(qids):
            yield best.rows(qids)

    return run


def query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(qids, vectors) of at most about QUERY_BLOCK queries at a time, in order of qid."""
    parts = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    for part in range(parts):
        own = queries if parts == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == part)
        rows = sorted((r.qid, r.q) for r in own.select(F.col("qid").cast("long").alias("qid"), F.col("q").cast("array<double>").alias("q")).collect())
        if rows:
            if len({len(v) for _, v in rows}) > 1:
                raise DimensionMismatch("queries differ in dimensions")
            yield np.array([i for i, _ in rows]), np.array([v for _, v in rows])


def scan(candidates: DataFrame, queries: DataFrame, k: int, scorer: Scorer, routes: DataFrame | None = None) -> DataFrame:
    """(qid, id, score): at least the k best candidates (id, scorer.payload[, shard_id]) of each query (qid, q).

    With routes (qid, shard_id) a query sees the rows of its shards only. Each task keeps k rows a
    query; ranked() merges them.
    """
    spark = candidates.sparkSession
    names = [scorer.payload] + (["shard_id"] if routes is not None else [])
    given = candidates.select(F.col("id").cast("long").alias("id"), *names).where(F.col("id").isNotNull() & F.col(scorer.payload).isNotNull())
    out = None
    for qids, q in query_blocks(queries) if k > 0 else ():
        by_shard, own = None, given
        if routes is not None:
            number = {i: n for n, i in enumerate(qids.tolist())}
            by_shard = {}
            wanted = spark.createDataFrame([(i,) for i in number], "qid long")
            for r in routes.join(F.broadcast(wanted), "qid", "left_semi").select("qid", "shard_id").distinct().collect():
                by_shard.setdefault(r.shard_id, []).append(number[r.qid])
            by_shard = {s: np.array(sorted(n)) for s, n in by_shard.items()}
            own = given.where(F.col("shard_id").isin(list(by_shard))) if len(by_shard) <= NAMED_SHARDS else given
        found = own.mapInArrow(_run(spark.sparkContext.broadcast((qids, q, by_shard)), k, scorer), FOUND)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], FOUND) if out is None else out


def ranked(found: DataFrame, k: int | None = None) -> DataFrame:
    """found (qid, id, score, ...) with rank from 1 by (score, id), the first k only."""
    order = W.partitionBy("qid").orderBy(F.round("score", DIGITS), "id")
    out = found.withColumn("rank", F.row_number().over(order).cast("long"))
    return out if k is None else out.where(F.col("rank") <= k)


def knn(vectors: DataFrame, queries: DataFrame, metric: str, k: int, routes: DataFrame | None = None) -> DataFrame:
    """(qid, rank, id, score): the k nearest vectors (id, data) of each query (qid, q), ties by id."""
    found = scan(vectors, queries, k, Exact(metric.replace("-", "_")), routes)
    return ranked(found, k).select("qid", "rank", "id", shown(F.col("score")).alias("score"))
