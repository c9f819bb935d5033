"""Exact top-k inner products by vector-approximation files."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._common import dropped, written

SCALE = 64
#: Bits of a cell's number, for each component.
BITS = 6
#: Vectors in a block of the file, and queries that a job takes along.
BLOCK, QUERIES = 16_384, 32_768
#: Queries whose bounds are worked out together.
TILE = 64
#: Exact vectors read at first for a query, besides k.
AHEAD = 44
#: Pairs of a query and a vector (16 bytes each) that are broadcast to read exact vectors; more are joined by a shuffle.
PAIRS = 1_000_000


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, x): components floor(scale * x), as doubles, of the vectors that have an id and only finite components.

    Components for which scale * x is beyond a double count as not finite.
    """
    x = F.col("x")
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col).cast("array<double>"), lambda v: v * scale).alias("x"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    given = given.where(F.col("id").isNotNull() & x.isNotNull()).where((F.size("x") > 0) & ~bad)
    whole = F.transform(x, lambda v: F.when(F.abs(v) < 2.0**53, F.floor(v).cast("double")).otherwise(v))  # larger ones are whole
    return given.select("id", whole.alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _extremes(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo = hi = None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch["x"], dim)
                lo = x.min(0) if lo is None else np.minimum(lo, x.min(0))
                hi = x.max(0) if hi is None else np.maximum(hi, x.max(0))
        if lo is not None:
            yield pa.record_batch([pa.array([lo.tolist()], pa.list_(pa.float64())), pa.array([hi.tolist()], pa.list_(pa.float64()))], names=["lo", "hi"])

    return run


class Cells:
    """Cells of equal width for each component; all bounds are whole numbers and belong to their cell."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, bits: int = BITS) -> None:
        self.lo, self.hi = lo, hi
        self.width = np.maximum(1, -(-(hi - lo + 1) // (1 << bits)))

    def number(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.lo) // self.width).astype(np.uint8)

    def bounds(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest component that a cell may hold."""
        low = self.lo + cells * self.width
        return low, np.minimum(low + self.width - 1, self.hi)


def _file(cells: Cells, dim: int):
    """Blocks of the approximation: places in the exact file, ids, and cell numbers of up to BLOCK vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def block() -> pa.RecordBatch:
            row = [np.concatenate(c).tobytes() for c in zip(*held)]
            return pa.record_batch([pa.array([v], pa.binary()) for v in row], names=["nos", "ids", "cells"])

        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                held.append((part["no"].to_numpy().astype("<i8"), part["id"].to_numpy().astype("<i8"), cells.number(_matrix(part["x"], dim))))
                n += part.num_rows
                if n >= BLOCK:
                    yield block()
                    held, n = [], 0
        if held:
            yield block()

    return run


class Asked:
    """Queries of a job: ids ascending, their components, and the bounds of their scores from cells."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, kind: type) -> None:
        self.ids, self.x, self.kind, self.tile = ids, x, kind, TILE
        self.floors = np.full(len(ids), -np.inf)

    def bounds(self, batches: Iterable[pa.RecordBatch], cells: Cells) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each block and tile of queries: the tile's start, places, and least and most of all scores; -inf for own ids."""
        up, down = np.maximum(self.x, 0).astype(self.kind), np.minimum(self.x, 0).astype(self.kind)
        for batch in batches:
            for row in batch.to_pylist():
                nos, ids = np.frombuffer(row["nos"], "<i8"), np.frombuffer(row["ids"], "<i8")
                low, high = cells.bounds(np.frombuffer(row["cells"], np.uint8).reshape(len(ids), -1).astype(np.float64))
                low, high = low.T.astype(self.kind), high.T.astype(self.kind)
                order = np.argsort(ids, kind="stable")
                for at in range(0, len(self.ids), self.tile):
                    tile = slice(at, at + self.tile)
                    least, most = up[tile] @ low + down[tile] @ high, up[tile] @ high + down[tile] @ low
                    first, last = (np.searchsorted(ids, self.ids[tile], side, sorter=order) for side in ("left", "right"))
                    for i in np.flatnonzero(first < last).tolist():
                        least[i, order[first[i] : last[i]]] = most[i, order[first[i] : last[i]]] = -np.inf
                    yield at, nos, least, most


def _floors(shared, cells: Cells, k: int):
    """First scan: the k largest lower bounds that a task finds for each query, a row for each tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Asked = shared.value
        best = np.full((len(asked.ids), k), -np.inf)
        for at, _, least, _ in asked.bounds(batches, cells):
            both = np.concatenate((best[at : at + asked.tile], least), 1)
            best[at : at + asked.tile] = np.partition(both, both.shape[1] - k, 1)[:, -k:]
        for at in range(0, len(best), asked.tile):
            yield pa.record_batch([pa.array([at], pa.int32()), pa.array([best[at : at + asked.tile].tobytes()], pa.binary())], names=["tile", "best"])

    return run


def _merged(k: int):
    """The kth of all tasks' lower bounds for each query of a tile, from rows sorted by tile; one is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, best = None, np.empty((0, k))

        def put() -> pa.RecordBatch:
            return pa.record_batch([pa.array([tile], pa.int32()), pa.array([best.min(1).tobytes()], pa.binary())], names=["tile", "floors"])

        for batch in batches:
            for at, data in zip(batch["tile"].to_pylist(), batch["best"].to_pylist()):
                own = np.frombuffer(data).reshape(-1, k)
                if at != tile:
                    if tile is not None:
                        yield put()
                    tile, best = at, own
                else:
                    best = np.partition(np.concatenate((best, own), 1), k, 1)[:, -k:]
        if tile is not None:
            yield put()

    return run


def _survivors(shared, cells: Cells):
    """Second scan: places of the vectors whose score may reach the kth lower bound, with their upper bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Asked = shared.value
        for at, nos, _, most in asked.bounds(batches, cells):
            query, place = np.nonzero((most >= asked.floors[at : at + asked.tile, None]) & (most > -np.inf))
            if len(query):
                columns = [asked.ids[at + query], nos[place], most[query, place].astype(np.float64)]
                yield pa.record_batch([pa.array(c) for c in columns], names=["query_id", "no", "most"])

    return run


def _scores(shared, dim: int):
    """Exact scores of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Asked = shared.value
        for batch in batches:
            at = np.searchsorted(asked.ids, batch["query_id"].to_numpy())
            found = np.einsum("ij,ij->i", asked.x[at], _matrix(batch["x"], dim))
            yield pa.record_batch([batch["query_id"], batch["id"], pa.array(found.astype(np.int64))], names=["query_id", "vec_id", "score"])

    return run


FOUND = "query_id long, vec_id long, score long"


def _best(found: DataFrame, k: int, score: str = "score") -> DataFrame:
    best = W.partitionBy("query_id").orderBy(F.desc(score), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _search(file: DataFrame, exact: DataFrame, asked: Asked, cells: Cells, dim: int, k: int) -> DataFrame:
    """The k best of each query: two scans of the approximation, then exact vectors in order of their upper bounds."""
    spark = file.sparkSession
    floors = file.mapInArrow(_floors(spark.sparkContext.broadcast(asked), cells, k), "tile int, best binary")
    for r in floors.repartition("tile").sortWithinPartitions("tile").mapInArrow(_merged(k), "tile int, floors binary").collect():  # 8 bytes a query
        asked.floors[r.tile : r.tile + asked.tile] = np.frombuffer(r.floors)
    shared = spark.sparkContext.broadcast(asked)
    left = written(file.mapInArrow(_survivors(shared, cells), "query_id long, no long, most double"), "survivors")

    def scored(pairs: DataFrame) -> DataFrame:
        few = pairs.limit(PAIRS + 1).count() <= PAIRS
        rows = exact.join(F.broadcast(pairs) if few else pairs, "no").select("query_id", "id", "x")
        return written(rows.mapInArrow(_scores(shared, dim), FOUND), "scores")

    order = W.partitionBy("query_id").orderBy(F.desc("most"), "no")
    first = written(left.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + AHEAD).select("query_id", "no", "most"), "first")
    near = scored(first.select("query_id", "no"))
    # where k scores are known, the kth of them is the least that a vector not yet read has to reach
    certain = _best(near, k).groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
    rest = left.join(first, ["query_id", "no"], "left_anti").join(certain, "query_id")
    later = scored(written(rest.where((F.col("n") < k) | (F.col("most") >= F.col("kth"))).select("query_id", "no"), "rest"))
    out = written(_best(near.unionByName(later), k).drop("rank"), "best")
    dropped(left, first, near, later)
    return out


def sortable(n: int) -> str:
    """A string for a whole number of up to 9,999 digits, in the numbers' order."""
    digits = str(abs(n))
    if n >= 0:
        return f"1{len(digits):04d}{digits}"
    return f"0{9999 - len(digits):04d}{digits.translate(str.maketrans('0123456789', '9876543210'))}"


def _plainly(shared, dim: int, k: int):
    """The k best of a task's vectors for each query by whole numbers of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Asked = shared.value
        queries = [[int(v) for v in x] for x in asked.x.tolist()]
        best: list[list[tuple[int, int]]] = [[] for _ in queries]
        for batch in batches:
            for own, x in zip(batch["id"].to_pylist(), batch["x"].to_pylist()):
                numbers = [int(v) for v in x]
                for i, q in enumerate(queries):
                    if own != asked.ids[i]:
                        best[i].append((-sum(a * b for a, b in zip(q, numbers)), own))
                        if len(best[i]) >= 4 * k + 64:
                            best[i] = sorted(best[i])[:k]
        for i, found in enumerate(best):
            rows = sorted(found)[:k]
            if rows:
                yield pa.record_batch([pa.array([int(asked.ids[i])] * len(rows), pa.int64()), pa.array([v for _, v in rows], pa.int64()), pa.array([sortable(-n) for n, _ in rows])], names=["query_id", "vec_id", "big"])

    return run


def _sortable_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch["query_id"], batch["vec_id"], pa.array([sortable(n) for n in batch["score"].to_pylist()], pa.string())], names=["query_id", "vec_id", "big"])


def _nearest_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for big in batch["big"].to_pylist():
            n = int(big[5:]) if big[0] == "1" else -int(big[5:].translate(str.maketrans("0123456789", "9876543210")))
            found.append(max(-(2**63), min(2**63 - 1, n)))
        yield pa.record_batch([batch["query_id"], batch["rank"], batch["vec_id"], pa.array(found, pa.int64())], names=["query_id", "rank", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query's (id, x) with all vectors (id, x).

    Components are whole numbers. Ties go to the smaller vec_id; a query's own id is no candidate.

    Vectors are written as two files: exact ones, and an approximation in blocks, with a few bits of cell number
    for each component. Queries are taken along by broadcast, at most 32,768 in a job. A scan of the approximation gives
    each query the kth best of all lower bounds; a second one lists the vectors whose upper bound reaches it. Of
    these, exact vectors are read for the k + 44 with the best upper bounds of each query, then for those
    whose bound reaches the kth score found, and then the result is certain. Of equal vectors those with the k + 1
    smallest ids stand for all, k rows of each, as no other can be among the k best.

    Vectors with a component whose square times the number of components is beyond 2**53 are in neither bound: they,
    as queries and as candidates, are compared with all others in whole numbers of any size. A score beyond a
    long is returned as the nearest long, and ranked as what it is.

    Vectors are compared with those of as many components; others take no part in that. A repeated vec_id
    is a candidate for each row; for a query with a repeated id the smallest vector counts. Fewer than k
    candidates are all returned; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    kind = "array<double>"
    same = W.partitionBy("x").orderBy("id")
    given = vectors.select("id", F.col("x").cast(kind).alias("x"))
    given = given.withColumn("ids", F.dense_rank().over(same)).withColumn("again", F.row_number().over(same) - F.rank().over(same))
    given = given.where((F.col("ids") <= k + 1) & (F.col("again") < k))
    largest = F.array_max(F.transform("x", F.abs))
    sized = given.select("id", "x", F.size("x").alias("dim"), (largest * largest * F.size("x") >= 2.0**53).alias("wide"))
    exact = written(sized.select(F.monotonically_increasing_id().alias("no"), "*"), "exact")
    queries = queries.select("id", F.col("x").cast(kind).alias("x")).groupBy("id", F.size("x").alias("dim")).agg(F.min("x").alias("x"))
    queries = written(queries.withColumn("wide", largest * largest * F.col("dim") >= 2.0**53), "queries")
    some_wide = not exact.where("wide").isEmpty() or not queries.where("wide").isEmpty()
    outs, plain = [], []

    def blocks(asked: DataFrame, kind: type) -> Iterator[Asked]:
        parts = max(1, math.ceil(asked.count() / QUERIES))
        for part in range(parts):
            rows = sorted((r.id, r.x) for r in asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).select("id", "x").collect())
            if rows:
                yield Asked(np.array([i for i, _ in rows]), np.array([x for _, x in rows], np.float64), kind)

    for (dim,) in queries.select("dim").distinct().orderBy("dim").collect():
        own, asking = exact.where(F.col("dim") == dim), queries.where(F.col("dim") == dim)
        narrow = own.where("not wide").select("no", "id", "x")
        ends = narrow.mapInArrow(_extremes(dim), "lo array<double>, hi array<double>").collect()  # one row for each partition
        if ends:
            lo, hi = np.min([r.lo for r in ends], 0), np.max([r.hi for r in ends], 0)
            top = asking.where("not wide").select(F.max(largest)).first()[0] or 0.0
            small = np.float32 if dim * max(np.abs(lo).max(), np.abs(hi).max(), top) ** 2 < 1 << 24 else np.float64
            cells = Cells(lo, hi)
            file = written(narrow.mapInArrow(_file(cells, dim), "nos binary, ids binary, cells binary"), "vafile")
            outs += [_search(file, narrow, asked, cells, dim, k) for asked in blocks(asking.where("not wide"), small)]
        if some_wide:
            for candidates, those in ((own.where("wide"), asking.where("not wide")), (own, asking.where("wide"))):
                for asked in blocks(those, np.float64):
                    shared = spark.sparkContext.broadcast(asked)
                    plain.append(candidates.select("id", "x").mapInArrow(_plainly(shared, dim, k), "query_id long, vec_id long, big string"))
    if not outs and not plain:
        return spark.range(0).select(F.col("id").alias("query_id"), F.col("id").cast("int").alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score"))
    found = None
    for more in outs:
        found = more if found is None else found.unionByName(more)
    if not some_wide:
        return _best(found, k).select("query_id", "rank", "vec_id", "score")
    found = None if found is None else found.mapInArrow(_sortable_scores, "query_id long, vec_id long, big string")
    for more in plain:
        found = more if found is None else found.unionByName(more)
    return _best(found, k, "big").select("query_id", "rank", "vec_id", "big").mapInArrow(_nearest_long, "query_id long, rank int, vec_id long, score long")


def digest(embeddings: DataFrame) -> DataFrame:
    """Top 20 of every row whose vec_id is divisible by 20, against all rows."""
    vectors = whole_numbers(embeddings)
    return top_k(vectors, vectors.where("id % 20 = 0"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
