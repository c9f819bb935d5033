"""Normalisation, rates, fingerprints and sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

FNV_BASE, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def minmax(score: Column, over: WindowSpec) -> Column:
    """Scores of a list scaled to 0 (best) to 1: NaN is 1.0, lists of one value or of NaN alone are 0.0."""
    real = F.when(~F.isnan(score), score)
    lo, hi = F.min(real).over(over), F.max(real).over(over)
    scaled = F.when(F.isnan(score), F.lit(1.0)).when(lo == hi, F.lit(0.0)).otherwise((score - lo) / (hi - lo))
    return F.when(lo.isNull(), F.lit(0.0)).otherwise(scaled)


def rate(hits: Column, total: Column) -> Column:
    """hits / total, 0 where total is 0."""
    return F.when(total == 0, F.lit(0.0)).otherwise(hits.cast("double") / total)


def nearest_rank(column: str, share: float) -> Column:
    """Nearest-rank percentile as an aggregate; 0 of nothing."""
    return F.coalesce(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {column})").cast("double"), F.lit(0.0))


def fnv1a(data: bytes) -> str:
    """FNV-1a of 64 bits as 16 hexadecimal digits."""
    h = FNV_BASE
    for byte in data:
        h = (h ^ byte) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


def fnv1a_each(values: list[bytes | None]) -> list[str | None]:
    """fnv1a of each value: all values' bytes of one place at a time, longest values first."""
    order = sorted((i for i, v in enumerate(values) if v is not None), key=lambda i: -len(values[i]))
    sizes = np.array([len(values[i]) for i in order], np.int64)
    data = np.frombuffer(b"".join(values[i] for i in order), np.uint8).astype(np.uint64)
    begins = np.cumsum(sizes) - sizes
    h = np.full(len(order), FNV_BASE, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(int(sizes[0]) if len(sizes) else 0):
            left = int(np.searchsorted(-sizes, -at, "left"))  # those longer than `at`
            h[:left] = (h[:left] ^ data[begins[:left] + at]) * np.uint64(FNV_PRIME)
    out: list[str | None] = [None] * len(values)
    for i, x in zip(order, h.tolist()):
        out[i] = f"{x:016x}"
    return out


def fingerprint(column: Column) -> Column:
    """fnv1a of a binary column; null for null. It goes through values byte by byte, so it is for small artifacts."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series(fnv1a_each([None if v is None else bytes(v) for v in values]), dtype=object)

    return F.pandas_udf(run, "string")(column)


def raw_shard_bytes(centroids: Column, vectors: Column, dims: Column) -> Column:
    """Size of a raw shard: 32 bytes of header, centroids of 4-byte components, rows of an 8-byte id and these."""
    return F.lit(8 + 16 + 8) + centroids * dims * 4 + vectors * (8 + 4 * dims)


def pq_shard_bytes(centroids: Column, vectors: Column, dims: Column, m: Column) -> Column:
    """Size of a compressed shard: 40 bytes of header, centroids, rows of an 8-byte id and m codes."""
    return F.lit(8 + 24 + 8) + centroids * dims * 4 + vectors * (8 + m)


def raw_memory(n: Column, dims: Column) -> Column:
    most = F.lit(2**63 - 1)
    return F.coalesce(F.try_multiply(F.try_multiply(n, dims), F.lit(4).cast("long")), most)


def pq_memory(n: Column, dims: Column, m: Column, k: Column) -> Column:
    """Codes of all vectors and the codebook; the largest number if it overflows."""
    most = F.lit(2**63 - 1)
    codebook = F.try_multiply(F.try_multiply(F.try_multiply(m, k), F.floor(dims / m)), F.lit(4).cast("long"))
    return F.coalesce(F.try_add(F.try_multiply(n, m), codebook), most)


def canonical_family(algorithm: Column, compressed: Column, codec: Column) -> Column:
    """Name of an index family: flat k-means is ivf_flat, or ivf_pq with 8-bit codes; others with _ for -."""
    flat = algorithm.isin("ivf-flat", "kmeans-flat")
    return F.when(flat & compressed & (codec == "pq8"), "ivf_pq").when(flat & ~compressed, "ivf_flat").otherwise(F.translate(algorithm, "-", "_"))
