"""Which shards a bounded least-recently-used cache would have held; and loading hot shards ahead."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from ..errors import ConfigError
from ..evaluation.metrics import prefetch
from .config import PrefetchPolicy


@dataclass
class CacheMetrics:
    hits: int = 0
    misses: int = 0
    evictions: int = 0
    load_ns: int = 0

    def hit_rate(self) -> float:
        total = self.hits + self.misses
        return self.hits / total if total else 0.0

    def mean_load_ns(self) -> float:
        return self.load_ns / self.misses if self.misses else 0.0


class ShardCache:
    """Keeps the `capacity` shards used last."""

    def __init__(self, capacity: int) -> None:
        if capacity < 1:
            raise ConfigError("capacity must be at least 1")
        self.capacity, self.held, self.metrics = capacity, OrderedDict(), CacheMetrics()

    def access(self, shard: int) -> bool:
        """Whether the shard was held; it is afterwards."""
        hit = shard in self.held
        if hit:
            self.held.move_to_end(shard)
            self.metrics.hits += 1
        else:
            self.metrics.misses += 1
            self.held[shard] = True
            if len(self.held) > self.capacity:
                self.held.popitem(last=False)
                self.metrics.evictions += 1
        return hit


class LoadedShards:
    """Rows of the `capacity` shards used last, kept in the executors' memory; others are loaded when they are asked for.

    sizes: bytes of each shard as stored.
    """

    def __init__(self, rows: DataFrame, sizes: dict[int, int], capacity: int) -> None:
        self.rows, self.sizes = rows, sizes
        self.cache, self.tables = ShardCache(capacity), {}

    @property
    def metrics(self) -> CacheMetrics:
        return self.cache.metrics

    def retained_bytes(self) -> int:
        return sum(self.sizes.get(s, 0) for s in self.cache.held)

    def load(self, shard: int) -> DataFrame:
        if not self.cache.access(shard):
            began = time.perf_counter_ns()
            table = self.rows.where(self.rows["shard_id"] == shard).persist()
            table.count()
            self.metrics.load_ns += time.perf_counter_ns() - began
            self.tables[shard] = table
            for gone in [s for s in self.tables if s not in self.cache.held]:
                self.tables.pop(gone).unpersist()
        return self.tables[shard]

    def routed(self, shards: Iterable[int]) -> DataFrame:
        """Rows of some shards; read from storage, past the cache, if they are more than it holds."""
        wanted = sorted(set(shards))
        if len(wanted) > self.cache.capacity:
            return self.rows.where(self.rows["shard_id"].isin(wanted))
        out = self.rows.limit(0)
        for n, shard in enumerate(wanted):
            table = self.load(shard)
            out = table if n == 0 else out.unionByName(table)
        return out


def replay(trace: DataFrame, capacity: int, by: str = "worker") -> DataFrame:
    """(by, hits, misses, hit_rate) of caches fed by trace (by, at, shard_id) in order of `at`, one for each value of by.

    The trace is sorted and streamed; a task holds a cache, not the trace.
    """
    kind = trace.schema[by].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, cache = None, None

        def row() -> pd.DataFrame:
            m = cache.metrics
            return pd.DataFrame({by: [name], "hits": [m.hits], "misses": [m.misses], "hit_rate": [m.hit_rate()]})

        for batch in batches:
            for own, shard in zip(batch[by], batch["shard_id"]):
                if cache is None or own != name:
                    if cache is not None:
                        yield row()
                    name, cache = own, ShardCache(capacity)
                cache.access(shard)
        if cache is not None:
            yield row()

    ordered = trace.select(by, "at", "shard_id").repartition(by).sortWithinPartitions(by, "at", "shard_id")
    return ordered.mapInPandas(run, f"{by} {kind}, hits long, misses long, hit_rate double")


def warm(shards: DataFrame, probes: DataFrame, policy: PrefetchPolicy) -> DataFrame:
    """Rows of the shards that are probed often, kept in memory; none if the policy is off."""
    if not policy.enabled:
        return shards.limit(0)
    names = prefetch(probes, policy.min_query_count).select("shard_id")
    return shards.join(names, "shard_id", "left_semi").persist()
