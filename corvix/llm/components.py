"""Connected components of a graph that fits no single machine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import dropped, spread_join, written

SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])


class UnionFind:
    """Disjoint sets whose root is the smallest member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of each batch as stars of its own disjoint sets: no more rows than nodes."""
    for batch in batches:
        sets = UnionFind()
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist()):
            sets.union(a, b)
        nodes = list(sets.parent)
        roots = [sets.find(x) for x in nodes]
        yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], schema=SCHEMA)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b), label being the smallest node of its component.

    Each batch of edges is first contracted by a local union-find. Then, until no edge is left, every
    node takes the smallest node among itself and its neighbours, and the edges move to those: chains
    halve, stars vanish at once. Node degrees are known before each join, so hubs are dealt to many
    tasks. Nothing is collected. Null ends and loops are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    edges = edges.select("a", "b").where("a is not null and b is not null and a != b")
    current = written(edges.mapInArrow(_forest, "a long, b long").distinct(), "edges")
    steps: list[DataFrame] = []
    while total := current.count():
        both = current.union(current.select("b", "a"))
        step = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("to"), F.count("*").alias("n")), "step")
        steps.append(step)
        ends = step.select(F.col("node").alias("a"), F.col("to").alias("a2"), "n")
        moved = spread_join(current, ends, ["a"], "n", ["b"], 2 * total)
        ends = step.select(F.col("node").alias("b"), F.col("to").alias("b2"), "n")
        moved = spread_join(moved, ends, ["b"], "n", ["a"], 2 * total)
        moved = moved.select(F.col("a2").alias("a"), F.col("b2").alias("b")).where("a != b")
        following = written(moved.mapInArrow(_forest, "a long, b long").distinct(), "edges")
        dropped(current)
        current = following
    dropped(current)
    if not steps:
        return spark.range(0).select(F.col("id").alias("node"), F.col("id").alias("label"))
    out = steps[0].select("node", F.col("to").alias("label"))
    for step in steps[1:]:
        out = written(out, "labels")
        nodes = out.count()
        sizes = out.groupBy(F.col("label").alias("node")).agg(F.count("*").alias("n"))
        ends = sizes.join(step.select("node", "to"), "node", "left").select(F.col("node").alias("label"), F.coalesce("to", "node").alias("_to"), "n")
        out = spread_join(out, ends, ["label"], "n", ["node"], nodes).select("node", F.col("_to").alias("label"))
    return written(out, "labels")
