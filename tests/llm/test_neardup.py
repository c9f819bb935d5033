"""Near-duplicate groups against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvix.llm import _common, components, neardup
from corvix.llm.components import UnionFind

SCHEMA = "doc_id long, text string, digest string, kept string"


def words(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def edited(rng, base, share):
    return [w if rng.random() > share else f"x{rng.randrange(10**6)}" for w in base]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for size, shares in [(400, [0, 0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.2]), (60, [0, 0.02, 0.02, 0.1])]:
        base = words(rng, size)
        for s in shares:
            out.append(" ".join(edited(rng, base, s)))
    hot = words(rng, 150)
    out += [" ".join(edited(rng, hot, rng.choice([0.002, 0.01, 0.03]))) for _ in range(60)]
    out += [" ".join(hot)] * 30
    out += [" ".join(words(rng, rng.randrange(1, 80))) for _ in range(40)]
    out += ["a b c", "A  b\tC", "a b", "", None, " \n ", "É b c d e f", "é b c d e f", "long " * 20000, "LONG " * 20000]
    rng.shuffle(out)
    return [(i * 3 + 1, t) for i, t in enumerate(out)]


def sets(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, percent):
    u = UnionFind()
    s = [(i, sets(t)) for i, t in rows]
    for x, (i, a) in enumerate(s):
        for k, b in s[x + 1 :]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                u.union(i, k)
    return {i: (len(a), u.find(i)) for i, a in s}


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("group, floor", [(128, 200), (4, 3)])
def test_groups(spark, rows, monkeypatch, percent, group, floor):
    monkeypatch.setattr(neardup, "GROUP", group)
    monkeypatch.setattr(neardup, "BLOCK", min(group, 5))
    monkeypatch.setattr(_common, "HOT_FLOOR", floor)
    docs = spark.createDataFrame([(i, t, "x", None) for i, t in rows], SCHEMA).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, percent).collect()}
    assert got == brute(rows, percent)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(5, "a b c d e f", "", ""), (5, "a b c d e f", "", ""), (None, "a b c d e f", "", ""), (2, "A b c d e f", "", ""), (7, None, None, None)], SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()), key=str)
    assert got == [(2, 2, 2, True), (5, 2, 2, False), (5, 2, 2, False), (7, 0, 7, True), (None, 2, None, True)]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def brute_rows(rows, percent):
    """Components of documents: rows are linked by their sets, or by their doc_id if none is empty."""
    u = UnionFind()
    s = [(i, sets(t)) for i, t in rows]
    for x, (_, a) in enumerate(s):
        for y, (_, b) in enumerate(s[:x]):
            if a and b and (s[x][0] == s[y][0] or 100 * len(a & b) >= percent * len(a | b)):
                u.union(x, y)
    least = {}
    for x, (i, _) in enumerate(s):
        least[u.find(x)] = min(least.get(u.find(x), i), i)
    return sorted((i, len(a), least[u.find(x)] if a else i) for x, (i, a) in enumerate(s))


@pytest.mark.parametrize("group, floor", [(4096, 200), (3, 3)])
def test_repeated_ids(spark, monkeypatch, group, floor):
    rng = random.Random(8)
    monkeypatch.setattr(neardup, "GROUP", group)
    monkeypatch.setattr(_common, "HOT_FLOOR", floor)
    text = words(rng, 200)
    rows = [(5, "a few words"), (5, " ".join(text)), (7, " ".join(text)), (8, " ".join(text[:-1])), (9, " ".join(words(rng, 60)))]
    bases = [words(rng, 90) for _ in range(6)]
    for _ in range(80):
        rows.append((rng.randrange(20, 90), " ".join(edited(rng, rng.choice(bases), rng.choice([0, 0.005, 0.02, 0.3])))))
    rows += [(95, rng.choice(["", None, "one two", "one two three"])) for _ in range(12)]
    docs = spark.createDataFrame([(i, t, "x", None) for i, t in rows], SCHEMA).repartition(5)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, 80).collect())
    assert got == brute_rows(rows, 80)


def test_much_repeated_id(spark):
    one = spark.range(100_000).select(F.lit(3).cast("long").alias("doc_id"), F.lit("one two three four five six seven").alias("text"))
    docs = one.union(spark.createDataFrame([(2, "one two three four five six seven eight"), (3, "other words")], "doc_id long, text string"))
    got = neardup.near_duplicates(docs, 75).groupBy("doc_id", "n_shingles", "component_id").count().collect()
    assert sorted(map(tuple, got)) == [(2, 4, 2, 1), (3, 1, 2, 1), (3, 3, 2, 100_000)]


def test_superminhash():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for share in (0.2, 0.5, 0.9):
        n = int(1000 * share)
        hits = []
        for k in range(30):
            a, b = neardup.superminhash(x[k : k + 1000] ^ np.uint64(k), 64), neardup.superminhash(np.concatenate((x[k : k + n], x[1000 + k : 2000 + k - n])) ^ np.uint64(k), 64)
            hits.append((a == b).mean())
        assert abs(np.mean(hits) - n / (2000 - n)) < 0.05
    few = neardup.superminhash(x[:3], 16)
    assert np.isfinite(few).all() and len(set(few.tolist())) == 16


def test_banding():
    for percent in (80, 85, 95, 100):
        bands, rows = neardup.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= neardup.MISSED and bands <= neardup.BANDS


def test_components(spark, monkeypatch):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5000 + i) for i in range(300)] + [(None, 3), (4, 4)]
    u = UnionFind()
    for a, b in edges:
        if a is not None and a != b:
            u.union(a, b)
    nodes = {x for e in edges if None not in e and e[0] != e[1] for x in e}
    monkeypatch.setattr(_common, "HOT_FLOOR", 20)
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    assert {r.node: r.label for r in components.connected_components(df).collect()} == {x: u.find(x) for x in nodes}
    assert components.connected_components(df.limit(0)).count() == 0


def test_spread_join(spark, monkeypatch):
    monkeypatch.setattr(_common, "HOT_FLOOR", 10)
    big = spark.range(500).select(F.when(F.col("id") < 300, 7).otherwise(F.col("id") % 20).alias("k"), "id")
    small = big.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    out = _common.spread_join(big, small, ["k"], "n", ["id"], 500)
    assert out.count() == 500 and out.where("v != 2 * k").count() == 0
