"""Operators against brute force and known values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvix.errors import ConfigError, DimensionMismatch
from corvix.operators import backends, bm25, hybrid, ivf, merge, pq
from corvix.operators import scan as scanning
from corvix.plans.config import AnnFamily, DistanceMetric, FanOutPolicy, HnswConfig, HybridRankingPolicy, PqParams

SAMPLE = [
    (1, [0.1, 0.2]), (2, [0.9, 0.8]), (3, [0.4, 0.6]), (4, [0.6, 0.3]), (5, [0.2, 0.9]), (6, [0.0, 0.0]), (7, [1.0, 1.0]),
]
BM25_DOCS = [
    (1, "the quick brown fox jumps over the lazy dog"),
    (2, "the lazy dog slept all day"),
    (3, "quick brown rabbit runs fast"),
    (4, "fox and rabbit are friends"),
    (5, "the cat sat on the mat"),
]


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 8)) + 4 * rng.integers(0, 4, 300)[:, None], 3)
    df = spark.createDataFrame([(i, [float(v) for v in r], i) for i, r in enumerate(x)], "id long, data array<double>, pos long").repartition(5).cache()
    return x, df


def asked(df, n=7):
    return df.where(F.col("id") % 40 == 0).select(F.col("id").alias("qid"), F.col("data").alias("q"))


def brute(x, q, metric, k):
    d = scanning.distances(metric, q[None], x)[0]
    return [int(i) for i in np.lexsort((np.arange(len(x)), np.round(d, 9)))[:k]]


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "inner_product"])
def test_knn(cloud, metric):
    x, df = cloud
    got = {}
    for r in scanning.knn(df, asked(df), metric, 6).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    assert got == {q: brute(x, x[q], metric, 6) for q in range(0, 300, 40)}


def test_knn_edges(spark, cloud):
    _, df = cloud
    one = spark.createDataFrame([(0, [0.1, 0.2])], "qid long, q array<double>")
    small = spark.createDataFrame(SAMPLE, "id long, data array<double>")
    assert scanning.knn(small, one, "cosine", 0).count() == 0
    assert scanning.knn(small, one, "euclidean", 50).count() == len(SAMPLE)
    assert scanning.knn(small.limit(0), one, "euclidean", 5).count() == 0
    assert scanning.knn(small, one.limit(0), "euclidean", 5).count() == 0
    nulls = small.unionByName(spark.createDataFrame([(None, [1.0, 1.0]), (8, None)], "id long, data array<double>"))
    assert scanning.knn(nulls, one, "euclidean", 50).count() == len(SAMPLE)
    assert [r.id for r in scanning.knn(small, one, "cosine", 3).orderBy("rank").collect()][0] == 1
    zero = spark.createDataFrame([(0, [0.0, 0.0])], "qid long, q array<double>")
    assert [(r.id, r.score) for r in scanning.knn(small, zero, "cosine", 3).orderBy("rank").collect()] == [(1, 1.0), (2, 1.0), (3, 1.0)]
    with pytest.raises(Exception, match="components"):
        scanning.knn(df, one, "euclidean", 3).collect()
    with pytest.raises(DimensionMismatch):
        two = one.unionByName(spark.createDataFrame([(1, [1.0])], "qid long, q array<double>"))
        scanning.knn(small, two, "euclidean", 3)


def test_query_blocks(cloud, monkeypatch):
    _, df = cloud
    whole = {(r.qid, r.rank, r.id) for r in scanning.knn(df, asked(df), "euclidean", 4).collect()}
    monkeypatch.setattr(scanning, "QUERY_BLOCK", 3)
    monkeypatch.setattr(scanning, "PAIRS", 50)
    assert {(r.qid, r.rank, r.id) for r in scanning.knn(df, asked(df), "euclidean", 4).collect()} == whole


def test_merge_is_order_free(spark):
    rows = [(0, 3, 0.5), (0, 1, 0.2), (0, 3, 0.1), (0, 2, 0.2), (0, 9, 0.9)]
    kind = "qid long, id long, score double"
    for order in (rows, rows[::-1]):
        lists = [spark.createDataFrame(order[:2], kind), spark.createDataFrame(order[2:], kind)]
        out = merge.merge(lists, 3).orderBy("rank").collect()
        assert [(r.id, r.score) for r in out] == [(3, 0.1), (1, 0.2), (2, 0.2)]
    assert merge.merge([spark.createDataFrame(rows, kind)], 0).count() == 0


def test_rerank(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, data array<double>")
    q = spark.createDataFrame([(0, [0.0, 1.0])], "qid long, q array<double>")
    c = spark.createDataFrame([(0, 1, 0.0), (0, 2, 9.0), (0, 7, 0.5)], "qid long, id long, score double")
    assert [r.id for r in merge.rerank(c, v, q, "euclidean", 5).orderBy("rank").collect()] == [2, 1]
    assert [r.id for r in merge.rerank(c, v, q, "euclidean", keep_missing=True).orderBy("rank").collect()] == [2, 7, 1]
    assert merge.rerank_target(5, None, 4, True) == 20
    assert merge.rerank_target(5, 3, 4, True) == 5
    assert merge.rerank_target(5, 30, 4, False) == 5


def test_kmeans_and_assign(cloud):
    x, df = cloud
    c = ivf.kmeans(df, 4, 10, 7)
    again = ivf.kmeans(df.repartition(3), 4, 10, 7)
    assert sorted(map(tuple, c.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)
    centers = np.array([r.centroid for r in c.orderBy("shard_id").collect()])
    want = ((x[:, None] - centers[None]) ** 2).sum(2).argmin(1)
    assert {r.id: r.shard_id for r in ivf.assign(df, c).collect()} == dict(enumerate(want.tolist()))
    for k in range(4):
        assert np.allclose(x[want == k].mean(0), centers[k], atol=1e-6)
    assert ivf.kmeans(df.limit(3), 10, 2, 7).count() == 3
    with pytest.raises(ConfigError):
        ivf.kmeans(df, 0, 2, 7)


def test_centroid_blocks(cloud, monkeypatch):
    _, df = cloud
    c = ivf.kmeans(df, 5, 2, 7)
    whole = {(r.id, r.shard_id) for r in ivf.assign(df, c).collect()}
    monkeypatch.setattr(ivf, "CENTROID_BLOCK", 2)
    assert {(r.id, r.shard_id) for r in ivf.assign(df, c).collect()} == whole


def test_full_probe_is_exact(cloud):
    _, df = cloud
    c = ivf.kmeans(df, 4, 5, 7)
    s = ivf.positioned(ivf.assign(df, c))
    exact = {tuple(r) for r in scanning.knn(df, asked(df), "euclidean", 5).collect()}
    assert {tuple(r) for r in ivf.search(s, c, asked(df), "euclidean", 5, FanOutPolicy(4)).collect()} == exact
    assert ivf.search(s, c, asked(df), "euclidean", 5, FanOutPolicy(1, 0, 2)).groupBy("qid").count().agg(F.max("count")).first()[0] <= 2


def test_strided(spark):
    for n, p in [(10, 4), (7, 7), (5, 9), (11, 2), (9, 1), (120, 64)]:
        rows = spark.range(n).where(ivf.strided(F.col("id"), F.lit(n), F.lit(min(n, p)))).collect()
        m = min(n, p)
        want = {0} if m <= 1 else {i * (n - 1) // (m - 1) for i in range(m)}
        assert {r.id for r in rows} == want


def test_routing_dedups_shards(spark):
    c = spark.createDataFrame([(0, 5, [0.0]), (1, 5, [1.0]), (2, 6, [2.0]), (3, 7, [3.0])], "centroid_id int, shard_id int, centroid array<double>")
    q = spark.createDataFrame([(0, [0.0])], "qid long, q array<double>")
    assert [(r.shard_id, r.probe_rank) for r in ivf.route(q, c, FanOutPolicy(3)).orderBy("probe_rank").collect()] == [(5, 1), (6, 3)]
    assert [r.shard_id for r in ivf.route(q, c, FanOutPolicy(4, 2)).orderBy("probe_rank").collect()] == [5, 6]


def test_pq(cloud):
    x, df = cloud
    book = pq.train(df, PqParams(2, 8), 4, 11)
    coded = pq.encode(df, book).cache()
    b = pq.loaded(book)
    for r in coded.where("id < 20").collect():
        assert list(r.codes) == [int(((x[r.id][4 * m : 4 * m + 4] - b[m]) ** 2).sum(1).argmin()) for m in range(2)]
    back = pq.reconstruct(coded.drop("data"), book)
    again = pq.encode(back, book)
    assert {(r.id, tuple(r.codes)) for r in again.collect()} == {(r.id, tuple(r.codes)) for r in coded.collect()}
    approx = {r.id: np.array(r.data) for r in back.collect()}
    found = pq.adc_topk(coded, book, asked(df), 5).where("qid = 40").orderBy("rank").collect()
    d = {i: float(((x[40] - v) ** 2).sum()) for i, v in approx.items()}
    assert [r.score for r in found] == pytest.approx(sorted(d.values())[:5], abs=1e-5)
    assert pq.bad_codes(coded, 8).count() == 0
    with pytest.raises(ConfigError):
        PqParams(3, 8).check(8)
    with pytest.raises(Exception, match="codebook"):
        pq.reconstruct(coded.drop("data").withColumn("codes", F.transform("codes", lambda c: (c + 100).cast("short"))), book).collect()


GOLDEN = {
    "fox": [(4, -0.958994), (1, -0.727601)],
    "quick brown": [(3, -1.917988), (1, -1.455203)],
    "the": [(5, -0.778062), (1, -0.672390), (2, -0.546936)],
    "fox fox": [(4, -1.917988), (1, -1.455203)],
    "zebra": [],
    "": [],
}


def test_bm25(spark):
    docs = spark.createDataFrame(BM25_DOCS, "id long, text string")
    index = bm25.build(docs)
    assert (index.num_docs(), index.num_terms()) == (5, 21)
    queries = spark.createDataFrame(list(enumerate(GOLDEN)), "qid long, text string")
    got = {t: [] for t in GOLDEN}
    for r in bm25.search(index, queries, 10).orderBy("qid", "rank").collect():
        got[list(GOLDEN)[r.qid]].append((r.id, r.score))
    for text, want in GOLDEN.items():
        assert [i for i, _ in got[text]] == [i for i, _ in want]
        assert [s for _, s in got[text]] == pytest.approx([s for _, s in want], abs=1e-6)
    assert bm25.search(index, queries, 0).count() == 0
    assert bm25.faults(index).count() == 0
    empty = bm25.build(docs.limit(0))
    assert bm25.search(empty, queries, 5).count() == 0


def test_bm25_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a"), (2, None), (3, ""), (None, "a")], "id long, text string")
    index = bm25.build(docs)
    assert {(r.id, r.dl) for r in index.doc_lengths.collect()} == {(1, 3), (2, 0), (3, 0)}
    assert {(r.term, r.id, r.tf) for r in index.postings.collect()} == {("a", 1, 2), ("b", 1, 1)}


def test_hybrid(spark):
    kind = "qid long, id long, score double"
    v = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.1)], kind)
    b = spark.createDataFrame([(0, 2, -2.0), (0, 3, -1.0)], kind)
    out = hybrid.blend(v, b, HybridRankingPolicy(0.7, 0.3), 10).orderBy("rank").collect()
    assert [(r.id, r.score) for r in out] == [(2, 0.0), (1, 1.0), (3, 1.0)]
    assert [r.id for r in hybrid.blend(v, b.limit(0), None, 1).collect()] == [2]
    with pytest.raises(ConfigError):
        HybridRankingPolicy(0.0, 0.0)
    with pytest.raises(ConfigError):
        HybridRankingPolicy(float("nan"), 1.0)


def test_backends():
    assert backends.families() == ["diskann", "hnsw", "ivf_flat", "ivf_pq"]
    assert backends.exists("ivf-flat") and not backends.exists("lsh")
    assert backends.resolve("ivf-flat", "pq8").family == AnnFamily.IVF_PQ
    assert backends.resolve("hnsw", "pq8").family == AnnFamily.HNSW
    assert backends.resolve("ivf-flat", None).family == AnnFamily.IVF_FLAT
    with pytest.raises(ConfigError):
        backends.backend("diskann").validate(8, DistanceMetric.COSINE)
    with pytest.raises(ConfigError):
        backends.backend("ivf_pq", params=PqParams(3, 4)).validate(8, DistanceMetric.EUCLIDEAN)
    with pytest.raises(ConfigError):
        HnswConfig(m=0)
