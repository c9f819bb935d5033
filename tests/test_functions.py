"""Distances, tokens, scores and fingerprints on hand-made values."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corvix.functions import lexical, scores, vectors

PAIRS = [
    ("euclidean", [3.0, 4.0], [0.0, 0.0], 5.0),
    ("cosine", [1.0, 0.0], [2.0, 0.0], 0.0),
    ("cosine", [1.0, 0.0], [0.0, 1.0], 1.0),
    ("cosine", [1.0, 0.0], [-1.0, 0.0], 2.0),
    ("cosine", [0.0, 0.0], [1.0, 1.0], 1.0),
    ("inner_product", [1.0, 2.0, 3.0], [4.0, 5.0, 6.0], -32.0),
    ("inner-product", [1.0], [2.0], -2.0),
]


@pytest.mark.parametrize("metric, a, b, want", PAIRS)
def test_distance(spark, metric, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    assert df.select(vectors.distance(metric, F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


def test_sql_functions(spark):
    vectors.register(spark)
    row = spark.sql("SELECT l2_distance(array(3, 4), array(0, 0)) a, cosine_distance(array(0, 0), array(1, 0)) b, inner_product(array(1, 2), array(3, 4)) c, bm25_tokens('A-b  C') d").first()
    assert (row.a, row.b, row.c, row.d) == (5.0, 1.0, -11.0, ["a", "b", "c"])


def test_tokens(spark):
    df = spark.createDataFrame([("The quick, brown-fox!",), ("Éa 12 _x",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(lexical.tokenize(F.col("t"))).collect()] == [["the", "quick", "brown", "fox"], ["éa", "12", "x"], [], []]


def test_metadata_text(spark):
    df = spark.createDataFrame([(None,), ('"ab\\"c"',), ('{"k":1}',)], "m string")
    assert [r[0] for r in df.select(lexical.metadata_text(F.col("m"))).collect()] == ["", 'ab"c', '{"k":1}']


def test_minmax(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (1, 3.0), (2, 5.0), (3, nan), (4, nan), (4, 1.0), (4, 3.0)], "q long, s double")
    out = df.select("q", "s", scores.minmax(F.col("s"), W.partitionBy("q")).alias("n")).collect()
    got = sorted((r.q, "nan" if math.isnan(r.s) else r.s, r.n) for r in out if not (r.q == 4 and math.isnan(r.s)))
    assert got == [(1, 2.0, 0.0), (1, 3.0, 0.5), (1, 4.0, 1.0), (2, 5.0, 0.0), (3, "nan", 0.0), (4, 1.0, 0.0), (4, 3.0, 1.0)]
    assert [r.n for r in out if r.q == 4 and math.isnan(r.s)] == [1.0]


def test_fingerprint(spark):
    assert scores.fnv1a(b"") == "cbf29ce484222325"
    assert scores.fnv1a(b"a") == "af63dc4c8601ec8c"
    df = spark.createDataFrame([(b"a",), (None,)], "b binary")
    assert [r[0] for r in df.select(scores.fingerprint(F.col("b"))).collect()] == ["af63dc4c8601ec8c", None]


def test_sizes_and_rates(spark):
    one = spark.range(1)
    lit = lambda x: F.lit(x).cast("long")
    row = one.select(scores.raw_shard_bytes(lit(1), lit(10), lit(4)), scores.pq_shard_bytes(lit(1), lit(10), lit(4), lit(2)), scores.raw_memory(lit(2**62), lit(9)), scores.pq_memory(lit(10), lit(8), lit(2), lit(4)), scores.rate(lit(1), lit(0))).first()
    assert tuple(row) == (32 + 16 + 10 * 24, 40 + 16 + 10 * 10, 2**63 - 1, 20 + 2 * 4 * 4 * 4, 0.0)


def test_nearest_rank(spark):
    assert spark.range(1, 151).select(scores.nearest_rank("id", 0.99)).first()[0] == 149
    assert spark.range(0).select(scores.nearest_rank("id", 0.99)).first()[0] == 0
