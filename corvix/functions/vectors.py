"""Distances as column expressions; lower is better for all of them."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _double(a: Column) -> Column:
    return a.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine similarity; 1.0 if either vector is zero."""
    na, nb = norm(a), norm(b)
    return F.when((na == 0) | (nb == 0), F.lit(1.0)).otherwise(F.lit(1.0) - dot(a, b) / (na * nb))


def inner_product(a: Column, b: Column) -> Column:
    """Negated, so that lower is better."""
    return -dot(a, b)


DISTANCES = {"cosine": cosine, "euclidean": euclidean, "inner_product": inner_product}


def distance(metric: str, a: Column, b: Column) -> Column:
    return DISTANCES[metric.replace("-", "_")](a, b)


def shown(score: Column) -> Column:
    """A score as results carry it: six digits, no negative zero."""
    return F.round(score, 6) + F.lit(0.0)


def register(spark: SparkSession) -> None:
    """Temporary SQL functions l2_distance, cosine_distance, inner_product and bm25_tokens."""
    total = "aggregate(zip_with({0}, {1}, (x, y) -> {2}), 0D, (s, x) -> s + x)"
    l2 = total.format("a", "b", "(x - y) * (x - y)")
    ab, aa, bb = total.format("a", "b", "x * y"), total.format("a", "a", "x * y"), total.format("b", "b", "x * y")
    args = "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION l2_distance{args} RETURNS DOUBLE RETURN sqrt({l2})")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION inner_product{args} RETURNS DOUBLE RETURN -{ab}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION cosine_distance{args} RETURNS DOUBLE RETURN CASE WHEN {aa} = 0 OR {bb} = 0 THEN 1D ELSE 1 - {ab} / (sqrt({aa}) * sqrt({bb})) END")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION bm25_tokens(t STRING) RETURNS ARRAY<STRING> RETURN transform(filter(split(t, r'[^\p{IsAlphabetic}\p{N}]+'), x -> x != ''), x -> lower(x))")
