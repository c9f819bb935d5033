"""Tokens and Okapi BM25 as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.5, 0.75


def tokenize(text: Column) -> Column:
    """Runs of letters and digits of any script, cut out first and lower-cased then; none for null."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: t != "")
    return F.transform(parts, F.lower)


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25_tf(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """Saturated and length-normalised term frequency; 0 in a corpus of empty documents."""
    return F.when(avgdl == 0, F.lit(0.0)).otherwise(tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)))


def metadata_text(metadata: Column) -> Column:
    """Text of a metadata value: nothing for null, a JSON string's content, any other JSON as it is."""
    return F.coalesce(F.when(metadata.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), metadata, F.lit("}")), "$.v")).otherwise(metadata), F.lit(""))
