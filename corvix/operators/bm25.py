"""An inverted index as three tables, and Okapi BM25 search; scores are negated, so lower is better."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexical import bm25_idf, bm25_tf, tokenize
from ..functions.vectors import shown
from ..plans.config import BM25Params
from .scan import ranked

#: Up to this many rows of query terms are broadcast; more are joined by shuffle.
BROADCAST_TERMS = 100_000


@dataclass(frozen=True)
class Bm25Index:
    """postings(term, id, tf), doc_lengths(id, dl) and stats(n, avgdl)."""

    postings: DataFrame
    doc_lengths: DataFrame
    stats: DataFrame
    params: BM25Params = BM25Params()

    def num_docs(self) -> int:
        return self.stats.first().n

    def num_terms(self) -> int:
        return self.postings.select("term").distinct().count()


def postings(docs: DataFrame) -> DataFrame:
    """(term, id, tf) of docs (id, text); rows that share an id are one document."""
    terms = docs.where("id is not null").select("id", F.explode(tokenize(F.col("text"))).alias("term"))
    return terms.groupBy("term", "id").agg(F.count("*").alias("tf"))


def doc_lengths(docs: DataFrame) -> DataFrame:
    """(id, dl) of all documents, those without tokens too."""
    return docs.where("id is not null").groupBy("id").agg(F.sum(F.size(tokenize(F.col("text")))).alias("dl"))


def build(docs: DataFrame, params: BM25Params | None = None) -> Bm25Index:
    lengths = doc_lengths(docs)
    stats = lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))
    return Bm25Index(postings(docs), lengths, stats, params or BM25Params())


def document_frequency(index: Bm25Index) -> DataFrame:
    return index.postings.groupBy("term").agg(F.count("*").alias("df"))


def search(index: Bm25Index, queries: DataFrame, k: int) -> DataFrame:
    """(qid, rank, id, score) for queries (qid, text): documents with a query term, the k best.

    A term that a query has twice counts twice. Nothing for k = 0, an empty index or a query without
    tokens. Postings are read once, for the queries' terms; a posting's score doesn't need its query, so
    the lengths are joined before postings are multiplied by the queries that ask for them.
    """
    asked = queries.select("qid", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    few = asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    terms = asked.select("term").distinct()
    own = index.postings.join(F.broadcast(terms) if few else terms, "term", "left_semi")
    df = own.groupBy("term").agg(F.count("*").alias("df"))
    n, avgdl = index.stats.first()
    idf = df.select("term", bm25_idf(F.lit(n), F.col("df")).alias("idf"))
    weights = asked.join(idf, "term")
    sized = own.join(index.doc_lengths, "id", "left")
    tf = bm25_tf(F.col("tf"), F.coalesce("dl", F.lit(0)), F.lit(avgdl), index.params.k1, index.params.b)
    parts = sized.select("id", "term", tf.alias("w")).join(F.broadcast(weights) if few else weights, "term")
    scores = parts.groupBy("qid", "id").agg((-F.sum(F.col("idf") * F.col("w") * F.col("qtf"))).alias("score"))
    return ranked(scores, k).select("qid", "rank", "id", shown(F.col("score")).alias("score"))


def faults(index: Bm25Index) -> DataFrame:
    """(kind, key) of what makes an index invalid: unknown documents, empty counts, lengths that don't add up."""
    unknown = index.postings.join(index.doc_lengths, "id", "left_anti").select(F.lit("unknown_document").alias("kind"), F.col("id").cast("string").alias("key")).distinct()
    empty = index.postings.where("tf <= 0 or term = ''").select(F.lit("bad_posting").alias("kind"), F.col("term").alias("key"))
    sums = index.postings.groupBy("id").agg(F.sum("tf").alias("total"))
    lengths = index.doc_lengths.join(sums, "id", "left").where(F.coalesce("total", F.lit(0)) != F.col("dl"))
    return unknown.unionByName(empty).unionByName(lengths.select(F.lit("wrong_length").alias("kind"), F.col("id").cast("string").alias("key")))


def top_terms(index: Bm25Index, n: int) -> DataFrame:
    return document_frequency(index).orderBy(F.desc("df"), "term").limit(n)
