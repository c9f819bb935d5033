"""The library's operators as queries over the test tables.

Embeddings are scaled by 1 + label, so that the metrics rank differently. Searches ask with every row whose id is
divisible by 100, against all rows. Partitions are those of each label's mean, numbered by label.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .evaluation import metrics
from .functions import scores
from .functions.lexical import tokenize
from .functions.vectors import shown
from .operators import bm25, hybrid, ivf, merge, pq
from .operators.scan import knn
from .plans import distributed, validation
from .plans.build import fingerprints
from .plans.cache import replay
from .plans.config import FanOutPolicy, HybridRankingPolicy, PqParams
from .sources import generate, ingest
from .sources.layout import PATHS, key

K = 10
POLICY = FanOutPolicy(2)
SEED = 42
DIMS = 64
PQ_M, PQ_K = 8, 16


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    data = F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("label")))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), data.alias("data"), "label", F.col("vec_id").alias("pos"))


def asked(v: DataFrame) -> DataFrame:
    return v.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("data").alias("q"))


def centroids(v: DataFrame) -> DataFrame:
    return ivf.mean_centroids(v, "label")


def shards(v: DataFrame, c: DataFrame) -> DataFrame:
    return ivf.positioned(ivf.assign(v, c))


def _knn(metric: str, k: int = K):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        v = vectors(spark, sf)
        return knn(v, asked(v), metric, k)

    return query


def q_zero_vector_cosine(spark, sf):
    zero = spark.createDataFrame([(0, [0.0] * DIMS)], "qid long, q array<double>")
    return knn(vectors(spark, sf), zero, "cosine", K)


def _listed(spark, sf, metric, k=K):
    return _knn(metric, k)(spark, sf).drop("rank")


def q_global_merge(spark, sf):
    lists = [_listed(spark, sf, "cosine", K), _listed(spark, sf, "cosine", 2 * K)]
    return merge.merge(lists, K).select("qid", "rank", "id", "score")


def q_merge_dedup(spark, sf):
    lists = [_listed(spark, sf, "cosine"), _listed(spark, sf, "euclidean"), _listed(spark, sf, "inner_product")]
    return merge.dedup(reduce(DataFrame.unionByName, lists))


def q_ground_truth(spark, sf):
    return _knn("euclidean")(spark, sf).select("qid", "rank", "id")


def q_recall_at_k(spark, sf):
    return metrics.recall(_listed(spark, sf, "euclidean"), _listed(spark, sf, "cosine"))


def q_precision_at_k(spark, sf):
    return metrics.precision(_listed(spark, sf, "euclidean"), _listed(spark, sf, "cosine", 2 * K))


def _long(c: DataFrame, digits: int = 6) -> DataFrame:
    return c.select("shard_id", F.posexplode("centroid").alias("i", "x")).select("shard_id", "i", (F.round("x", digits) + F.lit(0.0)).alias("x"))


def q_ivf_centroids(spark, sf):
    return _long(centroids(vectors(spark, sf)))


def q_ivf_assign(spark, sf):
    v = vectors(spark, sf)
    return ivf.assign(v, centroids(v)).select("id", "shard_id")


def q_shard_summary(spark, sf):
    v = vectors(spark, sf)
    sizes = ivf.summary(ivf.assign(v, centroids(v)))
    return sizes.agg(F.count("*").alias("num_shards"), F.min("vector_count").alias("min_size"), F.max("vector_count").alias("max_size"), F.sum("vector_count").alias("total"))


def q_shard_compaction(spark, sf):
    v = vectors(spark, sf)
    own = centroids(v).select((F.col("shard_id") * 3 + 1).alias("shard_id"), "centroid")
    far = spark.createDataFrame([(i, [1000.0 + i] * DIMS) for i in (0, 5, 40)], "shard_id int, centroid array<double>")
    c = own.unionByName(far)
    return ivf.summary(ivf.compact(ivf.assign(v, c), c)[0])


def q_ivf_route(spark, sf):
    v = vectors(spark, sf)
    return ivf.route(asked(v), centroids(v), POLICY)


def q_candidate_shards_cap(spark, sf):
    v = vectors(spark, sf)
    pairs = centroids(v).select(F.col("shard_id").alias("centroid_id"), F.floor(F.col("shard_id") / 2).cast("int").alias("shard_id"), "centroid")
    return ivf.route(asked(v), pairs, FanOutPolicy(5, 2))


def _search(metric: str, policy: FanOutPolicy = POLICY, k: int = K):
    def query(spark, sf):
        v = vectors(spark, sf)
        c = centroids(v)
        return ivf.search(shards(v, c), c, asked(v), metric, k, policy)

    return query


def q_diskann_probe(spark, sf):
    v = vectors(spark, sf)
    s = shards(v, centroids(v))
    return s.where(ivf.strided(F.col("shard_pos"), F.col("shard_size"), F.least("shard_size", F.lit(16)))).select("shard_id", "shard_pos", "id")


def q_diskann_search(spark, sf):
    v = vectors(spark, sf)
    c = centroids(v)
    return ivf.strided_search(shards(v, c), c, asked(v), K, 16, FanOutPolicy(2, 0, 40))


def q_query_plan(spark, sf):
    v = vectors(spark, sf)
    c, q = centroids(v), asked(v)
    probes = ivf.route(q, c, FanOutPolicy(4))
    kept = ivf.route(q, c, FanOutPolicy(4, 2))
    found = ivf.search(shards(v, c), c, q, "euclidean", K, FanOutPolicy(4, 2))
    row = lambda df, kind, name: df.select("qid", F.lit(kind).alias("kind"), F.col(name).cast("long").alias("key"))
    return row(probes, "centroid", "shard_id").unionByName(row(kept, "shard", "shard_id")).unionByName(row(found, "candidate", "id"))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("qid", "rank", "id", shown(F.col("score")).alias("score"))


def q_exact_rerank(spark, sf):
    v = vectors(spark, sf)
    return _shown(merge.rerank(knn(v, asked(v), "cosine", 2 * K).drop("rank"), v, asked(v), "euclidean", K))


def q_rerank_keep_missing(spark, sf):
    v = vectors(spark, sf)
    return _shown(merge.rerank(knn(v, asked(v), "cosine", 2 * K).drop("rank"), v.where("label != 0"), asked(v), "euclidean", keep_missing=True))


def q_rerank_oversample(spark, sf):
    v = vectors(spark, sf)
    target = merge.rerank_target(5, None, 4, True)
    return _shown(merge.rerank(knn(v, asked(v), "cosine", target).drop("rank"), v, asked(v), "euclidean", 5))


def _means(v: DataFrame, iterations: int) -> DataFrame:
    return _long(ivf.kmeans(v, 4, iterations, SEED), 4)


def q_kmeans_step(spark, sf):
    return _means(vectors(spark, sf), 1)


def q_kmeans_centroids(spark, sf):
    return _means(vectors(spark, sf), 2)


def codebook(spark: SparkSession, v: DataFrame) -> DataFrame:
    """Sub-vectors of PQ_K drawn rows, as a codebook."""
    width = DIMS // PQ_M
    drawn = [list(r.data) for r in ivf.seeds(v, PQ_K, SEED).select("data").collect()]
    rows = [(m, code, x[m * width : (m + 1) * width]) for code, x in enumerate(drawn) for m in range(PQ_M)]
    return spark.createDataFrame(rows, "m int, code int, centroid array<double>")


def _book(book: DataFrame) -> DataFrame:
    return book.select("m", "code", F.posexplode("centroid").alias("i", "x")).select("m", "code", "i", (F.round("x", 4) + F.lit(0.0)).alias("x"))


def q_pq_train_step(spark, sf):
    v = vectors(spark, sf)
    return _book(pq.table(spark, pq.lloyd_step(v, pq.loaded(codebook(spark, v)))))


def q_pq_train(spark, sf):
    return _book(pq.train(vectors(spark, sf), PqParams(PQ_M, PQ_K), 2, SEED))


def q_kmeans_sampled(spark, sf):
    """One step over a sample of 100 vectors."""
    return _long(ivf.kmeans(vectors(spark, sf), 4, 1, SEED, 100), 4)


def q_pq_encode(spark, sf):
    v = vectors(spark, sf)
    coded = pq.encode(v, codebook(spark, v))
    return coded.select("id", F.posexplode("codes").alias("m", "code")).select("id", "m", F.col("code").cast("int").alias("code"))


def q_pq_reconstruct(spark, sf):
    v = vectors(spark, sf)
    book = codebook(spark, v)
    back = pq.reconstruct(pq.encode(v, book).drop("data"), book)
    return back.select("id", F.posexplode("data").alias("i", "x")).select("id", "i", F.round("x", 6).alias("x"))


def q_pq_adc_table(spark, sf):
    v = vectors(spark, sf)
    return pq.distance_table(asked(v), codebook(spark, v)).select("qid", "m", "code", F.round("d", 6).alias("d"))


def q_pq_adc_topk(spark, sf):
    v = vectors(spark, sf)
    book = codebook(spark, v)
    return pq.adc_topk(pq.encode(v, book), book, asked(v), K)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Test items as lexical queries: that with item_id i asks with the vector 100 * i."""
    return table(spark, sf, "benchmark").select((F.col("item_id") * 100).alias("qid"), "text")


def asked_texts(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).join(asked(vectors(spark, sf)).select("qid"), "qid", "left_semi")


def q_tokenize(spark, sf):
    t = tokenize(F.col("text"))
    return documents(spark, sf).select("id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


def q_bm25_postings(spark, sf):
    return bm25.postings(documents(spark, sf))


def q_bm25_doc_lengths(spark, sf):
    return bm25.doc_lengths(documents(spark, sf))


def q_bm25_fragments(spark, sf):
    return bm25.doc_lengths(table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "text"))


def q_bm25_document_frequency(spark, sf):
    return bm25.document_frequency(bm25.build(documents(spark, sf)))


def q_bm25_corpus_stats(spark, sf):
    return bm25.build(documents(spark, sf)).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


def q_bm25_vocabulary(spark, sf):
    terms = bm25.postings(documents(spark, sf)).select("term").distinct()
    return terms.agg(F.count("*").alias("num_terms"))


def _lexical(spark, sf, k=2 * K):
    return bm25.search(bm25.build(documents(spark, sf)), asked_texts(spark, sf), k)


def q_bm25_topk(spark, sf):
    return _lexical(spark, sf, K)


def q_bm25_topk_items(spark, sf):
    """All test items as queries, whether or not a vector has their number."""
    return bm25.search(bm25.build(documents(spark, sf)), texts(spark, sf), K)


def q_bm25_faults(spark, sf):
    """An index whose length table lacks the documents in French."""
    made = bm25.build(documents(spark, sf))
    others = table(spark, sf, "documents").where("lang != 'fr'").select(F.col("doc_id").alias("id"), "text")
    return bm25.faults(bm25.Bm25Index(made.postings, bm25.doc_lengths(others), made.stats))


def q_minmax_normalize(spark, sf):
    return hybrid.normalized(_listed(spark, sf, "euclidean", 2 * K)).select("qid", "id", F.round("norm", 6).alias("norm"))


def q_hybrid_topk(spark, sf):
    return hybrid.blend(_listed(spark, sf, "inner_product", 2 * K), _lexical(spark, sf), HybridRankingPolicy(0.7, 0.3), K)


def q_hybrid_rerank(spark, sf):
    v = vectors(spark, sf)
    c = centroids(v)
    found = ivf.search(shards(v, c), c, asked(v), "cosine", 2 * K, POLICY).drop("rank")
    exact = merge.rerank(found, v, asked(v), "euclidean").drop("rank")
    return hybrid.blend(exact, _lexical(spark, sf), HybridRankingPolicy(), K)


def q_search_with_metadata(spark, sf):
    meta = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("/", "lang", "source").alias("metadata"))
    return merge.with_metadata(_search("euclidean")(spark, sf), meta).select("qid", "rank", "id", "score", "metadata")


def _quality(spark, sf, name, found):
    return metrics.quality(name, _listed(spark, sf, "euclidean"), found)


def q_eval_ann(spark, sf):
    return _quality(spark, sf, "ivf_flat", _search("euclidean")(spark, sf))


def q_compare_ann(spark, sf):
    v = vectors(spark, sf)
    c, q, book = centroids(v), asked(v), codebook(spark, v)
    coded = pq.encode(shards(v, c), book)
    kinds = {
        "ivf_flat": _search("euclidean")(spark, sf),
        "hnsw": _search("euclidean")(spark, sf),
        "diskann": ivf.strided_search(shards(v, c), c, q, K, 16, POLICY),
        "ivf_pq": pq.adc_topk(coded, book, q, K, ivf.route(q, c, POLICY)),
    }
    return reduce(DataFrame.unionByName, [_quality(spark, sf, n, f) for n, f in kinds.items()])


def q_eval_hybrid(spark, sf):
    by_vector, by_text = _search("euclidean")(spark, sf), _lexical(spark, sf, K)
    kinds = {"vector": by_vector, "bm25": by_text, "hybrid": hybrid.blend(by_vector, by_text, HybridRankingPolicy(0.7, 0.3), K)}
    return reduce(DataFrame.unionByName, [_quality(spark, sf, n, f) for n, f in kinds.items()])


def q_partition_distribution(spark, sf):
    v = vectors(spark, sf)
    return metrics.distribution(ivf.summary(ivf.assign(v, centroids(v))))


def q_shard_hotness(spark, sf):
    v = vectors(spark, sf)
    c, q = centroids(v), asked(v)
    return metrics.hotness(c, ivf.route(q, c, POLICY), q.count())


def q_routing_accuracy(spark, sf):
    v = vectors(spark, sf)
    c = centroids(v)
    return metrics.routing_accuracy(_knn("cosine")(spark, sf), v, c, ivf.route(asked(v), c, POLICY))


def q_recall_estimate(spark, sf):
    found = _search("cosine")(spark, sf)
    return metrics.recall(_listed(spark, sf, "cosine"), found).agg(F.round(F.avg("recall"), 6).alias("recall"), F.count("*").alias("sample_size"))


def probes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_type", F.col("event_id").alias("at"), (F.col("user_id") % 16).cast("int").alias("shard_id"))


def q_prefetch_candidates(spark, sf):
    p = probes(spark, sf)
    return metrics.prefetch(p, p.count() // 16)


def q_cache_replay(spark, sf):
    return replay(probes(spark, sf), 6, "event_type").select("event_type", "hits", "misses", F.round("hit_rate", 6).alias("hit_rate"))


def q_latency_p99(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(scores.nearest_rank("value", 0.99).alias("p99"), F.round(F.avg("value"), 6).alias("mean"))


BOUNDS = [0.5, 1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0]


def q_latency_histogram(spark, sf):
    return metrics.latency_histogram(table(spark, sf, "events"), "value", BOUNDS)


def _sizes(spark, sf):
    v = vectors(spark, sf)
    return ivf.summary(ivf.assign(v, centroids(v)))


def q_shard_encoded_len(spark, sf):
    d, one = F.lit(DIMS).cast("long"), F.lit(1).cast("long")
    raw = scores.raw_shard_bytes(one, F.col("vector_count"), d)
    coded = scores.pq_shard_bytes(one, F.col("vector_count"), d, F.lit(PQ_M).cast("long"))
    return _sizes(spark, sf).select("shard_id", raw.alias("raw_bytes"), coded.alias("pq_bytes"))


def q_cost_metrics(spark, sf):
    sizes = q_shard_encoded_len(spark, sf).join(_sizes(spark, sf), "shard_id")
    total = sizes.agg(F.sum("raw_bytes").alias("disk_raw"), F.sum("pq_bytes").alias("disk_pq"), F.sum("vector_count").alias("n"))
    d, m, k = (F.lit(x).cast("long") for x in (DIMS, PQ_M, PQ_K))
    return total.select("disk_raw", "disk_pq", scores.raw_memory(F.col("n"), d).alias("memory_raw"), scores.pq_memory(F.col("n"), d, m, k).alias("memory_pq"), F.lit(DIMS * 4 / PQ_M).alias("ratio_pq"))


def q_worker_plan(spark, sf):
    return distributed.assignments(centroids(vectors(spark, sf)), 3)


def q_worker_coverage(spark, sf):
    """Outputs that lost shard 4, moved shard 2 to worker 7, repeat shard 1 and have one too many."""
    plan = distributed.assignments(centroids(vectors(spark, sf)), 3)
    moved = plan.where("shard_id != 4").withColumn("worker_id", F.when(F.col("shard_id") == 2, 7).otherwise(F.col("worker_id")))
    more = plan.where("shard_id = 1").unionByName(spark.createDataFrame([(99, 0)], "shard_id int, worker_id int"))
    return distributed.faults(plan, moved.unionByName(more).select("worker_id", "shard_id"))


def q_validate_shards(spark, sf):
    """Shards of which 3 lost a component in every row, and a plan that wants one more row in 5 and a shard 77."""
    v = vectors(spark, sf)
    placed = ivf.assign(v, centroids(v))
    damaged = placed.withColumn("data", F.when(F.col("shard_id") == 3, F.slice("data", 1, DIMS - 1)).otherwise(F.col("data")))
    wanted = ivf.summary(placed).withColumn("vector_count", F.col("vector_count") + F.when(F.col("shard_id") == 5, 1).otherwise(0))
    wanted = wanted.unionByName(spark.createDataFrame([(77, 1)], "shard_id int, vector_count long"))
    return validation.shard_faults(damaged, wanted, DIMS)


def q_validate_centroids(spark, sf):
    c = centroids(vectors(spark, sf))
    changed = c.where("shard_id != 1").withColumn("centroid", F.when(F.col("shard_id") == 6, F.transform("centroid", lambda x: x + 1)).otherwise(F.col("centroid")))
    return validation.centroid_faults(c, changed)


def q_dim_violations(spark, sf):
    v = vectors(spark, sf).withColumn("data", F.when(F.col("label") == 2, F.slice("data", 1, 60)).otherwise(F.col("data")))
    return ingest.dim_violations(v, DIMS)


def q_ingest_profile(spark, sf):
    meta = F.when(F.col("label") != 0, F.to_json(F.struct("label")))
    return ingest.profile(vectors(spark, sf).withColumn("metadata", meta))


def q_artifact_keys(spark, sf):
    names = table(spark, sf, "region").select(F.lower("r_name").alias("version"))
    kinds = ["dataset_vectors", "index_manifest", "index_centroids", "alias"]
    assert key("alias", "v1") == "aliases/v1.json"
    paths = [F.struct(F.lit(k).alias("kind"), F.regexp_replace(F.lit(PATHS[k]), r"\{version\}", F.col("version")).alias("path")) for k in kinds]
    return names.select(F.explode(F.array(*paths)).alias("p")).select("p.kind", "p.path")


def q_canonical_family(spark, sf):
    rows = [("ivf-flat", False, ""), ("kmeans-flat", False, ""), ("ivf-flat", True, "pq8"), ("kmeans-flat", True, "pq8"), ("hnsw", False, ""), ("disk-ann", False, ""), ("ivf-flat", True, "other")]
    given = spark.createDataFrame(rows, "algorithm string, compressed boolean, codec string")
    return given.select("algorithm", "compressed", "codec", scores.canonical_family(F.col("algorithm"), F.col("compressed"), F.col("codec")).alias("family"))


def q_fingerprint(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), scores.fingerprint(F.col("source").cast("binary")).alias("fingerprint"))


def q_shard_fingerprints(spark, sf):
    v = vectors(spark, sf)
    return fingerprints(ivf.assign(v, centroids(v)), "data")


def q_generate(spark, sf):
    return generate.clustered(spark).select("id", "metadata", F.posexplode("data").alias("i", "x")).withColumn("x", F.col("x").cast("double"))


QUERIES = {
    "q_knn_cosine": _knn("cosine"),
    "q_knn_euclidean": _knn("euclidean"),
    "q_knn_inner_product": _knn("inner_product"),
    "q_ivf_search": _search("euclidean"),
    "q_hnsw_search": _search("cosine"),
    "q_max_vectors_per_shard": _search("euclidean", FanOutPolicy(2, 0, 20)),
} | {name: f for name, f in list(globals().items()) if name.startswith("q_")}
