"""DuckDB SQL for the queries, over the same tables."""

from __future__ import annotations

# Each part names the parts before it that it needs.
EMB = """emb AS MATERIALIZED (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE * (1 + label)) AS v FROM embeddings),
q AS MATERIALIZED (SELECT id AS qid, v AS qv FROM emb WHERE id % 100 = 0)"""
CENTROIDS = """cl AS MATERIALIZED (SELECT label AS sid, i, round(avg(v[i]), 9) AS x FROM emb, range(1, 65) r(i) GROUP BY label, i),
c AS MATERIALIZED (SELECT sid, list(x ORDER BY i) AS cv FROM cl GROUP BY sid)"""
ASSIGN = """a AS MATERIALIZED (SELECT id, v, sid FROM (
  SELECT e.id, e.v, c.sid, row_number() OVER (PARTITION BY e.id ORDER BY round(list_distance(e.v, c.cv) ** 2, 9), c.sid) AS n FROM emb e, c) WHERE n = 1),
p0 AS MATERIALIZED (SELECT id, v, sid, list(id) OVER (PARTITION BY sid ORDER BY id) AS upto, count(*) OVER (PARTITION BY sid) AS size FROM a),
p AS MATERIALIZED (SELECT id, v, sid, len(upto) - 1 AS pos, size FROM p0)"""
ALL = f"{EMB}, {CENTROIDS}, {ASSIGN}"

DISTANCE = {"cosine": "list_cosine_distance({a}, {b})", "euclidean": "list_distance({a}, {b})", "inner_product": "-list_inner_product({a}, {b})"}


def distance(metric: str, a: str, b: str) -> str:
    return DISTANCE[metric].format(a=a, b=b)


def top(source: str, k: int | None, order: str = "score", more: str = "") -> str:
    """Ranked rows of a query (qid, id, score)."""
    ranked = f"SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round({order}, 9), id) AS rank, id, round(score, 6) + 0.0 AS score{more} FROM ({source})"
    return f"SELECT * FROM ({ranked})" + (f" WHERE rank <= {k}" if k else "")


def knn(metric: str, k: int = 10) -> str:
    return top(f"SELECT qid, id, {distance(metric, 'qv', 'v')} AS score FROM q, emb", k)


def routes(nprobe: int) -> str:
    return f"(SELECT qid, sid, n AS probe_rank FROM (SELECT qid, sid, row_number() OVER (PARTITION BY qid ORDER BY round(list_distance(qv, cv) ** 2, 9), sid) AS n FROM q, c) WHERE n <= {nprobe})"


def search(metric: str, nprobe: int = 2, k: int = 10, where: str = "true", cap: int | None = None) -> str:
    route = routes(nprobe) if cap is None else f"(SELECT * FROM {routes(nprobe)} WHERE probe_rank <= {cap})"
    return top(f"SELECT q.qid, p.id, {distance(metric, 'qv', 'v')} AS score FROM q JOIN {route} r USING (qid) JOIN p USING (sid) WHERE {where}", k)


def strided(size: str, probes: str) -> str:
    return f"(({size}) <= ({probes}) OR pos IN (SELECT i * (({size}) - 1) // (({probes}) - 1) FROM range(0, 64) t(i) WHERE i < ({probes})))"


TOKENS = r"list_transform(list_filter(regexp_split_to_array(coalesce({t}, ''), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''), lambda x: lower(x))"
POSTINGS = f"""doc AS MATERIALIZED (SELECT doc_id AS id, {TOKENS.format(t="text")} AS w FROM documents),
post AS MATERIALIZED (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM doc) GROUP BY term, id),
dl AS MATERIALIZED (SELECT id, sum(len(w))::BIGINT AS dl FROM doc GROUP BY id),
st AS MATERIALIZED (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl)"""


def bm25(k: int) -> str:
    asked = f"SELECT item_id * 100 AS qid, unnest({TOKENS.format(t='text')}) AS term FROM benchmark WHERE item_id * 100 IN (SELECT qid FROM q)"
    scored = f"""SELECT qid, id, -sum(ln((st.n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) * qtf) AS score
FROM (SELECT qid, term, count(*) AS qtf FROM ({asked}) GROUP BY qid, term) JOIN post USING (term)
JOIN (SELECT term, count(*) AS df FROM post GROUP BY term) USING (term) JOIN dl USING (id), st GROUP BY qid, id"""
    return top(scored, k)


def normalized(source: str) -> str:
    window = "OVER (PARTITION BY qid)"
    return f"SELECT qid, id, CASE WHEN max(score) {window} = min(score) {window} THEN 0.0 ELSE (score - min(score) {window}) / (max(score) {window} - min(score) {window}) END AS norm FROM ({source})"


def blend(vector: str, lexical: str, wv: float, wb: float, k: int = 10) -> str:
    both = f"SELECT coalesce(x.qid, y.qid) AS qid, coalesce(x.id, y.id) AS id, ({wv} * coalesce(x.norm, 1.0) + {wb} * coalesce(y.norm, 1.0)) / ({wv} + {wb}) AS score FROM ({normalized(vector)}) x FULL JOIN ({normalized(lexical)}) y ON x.qid = y.qid AND x.id = y.id"
    return top(both, k)


def hits(truth: str, found: str) -> str:
    return f"SELECT coalesce(t.qid, f.qid) AS qid, count(t.id) FILTER (f.id IS NOT NULL) AS hits, count(t.id) AS nt, count(f.id) AS nf FROM ({truth}) t FULL JOIN ({found}) f ON t.qid = f.qid AND t.id = f.id GROUP BY 1"


def quality(name: str, found: str, truth: str | None = None) -> str:
    return f"SELECT '{name}' AS name, count(*) AS queries, round(avg(CASE WHEN nt = 0 THEN 1.0 ELSE hits::DOUBLE / nt END), 6) AS recall, round(avg(CASE WHEN nf = 0 THEN 0.0 ELSE hits::DOUBLE / nf END), 6) AS \"precision\" FROM ({hits(truth or knn('euclidean'), found)})"


def lloyd_parts(iterations: int, k: int = 4, source: str = "emb") -> str:
    """Unrolled steps; drawn rows are the first by md5."""
    out = [f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5('42:' || id), id) - 1 AS cid, v AS cv FROM {source} QUALIFY cid < {k})"]
    for n in range(iterations):
        out.append(f"n{n} AS MATERIALIZED (SELECT e.id, e.v, c.cid FROM {source} e, c{n} c QUALIFY row_number() OVER (PARTITION BY e.id ORDER BY round(list_distance(e.v, c.cv) ** 2, 9), c.cid) = 1)")
        out.append(f"m{n} AS MATERIALIZED (SELECT cid, i, round(avg(v[i]), 9) AS x FROM n{n}, range(1, 65) r(i) GROUP BY cid, i)")
        out.append(f"u{n} AS MATERIALIZED (SELECT cid, list(x ORDER BY i) AS cv FROM m{n} GROUP BY cid)")
        out.append(f"c{n + 1} AS MATERIALIZED (SELECT c.cid, coalesce(u.cv, c.cv) AS cv FROM c{n} c LEFT JOIN u{n} u USING (cid))")
    return ", ".join(out)


def lloyd(iterations: int, k: int = 4, source: str = "emb", more: str = "") -> str:
    return f"WITH {EMB}, {more}{lloyd_parts(iterations, k, source)} SELECT cid::INTEGER AS shard_id, (i - 1)::INTEGER AS i, round(cv[i], 4) + 0.0 AS x FROM c{iterations}, range(1, 65) r(i)"


# The partitions of the index that stored.py builds; shards without a vector are left out.
BUILT = f"{EMB}, {lloyd_parts(2)}, c AS MATERIALIZED (SELECT cid AS sid, cv FROM c2), {ASSIGN}, sizes AS (SELECT (row_number() OVER (ORDER BY sid) - 1)::INTEGER AS shard_id, count(*) AS n FROM a GROUP BY sid)"
META = "CASE WHEN label <> 0 THEN '{\"label\":' || label || '}' END"


CODEBOOK = """book AS MATERIALIZED (SELECT (m)::INTEGER AS m, code::INTEGER AS code, v[m * 8 + 1 : m * 8 + 8] AS cv
  FROM (SELECT row_number() OVER (ORDER BY md5('42:' || id), id) - 1 AS code, v FROM emb QUALIFY code < 16), range(0, 8) r(m)),
coded AS MATERIALIZED (SELECT id, m, code, cv FROM (SELECT e.id, b.m, b.code, b.cv,
  row_number() OVER (PARTITION BY e.id, b.m ORDER BY round(list_distance(e.v[b.m * 8 + 1 : b.m * 8 + 8], b.cv) ** 2, 12), b.code) AS n FROM emb e, book b) WHERE n = 1)"""


def trained(iterations: int) -> str:
    """k-means of each sub-space, unrolled."""
    out = ["d0 AS MATERIALIZED (SELECT m, row_number() OVER (PARTITION BY m ORDER BY md5((42 + m) || ':' || id), id) - 1 AS code, v[m * 8 + 1 : m * 8 + 8] AS cv FROM emb, range(0, 8) r(m) QUALIFY code < 16)"]
    for n in range(iterations):
        out.append(f"n{n} AS MATERIALIZED (SELECT e.v[d.m * 8 + 1 : d.m * 8 + 8] AS v, d.m, d.code FROM emb e, d{n} d QUALIFY row_number() OVER (PARTITION BY e.id, d.m ORDER BY round(list_distance(e.v[d.m * 8 + 1 : d.m * 8 + 8], d.cv) ** 2, 12), d.code) = 1)")
        out.append(f"u{n} AS MATERIALIZED (SELECT m, code, list(x ORDER BY i) AS cv FROM (SELECT m, code, i, round(avg(v[i]), 9) AS x FROM n{n}, range(1, 9) r(i) GROUP BY m, code, i) GROUP BY m, code)")
        out.append(f"d{n + 1} AS MATERIALIZED (SELECT d.m, d.code, coalesce(u.cv, d.cv) AS cv FROM d{n} d LEFT JOIN u{n} u USING (m, code))")
    return f"WITH {EMB}, {', '.join(out)} SELECT m::INTEGER AS m, code::INTEGER AS code, (i - 1)::INTEGER AS i, round(cv[i], 4) + 0.0 AS x FROM d{iterations}, range(1, 9) r(i)"


TABLE = "SELECT qid, m, code, list_distance(qv[m * 8 + 1 : m * 8 + 8], cv) ** 2 AS d FROM q, book"
ADC = f"SELECT qid, id, sum(d) AS score FROM coded JOIN ({TABLE}) USING (m, code) GROUP BY qid, id"
ADC_ROUTED = f"SELECT x.qid, x.id, x.score FROM ({ADC}) x JOIN p ON p.id = x.id JOIN {routes(2)} r ON r.qid = x.qid AND r.sid = p.sid"


def reranked(candidates: str, k: int | None, missing: str = "true") -> str:
    exact = distance("euclidean", "qv", "v")
    return top(f"SELECT x.qid, x.id, CASE WHEN {missing} THEN {exact} ELSE x.score END AS score FROM ({candidates}) x JOIN emb USING (id) JOIN q USING (qid)", k)


BOUNDS = [0.5, 1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0]
SIZES = "SELECT sid, count(*) AS n FROM a GROUP BY sid"
WORKERS = "SELECT sid AS shard_id, (sid % 3)::INTEGER AS worker_id FROM c"
RATE = "CASE WHEN nf = 0 THEN 0.0 ELSE hits::DOUBLE / nf END"

SQL = {
    "q_knn_cosine": f"WITH {EMB} {knn('cosine')}",
    "q_knn_euclidean": f"WITH {EMB} {knn('euclidean')}",
    "q_knn_inner_product": f"WITH {EMB} {knn('inner_product')}",
    "q_zero_vector_cosine": "SELECT 0::BIGINT AS qid, row_number() OVER (ORDER BY vec_id) AS rank, vec_id AS id, 1.0::DOUBLE AS score FROM embeddings QUALIFY rank <= 10",
    "q_global_merge": f"WITH {EMB} {knn('cosine')}",
    "q_merge_dedup": f"WITH {EMB} SELECT qid, id, min(score) AS score FROM (({knn('cosine')}) UNION ALL ({knn('euclidean')}) UNION ALL ({knn('inner_product')})) GROUP BY qid, id",
    "q_ground_truth": f"WITH {EMB} SELECT qid, rank, id FROM ({knn('euclidean')})",
    "q_recall_at_k": f"WITH {EMB} SELECT qid, CASE WHEN nt = 0 THEN 1.0 ELSE hits::DOUBLE / nt END AS recall FROM ({hits(knn('euclidean'), knn('cosine'))})",
    "q_precision_at_k": f"WITH {EMB} SELECT qid, {RATE} AS \"precision\" FROM ({hits(knn('euclidean'), knn('cosine', 20))})",
    "q_ivf_centroids": f"WITH {EMB}, {CENTROIDS} SELECT sid AS shard_id, (i - 1)::INTEGER AS i, round(x, 6) + 0.0 AS x FROM cl",
    "q_ivf_assign": f"WITH {ALL} SELECT id, sid AS shard_id FROM a",
    "q_shard_summary": f"WITH {ALL} SELECT count(*) AS num_shards, min(n) AS min_size, max(n) AS max_size, sum(n)::BIGINT AS total FROM ({SIZES})",
    "q_shard_compaction": f"WITH {ALL} SELECT (row_number() OVER (ORDER BY sid) - 1)::INTEGER AS shard_id, n AS vector_count FROM ({SIZES})",
    "q_ivf_route": f"WITH {EMB}, {CENTROIDS} SELECT qid, sid AS shard_id, probe_rank FROM {routes(2)}",
    "q_candidate_shards_cap": f"WITH {EMB}, {CENTROIDS}, s AS (SELECT qid, (sid // 2)::INTEGER AS shard_id, min(probe_rank) AS probe_rank FROM {routes(5)} GROUP BY 1, 2) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY probe_rank) <= 2",
    "q_ivf_search": f"WITH {ALL} {search('euclidean')}",
    "q_hnsw_search": f"WITH {ALL} {search('cosine')}",
    "q_max_vectors_per_shard": f"WITH {ALL} {search('euclidean', where='pos <= 19')}",
    "q_diskann_probe": f"WITH {ALL} SELECT sid AS shard_id, pos AS shard_pos, id FROM p WHERE {strided('size', '16')}",
    "q_diskann_search": f"WITH {ALL} {search('euclidean', where='pos <= 39 AND ' + strided('least(size, 40)', '16'))}",
    "q_query_plan": f"WITH {ALL} SELECT qid, 'centroid' AS kind, sid::BIGINT AS key FROM {routes(4)} UNION ALL SELECT qid, 'shard', sid FROM {routes(4)} WHERE probe_rank <= 2 UNION ALL SELECT qid, 'candidate', id FROM ({search('euclidean', 4, cap=2)})",
    "q_exact_rerank": f"WITH {EMB} {reranked(knn('cosine', 20), 10)}",
    "q_rerank_keep_missing": f"WITH {EMB} {reranked(knn('cosine', 20), None, 'label <> 0')}",
    "q_rerank_oversample": f"WITH {EMB} {reranked(knn('cosine', 20), 5)}",
    "q_kmeans_step": lloyd(1),
    "q_kmeans_centroids": lloyd(2),
    "q_pq_train_step": f"""WITH {EMB}, {CODEBOOK}, s AS (SELECT d.m, d.code, i, round(avg(e.v[d.m * 8 + i]), 9) AS x FROM coded d JOIN emb e USING (id), range(1, 9) r(i) GROUP BY d.m, d.code, i)
SELECT b.m, b.code, (r.i - 1)::INTEGER AS i, round(coalesce(s.x, b.cv[r.i]), 4) + 0.0 AS x FROM book b CROSS JOIN range(1, 9) r(i) LEFT JOIN s ON s.m = b.m AND s.code = b.code AND s.i = r.i""",
    "q_pq_encode": f"WITH {EMB}, {CODEBOOK} SELECT id, m, code FROM coded",
    "q_pq_reconstruct": f"WITH {EMB}, {CODEBOOK} SELECT id, (m * 8 + i - 1)::INTEGER AS i, round(cv[i], 6) AS x FROM coded, range(1, 9) r(i)",
    "q_pq_adc_table": f"WITH {EMB}, {CODEBOOK} SELECT qid, m, code, round(d, 6) AS d FROM ({TABLE})",
    "q_pq_adc_topk": f"WITH {EMB}, {CODEBOOK} {top(ADC, 10)}",
    "q_tokenize": f"SELECT doc_id AS id, len(w) AS n_tokens, md5(array_to_string(w, ' ')) AS tokens_md5 FROM (SELECT doc_id, {TOKENS.format(t='text')} AS w FROM documents)",
    "q_bm25_postings": f"WITH {POSTINGS} SELECT term, id, tf FROM post",
    "q_bm25_doc_lengths": f"WITH {POSTINGS} SELECT id, dl FROM dl",
    "q_bm25_fragments": f"SELECT conv_id AS id, sum(len({TOKENS.format(t='text')}))::BIGINT AS dl FROM conversations GROUP BY conv_id",
    "q_bm25_document_frequency": f"WITH {POSTINGS} SELECT term, count(*) AS df FROM post GROUP BY term",
    "q_bm25_corpus_stats": f"WITH {POSTINGS} SELECT n, round(avgdl, 6) AS avgdl FROM st",
    "q_bm25_vocabulary": f"WITH {POSTINGS} SELECT count(DISTINCT term) AS num_terms FROM post",
    "q_bm25_topk": f"WITH {EMB}, {POSTINGS} {bm25(10)}",
    "q_bm25_topk_items": f"WITH {POSTINGS} {bm25(10).replace(' WHERE item_id * 100 IN (SELECT qid FROM q)', '', 1)}",
    "q_bm25_faults": f"WITH {POSTINGS} SELECT DISTINCT 'unknown_document' AS kind, id::VARCHAR AS key FROM post WHERE id IN (SELECT doc_id FROM documents WHERE lang = 'fr')",
    "q_minmax_normalize": f"WITH {EMB} SELECT qid, id, round(norm, 6) AS norm FROM ({normalized(knn('euclidean', 20))})",
    "q_hybrid_topk": f"WITH {EMB}, {POSTINGS} {blend(knn('inner_product', 20), bm25(20), 0.7, 0.3)}",
    "q_hybrid_rerank": f"WITH {ALL}, {POSTINGS} {blend(reranked(search('cosine', k=20), None).replace('round(score, 6) + 0.0 AS score', 'score', 1), bm25(20), 0.5, 0.5)}",
    "q_search_with_metadata": f"WITH {ALL} SELECT s.*, d.lang || '/' || d.source AS metadata FROM ({search('euclidean')}) s LEFT JOIN documents d ON d.doc_id = s.id",
    "q_eval_ann": f"WITH {ALL} {quality('ivf_flat', search('euclidean'))}",
    "q_compare_ann": f"WITH {ALL}, {CODEBOOK} {quality('ivf_flat', search('euclidean'))} UNION ALL {quality('hnsw', search('euclidean'))} UNION ALL {quality('diskann', search('euclidean', where=strided('size', '16')))} UNION ALL {quality('ivf_pq', top(ADC_ROUTED, 10))}",
    "q_eval_hybrid": f"WITH {ALL}, {POSTINGS} {quality('vector', search('euclidean'))} UNION ALL {quality('bm25', bm25(10))} UNION ALL {quality('hybrid', blend(search('euclidean'), bm25(10), 0.7, 0.3))}",
    "q_partition_distribution": f"WITH {ALL} SELECT count(*) AS num_shards, sum(n)::BIGINT AS total, min(n) AS min_size, max(n) AS max_size, round(avg(n), 6) AS mean_size, round(stddev_pop(n), 6) AS std_dev, round(max(n) / avg(n), 6) AS imbalance FROM ({SIZES})",
    "q_shard_hotness": f"WITH {EMB}, {CENTROIDS} SELECT c.sid AS shard_id, count(r.qid) AS probes, round(count(r.qid)::DOUBLE / (SELECT count(*) FROM q), 6) AS hotness FROM c LEFT JOIN {routes(2)} r ON r.sid = c.sid GROUP BY c.sid",
    "q_routing_accuracy": f"WITH {ALL}, t AS (SELECT qid, id FROM ({knn('cosine')}) WHERE rank = 1) SELECT count(*) AS queries, count(r.sid) AS correct, round(count(r.sid)::DOUBLE / count(*), 6) AS routing_accuracy FROM t JOIN a USING (id) LEFT JOIN {routes(2)} r ON r.qid = t.qid AND r.sid = a.sid",
    "q_recall_estimate": f"WITH {ALL} SELECT round(avg(hits::DOUBLE / nt), 6) AS recall, count(*) AS sample_size FROM ({hits(knn('cosine'), search('cosine'))})",
    "q_prefetch_candidates": "SELECT (user_id % 16)::INTEGER AS shard_id, count(*) AS queries FROM events GROUP BY 1 HAVING count(*) >= (SELECT count(*) // 16 FROM events)",
    "q_cache_replay": """WITH t AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n, user_id % 16 AS s FROM events),
l AS (SELECT event_type, n, s, lag(n) OVER (PARTITION BY event_type, s ORDER BY n) AS before FROM t),
h AS (SELECT l.event_type, l.n, l.before IS NOT NULL AND count(DISTINCT m.s) < 6 AS hit FROM l LEFT JOIN t m ON m.event_type = l.event_type AND m.n > l.before AND m.n < l.n GROUP BY l.event_type, l.n, l.before)
SELECT event_type, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (hit)::DOUBLE / count(*), 6) AS hit_rate FROM h GROUP BY event_type""",
    "q_latency_p99": "SELECT event_type, quantile_disc(value, 0.99) AS p99, round(avg(value), 6) AS mean FROM events GROUP BY event_type",
    "q_latency_histogram": " UNION ALL ".join([f"SELECT '{b}' AS le, count(*) FILTER (value <= {b}) AS count FROM events" for b in BOUNDS] + ["SELECT '+Inf', count(value) FROM events"]),
    "q_shard_encoded_len": f"WITH {ALL} SELECT sid AS shard_id, 32 + 64 * 4 + n * (8 + 4 * 64) AS raw_bytes, 40 + 64 * 4 + n * (8 + 8) AS pq_bytes FROM ({SIZES})",
    "q_cost_metrics": f"WITH {ALL} SELECT sum(32 + 64 * 4 + n * (8 + 4 * 64))::BIGINT AS disk_raw, sum(40 + 64 * 4 + n * (8 + 8))::BIGINT AS disk_pq, (sum(n) * 64 * 4)::BIGINT AS memory_raw, (sum(n) * 8 + 8 * 16 * 8 * 4)::BIGINT AS memory_pq, 32.0::DOUBLE AS ratio_pq FROM ({SIZES})",
    "q_worker_plan": f"WITH {EMB}, {CENTROIDS} {WORKERS}",
    "q_worker_coverage": f"""WITH {EMB}, {CENTROIDS}, plan AS ({WORKERS}),
got AS (SELECT shard_id, CASE WHEN shard_id = 2 THEN 7 ELSE worker_id END AS worker_id FROM plan WHERE shard_id <> 4 UNION ALL SELECT shard_id, worker_id FROM plan WHERE shard_id = 1 UNION ALL SELECT 99, 0)
SELECT 'missing_shard' AS kind, worker_id, shard_id FROM plan WHERE shard_id NOT IN (SELECT shard_id FROM got)
UNION ALL SELECT 'unknown_shard', worker_id, shard_id FROM got WHERE shard_id NOT IN (SELECT shard_id FROM plan)
UNION ALL SELECT 'wrong_worker', g.worker_id, g.shard_id FROM got g JOIN plan p USING (shard_id) WHERE g.worker_id <> p.worker_id
UNION ALL SELECT 'duplicate_shard', min(worker_id), shard_id FROM got GROUP BY shard_id HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'missing_worker', worker_id, NULL::INTEGER FROM plan WHERE worker_id NOT IN (SELECT worker_id FROM got)""",
    "q_validate_shards": f"""WITH {ALL}, s AS ({SIZES})
SELECT 'shard_vector_count_mismatch' AS kind, format('shard-{{:04d}}', sid) AS key, (n + 1)::VARCHAR AS expected, n::VARCHAR AS actual FROM s WHERE sid = 5
UNION ALL SELECT 'shard_vector_count_mismatch', 'shard-0077', '1', 'absent'
UNION ALL SELECT 'shard_dimension_mismatch', format('shard-{{:04d}}', sid), '64', '63' FROM s WHERE sid = 3""",
    "q_validate_centroids": f"WITH {EMB}, {CENTROIDS} SELECT 'shard_centroid_mismatch' AS kind, format('shard-{{:04d}}', sid) AS key, 'present' AS expected, CASE WHEN sid = 1 THEN 'absent' ELSE 'present' END AS actual FROM c WHERE sid IN (1, 6)",
    "q_dim_violations": "SELECT vec_id AS id, 60::BIGINT AS dims FROM embeddings WHERE label = 2",
    "q_ingest_profile": "SELECT count(*) AS vector_count, min(len(embedding)) AS min_dims, max(len(embedding)) AS max_dims, count(*) FILTER (label <> 0) AS with_metadata, (SELECT count(*) FROM (SELECT vec_id FROM embeddings GROUP BY vec_id HAVING count(*) > 1)) AS repeated_ids FROM embeddings",
    "q_artifact_keys": "SELECT kind, replace(path, '{version}', lower(r_name)) AS path FROM region, (VALUES ('dataset_vectors', 'datasets/{version}/vectors'), ('index_manifest', 'indexes/{version}/manifest.json'), ('index_centroids', 'indexes/{version}/centroids'), ('alias', 'aliases/{version}.json')) t(kind, path)",
    "q_canonical_family": "SELECT * FROM (VALUES ('ivf-flat', false, '', 'ivf_flat'), ('kmeans-flat', false, '', 'ivf_flat'), ('ivf-flat', true, 'pq8', 'ivf_pq'), ('kmeans-flat', true, 'pq8', 'ivf_pq'), ('hnsw', false, '', 'hnsw'), ('disk-ann', false, '', 'disk_ann'), ('ivf-flat', true, 'other', 'ivf_flat')) t(algorithm, compressed, codec, family)",
    "q_fingerprint": "SELECT doc_id AS id, format('{:016x}', list_reduce(list_prepend(14695981039346656037::UBIGINT, list_transform(range(1, length(source) + 1), lambda i: ascii(substr(source, i, 1))::UBIGINT)), lambda h, b: ((xor(h, b)::HUGEINT * 1099511628211) % 18446744073709551616)::UBIGINT)) AS fingerprint FROM documents",
    "q_generate": """WITH b AS (SELECT i AS id, ('0x' || substr(md5('3735928559:cluster:' || i), 1, 13))::BIGINT % 10 AS cluster FROM range(1, 1001) r(i))
SELECT id, '{"cluster":' || cluster || '}' AS metadata, j::INTEGER AS i, ((('0x' || substr(md5('3735928559:center:' || cluster || ':' || j), 1, 13))::BIGINT::DOUBLE / 2251799813685248 - 1)
  + (('0x' || substr(md5('3735928559:vector:' || id || ':' || j), 1, 13))::BIGINT::DOUBLE / 2251799813685248 - 1) * 0.1::DOUBLE)::FLOAT::DOUBLE AS x
FROM b, range(0, 128) c(j)""",
    "q_pq_train": trained(2),
    "q_kmeans_sampled": lloyd(1, source="drawn", more="drawn AS MATERIALIZED (SELECT id, v FROM emb ORDER BY md5('43:' || id), id LIMIT 100), "),
    "q_ingest_jsonl": f"WITH {EMB} SELECT id, coalesce({META}, 'null') AS metadata, (i - 1)::INTEGER AS i, v[i]::FLOAT::DOUBLE AS x FROM emb, range(1, 65) r(i)",
    "q_ingest_bad_lines": "SELECT lang IS NULL OR lang NOT IN ('fr', 'de') AS ok, count(*) AS lines FROM documents GROUP BY 1",
    "q_index_shards": f"WITH {BUILT} SELECT shard_id, n AS vector_count, 32 + 64 * 4 + n * (8 + 4 * 64) AS bytes FROM sizes",
    "q_index_manifest": f"WITH {BUILT} SELECT 'latest' AS alias, 'i1' AS index_version, 'd1' AS dataset_version, 64::BIGINT AS dims, 'euclidean' AS metric, 'ivf-flat' AS algorithm, sum(n)::BIGINT AS vector_count, count(*) AS num_shards FROM sizes",
    "q_index_recall_estimate": f"WITH {BUILT} SELECT round(avg(hits::DOUBLE / nt), 6) AS recall, 10::BIGINT AS k, 2::BIGINT AS nprobe, count(*) AS sample_size FROM ({hits(knn('euclidean'), search('euclidean'))})".replace("FROM emb WHERE id % 100 = 0", "FROM emb ORDER BY md5('44:' || id), id LIMIT 20"),
    "q_index_search": f"WITH {BUILT} SELECT s.*, {META} AS metadata FROM ({search('euclidean')}) s JOIN emb USING (id)",
    "q_worker_merge": f"WITH {BUILT} SELECT (shard_id % 3)::INTEGER AS worker_id, count(*) AS num_shards, sum(n)::BIGINT AS vector_count, min(shard_id) AS first_shard FROM sizes GROUP BY 1",
    "q_index_validate": "SELECT 'shard_centroid_mismatch' AS kind, 'shard-0001' AS key, 'present' AS expected, 'present' AS actual UNION ALL SELECT 'artifact_missing', 'datasets/d1/metadata', 'present', 'absent'",
    "q_store_objects": "SELECT 'regions/' || lower(r_name) || '.json' AS key, r_regionkey::BIGINT AS value FROM region WHERE r_name <> 'ASIA'",
    "q_lexical_index": f"WITH {POSTINGS} {bm25(10).replace(' WHERE item_id * 100 IN (SELECT qid FROM q)', '', 1)}",
    "q_pipeline_stages": f"WITH {ALL} {search('euclidean')}".replace("v AS qv FROM emb", "list_transform(v, lambda x: -x) AS qv FROM emb"),
    "q_service_modes": f"""WITH {BUILT}, {POSTINGS} SELECT 'vector' AS mode, rank, id, score FROM ({search('euclidean')}) WHERE qid = 0
UNION ALL SELECT 'lexical', rank, id, score FROM ({bm25(10)}) WHERE qid = 0
UNION ALL SELECT 'hybrid', rank, id, score FROM ({blend(search('euclidean'), bm25(10), 0.5, 0.5)}) WHERE qid = 0""",
    "q_eval_report": f"WITH {BUILT} SELECT *, (SELECT sum(n)::BIGINT * 64 * 4 FROM sizes) AS memory_bytes, 1.0::DOUBLE AS compression_ratio FROM ({quality('ivf_flat', search('euclidean'))})".replace("FROM emb WHERE id % 100 = 0", "FROM emb ORDER BY id LIMIT 3"),
    "q_config_defaults": """SELECT * FROM (VALUES ('storage_root', '"./data"'), ('num_shards', '4'), ('kmeans_iters', '20'), ('kmeans_seed', '3735928559'), ('kmeans_sample_size', 'null'), ('recall_sample_size', 'null'),
('recall_k', '10'), ('nprobe', '2'), ('candidate_shards', '0'), ('max_vectors_per_shard', '0'), ('pq_enabled', 'false'), ('pq_num_subspaces', '8'), ('pq_codebook_size', '256'), ('shard_cache_capacity', '128'),
('prefetch.enabled', 'false'), ('prefetch.min_query_count', '3')) t(name, value)""",
    "q_generate_gaussian": """WITH b AS (SELECT id, j, ('0x' || substr(md5('42:u:' || id || ':' || j), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u, ('0x' || substr(md5('42:v:' || id || ':' || j), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS w FROM range(0, 1000) r(id), range(0, 16) c(j))
SELECT id, '{"idx":' || id || '}' AS metadata, j::INTEGER AS i, round((sqrt(ln(1.0 - u) * -2) * cos(w * 6.283185307179586))::FLOAT::DOUBLE, 4) + 0.0 AS x FROM b""",
}
