"""Ingest, builds, searches, services and validation end to end on generated data."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from corvix import cli
from corvix.errors import ArtifactMissing, BackendUnsupported, ConfigError, InvalidKey, InvalidRecord, ManifestError, MergeError
from corvix.evaluation import harness, metrics
from corvix.operators import bm25
from corvix.plans import build as building
from corvix.plans import distributed, validation
from corvix.plans.build import BuildParams
from corvix.plans.cache import ShardCache, replay, warm
from corvix.plans.config import AnnFamily, DistanceMetric, FanOutPolicy, PqParams, PrefetchPolicy, QueryConfig, SystemConfig
from corvix.plans.pipeline import QueryPipeline, Searcher
from corvix.plans.service import QueryRequest, Service
from corvix.sources import generate, ingest, layout
from corvix.sources.manifest import DatasetManifest, IndexManifest, ShardDef, publish, resolve
from corvix.sources.store import HadoopStore, UnsupportedStore

DIMS = 8


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    store = HadoopStore(spark, str(tmp_path_factory.mktemp("root")))
    rows = generate.clustered(spark, 200, DIMS, 5, seed=9)
    dataset = ingest.write_dataset(store, rows, "d1")
    flat = building.build(store, dataset, BuildParams("flat", DistanceMetric.EUCLIDEAN, num_shards=5, kmeans_iters=5, recall_sample_size=10))
    building.build(store, dataset, BuildParams("pq", DistanceMetric.EUCLIDEAN, AnnFamily.IVF_PQ, 5, 5, pq=PqParams(4, 16)))
    building.build(store, dataset, BuildParams("strided", DistanceMetric.EUCLIDEAN, AnnFamily.DISKANN, 5, 5, family_params={"beam": 8}))
    building.build(store, dataset, BuildParams("both", DistanceMetric.EUCLIDEAN, AnnFamily.HNSW, 5, 5, recall_sample_size=5, pq=PqParams(4, 16)))
    publish(store, "latest", "flat")
    return store, dataset, flat


def asked(store, dataset, n=5):
    return harness.sample_queries(ingest.read_dataset(store, dataset), n)


def test_ingest(spark, store, tmp_path):
    lines = [{"id": 1, "vector": [0.1, 2], "metadata": {"a": 1}}, {"id": 2, "vector": [1, 0.5]}, {"id": 3, "vector": [1, 1], "metadata": None}, {"id": 4, "vector": [0, 0], "metadata": "x"}]
    (tmp_path / "in.jsonl").write_text("\n\n".join(map(json.dumps, lines)) + "\n  \n")
    made = ingest.ingest(spark, store, str(tmp_path / "in.jsonl"), "v1")
    assert (made.dims, made.vector_count) == (2, 4)
    assert {(r.id, r.metadata) for r in ingest.read_metadata(store, made).collect()} == {(1, '{"a":1}'), (3, "null"), (4, '"x"')}
    again = DatasetManifest.load(store, "v1")
    assert again == made
    ingest.write_jsonl(ingest.read_dataset(store, made).join(ingest.read_metadata(store, made), "id", "left"), str(tmp_path / "out"))
    back = ingest.read_jsonl(spark, str(tmp_path / "out"))
    assert back.where("ok").count() == 4 and {(r.id, r.metadata) for r in back.where("id < 3").collect()} == {(1, '{"a":1}'), (2, "null")}


BAD = ['{"id": -1, "vector": [1]}', '{"id": 1.5, "vector": [1]}', '{"vector": [1]}', '{"id": 1, "vector": []}', '{"id": 1, "vector": [1, null]}', '{"id": 1, "vector": ["a"]}', "nonsense", '{"id": 1}']


def test_bad_lines(spark, store, tmp_path):
    (tmp_path / "in.jsonl").write_text("\n".join([*BAD, '{"id": 7, "vector": [1]}']))
    assert [r.id for r in ingest.read_jsonl(spark, str(tmp_path / "in.jsonl")).where("ok").collect()] == [7]
    with pytest.raises(InvalidRecord, match="8 lines"):
        ingest.ingest(spark, store, str(tmp_path / "in.jsonl"), "v1")
    two = spark.createDataFrame([(1, [1.0], None), (2, [1.0, 2.0], None)], "id long, data array<float>, metadata string")
    for rows in (two, two.limit(0), two.limit(1).union(two.limit(1))):
        with pytest.raises(InvalidRecord):
            ingest.write_dataset(store, rows, "v1")


def test_keys_and_store(spark, store):
    for bad in ("", "/a", "a/../b", "a\\b", "a//b", "."):
        with pytest.raises(InvalidKey):
            layout.checked(bad)
    assert layout.key("worker_output", "v", worker=3) == "indexes/v/workers/0003/output.json"
    assert layout.shard_name(7) == "shard-0007"
    store.put("x/b", b"12")
    store.put("x/a", b"1")
    store.put("x/a", b"123")
    assert store.get("x/a") == b"123" and store.list("x") == ["x/a", "x/b"] and store.list("none") == []
    assert store.sizes("x").agg(F.sum("length")).first()[0] == 5
    store.delete("x/a")
    assert not store.exists("x/a")
    with pytest.raises(ArtifactMissing):
        store.get("x/a")
    with pytest.raises(BackendUnsupported):
        UnsupportedStore("s3").put("k", b"")


def test_build_and_search(built):
    store, dataset, flat = built
    assert flat.vector_count == 200 and sum(s.vector_count for s in flat.shards) == 200
    assert 0 <= flat.recall_estimate["recall"] <= 1
    assert resolve(store, "latest") == IndexManifest.load(store, "flat")
    searcher = Searcher(store, resolve(store, "latest"))
    out = searcher.search(asked(store, dataset), QueryConfig(top_k=3, fan_out=FanOutPolicy(2)))
    assert {(r.qid, r.id) for r in out.where("rank = 1").collect()} == {(i, i) for i in range(1, 6)}
    assert out.where("metadata IS NULL").count() == 0
    plan = searcher.plan(asked(store, dataset, 2), QueryConfig(fan_out=FanOutPolicy(3, 1)))
    assert (plan.centroids.count(), plan.shards.count()) == (6, 2)
    for name in ("pq", "strided", "both"):
        s = Searcher(store, IndexManifest.load(store, name))
        assert s.search(asked(store, dataset), QueryConfig(top_k=4)).groupBy("qid").count().where("count != 4").count() == 0
    coded = Searcher(store, IndexManifest.load(store, "pq"))
    found = coded.search(asked(store, dataset), QueryConfig(top_k=8))
    assert coded.rerank(found, asked(store, dataset)).where("rank = 1 AND qid = id AND abs(score) < 1e-9").count() == 5
    with pytest.raises(ConfigError):
        coded.search(asked(store, dataset), QueryConfig(distance_metric=DistanceMetric.COSINE))


def test_pipeline_equals_searcher(built):
    store, dataset, flat = built
    searcher = Searcher(store, flat)
    config = QueryConfig(top_k=4, fan_out=FanOutPolicy(3))
    line = QueryPipeline(searcher.tables, DistanceMetric.EUCLIDEAN)
    a = {(r.qid, r.rank, r.id) for r in line.run(asked(store, dataset), config).collect()}
    assert a == {(r.qid, r.rank, r.id) for r in searcher.search(asked(store, dataset), config).collect()}
    again = line.with_(reranks=True, vectors=ingest.read_dataset(store, dataset), oversample=3)
    assert a == {(r.qid, r.rank, r.id) for r in again.run(asked(store, dataset), config).collect()}
    with pytest.raises(ConfigError):
        line.with_(reranks=True).run(asked(store, dataset), config)
    with pytest.raises(ConfigError):
        building.build(store, dataset, BuildParams("x", DistanceMetric.COSINE, AnnFamily.IVF_PQ, pq=PqParams(4, 16)))
    with pytest.raises(ConfigError):
        building.build(store, dataset, BuildParams("x", family=AnnFamily.IVF_PQ))


def test_distributed_build(built):
    store, dataset, flat = built
    params = BuildParams("spread", DistanceMetric.EUCLIDEAN, num_shards=5, kmeans_iters=5)
    planned = distributed.plan(store, dataset, params, 3)
    outputs = [distributed.execute(store, dataset, planned, w) for w in range(3)]
    merged = distributed.merge(store, dataset, planned, params, outputs[::-1])
    assert [(s.shard_id, s.vector_count, s.fingerprint) for s in merged.shards] == [(s.shard_id, s.vector_count, s.fingerprint) for s in flat.shards]
    assert validation.validate_index(store, "spread").count() == 0
    for bad in ([], outputs[:2], [*outputs, outputs[0]], [outputs[0] | {"worker_id": 9}, *outputs[1:]], [outputs[0] | {"index_version": "y"}, *outputs[1:]]):
        with pytest.raises(MergeError):
            distributed.merge(store, dataset, planned, params, bad)
    with pytest.raises(ConfigError):
        distributed.execute(store, dataset, planned, 7)


def test_validation(built, spark):
    store, dataset, flat = built
    assert validation.validate_index(store, "flat").count() == 0
    assert validation.validate_index(store, "pq").count() == 0
    assert validation.validate_dataset(store, "d1").count() == 0
    assert [r.kind for r in validation.validate_index(store, "none").collect()] == ["artifact_missing"]
    assert [r.kind for r in validation.validate_dataset(store, "none").collect()] == ["artifact_missing"]
    params = BuildParams("broken", DistanceMetric.EUCLIDEAN, num_shards=3, kmeans_iters=3)
    made = building.build(store, dataset, params)
    centroids = made.centroids_key
    spark.createDataFrame([(0, [0.0] * DIMS)], "shard_id int, centroid array<double>").write.mode("overwrite").parquet(store.path(centroids))
    shards = spark.read.parquet(store.path("indexes/broken/shards")).where("shard_id != 1 OR shard_pos > 0").withColumn("data", F.when(F.col("shard_id") == 2, F.slice("data", 1, 3)).otherwise(F.col("data"))).cache()
    shards.count()
    shards.write.partitionBy("shard_id").parquet(store.path("indexes/broken/other"))
    store.delete("indexes/broken/shards")
    spark.read.parquet(store.path("indexes/broken/other")).write.partitionBy("shard_id").parquet(store.path("indexes/broken/shards"))
    kinds = {r.kind for r in validation.validate_index(store, "broken").collect()}
    assert kinds == {"shard_centroid_mismatch", "shard_vector_count_mismatch", "shard_dimension_mismatch", "fingerprint_mismatch"}
    store.put("indexes/broken/manifest.json", b'{"index_version": "broken"}')
    assert [r.kind for r in validation.validate_index(store, "broken").collect()] == ["manifest_invalid"]


def test_manifest_rules():
    good = dict(index_version="i", dataset_version="d", embedding_version="e", dims=2, metric="cosine", algorithm="ivf-flat", vector_count=3, shards=[ShardDef(0, 1, "x", [0, 0]), ShardDef(1, 2, "y", [1, 1])], centroids_key="c")
    IndexManifest(**good).validate()
    bad = [{"dims": 0}, {"metric": "l7"}, {"shards": []}, {"vector_count": 4}, {"codec": "pq8"}, {"codebook_key": "k"}, {"centroids_key": None}, {"manifest_version": 9}, {"algorithm": ""}, {"recall_estimate": {"recall": 2}}, {"shards": [ShardDef(0, 3, "x", [0])]}, {"shards": [ShardDef(0, 1, "x", [0, 0]), ShardDef(0, 2, "x", [0, 0])]}]
    for change in bad:
        with pytest.raises(ManifestError):
            IndexManifest(**good | change).validate()
    m = IndexManifest(**good, params={"k": 1})
    assert m.fits_dims(2) and m.fits_dataset("d") and m.fits_algorithm("ivf-flat", "", {"k": 1}) and not m.fits_algorithm("ivf-flat", params={"k": 2})


def test_service(built, spark):
    store, dataset, flat = built
    docs = spark.createDataFrame([(1, "alpha alpha"), (2, "beta"), (3, "alpha beta gamma")], "id long, text string")
    service = Service(Searcher(store, flat), building.build_lexical(store, docs, "flat"))
    v = [float(x) for x in asked(store, dataset, 1).first().q]
    assert service.query(QueryRequest(vector=v, k=3)).results[0]["id"] == 1
    assert [r["id"] for r in service.query(QueryRequest(query_text="alpha", query_mode="lexical", k=5, vector=v, rerank=True)).results] == [1, 3]
    assert service.query(QueryRequest(vector=v, query_text="beta", query_mode="hybrid", k=2, rerank=True, rerank_limit=5)).results[0]["id"] in (1, 2)
    assert service.resolve(QueryRequest(vector=v, nprobe=3, candidate_centroids=4)).fan_out.candidate_centroids == 4
    assert service.query_plan(QueryRequest(vector=v, nprobe=2)).shards.count() == 2
    assert service.resolve(QueryRequest(vector=v, query_text="a", rerank_limit=2, rerank=None)).mode == "vector"
    bad = [QueryRequest(), QueryRequest(vector=v, k=0), QueryRequest(vector=v, query_mode="x"), QueryRequest(query_mode="lexical", query_text="!!"), QueryRequest(query_mode="hybrid", query_text="a"), QueryRequest(vector=v, rerank=True, rerank_limit=0), QueryRequest(vector=v, nprobe=0), QueryRequest(vector=v, distance_metric="l7")]
    for request in bad:
        with pytest.raises(ConfigError):
            service.query(request)
    assert service.metrics() | {"results": 0} == {"requests": 3 + len(bad), "errors": len(bad), "results": 0}
    assert service.health()["status"] == "ok"
    assert "corvix_query_duration_seconds_count 3" in service.prometheus() and 'le="+Inf"} 3' in service.prometheus()


def test_http_and_cache(built, spark):
    import threading
    import urllib.error
    import urllib.request

    from corvix.plans.http import server

    store, dataset, flat = built
    service = Service(Searcher(store, flat, capacity=2, prefetch=PrefetchPolicy(True, 2)), debug=True)
    http = server(service, port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    v = [float(x) for x in asked(store, dataset, 1).first().q]

    def call(path, body=None):
        data = None if body is None else json.dumps(body).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{http.server_address[1]}{path}", data)) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    try:
        assert json.loads(call("/health")[1]) == {"status": "ok", "index_version": flat.index_version}
        asking = {"vector": v, "k": 3, "query_mode": "vector", "query_text": None, "rerank": None, "nprobe": 2}
        answers = [json.loads(call("/query", asking)[1]) for _ in range(3)]
        plain = Service(Searcher(store, flat)).query(QueryRequest(vector=v, k=3, nprobe=2)).results
        assert [a["results"] for a in answers] == [plain] * 3
        assert call("/query", asking | {"nprobe": 5})[0] == 200  # more shards than the cache holds
        m = service.searcher.loaded.metrics
        assert (m.misses, m.hits) == (2, 4) and len(service.searcher.loaded.tables) <= 2 and m.load_ns > 0
        assert len(json.loads(call("/debug/query-plan", asking)[1])["plan"]["shards"]) == 2
        assert call("/query", {"vector": v, "k": 0})[0] == call("/query", {"other": 1})[0] == 400
        assert call("/query", {"vector": v[:1], "k": 1})[0] == 400
        assert call("/none")[0] == call("/none", {})[0] == 404
        text = call("/metrics")[1]
        want = ["query_duration_seconds_count 4", "queries_total 4", "query_results_total 12", "shard_cache_hits_total 4", "shard_cache_misses_total 2", "shard_load_count_total 2", 'query_duration_seconds_bucket{le="10.0"} 4']
        assert all(f"corvix_{x}\n" in text for x in want) and "corvix_shard_load_latency_ns_total" in text
        assert f"corvix_shard_cache_retained_bytes {sum(s.bytes for s in flat.shards if s.shard_id in service.searcher.loaded.cache.held)}\n" in text
        service.debug = False
        assert call("/debug/query-plan", asking)[0] == 404
    finally:
        http.shutdown()


def test_mended_edges(built, spark, tmp_path):
    import glob

    from corvix.operators import ivf

    store, dataset, flat = built
    with pytest.raises(ConfigError):
        distributed.plan(store, dataset, BuildParams("w9", num_shards=2, metric=DistanceMetric.EUCLIDEAN, pq=PqParams(1, 2)), 2)
    rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [5.0, 1.0])], "id long, data array<double>")
    centers = ivf.kmeans(rows, 3, 4, 7)
    assert sorted(list(r.centroid) for r in centers.collect()) == [[0.0, 1.0], [5.0, 1.0]]
    got = {r.id: r.shard_id for r in ivf.assign(rows, centers).collect()}
    assert got[2] is None and {got[1], got[3]} == {0, 1}
    own = HadoopStore(spark, str(tmp_path))
    for data in (b"one", b"two"):
        own.put("a/b.json", data)
        assert own.get("a/b.json") == data
    assert own.list("a") == ["a/b.json"]
    copy = HadoopStore(spark, str(tmp_path / "copy"))
    shutil.copytree(store.root, copy.root)
    for name in glob.glob(f"{copy.root}/indexes/{flat.index_version}/shards/**/*.parquet", recursive=True)[:1]:
        with open(name, "wb") as f:
            f.write(b"not a table")
    kinds = {r.kind for r in validation.validate_index(copy, flat.index_version).collect()}
    assert "shard_parse_error" in kinds


def test_harness(built, spark):
    store, dataset, flat = built
    s = Searcher(store, flat)
    full = harness.eval_ann(s, 3, 5, nprobe=5, workload="warm")
    assert (full.recall, full.precision, full.queries) == (1.0, 1.0, 3) and full.p99_us >= full.mean_us > 0 and full.disk_bytes > 0
    names = [r.name for r in harness.compare_ann([s, Searcher(store, IndexManifest.load(store, "pq"))], 2, 3)]
    assert names == ["ivf_flat", "ivf_pq"]
    docs = spark.createDataFrame([(1, "alpha"), (2, "beta")], "id long, text string")
    modes = harness.eval_hybrid(s, bm25.build(docs), docs.withColumnRenamed("id", "qid"), 2, 3)
    assert [r.name for r in modes] == ["vector", "bm25", "hybrid"]
    parts = harness.evaluate_partitioning(s, 4, 3, 5)
    assert parts["routing_accuracy"].first().routing_accuracy == 1.0
    assert parts["hotness"].agg(F.sum("probes")).first()[0] == 20
    with pytest.raises(ConfigError):
        harness.timed(s.search, asked(store, dataset), "hot")


def test_metrics(spark):
    rows = lambda ids: spark.createDataFrame([(0, i) for i in ids], "qid long, id long")
    assert metrics.recall(rows([1, 2, 3]), rows([1, 2, 5])).first().recall == pytest.approx(2 / 3)
    assert metrics.precision(rows([1, 2, 3]), rows([1, 4, 5])).first().precision == pytest.approx(1 / 3)
    assert metrics.precision(rows([1]), rows([])).first().precision == 0.0
    assert metrics.recall(rows([]), rows([1])).first().recall == 1.0
    assert metrics.cost(10, 8, 5, 2, 4) == {"memory_bytes": 10 * 2 + 2 * 4 * 4 * 4, "disk_bytes": 5, "compression_ratio": 16.0}
    assert metrics.cost(2**62, 8, 0)["memory_bytes"] == 2**63 - 1


def test_cache(spark):
    cache = ShardCache(2)
    assert [cache.access(s) for s in (1, 2, 1, 3, 2, 1)] == [False, False, True, False, False, False]
    assert (cache.metrics.hits, cache.metrics.evictions, cache.metrics.hit_rate()) == (1, 3, 1 / 6)
    trace = spark.createDataFrame([("a", i, s) for i, s in enumerate((1, 2, 1, 3, 2, 1))] + [("b", 0, 1), ("b", 1, 1)], "worker string, at long, shard_id int")
    assert {r.worker: (r.hits, r.misses) for r in replay(trace, 2).collect()} == {"a": (1, 5), "b": (1, 1)}
    rows = spark.createDataFrame([(1, 10), (2, 20)], "shard_id int, id long")
    assert [r.id for r in warm(rows, trace, PrefetchPolicy(True, 5)).collect()] == [10]
    assert warm(rows, trace, PrefetchPolicy()).count() == 0
    with pytest.raises(ConfigError):
        ShardCache(0)
    with pytest.raises(ConfigError):
        SystemConfig(num_shards=0)


def test_generators(spark):
    a = generate.clustered(spark, 50, 4, 3, seed=1)
    assert {tuple(r.data) for r in a.collect()} == {tuple(r.data) for r in generate.clustered(spark.newSession(), 50, 4, 3, seed=1).repartition(7).collect()}
    assert a.agg(F.min("id"), F.max("id")).first() == (1, 50)
    g = generate.gaussian(spark, 2000, 3).select(F.explode("data").alias("x")).agg(F.avg("x"), F.stddev("x")).first()
    assert abs(g[0]) < 0.05 and abs(g[1] - 1) < 0.05
    with pytest.raises(ConfigError):
        generate.clustered(spark, 0)


def test_cli(spark, tmp_path, capsys):
    root = ["--root", str(tmp_path)]
    run = lambda *a: cli.main([*root, *a], spark)
    assert run("generate", "--dataset", "d", "--num-vectors", "60", "--dims", "4") == 0
    assert run("build-index", "--dataset", "d", "--index", "i", "--num-shards", "3", "--kmeans-iters", "2") == 0
    for mode in (["plan", "--workers", "2"], ["execute", "--worker", "0"], ["execute", "--worker", "1"], ["merge"]):
        assert run("build-index-worker", "--dataset", "d", "--index", "w", "--num-shards", "3", "--kmeans-iters", "2", "--mode", *mode) == 0
    assert run("publish", "--index", "i") == 0
    assert run("validate-manifest", "--index", "w") == 0
    capsys.readouterr()
    assert run("eval-ann", "--max-queries", "2", "--nprobe", "3") == 0
    assert json.loads(capsys.readouterr().out)["recall"] == 1.0
    assert run("publish", "--index", "none") == 2
    assert cli.as_text({"a": {"b": 1}, "c": [{"d": 2}]}) == "a.b: 1\nc[0].d: 2"


def test_streaming(spark, tmp_path):
    from corvix.streaming.ingest import assign_stream, probe_counts

    rows = spark.createDataFrame([(1, [0.0]), (2, [9.0])], "id long, data array<double>")
    rows.write.parquet(str(tmp_path / "in"))
    c = spark.createDataFrame([(0, [0.0]), (1, [10.0])], "shard_id int, centroid array<double>")
    q = assign_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), c, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert {(r.id, r.shard_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, 0), (2, 1)}
    probes = spark.sql("SELECT timestamp'2024-01-01 00:01:00' ts, 3 shard_id UNION ALL SELECT timestamp'2024-01-01 00:02:00', 3")
    probes.write.parquet(str(tmp_path / "probes"))
    counted = probe_counts(spark.readStream.schema(probes.schema).parquet(str(tmp_path / "probes")))
    s = counted.writeStream.outputMode("update").format("memory").queryName("probe_counts").option("checkpointLocation", str(tmp_path / "ck2")).start()
    s.processAllAvailable()
    s.stop()
    assert [(r.shard_id, r.probes) for r in spark.table("probe_counts").collect()] == [(3, 2)]
