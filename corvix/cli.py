"""Command line: python -m corvix <command> --root ROOT ..."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from pyspark.sql import SparkSession

from .errors import CorvixError
from .evaluation import harness
from .operators import bm25
from .plans import build as building
from .plans import distributed, validation
from .plans.build import BuildParams
from .plans.config import AnnFamily, DistanceMetric, HybridRankingPolicy, PqParams
from .plans.http import server
from .plans.pipeline import Searcher
from .plans.service import QueryRequest, Service
from .sources import generate, ingest
from .sources.manifest import DatasetManifest, publish, resolve
from .sources.store import HadoopStore


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="corvix")
    out.add_argument("--root", default="./data")
    out.add_argument("--output", choices=["json", "text"], default="json")
    sub = out.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple[str, dict]) -> None:
        p = sub.add_parser(name)
        for flag, more in options:
            p.add_argument(flag, **more)

    number = lambda d: {"type": int, "default": d}
    need = {"required": True}
    index = [("--dataset", need), ("--index", need), ("--metric", {"default": "cosine"}), ("--family", {"default": "ivf_flat"}), ("--num-shards", number(4)), ("--kmeans-iters", number(20)), ("--kmeans-seed", number(0xDEADBEEF)), ("--kmeans-sample-size", number(None)), ("--recall-sample-size", number(None)), ("--pq-subspaces", number(None)), ("--pq-codes", number(256))]
    asked = [("--alias", {"default": "latest"}), ("--max-queries", number(100)), ("--k", number(10)), ("--nprobe", number(2))]
    command("ingest", ("--input", need), ("--dataset", need), ("--embedding", {}))
    command("generate", ("--dataset", need), ("--num-vectors", number(1000)), ("--dims", number(128)), ("--num-clusters", number(10)), ("--seed", number(0xDEADBEEF)), ("--spread", {"type": float, "default": 0.1}))
    command("build-index", *index, ("--workers", number(None)))
    command("build-index-worker", *index, ("--mode", {"choices": ["plan", "execute", "merge"], "required": True}), ("--workers", number(2)), ("--worker", number(0)))
    command("publish", ("--alias", {"default": "latest"}), ("--index", need))
    command("serve", ("--alias", {"default": "latest"}), ("--lexical", {"action": "store_true"}), ("--stdin", {"action": "store_true"}), ("--host", {"default": "127.0.0.1"}), ("--port", number(8080)), ("--cache-shards", number(None)), ("--debug-routes", {"action": "store_true"}))
    command("benchmark", *asked, ("--workload", {"default": "mixed"}))
    command("eval-ann", *asked)
    command("compare-ann", ("--aliases", {"nargs": "+", "required": True}), *asked[1:])
    command("eval-hybrid", *asked, ("--texts", need), ("--vector-weight", {"type": float, "default": 0.7}), ("--bm25-weight", {"type": float, "default": 0.3}))
    command("validate-manifest", ("--index", need))
    command("evaluate-partitioning", *asked)
    return out


def _params(a: argparse.Namespace) -> BuildParams:
    pq = PqParams(a.pq_subspaces, a.pq_codes) if a.pq_subspaces else None
    return BuildParams(a.index, DistanceMetric(a.metric), AnnFamily(a.family), a.num_shards, a.kmeans_iters, a.kmeans_seed, a.kmeans_sample_size, a.recall_sample_size, pq=pq)


def serve(service: Service) -> None:
    """Requests as JSON lines on standard input, responses on standard output."""
    for line in sys.stdin:
        if line.strip():
            try:
                print(json.dumps(asdict(service.query(QueryRequest(**json.loads(line))))), flush=True)
            except (CorvixError, TypeError, json.JSONDecodeError) as e:
                print(json.dumps({"error": str(e)}), flush=True)


def as_text(value: object, name: str = "") -> str:
    """Nested values as lines `a.b: value`."""
    if isinstance(value, dict):
        return "\n".join(as_text(v, f"{name}.{k}" if name else str(k)) for k, v in value.items())
    if isinstance(value, list) and any(isinstance(v, dict) for v in value):
        return "\n".join(as_text(v, f"{name}[{i}]") for i, v in enumerate(value))
    return f"{name}: {value}"


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("corvix").getOrCreate()
    store = HadoopStore(spark, a.root)
    show = lambda x: print(json.dumps(x, indent=2, default=str) if a.output == "json" else as_text(x))
    searcher = lambda alias: Searcher(store, resolve(store, alias))
    try:
        if a.command == "ingest":
            show(asdict(ingest.ingest(spark, store, a.input, a.dataset, a.embedding)))
        elif a.command == "generate":
            rows = generate.clustered(spark, a.num_vectors, a.dims, a.num_clusters, a.seed, a.spread)
            show(asdict(ingest.write_dataset(store, rows, a.dataset, source="generated")))
        elif a.command == "build-index":
            dataset, params = DatasetManifest.load(store, a.dataset), _params(a)
            made = distributed.run(store, dataset, params, a.workers) if a.workers else building.build(store, dataset, params)
            show(asdict(made))
        elif a.command == "build-index-worker":
            dataset, params = DatasetManifest.load(store, a.dataset), _params(a)
            if a.mode == "plan":
                show(asdict(distributed.plan(store, dataset, params, a.workers)))
            else:
                planned = distributed.WorkerPlan(**store.get_json(f"indexes/{a.index}/worker_plan.json"))
                if a.mode == "execute":
                    show(distributed.execute(store, dataset, planned, a.worker))
                else:
                    outputs = [store.get_json(k) for k in store.list(f"indexes/{a.index}/workers") if k.endswith("output.json")]
                    show(asdict(distributed.merge(store, dataset, planned, params, outputs)))
        elif a.command == "publish":
            publish(store, a.alias, a.index)
        elif a.command == "serve":
            s = Searcher(store, resolve(store, a.alias), capacity=a.cache_shards)
            service = Service(s, building.load_lexical(store, s.manifest.index_version) if a.lexical else None, debug=a.debug_routes)
            serve(service) if a.stdin else server(service, a.host, a.port).serve_forever()
        elif a.command in ("benchmark", "eval-ann"):
            show(asdict(harness.eval_ann(searcher(a.alias), a.max_queries, a.k, a.nprobe, getattr(a, "workload", "mixed"))))
        elif a.command == "compare-ann":
            show([asdict(r) for r in harness.compare_ann([searcher(x) for x in a.aliases], a.max_queries, a.k, a.nprobe)])
        elif a.command == "eval-hybrid":
            texts = spark.read.json(a.texts, schema="id long, text string")
            policy = HybridRankingPolicy(a.vector_weight, a.bm25_weight)
            made = bm25.build(texts)
            show([asdict(r) for r in harness.eval_hybrid(searcher(a.alias), made, texts.withColumnRenamed("id", "qid"), a.max_queries, a.k, a.nprobe, policy)])
        elif a.command == "validate-manifest":
            faults = [r.asDict() for r in validation.validate_index(store, a.index).collect()]
            show(faults)
            return int(bool(faults))
        elif a.command == "evaluate-partitioning":
            show({k: [r.asDict() for r in v.collect()] for k, v in harness.evaluate_partitioning(searcher(a.alias), a.max_queries, a.k, a.nprobe).items()})
    except CorvixError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0
