"""The pipeline on planted documents, and that the rest stands without this subpackage."""

import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

STAGES = ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(12)
    word = lambda: f"{rng.choice('bdfgklmn')}{rng.choice('aeiou')}{rng.choice('rstvz')}{rng.choice('aeiou')}{rng.choice('lmnr')}"
    prose = lambda n: " ".join(word() for _ in range(n))
    rows, labels = [], []
    for i in range(400):
        t = prose(rng.randrange(40, 120))
        if i % 5 == 4:
            t = " ".join(f"{w} zork" if k % 15 == 0 else w for k, w in enumerate(t.split()))
        rows.append([i, t])
        labels.append((i, 1, int(i % 5 == 4)))
    copy = rows[0][1]
    rows[1][1] = copy.replace(copy.split()[20], "changed")
    rows[2][1] = copy
    item = prose(30)
    rows[10][1] = f"{prose(20)} {item} {prose(20)}"
    rows[11][1] = f"{prose(900)} {item} {prose(20)}"
    passage = prose(60)
    for i in (20, 21, 22, 23):
        rows[i][1] = f"{rows[i][1]}\n{passage}\n{prose(40)}"
    rows += [[1000, None], [1001, ""], [None, prose(30)]]
    root = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), passage, item


def test_stages(spark, planted):
    root, passage, item = planted
    assert [n for n, _ in corpus_pipeline.STAGES] == STAGES and corpus_pipeline.ORACLE_SQL is None
    docs, kept = spark.read.parquet(f"{root}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, root).cache()
        assert docs.columns == corpus_pipeline.COLUMNS
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    toxic = {i for i in range(400) if i % 5 == 4}
    assert not toxic & set(kept["toxicity"]) and len(kept["toxicity"]) == 403 - len(toxic)
    holders = [i for i, t in kept["line_dedup"].items() if t and passage in t]
    assert holders == [23] and set(kept["line_dedup"]) == set(kept["toxicity"])
    gone = set(kept["line_dedup"]) - set(kept["near_dedup"])
    assert gone == {1, 2}
    assert set(kept["near_dedup"]) - set(kept["decontamination"]) == {10}
    assert item not in kept["decontamination"][11] and item in kept["near_dedup"][11]
    assert kept["decontamination"][12] == kept["near_dedup"][12]
    long = docs.where("doc_id = 11").first()
    assert long.n_chars == len(long.text)
    changed = docs.where("doc_id = 22").first()
    assert changed.n_chars == len(changed.text)


def test_odd_rows(spark, planted):
    root = planted[0]
    rows = [(1, "one line of some words here", "en"), (1, "one line of some words here", "en"), (1, "another text", None), (None, None, "fr"), (None, "", None)]
    docs = spark.createDataFrame([(*r, "s", 3, "x", 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, n_hit int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, root)
        assert docs.columns == corpus_pipeline.COLUMNS and docs.count() == 5, name
    assert corpus_pipeline.pack_sequences(spark, docs, root).select("doc_id").distinct().count() == 2


def test_run(spark, planted):
    out = corpus_pipeline.run(spark, planted[0])
    assert out.where("doc_id = 4 OR doc_id = 2 OR doc_id = 10").count() == 0
    per_doc = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("want"))
    assert per_doc.where("n != want").count() == 0
    none = [f(spark, spark.read.parquet(f"{planted[0]}/documents.parquet").limit(0), planted[0]).count() for _, f in corpus_pipeline.STAGES]
    assert none == [0] * 5


def test_rest_without_subpackage(tmp_path):
    """The entry module, in a copy without this subpackage, imports and has the other queries."""
    import os
    import shutil

    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(f"{here}/corvix", tmp_path / "corvix", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert 'q_knn_cosine' in n and not any(x.startswith('op') for x in n); e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env).returncode == 0
