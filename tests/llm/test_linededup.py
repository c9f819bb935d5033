"""Line dedup against a direct reading of its rule."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corvix.llm import _common, linededup

SCHEMA = "doc_id long, text string, lost string, n_lines int"
SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(-1 if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 3 or (-1 if i is None else i) == max(holders[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    pool = [f"line number {i} that is long enough" for i in range(30)] + ["short", "", "exactly twenty chars", "ninteen characters.", "Ünïcödé zwanzig zeichen"]
    out = []
    for i in range(120):
        lines = [rng.choice(pool) for _ in range(rng.randrange(0, 90))]
        lines = [rng.choice(["", " ", "\t", "\r"]) + (x.upper() if rng.random() < 0.2 and x.isascii() else x) + rng.choice(["", "  ", "\x0b"]) for x in lines]
        if i % 3 == 0:
            lines.insert(len(lines) // 2, "the very common line of this corpus")
        out.append((i * 7, "\n".join(lines)))
    return out + [(3, None), (4, ""), (5, "\n\n"), (None, "the very common line of this corpus\nown"), (14, "the very common line of this corpus\nsame id"), ("x" and 9, "y" * 200_000)]


@pytest.mark.parametrize("floor", [200, 5])
def test_lines(spark, rows, monkeypatch, floor):
    monkeypatch.setattr(_common, "HOT_FLOOR", floor)
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], SCHEMA).repartition(4)
    out = linededup.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()), key=str) == brute(rows)
    hashed = {(r.doc_id, r.kept_sha256) for r in linededup.digest(docs).collect()}
    assert hashed == {(i, hashlib.sha256(t.encode()).hexdigest()) for i, _, _, t in brute(rows)}


def test_broadcast_tables_are_one_file(spark, rows, monkeypatch):
    monkeypatch.setattr(_common, "HOT_FLOOR", 5)
    made = {}

    def kept(df, name):
        made[name] = _common.written(df, name)
        return made[name]

    monkeypatch.setattr(linededup, "written", kept)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], SCHEMA).repartition(4)
        out = linededup.dedup_lines(docs).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out), key=str) == brute(rows)
    assert {name: (made[name].count() > 4, len(made[name].inputFiles())) for name in ("hot", "stats")} == {"hot": (True, 1), "stats": (True, 1)}


def test_equal_rows_and_empty_table(spark):
    line = "a line of more than twenty characters"
    docs = spark.createDataFrame([(1, line), (1, line), (2, line), (3, line), (3, line)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in linededup.dedup_lines(docs).collect()) == [(1, ""), (1, ""), (2, ""), (3, line), (3, line)]
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_plan_is_native(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plan = linededup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    bitmaps = linededup.keep_bitmaps(docs).select(F.explode("lost"))
    assert bitmaps.where("value = 0").count() == 0
