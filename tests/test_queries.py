"""Every query against its SQL on the smallest tables, as the driver compares them."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from corvix import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(df):
    df = df[sorted(df.columns)]
    cell = lambda v: repr(round(v, 9)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF).toPandas()
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_all_items_are_asked(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").select("item_id").distinct().count()
    found = __spark_entry__.queries()["q_bm25_topk_items"](spark, SF)
    assert found.select("qid").distinct().count() == items


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 50


def test_registered():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert glob.glob(f"{SF}/*.parquet")
