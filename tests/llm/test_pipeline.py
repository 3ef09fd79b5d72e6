"""The pipeline's stages, each on what the one before kept."""

import duckdb
import pytest

import corpus_pipeline as C
import __spark_entry__ as E
from tools.compare import normal

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in C.STAGES:
        before, docs = docs, C.settle(stage(spark, docs, SF))
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns and docs.dtypes == before.dtypes
    first = spark.read.parquet(f"{SF}/documents.parquet")
    assert seen["toxicity"].join(first, columns, "left_anti").count() == 0
    kept = C.minhash.near_duplicates(seen["toxicity"], percent=80).where("kept").select("doc_id")
    assert sorted(r[0] for r in seen["minhash"].select("doc_id").collect()) == sorted(r[0] for r in kept.collect())
    assert seen["substring_dedup"].count() == seen["minhash"].count()
    assert set(r[0] for r in seen["mixing"].select("doc_id").collect()) == set(r[0] for r in docs.select("doc_id").collect())
    assert docs.agg({"length": "max"}).first()[0] <= 1024


def test_registered():
    names = set(E.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


@pytest.mark.parametrize("name", ["op1_minhash", "op5_search", "op6_embedding_dedup"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    left, right = normal(E.queries()[name](spark, SF).toPandas()), normal(con.execute(E.oracle_sql()[name]).df())
    assert len(left) > 0 and left.equals(right)
