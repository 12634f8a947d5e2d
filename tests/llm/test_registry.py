"""The thin queries against their SQL on the smallest tables, and that they return one row a row."""

import duckdb
import pytest

from grainloom.llm import registry

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    df = registry.QUERIES[name](spark, D)
    got = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(got.fetchall())


@pytest.mark.parametrize(("name", "key"), [("op2_sharding", "doc_id"), ("op4_secrets", "doc_id"), ("op5_language", "doc_id"), ("op7_toxicity", "doc_id"), ("op8_embeddings", "vec_id"), ("op9_jaccard", "doc_id"), ("op10_bpe", "doc_id")])
def test_one_row_a_row(spark, name, key):
    table = "embeddings" if key == "vec_id" else "documents"
    out = registry.QUERIES[name](spark, D)
    assert sorted(r[0] for r in out.select(key).collect()) == sorted(r[0] for r in spark.read.parquet(f"{D}/{table}.parquet").select(key).collect())
