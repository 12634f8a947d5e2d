"""Every catalogue query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from grainloom.plans import catalogue

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def cell(v):
    return f"{v + 0.0:.6g}" if isinstance(v, float) and math.isfinite(v) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_as_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, D)
    sql = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in sql.description]
    assert sorted(columns) == sorted(df.columns)
    kinds = {r[0]: r[1] for r in duck.execute("DESCRIBE " + catalogue.ORACLES[name]).fetchall()}
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    want = sorted(tuple(map(cell, r)) for r in duck.execute(catalogue.ORACLES[name]).fetchall())
    assert sorted(tuple(map(cell, r)) for r in df.select(*columns).collect()) == want
    assert want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, D).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
