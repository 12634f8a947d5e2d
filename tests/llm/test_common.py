"""Stored tables and their ends."""

from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grainloom.llm import common


def test_settled_leaves_only_its_result(spark):
    made = []

    def make():
        made.append(common.stored(spark.range(3), "step"))
        return made[0].withColumn("x", F.col("id") * 2)

    before = common.stored(spark.range(1), "before")
    out = common.settled(make, "out")
    assert out.agg(F.sum("x")).first()[0] == 6 and before.count() == 1
    assert Path(out.stored_at).exists() and not Path(made[0].stored_at).exists()
    common.discard(out, before, None, spark.range(1))
    assert not Path(out.stored_at).exists() and not Path(before.stored_at).exists()


def test_settled_cleans_up_after_an_error(spark):
    made = []

    def make():
        made.append(common.stored(spark.range(3), "step"))
        raise ValueError

    with pytest.raises(ValueError):
        common.settled(make, "out")
    assert not Path(made[0].stored_at).exists()


def test_names(spark):
    df = spark.range(1).select(F.col("id").alias("_K"), F.col("id").alias("_k_"))
    assert common.fresh(df, "_k") == "_k__" and common.fresh(df, "other") == "other"


def test_slices():
    texts = ["a" * 10, None, "", "b" * 25, "é" * 5, "c"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["k", "t"])
    for size in (1, 10, 20, 1000):
        parts = list(common.slices(batch, size=size))
        assert [t for p in parts for t in p.column(1).to_pylist()] == texts
        assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= size for p in parts)
    assert len(list(common.slices(batch, size=1000))) == 1 and list(common.slices(batch.slice(0, 0))) == []
