"""Forests from sums, against pyspark.ml and plain numpy."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from grainloom.operators import forests, learn


def table(spark, n=3000):
    r = random.Random(9)
    rows = []
    for i in range(n):
        a, b = r.gauss(0, 1), r.gauss(0, 1)
        rows.append((i, a, None if i % 50 == 0 else b, 1000 + 30 * a + 20 * b * b + r.gauss(0, 5), float(a + b * b + r.gauss(0, 0.3) > 1.2)))
    return spark.createDataFrame(rows, "id long, a double, b double, y double, c double")


def test_draws_are_poisson():
    w = forests.draws(np.arange(-3000, 3000, dtype=np.int64) * 7919)
    assert w.shape == (6000, forests.TREES) and abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.05 and abs(np.corrcoef(w[:-1, 0], w[1:, 0])[0, 1]) < 0.05


def test_a_tree_by_hand():
    """The first split halves the variance most; without depth left or gain there are means."""
    bins = np.stack(np.unravel_index(np.arange(forests.CELLS), (forests.BINS,) * 2), axis=1)
    n = np.where((bins < 4).all(axis=1), 1.0, 0.0)
    v = (n * (10 * (bins[:, 0] >= 2) + (bins[:, 1] >= 3)))[:, None]
    said = forests.tree(n, v, bins, 2, np.random.default_rng(1))
    assert np.allclose(said[n > 0], v[n > 0]) and said[-1, 0] == 11


@pytest.mark.parametrize("target", ["y", "c"])
def test_forests_as_of_pyspark_ml(spark, target):
    df = table(spark)
    kind = "regression" if target == "y" else "classes"
    got = {(x.fold, x.metric): x.value for x in learn.evaluated(df, "id", ["a", "b"], target, folds=2, names=["forest"]).collect()}
    for fold in range(2):
        train, test = learn.split(df.withColumn("_y", F.col(target)), "id", fold, strata=None if target == "y" else "c")
        mean = train.agg(F.avg("b")).first()[0]
        ready = lambda x: VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(x.fillna(mean, ["b"]))  # noqa: B023, E731
        n = train.groupBy("_y").count().withColumn("_w", 1 / F.col("count"))
        model = RandomForestRegressor(labelCol="_y", numTrees=300, seed=1) if kind == "regression" else RandomForestClassifier(labelCol="_y", weightCol="_w", numTrees=300, seed=1)
        pred = model.fit(ready(train if kind == "regression" else train.join(n, "_y"))).transform(ready(test))
        want = (learn.regression_metrics(pred) if kind == "regression" else learn.classification_metrics(pred)).first().asDict()
        assert {m for f, m in got if f == fold} == want.keys()
        for m, x in want.items():
            assert got[fold, m] == pytest.approx(x, rel=0.1 if m == "rmse" else 0.03), (fold, m)


def test_forests_do_not_depend_on_partitions_and_fit_no_model(spark, monkeypatch):
    monkeypatch.setattr(RandomForestRegressor, "fit", None)
    df = table(spark, 400).withColumn("b", F.when(F.col("id") % 3 > 0, F.col("b")))
    found = [sorted(tuple(x) for x in learn.evaluated(df.repartition(n), "id", ["a", "b"], "y", folds=2, names=["forest"]).collect()) for n in (1, 7)]
    assert len(found[0]) == 6 and all(a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-6) for a, b in zip(*found, strict=True))


def test_scores_by_cells_as_by_rows(spark):
    """Metrics of cells equal those of rows."""
    from pyspark.ml.linalg import Vectors

    r = np.random.default_rng(3)
    p = np.round(r.random(40), 2)
    held = r.integers(0, 4, (40, 2)).astype(float)
    rows = [(float(y), float(p[i] > 0.5), Vectors.dense([1 - p[i], p[i]])) for i in range(40) for y in (0, 1) for _ in range(int(held[i, y]))]
    want = learn.classification_metrics(spark.createDataFrame(rows, ["_y", "prediction", "probability"])).first().asDict()
    got = forests._classes(held, np.stack([1 - p, p], axis=1), [0.0, 1.0])
    assert got.keys() == want.keys() and all(got[m] == pytest.approx(want[m]) for m in want)
    y = r.normal(size=300)
    cell = r.integers(0, 40, 300)
    sums = np.stack([np.bincount(cell, w, 40) for w in (np.ones(300), y, y * y)], axis=1)
    want = learn.regression_metrics(spark.createDataFrame([(float(a), float(p[c])) for a, c in zip(y, cell, strict=True)], ["_y", "prediction"])).first().asDict()
    got = forests._regression(sums, p[:, None], 1.0)
    assert got.keys() == want.keys() and all(got[m] == pytest.approx(want[m]) for m in want)


def test_workers_need_no_package():
    from pyspark import cloudpickle

    # Pickled by reference, they would be some 50 bytes.
    assert all(len(cloudpickle.dumps(f)) > 1000 for f in (forests.draws, forests.tree))
