"""Linear models of many feature sets, targets and splits from one pass over the data.

A repeated split is a hash of the key, so every row knows its fold's side.
One pass sums, for each target and for all rows and each fold's test rows,
the products of all columns (values, what is present, the target); train
is all less test. Least squares, ridge and lasso, with means filled in and
columns scaled by the train rows alone, and the test metrics follow from
these sums: no model reads the data again, and the driver gets matrices of
the number of columns only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODELS = ("linear", "ridge", "lasso")
#: Weight of ridge's squares; lasso's weight on mean squares halved, its rounds at most and the step that ends them.
RIDGE, LASSO, ROUNDS, STEP = 1.0, 0.01, 10_000, 1e-10


def _centre(df: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and deviation of each column (0 and 1 where they have none): sums of shifted values keep their digits."""
    row = df.agg(*(f(c).alias(f"{n}_{i}") for i, c in enumerate(names) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return {c: (row[f"m_{i}"] or 0.0, row[f"s_{i}"] or 1.0) for i, c in enumerate(names)}


def gathered(df: DataFrame, key: str, columns: list[str], targets: list[str], folds: int, test: float, seed: int) -> tuple[dict[tuple[str, int], np.ndarray], dict[str, tuple[float, float]]]:
    """The sums of products of (values, present, target, 1) by (target, fold): fold -1 is all rows, others that fold's test rows. And the shifts of the columns."""
    from .learn import share_of

    number = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double"))
    rows = df.select(*(number(c).alias(c) for c in dict.fromkeys([*columns, *targets])), *(share_of(key, fold, seed).alias(f"_u{fold}") for fold in range(folds)))
    shift = _centre(rows, [*columns, *targets])
    k = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        read = lambda b, c: (np.asarray(b.column(c).to_numpy(zero_copy_only=False), float) - shift[c][0]) / shift[c][1]
        for b in batches:
            x = np.stack([read(b, c) for c in columns], axis=1) if k else np.empty((len(b), 0))
            there = ~np.isnan(x)
            u = [b.column(f"_u{fold}").to_numpy() < test for fold in range(folds)]
            for t, name in enumerate(targets):
                y = read(b, name)
                good = ~np.isnan(y)
                v = np.concatenate([np.where(there, x, 0), there, y[:, None], np.ones((len(y), 1))], axis=1)
                for fold in range(-1, folds):
                    part = v[good] if fold < 0 else v[good & u[fold]]
                    sums[t, fold] = sums.get((t, fold), 0) + part.T @ part
        for (t, fold), m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([fold], pa.int32()), pa.array([m.ravel()], pa.list_(pa.float64()))], ["target", "fold", "cells"])

    parts = rows.mapInArrow(run, "target int, fold int, cells array<double>").select("target", "fold", F.posexplode("cells").alias("at", "value"))
    width = 2 * k + 2
    out = {(name, fold): np.zeros(width * width) for name in targets for fold in range(-1, folds)}
    for t, fold, at, value in parts.groupBy("target", "fold", "at").agg(F.sum("value").alias("value")).toLocalIterator():
        out[targets[t], fold][at] = value
    return {name: m.reshape(width, width) for name, m in out.items()}, shift


def solved(a: np.ndarray, b: np.ndarray, n: float, model: str) -> np.ndarray:
    """The weights of scaled columns from their products a and those with the target b, of n rows."""
    if model == "linear":
        return np.linalg.pinv(a, hermitian=True) @ b
    if model == "ridge":
        return np.linalg.solve(a + RIDGE * np.eye(len(a)), b)
    w = np.zeros(len(a))
    for _ in range(ROUNDS):
        moved = 0.0
        for j in np.flatnonzero(np.diag(a) > 0):
            rho = b[j] - a[j] @ w + a[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - n * LASSO, 0) / a[j, j]
            moved, w[j] = max(moved, abs(new - w[j])), new
        if moved < STEP:
            break
    return w


def scored(whole: np.ndarray, held: np.ndarray, at: list[int], k: int, scale_y: float, model: str) -> dict[str, float]:
    """R2, RMSE and Pearson's r on the held-out rows of a model of the columns `at` fitted on the others; from the sums alone."""
    train = whole - held
    n, y, one = train[-1, -1], len(train) - 2, len(train) - 1
    m, x = np.array([k + i for i in at], int), np.array(at, int)
    if not n or not held[-1, -1]:
        return {}
    count = train[m, one]
    mean = np.divide(train[x, one], count, out=np.zeros(len(at)), where=count > 0)
    c = np.zeros((len(train), len(at)))  # centred columns, 0 where a value is missing
    c[x, range(len(at))], c[m, range(len(at))] = 1, -mean
    middle = train[y, one] / n
    target = np.zeros(len(train))
    target[y], target[one] = 1, -middle
    products = c.T @ train @ c
    deviation = np.sqrt(np.maximum(np.diag(products), 0) / n)
    deviation[deviation < 1e-12] = 1.0
    # Lasso's weight on absolute sizes is for the target in its own unit.
    w = solved(products / np.outer(deviation, deviation), (c.T @ train @ target) / deviation * scale_y, n, model) / scale_y
    said = c @ (w / deviation)
    said[one] += middle
    truth = np.zeros(len(train))
    truth[y] = 1
    total = held[one, one]
    sum_y, sum_p = truth @ held[one], said @ held[one]
    yy, pp, py = truth @ held @ truth - sum_y**2 / total, said @ held @ said - sum_p**2 / total, said @ held @ truth - sum_p * sum_y / total
    error = max((truth - said) @ held @ (truth - said), 0)
    return {"r2": 1 - error / yy if yy > 1e-12 else 0.0, "rmse": scale_y * (error / total) ** 0.5, "pearson": py / (pp * yy) ** 0.5 if pp > 1e-12 and yy > 1e-12 else 0.0}


def bank(df: DataFrame, key: str, sets: dict[str, list[str]], targets: list[str], folds: int = 5, test: float = 0.2, seed: int = 42) -> DataFrame:
    """feature_set, target, model, fold, metric, value of the linear models of every feature set and target. Rows without a target count for the others."""
    columns = list(dict.fromkeys(c for cs in sets.values() for c in cs))
    sums, shift = gathered(df, key, columns, targets, folds, test, seed)
    rows = [
        (name, target, model, fold, metric, float(value))
        for name, chosen in sets.items() for target in targets for fold in range(folds) for model in MODELS
        for metric, value in scored(sums[target, -1], sums[target, fold], [columns.index(c) for c in chosen], len(columns), shift[target][1], model).items()
    ]
    return df.sparkSession.createDataFrame(rows, "feature_set string, target string, model string, fold int, metric string, value double")
