"""Models on design matrices (V09-V13, A45, J22, C39): pyspark.ml over repeated deterministic splits."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from .windows import quantiles

#: Models of different feature sets and targets that are fitted side by side.
AT_ONCE = 4


def aligned(x: DataFrame, y: DataFrame, key: list[str], target: str) -> DataFrame:
    """Rows with a target, by key."""
    return x.join(y.select(*key, target).where(F.col(target).isNotNull()), key)


def task_kind(df: DataFrame, target: str) -> str:
    """Binary up to two values, regression for numbers of more than ten values, else multiclass."""
    n = df.agg(F.countDistinct(target)).first()[0]
    numeric = df.schema[target].dataType.simpleString() in ("double", "float", "int", "bigint")
    return "binary" if n <= 2 else "regression" if numeric and n > 10 else "multiclass"


def models(kind: str) -> dict:
    """The bank of models for a kind of task."""
    if kind == "regression":
        return {
            "linear": LinearRegression(labelCol="_y"), "ridge": LinearRegression(labelCol="_y", regParam=1.0, elasticNetParam=0.0), "lasso": LinearRegression(labelCol="_y", regParam=0.01, elasticNetParam=1.0),
            "forest": RandomForestRegressor(labelCol="_y", numTrees=300, seed=42),
        }
    return {"logistic": LogisticRegression(labelCol="_y", weightCol="_w"), "forest": RandomForestClassifier(labelCol="_y", weightCol="_w", numTrees=300, seed=42)}


def share_of(key: str, fold: int, seed: int = 42):
    """A number from 0 to 1 by the key: below the test share a row is in the fold's test."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(fold)), F.lit(1_000_003)) / 1_000_003


def split(df: DataFrame, key: str, fold: int, test: float = 0.2, seed: int = 42, strata: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Train and test by a hash of the key, so a split does not depend on partitions.

    strata: a column of few values; of each value's rows the share `test` with the smallest hashes is the test
    (to a hash's precision by its quantile), so that every class is in both.
    """
    u = share_of(key, fold, seed)
    if strata is None:
        return df.where(u >= test), df.where(u < test)
    marked = df.withColumn("_u", u)
    cuts = quantiles(marked, "_u", [test], strata).select(F.col(strata).alias("_c"), F.col("value").alias("_cut"))
    both = marked.join(F.broadcast(cuts), F.col(strata) == F.col("_c"))  # a row a class
    return both.where("_u >= _cut").drop("_u", "_c", "_cut"), both.where("_u < _cut").drop("_u", "_c", "_cut")


def held_out(df: DataFrame, key: str, fold: int, test: float = 0.2, seed: int = 42, strata: str | None = None) -> Column:
    """Whether a row is in the test of split(), as a condition; the classes' cuts are found first."""
    u = share_of(key, fold, seed)
    if strata is None:
        return u < test
    cuts = quantiles(df.withColumn("_u", u), "_u", [test], strata).where(F.col(strata).isNotNull()).select(strata, "value").collect()  # a row a class
    return reduce(lambda found, c: F.when(F.col(strata) == c[0], u < c[1]).otherwise(found), cuts, F.lit(False))


def regression_metrics(pred: DataFrame) -> DataFrame:
    """R2, RMSE and Pearson's r of (_y, prediction), one row."""
    y, p = F.col("_y"), F.col("prediction")
    m = pred.agg(F.avg(y).alias("_m"))
    e = pred.crossJoin(F.broadcast(m))  # one row
    return e.agg(F.coalesce(1 - F.try_divide(F.sum((y - p) ** 2), F.sum((y - F.col("_m")) ** 2)), F.lit(0.0)).alias("r2"), F.sqrt(F.avg((y - p) ** 2)).alias("rmse"), F.coalesce(F.corr(y, p), F.lit(0.0)).alias("pearson"))


def classification_metrics(pred: DataFrame) -> DataFrame:
    """Accuracy, macro F1, AUROC (by ranks, ties shared) and AUPRC (average precision) of (_y, prediction, probability), one row.

    Probabilities are rounded to 6 digits, so the ranks are over a million rows at most.
    """
    classes = pred.select(F.explode(F.array_distinct(F.array("_y", "prediction"))).alias("c"), "_y", "prediction")
    f1 = classes.groupBy("c").agg(F.count_if((F.col("_y") == F.col("c")) & (F.col("prediction") == F.col("c"))).alias("tp"), F.count_if((F.col("_y") == F.col("c")) != (F.col("prediction") == F.col("c"))).alias("err"))
    f1 = f1.agg(F.avg(F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("err")), F.lit(0.0))).alias("f1_macro"))
    p = pred.select("_y", F.round(vector_to_array("probability")[1], 6).alias("p")).groupBy("p").agg(F.sum("_y").alias("pos"), F.count_if(F.col("_y") == 0).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    auc = p.withColumn("w", F.col("pos") * (below + F.col("neg") / 2)).agg(F.coalesce(F.try_divide(F.sum("w"), F.sum("pos") * F.sum("neg")), F.lit(0.5)).alias("auroc"))
    down = Window.orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    precise = p.withColumn("precision", F.sum("pos").over(down) / F.sum(F.col("pos") + F.col("neg")).over(down))
    auc = auc.crossJoin(precise.agg(F.coalesce(F.try_divide(F.sum(F.col("pos") * F.col("precision")), F.sum("pos")), F.lit(0.0)).alias("auprc")))
    return pred.agg(F.avg((F.col("_y") == F.col("prediction")).cast("int")).alias("accuracy")).crossJoin(F.broadcast(f1)).crossJoin(F.broadcast(auc))  # one row each


def compared(df: DataFrame, key: str, sets: dict[str, list[str]], targets: list[str], folds: int = 5, names: list[str] | None = None) -> DataFrame:
    """The scores of all feature sets and targets: feature_set, target and what summarised() gives.

    The linear models of numeric targets come from sums that one pass gathers (see moments); other models read one stored table.
    """
    from . import moments

    columns = list(dict.fromkeys(c for cs in sets.values() for c in cs))
    data = written(df.select(key, *columns, *targets))
    kinds = {y: task_kind(data, y) for y in targets}
    wanted = lambda kind: [n for n in models(kind) if not names or n in names]
    numeric = [y for y in targets if kinds[y] == "regression"]
    linear = [n for n in wanted("regression") if n in moments.MODELS]
    rest = {y: [n for n in wanted(kinds[y]) if y not in numeric or n not in moments.MODELS] for y in targets}
    fit = lambda s, y: summarised(evaluated(data.where(F.col(y).isNotNull()), key, sets[s], y, folds, rest[y])).select(F.lit(s).alias("feature_set"), F.lit(y).alias("target"), "*")
    jobs = [(s, y) for y in targets if rest[y] for s in sets]
    with ThreadPoolExecutor(AT_ONCE) as pool:  # small fits wait for their own steps, so some go side by side
        parts = list(pool.map(lambda job: fit(*job), jobs))
    if numeric and linear:
        parts.append(summarised(moments.bank(data, key, sets, numeric, folds).where(F.col("model").isin(linear)), "feature_set", "target"))
    return reduce(DataFrame.unionByName, parts)


def run_from_files(spark, x_path: str, y_path: str, key: list[str], sets: dict[str, list[str]], targets: list[str], out: str, folds: int = 5, names: list[str] | None = None) -> DataFrame:
    """Tables read by their extensions, aligned by key, compared, and the scores written below out; returns them as they are read back."""
    from ..sources.readers import read_any
    from ..sources.writers import write_table

    x, y = read_any(spark, x_path), read_any(spark, y_path)
    columns = list(dict.fromkeys(c for cs in sets.values() for c in cs))
    rows = x.select(*key, *(F.col(c).cast("double").alias(c) for c in columns)).join(y.select(*key, *(F.col(t).cast("double").alias(t) for t in targets)), key)
    rows = rows.withColumn("_id", F.concat_ws("|", *key)).drop(*key)
    write_table(compared(rows, "_id", sets, targets, folds, names), f"{out}/summary_metrics.parquet")
    return read_any(spark, f"{out}/summary_metrics.parquet")


def evaluated(df: DataFrame, key: str, columns: list[str], target: str, folds: int = 5, names: list[str] | None = None) -> DataFrame:
    """Model, fold, metric, value for each model and repeated split (by class for classes).

    Forests of few columns come from sums that one pass gathers for all splits (see forests); other models are fitted split by split.
    """
    from . import forests

    kind = task_kind(df, target)
    data = written(df.select(key, *(F.col(c).cast("double").alias(c) for c in columns), F.col(target).cast("double").alias("_y")))  # read by every split
    strata = None if kind == "regression" else "_y"
    bank = {name: model for name, model in models(kind).items() if not names or name in names}
    out = None
    if strata:
        sizes = data.groupBy("_y").agg(F.count(F.lit(1)).alias("_n"))
        total, k = data.count(), sizes.count()
    if "forest" in bank and forests.BINS ** len(columns) <= forests.CELLS and not (strata and k > forests.CLASSES):
        del bank["forest"]
        classes = {y: n for y, n in sizes.where("_y IS NOT NULL").collect()} if strata else None  # a row a class
        found = forests.scores(data, key, columns, "_y", [held_out(data, key, fold, strata=strata) for fold in range(folds)], classes)
        out = df.sparkSession.createDataFrame([("forest", *row) for row in found], "model string, fold int, metric string, value double")
    if strata:
        data = data.join(F.broadcast(sizes), "_y").withColumn("_w", F.lit(float(total)) / (k * F.col("_n"))).drop("_n")  # a row a class
    for fold in range(folds if bank else 0):
        train, test = split(data, key, fold, strata=strata)
        steps = [Imputer(strategy="mean", inputCols=columns, outputCols=columns), VectorAssembler(inputCols=columns, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True)]
        prepared = Pipeline(stages=steps).fit(train)  # once a fold, for all models
        train, test = prepared.transform(train).cache(), prepared.transform(test)
        for name, model in bank.items():
            pred = written(model.fit(train).transform(test).select("_y", "prediction", *(["probability"] if strata else [])))  # read for each metric
            m = regression_metrics(pred) if kind == "regression" else classification_metrics(pred)
            row = m.select(F.lit(name).alias("model"), F.lit(fold).alias("fold"), *m.columns).unpivot(["model", "fold"], m.columns, "metric", "value")
            out = row if out is None else out.unionByName(row)
        train.unpersist()
    return out


def summarised(scores: DataFrame, *by: str) -> DataFrame:
    """Mean and sample deviation over folds."""
    return scores.groupBy(*by, "model", "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("std"), F.count(F.lit(1)).alias("n_folds"))
