"""Exports for outside tools in several build modes (C38): one table of outputs, stored by mode and kind, and a report of checked constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .features import numeric_columns, participant_vectors

#: What each mode builds.
MODES = {"artifact_only": ["artifact"], "outside_llm": ["artifact", "card"], "tre_minimal": ["artifact", "config"], "full": ["artifact", "config", "card"]}


def outputs(x: DataFrame, key: str, features: list[str], tasks: DataFrame, feature_set: str, modes: list[str], policy: str = "error") -> DataFrame:
    """mode, kind, name, embedding, content: vectors of participants (artifact), and settings and a card for each task (task, target, metric).

    Each output is made once and dealt to the modes that take it; modes and kinds are folders of the stored table.
    """
    if unknown := set(modes) - MODES.keys():
        raise ValueError(f"unknown modes: {sorted(unknown)}")
    vectors = participant_vectors(x, key, features, policy)
    null = F.lit(None).cast("string")
    artifact = vectors.select(F.lit("artifact").alias("kind"), F.col(key).cast("string").alias("name"), F.col("embedding"), null.alias("content"))
    none = F.lit(None).cast("array<double>").alias("embedding")
    settings = F.to_json(F.struct("task", "target", "metric", F.lit(feature_set).alias("features"), F.lit(len(features)).alias("dimensions")))
    config = tasks.select(F.lit("config").alias("kind"), F.col("task").alias("name"), none, settings.alias("content"))
    said = F.concat(F.lit("# "), "task", F.lit("\n\nPredict "), "target", F.lit(f" from {feature_set} ({len(features)} columns); score by "), "metric", F.lit("."))
    card = tasks.select(F.lit("card").alias("kind"), F.col("task").alias("name"), none, said.alias("content"))
    takes = x.sparkSession.createDataFrame([(m, k) for m in modes for k in MODES[m]], "mode string, kind string")  # eight rows at most
    every = artifact.unionByName(config).unionByName(card)
    return written(every.join(F.broadcast(takes), "kind"), by=["mode", "kind"]).select("mode", "kind", "name", "embedding", "content")


def summary(built: DataFrame) -> DataFrame:
    """mode, and how many vectors, of what width, settings and cards it has."""
    n = lambda k: F.count_if(F.col("kind") == k)
    return built.groupBy("mode").agg(n("artifact").alias("n_vectors"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dimensions"), n("config").alias("n_configs"), n("card").alias("n_cards"))


def checks(x: DataFrame, key: str, features: list[str], tasks: DataFrame, targets: list[str]) -> DataFrame:
    """check, n_seen, n_failed, passed: participants that repeat or are null, values that are no finite numbers, columns that are missing or not numeric, tasks that repeat or whose target is unknown."""
    have = [c for c in features if c in numeric_columns(x)]
    row = lambda df, name, seen, failed: df.agg(F.lit(name).alias("check"), seen.cast("long").alias("n_seen"), F.coalesce(failed, F.lit(0)).cast("long").alias("n_failed"))
    bad = lambda c: (F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))).cast("int")
    one = F.count(F.lit(1))
    per = lambda df, k: df.groupBy(k).agg(F.count(F.lit(1)).alias("n"))
    report = row(per(x.where(F.col(key).isNotNull()), key), "participants are unique", one, F.sum((F.col("n") > 1).cast("int")))
    report = report.unionByName(row(x, "participants are known", one, F.sum(F.col(key).isNull().cast("int"))))
    report = report.unionByName(row(x, "values are finite", one * len(have), sum((F.sum(bad(c)) for c in have), F.lit(0))))
    report = report.unionByName(x.sparkSession.createDataFrame([("features are numeric columns", len(features), len(features) - len(have))], "check string, n_seen long, n_failed long"))
    report = report.unionByName(row(per(tasks, "task"), "tasks are unique", one, F.sum((F.col("n") > 1).cast("int"))))
    report = report.unionByName(row(tasks, "targets are known", one, F.sum((~F.col("target").isin(targets)).cast("int"))))
    return report.withColumn("passed", F.col("n_failed") == 0)
