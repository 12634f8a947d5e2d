"""Checks, profiles and comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import close
from .windows import quantiles


def checked_unique(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows of df; reading a repeated or null key raises."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    name = F.concat_ws(",", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in key))
    null = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in key))
    marked = df.withColumn("_n", n)
    bad = (F.col("_n") > 1) | null
    # The filter is never true for good rows and fails on bad ones, so it cannot be pruned.
    return marked.where(F.when(bad, F.raise_error(F.concat(F.lit("repeated or null key: "), name)).cast("boolean")).otherwise(F.lit(True))).drop("_n")


def checked_join(a: DataFrame, b: DataFrame, key: list[str], how: str = "inner", kind: str = "one_to_one") -> DataFrame:
    """Fails when a side that must be unique is not."""
    return (checked_unique(a, key) if kind == "one_to_one" else a).join(checked_unique(b, key), key, how)


def profile(df: DataFrame, columns: list[str], table: str) -> DataFrame:
    """Rows, missing, zero, distinct, least, median and largest of numeric columns, over the long form."""
    long = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "column", "value")
    medians = quantiles(long, "value", [0.5], "column").select(F.col("column").alias("_c"), F.col("value").alias("median"))
    out = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_present"), F.count_if(F.col("value").isNull()).alias("n_missing"), F.count_if(F.col("value") == 0).alias("n_zero"),
        F.countDistinct("value").alias("n_distinct"), F.min("value").alias("least"), F.max("value").alias("largest"),
    )
    out = out.join(F.broadcast(medians), F.col("column") == F.col("_c"), "left").drop("_c")  # a row a column
    return out.select("column", "n_rows", "n_present", "n_missing", "n_zero", "n_distinct", "least", "median", "largest", F.lit(table).alias("table_name"))


def panel_coverage(long: DataFrame, item: str = "item", value: str = "value") -> DataFrame:
    """Share present and non-zero, and quantiles of the number of non-zero values of an item (as many different numbers as features at most)."""
    per = long.groupBy(item).agg(F.count(value).alias("present"), F.count_if(F.col(value) != 0).alias("nonzero"), F.count(F.lit(1)).alias("cells"))
    q = lambda p: F.percentile("nonzero", p)
    return per.agg(
        F.count(F.lit(1)).alias("n_items"), (F.sum("present") / F.sum("cells") * 100).alias("present_pct"), (F.sum("nonzero") / F.sum("cells") * 100).alias("nonzero_pct"),
        q(0.5).alias("median_nonzero"), q(0.05).alias("p05_nonzero"), q(0.95).alias("p95_nonzero"),
    )


def panel_agreement(a: DataFrame, b: DataFrame, key: list[str], by: str) -> DataFrame:
    """Of two long panels (key, value): differences and exact share by feature."""
    both = a.select(*key, F.col("value").alias("x")).join(b.select(*key, F.col("value").alias("y")), key).where("x is not null and y is not null").withColumn("d", F.abs(F.col("x") - F.col("y")))
    out = both.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_abs"), F.max("d").alias("max_abs"),
        F.avg(F.when(F.col("y") != 0, F.col("d") / F.abs("y"))).alias("mean_rel"), (F.avg(close(F.col("x"), F.col("y")).cast("int")) * 100).alias("exact_pct"),
    )
    q = quantiles(both, "d", [0.5, 0.95], by).groupBy(F.col(by).alias("_b")).agg(F.max(F.when(F.col("quantile") == 0.5, F.col("value"))).alias("median_abs"), F.max(F.when(F.col("quantile") == 0.95, F.col("value"))).alias("p95_abs"))
    return out.join(F.broadcast(q), F.col(by).eqNullSafe(F.col("_b"))).select(by, "n", "mean_abs", "median_abs", "p95_abs", "max_abs", "mean_rel", "exact_pct")  # a row a feature


def overall(df: DataFrame, value: str, weight: str) -> DataFrame:
    """A35."""
    return df.agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias(value), F.sum(weight).alias(weight))


def compared(a: DataFrame, b: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """By column: rows that are equal (nulls alike), and rows that only one side has."""
    x = a.select(*key, F.lit(1).alias("_a"), *(F.col(c).alias(f"a_{c}") for c in columns))
    y = b.select(*key, F.lit(1).alias("_b"), *(F.col(c).alias(f"b_{c}") for c in columns))
    both = x.join(y, key, "full")
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")).alias("same")) for c in columns))
    each = both.select("_a", "_b", F.explode(rows).alias("_r")).select("_a", "_b", "_r.*")
    shared = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return each.groupBy("column").agg(F.count_if(shared).alias("n_shared"), F.count_if(shared & F.col("same")).alias("n_equal"), F.count_if(~shared).alias("n_one_sided"))


def share_table(df: DataFrame, group: list[str]) -> DataFrame:
    """Counts and their share of all."""
    n = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_t")))).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def mapping_summary(best: DataFrame, tier: str = "confidence", score: str = "match_score") -> DataFrame:
    """A38."""
    pct = lambda t: F.round(F.avg(F.when(F.col(tier) == t, 100.0).otherwise(0.0)), 2).alias(f"{t}_pct")
    return best.agg(F.count(F.lit(1)).alias("n"), *(pct(t) for t in ("high", "medium", "low", "review")), F.round(F.avg(score), 4).alias("mean_score"))


def matrix_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, columns, and the median share of columns that a row has."""
    present = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return df.select((present / len(columns)).alias("_p")).agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(columns)).cast("long").alias("n_columns"), F.percentile("_p", 0.5).alias("median_present"))


def provenance_agrees(values: DataFrame, provenance: DataFrame, key: list[str]) -> DataFrame:
    """Cells whose value is null though their provenance is not missing, or the other way round, by feature (last of key)."""
    both = values.join(provenance, key)
    return both.groupBy(key[-1]).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull() != (F.col("method") == "missing")).alias("n_conflicts"))


def outside_domain(df: DataFrame, column: str, domain: DataFrame) -> DataFrame:
    """Rows whose value is not declared."""
    return df.where(F.col(column).isNotNull()).join(domain.select(F.col("value").alias(column)).distinct(), column, "left_anti")
