"""Joins along time (C39): as-of and range joins of one key's rows, without pairs of rows.

Time is cut into buckets of a stated width. Within a (key, bucket) both
sides are ordered together and each left row takes the last right row
before it; what a bucket has not seen comes from the last right row of the
buckets before, of which a key has one small row each. So a key with very
many rows is spread over its buckets, and work grows with the rows of both
sides, never with their product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def _bucket(at: str, width: int) -> Column:
    return F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / width)


def asof(left: DataFrame, right: DataFrame, key: list[str], at: str, since: str, width: int = 90 * DAY) -> DataFrame:
    """left with the columns of right (but key) of the last right row of the same key with since <= at; of equal times the largest by all columns.

    Rows of left without such a row, a key or a time keep nulls; rows of right without a key or a time count for nothing.
    Columns of right must not have names of left, but the key.
    """
    values = [c for c in right.columns if c not in key]
    have = [F.col(k).isNotNull() for k in (*key, since)]
    usable = right
    for condition in have:
        usable = usable.where(condition)
    a = left.select(*key, _bucket(at, width).alias("_b"), F.col(at).cast("timestamp").alias("_t"), F.lit(1).alias("_s"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_r"))
    b = usable.select(*key, _bucket(since, width).alias("_b"), F.col(since).cast("timestamp").alias("_t"), F.lit(0).alias("_s"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), F.struct(*values).alias("_r"))
    both = a.unionByName(b)
    here = Window.partitionBy(*key, "_b").orderBy("_t", "_s", "_r").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("_last", F.last("_r", ignorenulls=True).over(here)).where(F.col("_s") == 1)
    last = both.groupBy(*key, "_b").agg(F.max(F.when(F.col("_s") == 0, F.struct("_t", "_r"))).alias("_m"))
    before = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("_c", F.last("_m", ignorenulls=True).over(before)).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), F.col("_b").alias("_b2"), F.col("_c._r").alias("_c"))
    same = F.col("_b") == F.col("_b2")
    for i, k in enumerate(key):
        same &= F.col(k) == F.col(f"_k{i}")
    out = placed.join(carried, same, "left").withColumn("_r", F.coalesce("_last", "_c"))
    return out.select("_l.*", *(F.col("_r")[v].alias(v) for v in values))


def in_spans(points: DataFrame, spans: DataFrame, key: list[str], at: str, start: str, end: str, width: int = 90 * DAY) -> DataFrame:
    """points with the span of their key that holds them (start <= at < end), nulls without one. Spans of a key must not overlap: see overlapping()."""
    found = asof(points, spans, key, at, start, width)
    inside = F.col(at).cast("timestamp") < F.col(end).cast("timestamp")
    return found.withColumns({c: F.when(inside, F.col(c)) for c in spans.columns if c not in key and c != end}).withColumn(end, F.when(inside, F.col(end)))


def overlapping(spans: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """Spans that begin before an earlier one of their key has ended (an empty table means that in_spans() may be used)."""
    before = Window.partitionBy(*key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_e", F.max(end).over(before)).where(F.col(start) < F.col("_e")).drop("_e")


def window_targets(targets: DataFrame, key: str, ts: str, unit: str, wanted: list[str], strict: bool = False) -> tuple[DataFrame, list[str]]:
    """Key, window_id and the wanted columns of targets that exist and are numeric; and the names of those that are not there."""
    from .features import approved_targets, windowed

    chosen = approved_targets(targets, wanted, strict)
    if not chosen:
        raise ValueError("none of the wanted targets is a numeric column")
    return windowed(targets, ts, unit).select(key, "window_id", *chosen), [c for c in wanted if c not in targets.columns]
