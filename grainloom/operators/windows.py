"""Windows, sorts, limits and sets (W01-W11, T01-T07, U01-U05). Every order is total, so results do not depend on partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written


#: Rows up to which quantiles() takes the built-in aggregate (at most 16 bytes a distinct value).
AT_ONCE = 2_000_000

#: Accuracy of the approximate quantiles around wanted ranks.
FINE = 5_000


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, ranked from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def by_priority(df: DataFrame, group: list[str], kind: str, priority: dict[str, int], tie: str, n: int) -> DataFrame:
    """The first n rows of each group by the priority of their kind (others 999), then by tie."""
    place = F.lit(999)
    for k, v in priority.items():
        place = F.when(F.col(kind) == k, F.lit(v)).otherwise(place)
    return top_k(df, group, [place, F.asc(tie)], n, "_r").drop("_r")


def places(df: DataFrame, kind: str, order: str, name: str) -> DataFrame:
    """The place of each row within its kind, from 0: its number by kind and order less the least of its kind."""
    ranked = numbered(df, [kind, order], "_at")
    least = ranked.groupBy(kind).agg(F.min("_at").alias("_l"))
    return ranked.join(least, kind).withColumn(name, F.col("_at") - F.col("_l")).drop("_at", "_l")


def first_of(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by order (an aggregate, so rows are combined before the shuffle)."""
    rest = [c for c in df.columns if c not in key]
    by = F.struct(*(o.alias(f"_{i}") for i, o in enumerate(order)))
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), by).alias("_r")).select(*key, "_r.*") if rest else df.distinct()


def ranged(df: DataFrame, order: list[Column], value: str | None = None) -> DataFrame:
    """df with _before, the rows before each one by order, or with `value` the sum of it up to and with each one; no task sees all rows.

    Rows are range-partitioned and written with their partition and place, so that the offsets, which
    come from the sums of the partitions before, belong to the same partitions.
    """
    parts = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    total = F.sum(value) if value else F.count(F.lit(1))
    sums = parts.groupBy("_p").agg(total.alias("_n"))
    offsets = sums.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))  # a row a partition
    out = parts.join(F.broadcast(offsets), "_p")
    within = F.sum(value).over(Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)) if value else F.col("_i")
    return out.withColumn("_before", F.col("_o") + within).drop("_p", "_i", "_o")


def numbered(df: DataFrame, order: list[str], name: str = "ordinal", start: int = 0) -> DataFrame:
    """Consecutive numbers by order from start."""
    return ranged(df, [F.col(c) for c in order]).withColumn(name, (F.col("_before") + start).cast("long")).drop("_before")


def running_share(df: DataFrame, value: str, tie: str, share: str = "cumulative_share") -> DataFrame:
    """Running total over the grand total, by value downwards."""
    total = df.agg(F.sum(value).alias("_total"))
    out = ranged(df, [F.desc(value), F.asc(tie)], value).crossJoin(F.broadcast(total))  # one row
    return out.withColumn(share, F.coalesce(F.try_divide("_before", "_total"), F.lit(0.0))).drop("_before", "_total")


def quantiles(df: DataFrame, value: str, at: list[float], by: str | None = None) -> DataFrame:
    """(by), quantile, value: exact, with linear interpolation between neighbours; nulls do not count. by: a column of few values.

    Up to AT_ONCE rows the built-in aggregate is used, which keeps the values in a task. Beyond, approximate quantiles cut
    the values close to the wanted ranks into buckets; only the buckets that hold a wanted rank are ordered.
    """
    rows = df.where(F.col(value).isNotNull()).select((F.col(by) if by else F.lit(0)).alias("_g"), F.col(value).cast("double").alias("_v"))
    if rows.count() <= AT_ONCE:
        found = rows.groupBy("_g").agg(F.percentile("_v", F.array(*map(F.lit, at))).alias("_p"))
        out = found.select("_g", F.explode(F.arrays_zip(F.array(*map(F.lit, at)).alias("q"), F.col("_p").alias("v"))).alias("_x")).select("_g", F.col("_x.q").alias("quantile"), F.col("_x.v").alias("value"))
        return out.withColumnRenamed("_g", by) if by else out.drop("_g")
    rows = written(rows)  # read three times
    # Cuts close on both sides of each wanted rank; they settle the work only, as ranks come from exact counts.
    near = sorted({min(max(q + e / FINE, 0.0), 1.0) for q in at for e in (-2, 2)})
    cuts = rows.groupBy(F.col("_g").alias("_h")).agg(F.percentile_approx("_v", near, FINE).alias("_c"))
    bucket = reduce(lambda a, b: a + b, ((F.col("_v") > F.get("_c", F.lit(i))).cast("int") for i in range(len(near))))
    placed = rows.join(F.broadcast(cuts), F.col("_g").eqNullSafe(F.col("_h"))).select("_g", "_v", bucket.alias("_b"))
    sizes = placed.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_g")
    sizes = sizes.withColumns({"_s": F.sum("_n").over(w.orderBy("_b")) - F.col("_n"), "_t": F.sum("_n").over(w)})
    place = (F.col("_t") - 1) * F.col("_q")
    wanted = sizes.withColumn("_q", F.explode(F.array(*map(F.lit, at)))).withColumn("_k", F.explode(F.array(F.floor(place), F.ceil(place)))).where((F.col("_k") >= F.col("_s")) & (F.col("_k") < F.col("_s") + F.col("_n")))
    wanted = wanted.select(F.col("_g").alias("_h"), F.col("_b").alias("_d"), (F.col("_k") - F.col("_s")).alias("_r"), "_q", (place - F.floor(place)).alias("_f")).distinct()
    here = F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_b") == F.col("_d"))
    counts = placed.join(F.broadcast(wanted.select("_h", "_d").distinct()), here, "left_semi").groupBy("_g", "_b", "_v").agg(F.count(F.lit(1)).alias("_m"))
    counts = counts.withColumn("_e", F.sum("_m").over(Window.partitionBy("_g", "_b").orderBy("_v")))
    found = counts.join(F.broadcast(wanted), here & (F.col("_r") < F.col("_e")) & (F.col("_r") >= F.col("_e") - F.col("_m")))
    out = found.groupBy("_g", "_q").agg((F.min("_v") + (F.max("_v") - F.min("_v")) * F.max("_f")).alias("value")).withColumnRenamed("_q", "quantile")
    return out.withColumnRenamed("_g", by) if by else out.drop("_g")


def usage_tier(share: Column) -> Column:
    """By the running share of use."""
    return F.when(share <= 0.80, "tier_1_high_usage_top_80pct").when(share <= 0.95, "tier_2_medium_usage_next_15pct").otherwise("tier_3_low_usage_last_5pct")


def latest(df: DataFrame, group: list[str], attempt: str) -> DataFrame:
    """The rows of each group's last attempt."""
    last = df.groupBy(*group).agg(F.max(attempt).alias(attempt))
    return df.join(last, [*group, attempt], "left_semi")


def next_attempt(df: DataFrame, group: list[str], attempt: str) -> DataFrame:
    """W05."""
    return df.groupBy(*group).agg((F.coalesce(F.max(attempt), F.lit(0)) + 1).alias("next_attempt"))


def z_scores(df: DataFrame, columns: list[str], population: bool = False) -> DataFrame:
    """Each column less its mean over its deviation; a deviation of 0 or of one row counts as 1."""
    std = F.stddev_pop if population else F.stddev_samp
    stats = df.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.coalesce(F.nullif(std(c), F.lit(0.0)), F.lit(1.0)).alias(f"_s_{c}") for c in columns))
    out = df.crossJoin(F.broadcast(stats))  # one row
    return out.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}") for c in columns}).drop(*(f"_{x}_{c}" for c in columns for x in "ms"))


def shares(df: DataFrame, group: list[str], within: list[str], name: str = "share") -> DataFrame:
    """Counts by group and their share within the wider group."""
    n = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy(*within)))


def set_report(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Values in both, only in a, only in b."""
    return a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full").select(
        key, F.when(F.col("_a").isNull(), "right_only").when(F.col("_b").isNull(), "left_only").otherwise("both").alias("side"))
