"""Item features from donors (C27): transfer, scaling by a proxy, and derived features in the order of their dependencies.

Cells stay long (item, feature, value), so their lineage travels with
them: how a value was made, from which donor, by which factor, and the ids
of all records that it rests on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written

#: A derived feature: what is summed, and what that is divided by (nothing: the sum itself).
Formula = tuple[list[str], list[str]]


def _amounts(records: DataFrame, prefix: str) -> DataFrame:
    return records.select(F.col("donor").alias(f"{prefix}_donor"), F.col("feature").alias(f"{prefix}_feature"), F.col("amount").alias(f"{prefix}_amount"), F.col("record").alias(f"{prefix}_record"))


def _sound(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def transferred(specs: DataFrame, records: DataFrame, features: list[str], scaled: list[str], scale_by: str) -> DataFrame:
    """item, feature, value, method, donor, scale_factor, source_value, sources, proxy_used of every item and feature.

    specs: item, donor, proxy (or null); records: donor, feature, amount, record, one for each donor and feature.
    A feature that the donor lacks comes from the proxy if it is one of `scaled`, times the ratio of both donors' `scale_by`,
    which must be positive at the proxy. What neither gives, and what is negative or not finite, is unresolved: no value.
    """
    cells = specs.select("item", F.col("donor").cast("string").alias("own"), F.col("proxy").cast("string").alias("other"), F.explode(F.array(*map(F.lit, features))).alias("feature"))
    r = records.where(_sound(F.col("amount")))
    base = r.where(F.col("feature") == scale_by)
    own, other, own_base, other_base = _amounts(r, "o"), _amounts(r.where(F.col("feature").isin(scaled)), "p"), _amounts(base, "ob"), _amounts(base, "pb")
    out = cells.join(own, (F.col("own") == F.col("o_donor")) & (F.col("feature") == F.col("o_feature")), "left")
    out = out.join(other, (F.col("other") == F.col("p_donor")) & (F.col("feature") == F.col("p_feature")) & F.col("o_amount").isNull(), "left")
    out = out.join(own_base, F.col("own") == F.col("ob_donor"), "left").join(other_base, F.col("other") == F.col("pb_donor"), "left")
    factor = F.when(F.col("pb_amount") > 0, F.col("ob_amount") / F.col("pb_amount"))
    by_proxy = F.col("o_amount").isNull() & F.col("p_amount").isNotNull() & factor.isNotNull()
    value = F.when(F.col("o_amount").isNotNull(), F.col("o_amount")).when(by_proxy, F.col("p_amount") * factor)
    out = out.withColumns({"value": F.when(_sound(value) & (value >= 0), value), "proxy_used": by_proxy, "scale_factor": F.when(by_proxy, factor).otherwise(F.lit(1.0))})
    known = F.col("value").isNotNull()
    return out.select(
        "item", "feature", "value", F.when(~known, "unresolved").when(by_proxy, "scaled_proxy").otherwise("donor_transfer").alias("method"), F.when(known, F.when(by_proxy, F.col("other")).otherwise(F.col("own"))).alias("donor"),
        F.when(known, F.col("scale_factor")).alias("scale_factor"), F.when(known, F.coalesce("o_amount", "p_amount")).alias("source_value"),
        F.when(known, F.array_sort(F.array_distinct(F.array_compact(F.when(by_proxy, F.array("p_record", "ob_record", "pb_record")).otherwise(F.array("o_record")))))).otherwise(F.array().cast("array<bigint>")).alias("sources"), (known & F.col("proxy_used")).alias("proxy_used"),
    )


def levels(formulas: dict[str, Formula]) -> list[list[str]]:
    """The derived features in groups: each rests on stored features and earlier groups only. A cycle is an error."""
    left, done, out = dict(formulas), set(), []
    while left:
        ready = [n for n, (up, down) in left.items() if not any(d in left for d in (*up, *down))]
        if not ready:
            raise ValueError(f"features that rest on themselves: {sorted(left)}")
        out.append(ready)
        done |= set(ready)
        left = {n: f for n, f in left.items() if n not in done}
    return out


def derived(cells: DataFrame, formulas: dict[str, Formula]) -> DataFrame:
    """cells and the derived ones: a sum, or a sum over a positive sum; without all of its parts a cell is unresolved.

    Their sources are those of all parts, they use a proxy if a part does, and `parts` names what they were made of.
    """
    spark = cells.sparkSession
    out = written(cells.withColumn("parts", F.array().cast("array<string>")))
    for names in levels(formulas):
        rows = [(n, d, side, len(set(formulas[n][0]) | set(formulas[n][1])), bool(formulas[n][1])) for n in names for side in (0, 1) for d in dict.fromkeys(formulas[n][side])]
        parts = spark.createDataFrame(rows, "name string, feature string, side int, n_parts int, ratio boolean")  # as long as the formulas
        each = out.join(F.broadcast(parts), "feature")
        total = lambda side: F.sum(F.when(F.col("side") == side, F.col("value")))
        made = each.groupBy("item", "name", "n_parts", "ratio").agg(
            total(0).alias("up"), total(1).alias("down"), F.countDistinct(F.when(F.col("value").isNotNull(), F.col("feature"))).alias("n"), F.max("proxy_used").alias("proxy_used"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"), F.array_sort(F.collect_set("feature")).alias("parts"))
        value = F.when(F.col("n") == F.col("n_parts"), F.when(~F.col("ratio"), F.col("up")).when(F.col("down") > 0, F.col("up") / F.col("down")))
        made = made.select("item", F.col("name").alias("feature"), value.alias("value"), F.when(value.isNull(), "unresolved").otherwise("derived").alias("method"), "sources", "proxy_used", "parts")
        out = written(out.unionByName(made, allowMissingColumns=True))
    return out


def coverage(cells: DataFrame) -> DataFrame:
    """Feature, and its numbers of cells by how they were made."""
    count = lambda m: F.count_if(F.col("method") == m).alias(m)
    return cells.groupBy("feature").agg(F.count(F.lit(1)).alias("n_items"), *(count(m) for m in ("donor_transfer", "scaled_proxy", "derived", "unresolved")), F.count_if((F.col("method") == "derived") & F.col("proxy_used")).alias("derived_with_proxy"))
