"""Canonical items and fused values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import covered, known
from ..functions.text import canonical_id
from .windows import first_of, running_share, usage_tier


def crosswalk(df: DataFrame, id_col: str, name: str, category: str, ascii_only: bool = False) -> DataFrame:
    """Item, canonical_id."""
    return df.select(F.col(id_col).alias("item"), F.col(name).alias("name"), F.col(category).alias("category"), canonical_id(F.col(name), F.col(category), ascii_only).alias("canonical_id"))


def canonical_table(items: DataFrame, most: int = 12) -> DataFrame:
    """A row a canonical item: representative (first item), up to `most` distinct names, and whether it merged several."""
    first = first_of(items, ["canonical_id"], [F.col("item")]).select("canonical_id", F.col("item").alias("representative"), F.col("name").alias("representative_name"), F.col("category"))
    names = items.groupBy("canonical_id").agg(F.countDistinct("item").alias("item_count"), F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, most), " | ").alias("examples"))
    return first.join(names, "canonical_id").withColumn("merged", F.col("item_count") > 1)


def usage(items: DataFrame, logs: str, key: str = "canonical_id") -> DataFrame:
    """Total use, items, running share and tier of each key."""
    sums = items.groupBy(key).agg(F.sum(logs).alias("total_loggings"), F.countDistinct("item").alias("item_count"))
    out = running_share(sums, "total_loggings", key, "cumulative_logging_share")
    return out.withColumn("usage_tier", usage_tier(F.col("cumulative_logging_share")))


def weighted_mean(value: str, weight: str) -> tuple[Column, Column]:
    """(mean, observations): NaN and null values go, such weights count 1, negative ones 0; a plain mean if weights sum to 0."""
    v = known(F.col(value).cast("double"))
    w = F.when(v.isNotNull(), F.greatest(F.coalesce(known(F.col(weight).cast("double")), F.lit(1.0)), F.lit(0.0)))
    return F.coalesce(F.try_divide(F.sum(v * w), F.nullif(F.sum(w), F.lit(0.0))), F.avg(v)), F.count(v)


def mode_text(c: str, df: DataFrame, key: list[str]) -> DataFrame:
    """The commonest text that is not blank, of ties the smallest."""
    n = df.where(F.trim(F.col(c)) != "").groupBy(*key, c).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*key).agg(F.min_by(c, F.struct(-F.col("_n"), F.col(c))).alias(c))


def confidence_order(c: Column) -> Column:
    """A08."""
    return F.when(c == "high", 4).when(c == "medium", 3).when(c == "review", 2).when(c == "low", 1).otherwise(0)


def best_confidence(c: str) -> Column:
    return F.max_by(F.col(c), confidence_order(F.col(c)))


def long_form(df: DataFrame, key: list[str], columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Columns as rows (nulls stay)."""
    return df.unpivot(key, columns, name, value)


def imputed(observed: DataFrame, mapped: DataFrame, key: list[str]) -> DataFrame:
    """Value by key: observed, else mapped; rows with neither go. Both sides: key, value."""
    both = observed.select(*key, F.col("value").alias("_o")).join(mapped.select(*key, F.col("value").alias("_m")), key, "full")
    return both.select(*key, F.coalesce("_o", "_m").alias("value"), F.when(F.col("_o").isNotNull(), "observed").otherwise("mapped").alias("method")).where("value is not null")


def hybrid(df: DataFrame, primary: str, fallback: str, out: str) -> DataFrame:
    """Coalesce with a tag of where the value came from."""
    return df.withColumns({out: F.coalesce(primary, fallback), f"{out}_source": F.when(F.col(primary).isNotNull(), primary).when(F.col(fallback).isNotNull(), fallback).otherwise("missing")})


def routed(items: DataFrame) -> DataFrame:
    """Review or acceptance from two layers' confidences (first_confidence, second_confidence; null is no candidate)."""
    first, second = F.coalesce("first_confidence", F.lit("review")), F.coalesce("second_confidence", F.lit(""))
    strong, weak = second.isin("medium", "high"), first.isin("low", "review")
    reason = (
        F.when(strong & weak, "second layer is strong").when(strong, "both layers are acceptable").when(weak, "first layer is weak or ambiguous").otherwise("first layer is acceptable")
    )
    return items.withColumns({
        "review_status": F.when(weak & ~strong, "pending").otherwise("auto_accept"),
        "identity_type": F.when(strong, "branded_or_packaged").otherwise("generic_or_recipe"), "review_reason": reason,
    })


def agreement(df: DataFrame) -> DataFrame:
    """P20: agreement state and review priority. Columns: comparable, same_name, same_source (boolean), confidence, similarity, other_score."""
    state = (
        F.when(~F.col("comparable"), "not_comparable").when(F.col("same_name"), "same_source_and_similar_name").when(F.col("same_source"), "same_source_different_item").otherwise("different_source")
    )
    ours, theirs = F.col("confidence").isin("high", "medium"), F.col("confidence").isin("low", "review")
    priority = (
        F.when(F.col("agreement_state") == "same_source_and_similar_name", "agreement").when(ours & (F.col("similarity") >= 0.98), "both_plausible_review")
        .when(theirs & (F.col("other_score") >= 0.72), "other_may_be_better_review").when(ours, "ours_may_be_better_review").otherwise("ambiguous_review")
    )
    return df.withColumn("agreement_state", state).withColumn("review_priority", priority)


def categorised(c: Column, rules: list[tuple[str, str]], other: Column) -> Column:
    """The name of the first pattern found (any case), else other."""
    out = other
    for pattern, name in reversed(rules):
        out = F.when(c.rlike(f"(?i){pattern}"), F.lit(name)).otherwise(out)
    return out


def coverage_registry(features: DataFrame, items: DataFrame, amounts: DataFrame) -> DataFrame:
    """For each feature and item: the item's own amount, else its proxy's scaled by the protein ratio, else unresolved; and the feature's status.

    features: feature; items: item, primary_id, proxy_id, ratio; amounts: feature, donor, amount (a row each).
    """
    grid = items.crossJoin(features)  # a stated grid: every feature of every item is an output row
    ok = amounts.where(covered(F.col("amount")))
    own = ok.select("feature", F.col("donor").alias("primary_id"), F.col("amount").alias("own"))
    proxy = ok.select("feature", F.col("donor").alias("proxy_id"), F.col("amount").alias("other"))
    cells = grid.join(own, ["feature", "primary_id"], "left").join(proxy, ["feature", "proxy_id"], "left")
    value = F.coalesce(F.col("own"), F.col("other") * F.col("ratio"))
    method = F.when(F.col("own").isNotNull(), "recorded").when(value.isNotNull(), "proxy").otherwise("unresolved")
    return cells.select("feature", "item", value.alias("value"), method.alias("method"))


def registry_status(cells: DataFrame) -> DataFrame:
    """Included if every item has a value, else pending."""
    return cells.groupBy("feature").agg(F.count("value").alias("n_known"), F.count(F.lit(1)).alias("n_items"), F.when(F.count("value") == F.count(F.lit(1)), "included").otherwise("completion_pending").alias("status"))


def derived(cells: DataFrame, sums: dict[str, list[str]], ratios: dict[str, tuple[str, str]]) -> DataFrame:
    """(item, feature, value, lineage) of sums and ratios of features; a null or zero part makes null."""
    wide = cells.groupBy("item").pivot("feature", sorted({x for v in sums.values() for x in v} | {x for v in ratios.values() for x in v})).agg(F.first("value"))
    parts = [(n, sum((F.col(x) for x in xs[1:]), F.col(xs[0])), "+".join(xs)) for n, xs in sums.items()] + [(n, F.try_divide(F.col(a), F.col(b)), f"{a}/{b}") for n, (a, b) in ratios.items()]
    rows = F.array(*(F.struct(F.lit(n).alias("feature"), v.cast("double").alias("value"), F.lit(s).alias("lineage")) for n, v, s in parts))
    return wide.select("item", F.explode(rows).alias("_r")).select("item", "_r.*")


def kept(df: DataFrame, column: str) -> DataFrame:
    """Rows that are to be kept: yes, maybe, true or 1 in any letter case, or blank."""
    return df.where(F.trim(F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))).isin("yes", "maybe", "true", "1", ""))


def identities(sources: list[DataFrame], name: str, code: str) -> DataFrame:
    """Each name of all sources with its smallest code, the number of its codes, and whether they conflict."""
    from ..sources.readers import union_all

    each = union_all([s.select(name, code) for s in sources]).distinct()
    return each.groupBy(name).agg(F.count(F.lit(1)).alias("n_codes"), (F.count(F.lit(1)) > 1).alias("conflict"), F.min(code).alias(code))
