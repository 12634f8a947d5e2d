"""Abundance tables of communities (C37): one long table (who, level, taxon, value) to matrices, diversity, taxon groups and a manifest.

Everything is an aggregate by participant; only the wide matrix needs names
of columns, which come from a counted dictionary of a stated length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import feature_token

#: Columns of a wide matrix at most: the taxa of most participants; the others are summed.
WIDEST = 2_000


def averaged(raw: DataFrame, who: str, level: str, taxon: str, value: str) -> DataFrame:
    """who, level, taxon, value: repeated measurements as their mean (A43); rows without a participant or a taxon go."""
    out = raw.select(F.col(who).cast("string").alias("who"), F.col(level).alias("level"), F.col(taxon).alias("taxon"), F.col(value).cast("double").alias("value")).where("who IS NOT NULL AND taxon IS NOT NULL")
    return out.groupBy("who", "level", "taxon").agg(F.avg(F.when(F.isnan("value"), None).otherwise(F.col("value"))).alias("value"))


def diversity(long: DataFrame) -> DataFrame:
    """Who, level, shannon, simpson, richness, total; from four sums, negative and missing values count 0."""
    v = F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(0.0))
    s = long.groupBy("who", "level").agg(F.sum(v).alias("total"), F.sum(F.when(v > 0, v * F.ln(v)).otherwise(0.0)).alias("_l"), F.sum(v * v).alias("_q"), F.count_if(v > 0).alias("richness"))
    t = F.col("total")
    return s.select("who", "level", F.when(t > 0, F.ln(t) - F.col("_l") / t).otherwise(0.0).alias("shannon"), F.when(t > 0, 1 - F.col("_q") / (t * t)).otherwise(1.0).alias("simpson"), "richness", "total")


def held(taxon: Column, pattern: str) -> Column:
    """Whether a taxon's name matches, in any letter case; doubled underscores count once."""
    return F.replace(taxon, F.lit("__"), F.lit("_")).rlike(f"(?i){pattern}")


def groups(long: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """who, level, a sum for each named group of taxa, their total (a taxon of two groups counts once) and n_matched, the taxa of the level that match."""
    v = F.coalesce("value", F.lit(0.0))
    hit = {name: held(F.col("taxon"), p) for name, p in patterns.items()}
    either = F.greatest(*(h.cast("int") for h in hit.values()), F.lit(0)) > 0
    sums = long.groupBy("who", "level").agg(*(F.sum(F.when(h, v).otherwise(0.0)).alias(name) for name, h in hit.items()), F.sum(F.when(either, v).otherwise(0.0)).alias("groups_total"))
    matched = long.groupBy("level").agg(F.countDistinct(F.when(either, F.col("taxon"))).alias("n_matched"))
    return sums.join(F.broadcast(matched), "level")  # a row a level


def prepared(long: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """who, level, diversity and groups side by side."""
    return diversity(long).join(groups(long, patterns), ["who", "level"], "full")


def manifest(long: DataFrame, wanted: list[str], patterns: dict[str, str]) -> DataFrame:
    """level, status (exported or missing), n_rows, n_features, n_matched of each wanted level."""
    either = F.greatest(*(held(F.col("taxon"), p).cast("int") for p in patterns.values()), F.lit(0)) > 0
    have = long.groupBy("level").agg(F.countDistinct("who").alias("n_rows"), F.countDistinct("taxon").alias("n_features"), F.countDistinct(F.when(either, F.col("taxon"))).alias("n_matched"))
    levels = long.sparkSession.createDataFrame([(x,) for x in wanted], "level string")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return levels.join(have, "level", "left").select("level", F.when(F.col("n_rows").isNull(), "missing").otherwise("exported").alias("status"), zero("n_rows"), zero("n_features"), zero("n_matched"))


def dictionary(long: DataFrame, most: int = WIDEST) -> DataFrame:
    """taxon and n_who, its participants: the first `most` by them, then by name."""
    return long.groupBy("taxon").agg(F.countDistinct("who").alias("n_who")).orderBy(F.desc("n_who"), "taxon").limit(most)


def wide(long: DataFrame, prefix: str, most: int = WIDEST) -> DataFrame:
    """who, a column for each taxon of the dictionary (0 where absent), and {prefix}other, the sum of all further taxa. long: of one level."""
    names = [x[0] for x in dictionary(long, most).collect()]  # at most `most`
    token = F.concat(F.lit(prefix), feature_token(F.col("taxon")))
    taken, columns = set(), {}
    for name, column in zip(names, [x[0] for x in long.sparkSession.createDataFrame([(n,) for n in names], "taxon string").select(token).collect()] if names else [], strict=True):
        while column in taken:
            column += "_"
        taken.add(column)
        columns[name] = column
    sums = long.withColumn("_n", F.when(F.col("taxon").isin(names), F.col("taxon")).otherwise("")).groupBy("who").pivot("_n", [*names, ""]).agg(F.sum("value"))
    sums = sums.toDF("who", *(f"_{i}" for i in range(len(names))), "_rest")
    return sums.select("who", *(F.coalesce(f"_{i}", F.lit(0.0)).alias(c) for i, c in enumerate(columns.values())), F.coalesce(F.col("_rest"), F.lit(0.0)).alias(f"{prefix}other"))
