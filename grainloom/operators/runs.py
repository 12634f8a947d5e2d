"""Runs of several steps that leave their tables and a summary behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..scratch import written
from . import features, graph, match, quality


def mapping_run(left: DataFrame, right: DataFrame, out: str) -> DataFrame:
    """Prepared names through candidates, placeholders, graph and validation; tables below out, and a row of the summary as it is read back."""
    spark: SparkSession = left.sparkSession
    found = match.with_unmatched(left, match.candidates(left, right))
    found.write.parquet(f"{out}/candidates")
    found = spark.read.parquet(f"{out}/candidates")
    graph.from_mapping(found.where("right_id IS NOT NULL")).write.parquet(f"{out}/edges")
    best = found.where("candidate_rank = 1")
    edges = spark.read.parquet(f"{out}/edges").agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("source").alias("n_sources"), F.countDistinct("target").alias("n_targets"))
    kept = found.agg(F.count("right_id").alias("n_candidates"))
    quality.mapping_summary(best).crossJoin(kept).crossJoin(edges).write.parquet(f"{out}/summary")  # one row each
    return spark.read.parquet(f"{out}/summary")


def layer_run(items: DataFrame, layers: dict[str, DataFrame], key: str, out: str) -> tuple[DataFrame, DataFrame]:
    """Layer tables checked (one row a key), stored one by one, and folded onto the items; the fold, and of each layer its rows, the items that it covers and the columns that it adds."""
    spark = items.sparkSession
    stored, report, have = [], None, list(items.columns)
    keys = items.select(key).distinct()
    for name, layer in layers.items():
        quality.checked_unique(layer, [key]).write.parquet(f"{out}/{name}")
        table = spark.read.parquet(f"{out}/{name}")
        new = [c for c in table.columns if c not in have]
        have += new
        row = table.join(keys.withColumn("_in", F.lit(1)), key, "left").agg(F.lit(name).alias("layer"), F.count(F.lit(1)).alias("n_rows"), F.count("_in").alias("n_items"), F.lit(", ".join(new)).alias("adds"))
        report = row if report is None else report.unionByName(row)
        stored.append(table)
    return written(features.joined_tables([items, *stored], key)), report


def discovered(df: DataFrame, excluded: set[str], schema: DataFrame | None = None, groups: list[str] | None = None) -> list[str]:
    """The columns that hold amounts: those that a schema table (column, group) has in the groups, or without one all numeric columns but the excluded; always numeric, in the table's order."""
    numeric = features.numeric_columns(df, tuple(excluded))
    if schema is None:
        return numeric
    listed = schema.where(F.col("group").isin(groups)) if groups is not None else schema
    named = {r[0] for r in listed.select("column").distinct().limit(len(df.columns) + 1).join(F.broadcast(df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")), "column").collect()}  # names of df's columns only
    return [c for c in numeric if c in named]


def scenario_means(scenarios: dict[str, DataFrame], key: str, columns: list[str]) -> DataFrame:
    """C14: scenario, key and columns of all scenarios, and as scenario `combined` the mean of each item over those that have a value."""
    each = None
    for name, df in scenarios.items():
        rows = df.select(F.lit(name).alias("scenario"), key, *(F.col(c).cast("double").alias(c) for c in columns))
        each = rows if each is None else each.unionByName(rows)
    each = written(each)
    return each.unionByName(each.groupBy(key).agg(*(F.avg(c).alias(c) for c in columns)).select(F.lit("combined").alias("scenario"), key, *columns))


def identity_links(sources: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """left_source, left_id, right_source, right_id, norm of records of different sources with one normalised name. sources: table, id, name."""
    every = None
    for name, (df, ident, said) in sources.items():
        rows = df.select(F.lit(name).alias("source"), F.col(ident).cast("string").alias("id"), normalize(F.col(said)).alias("norm")).where("norm <> ''").distinct()
        every = rows if every is None else every.unionByName(rows)
    every = written(every)
    # Names that would make more than match.SPLIT pairs are dealt out by their left ids, each block with the right ids; rows of one source never meet.
    order = sorted(sources)
    n = every.groupBy("norm").pivot("source", order).agg(F.count(F.lit(1))).na.fill(0, order)
    pairs = sum((F.col(f"`{a}`") * F.col(f"`{b}`") for i, a in enumerate(order) for b in order[i + 1 :]), F.lit(0))
    n = written(n.select("norm", pairs.alias("_p")))
    tasks = 1 + (n.agg(F.sum("_p")).first()[0] or 0) // (4 * match.SPLIT)
    blocks = n.select("norm", F.ceil(F.col("_p") / match.SPLIT).cast("int").alias("_n")).where("_n > 1")
    dealt = every.join(blocks, "norm", "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    out = None
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            left = dealt.where(F.col("source") == a).select(F.col("source").alias("left_source"), F.col("id").alias("left_id"), "norm", F.pmod(F.xxhash64("id"), "_n").cast("int").alias("_x"))
            right = dealt.where(F.col("source") == b).select(F.col("source").alias("right_source"), F.col("id").alias("right_id"), "norm", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_x"))
            found = left.repartition(tasks, "norm", "_x").join(right, ["norm", "_x"])  # tasks by pairs, as the rows themselves are few
            out = found if out is None else out.unionByName(found)
    if out is None:
        return every.where("false").select(F.col("source").alias("left_source"), F.col("id").alias("left_id"), F.col("source").alias("right_source"), F.col("id").alias("right_id"), "norm")
    return out.select("left_source", "left_id", "right_source", "right_id", "norm")
