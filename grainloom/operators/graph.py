"""Property graphs as tables (A12-A25, A50, J18-J20, G01-G10, C15-C22). nodes: key, kind, label; edges: source, target, relation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import spread, written
from .windows import quantiles as ranks
from .windows import top_k


def upsert_nodes(versions: DataFrame, key: str, seq: str) -> DataFrame:
    """Of each attribute the last version that is not null."""
    rest = [c for c in versions.columns if c not in (key, seq)]
    return versions.groupBy(key).agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in rest))


def first_nodes(nodes: DataFrame, seq: Column) -> DataFrame:
    """The first version of each key."""
    from .windows import first_of

    return first_of(nodes, ["key"], [seq])


def schema_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A50."""
    a, b = nodes.select(F.col("key").alias("source"), F.col("kind").alias("source_kind")), nodes.select(F.col("key").alias("target"), F.col("kind").alias("target_kind"))
    return edges.join(a, "source").join(b, "target").groupBy("source_kind", "relation", "target_kind").agg(F.count(F.lit(1)).alias("n"))


def labelled(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends' labels, unknown where a node is missing."""
    for side in ("source", "target"):
        n = nodes.select(F.col("key").alias(side), F.col("label").alias(f"{side}_label"), F.col("kind").alias(f"{side}_kind"))
        edges = edges.join(n, side, "left").withColumns({f"{side}_label": F.coalesce(f"{side}_label", side), f"{side}_kind": F.coalesce(f"{side}_kind", F.lit("unknown"))})
    return edges


def node_information(edges: DataFrame, categories: DataFrame) -> DataFrame:
    """What a target tells of the sources' categories: prevalence, IDF, entropy, specificity, cross entropy, divergence.

    categories: source, category (a row a source). The number of sources and of categories are one-row tables.
    """
    # Edges and categories come together by source, where equal ones become one; after that all counts are of rows.
    n = max(edges.count(), categories.count())
    own = spread(categories.select("source", "category"), n, "source").distinct()
    background = own.groupBy("category").agg(F.count("source").alias("_b"))
    totals = own.select("source").distinct().agg(F.count("source").alias("n_sources")).crossJoin(F.broadcast(background.agg(F.count("category").alias("n_categories"))))  # one row each
    pairs = spread(edges.select("source", "target", "relation"), n, "source").distinct().join(own, "source")
    counts = pairs.groupBy("relation", "target", "category").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("relation", "target"))
    terms = counts.withColumn("p", p).join(background, "category").crossJoin(F.broadcast(totals)).withColumn("q", F.greatest(F.col("_b") / F.col("n_sources"), F.lit(1e-12)))
    info = terms.groupBy("relation", "target").agg(
        F.sum("n").alias("prevalence"), F.max("n_sources").alias("n_sources"), F.max("n_categories").alias("n_categories"),
        F.sum(-F.col("p") * F.ln("p")).alias("entropy"), F.sum(-F.col("p") * F.ln("q")).alias("cross_entropy"), F.sum(F.col("p") * F.ln(F.col("p") / F.col("q"))).alias("divergence"),
    )
    idf = F.ln((F.col("n_sources") + 1) / (F.col("prevalence") + 1)) + 1
    top = F.ln(F.greatest(F.col("n_categories"), F.lit(1)).cast("double"))
    normal = F.when(top > 0, F.col("entropy") / top).otherwise(F.lit(0.0))
    out = info.withColumn("idf", idf).withColumn("normalized_entropy", normal).withColumn("specificity", F.greatest(F.lit(0.0), 1 - F.col("normalized_entropy")))
    return out.withColumn("idf_entropy", F.col("idf") * F.col("specificity")).withColumn("idf_entropy_divergence", F.col("idf_entropy") * F.log1p(F.greatest(F.col("divergence"), F.lit(0.0))))


def weighted_edges(edges: DataFrame, info: DataFrame, metric: str) -> DataFrame:
    """Value (null: 1) times the target's metric (null: 0)."""
    rows = spread(edges, edges.count(), "relation", "target")
    return rows.join(info.select("relation", "target", F.col(metric).alias("_w")), ["relation", "target"], "left").withColumn("weighted_value", F.coalesce("value", F.lit(1.0)) * F.coalesce("_w", F.lit(0.0))).drop("_w")


def threshold_summary(weighted: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.75, 0.9, 0.95, 0.975, 0.99)) -> DataFrame:
    """At each quantile of weights: edges kept, sources covered, median and tenth percentile of a source's edges; the highest that covers 95 % with a median of 20 is recommended, else 0.9."""
    names = [f"t{i}" for i in range(len(quantiles))]
    rows = written(weighted.select("source", "weighted_value"))  # read for the thresholds and for the counts
    cuts = ranks(rows, "weighted_value", list(quantiles))
    cuts = cuts.agg(*(F.max(F.when(F.col("quantile") == q, F.col("value"))).alias(n) for q, n in zip(quantiles, names, strict=True)))
    own = spread(rows, rows.count(), "source")
    totals = own.groupBy("source").agg(F.count(F.lit(1)).alias("_n")).agg(F.sum("_n").alias("total"), F.count("source").alias("n_sources"))
    per = own.crossJoin(F.broadcast(cuts)).groupBy("source").agg(*(F.count_if(F.col("weighted_value") >= F.col(n)).alias(n) for n in names))  # one row
    each = F.array(*(F.struct(F.lit(q).alias("quantile"), F.col(n).alias("n")) for q, n in zip(quantiles, names, strict=True)))
    per = per.select(F.explode(each).alias("e")).select("e.*").where("n > 0")
    # Numbers of edges are few, so their quantiles are small aggregates.
    out = per.groupBy("quantile").agg(F.sum("n").alias("edges_retained"), F.count(F.lit(1)).alias("sources_covered"), F.percentile("n", 0.5).alias("median_edges"), F.percentile("n", 0.1).alias("p10_edges"))
    at = cuts.select(F.explode(F.array(*(F.struct(F.lit(q).alias("quantile"), F.col(n).alias("threshold")) for q, n in zip(quantiles, names, strict=True)))).alias("e")).select("e.*")
    out = out.join(F.broadcast(at), "quantile").crossJoin(F.broadcast(totals))  # a row a quantile, and one
    viable = (F.col("sources_covered") >= 0.95 * F.col("n_sources")) & (F.col("median_edges") >= 20)
    best = out.agg(F.coalesce(F.max(F.when(viable, F.col("quantile"))), F.lit(0.9)).alias("_best"))
    return out.crossJoin(F.broadcast(best)).select("quantile", "threshold", "edges_retained", (F.col("edges_retained") / F.col("total")).alias("retained_fraction"), "sources_covered", "median_edges", "p10_edges", (F.col("quantile") == F.col("_best")).alias("recommended"))


def signatures(weighted: DataFrame, n: int = 25) -> DataFrame:
    """The heaviest edges of each source."""
    rows = written(weighted)  # read for its number and for the ranks
    return top_k(spread(rows, rows.count(), "source"), ["source"], [F.desc("weighted_value"), F.asc("relation"), F.asc("target")], n)


def signature_matrix(weighted: DataFrame, n: int) -> DataFrame:
    """The n features with the largest total weight, in long form: source, feature, value."""
    f = weighted.withColumn("feature", F.concat_ws("=", "relation", "target"))
    top = f.groupBy("feature").agg(F.sum("weighted_value").alias("_t")).orderBy(F.desc("_t"), "feature").limit(n).select("feature")
    return f.join(F.broadcast(top), "feature", "left_semi").groupBy("source", "feature").agg(F.sum("weighted_value").alias("value"))  # n rows


def ego(edges: DataFrame, seeds: DataFrame, hops: int, most: int) -> DataFrame:
    """Edges within `hops` of the seeds (key), at most `most` of a (source, relation) on each hop, with the hop."""
    front, seen, out = seeds.select("key").distinct(), seeds.select("key").distinct(), None
    for hop in range(1, hops + 1):
        found = top_k(edges.join(front, edges["source"] == front["key"], "left_semi"), ["source", "relation"], [F.asc("target")], most, "_r").drop("_r").withColumn("hop", F.lit(hop))
        out = found if out is None else out.unionByName(found)
        front = found.select(F.col("target").alias("key")).distinct().join(seen, "key", "left_anti")
        seen = seen.unionByName(front)
    return out


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that edges touch."""
    ends = edges.select(F.col("source").alias("key")).unionByName(edges.select(F.col("target").alias("key"))).distinct()
    return nodes.join(ends, "key", "left_semi")


def path_counts(first: DataFrame, second: DataFrame) -> DataFrame:
    """By source: distinct middles and ends of paths of two edges, and paths."""
    b = second.select(F.col("source").alias("target"), F.col("target").alias("end"))
    paths = written(spread(first.select("source", "target"), first.count(), "target").join(b, "target"))  # their number is known once they are written
    return spread(paths, paths.count(), "source").groupBy("source").agg(F.countDistinct("target").alias("n_middle"), F.countDistinct("end").alias("n_end"), F.count(F.lit(1)).alias("n_paths"))


def top_labels(df: DataFrame, key: list[str], label: str, k: int) -> DataFrame:
    """The k commonest labels of each key, ties by label."""
    n = df.groupBy(*key, label).agg(F.count(F.lit(1)).alias("n"))
    return top_k(n, key, [F.desc("n"), F.asc(label)], k)


def label_summary(df: DataFrame, key: str, label: str, k: int) -> DataFrame:
    """Key, its k commonest labels in order, and the counts of all labels as JSON by label."""
    n = df.groupBy(key, label).agg(F.count(F.lit(1)).alias("n"))
    by = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(label).alias("l"))))
    counts = F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), F.col("n").alias("n"))))
    out = n.groupBy(key).agg(by.alias("_t"), counts.alias("_c"))
    pair = lambda x: F.concat(F.lit('"'), x["l"], F.lit('":'), x["n"].cast("string"))
    return out.select(key, F.array_join(F.transform(F.slice("_t", 1, k), lambda x: x["l"]), " | ").alias("top_labels"), F.concat(F.lit("{"), F.array_join(F.transform("_c", pair), ","), F.lit("}")).alias("counts"))


def from_mapping(candidates: DataFrame) -> DataFrame:
    """The edges of the best candidates, from items to what they were mapped to."""
    best = candidates.where("candidate_rank = 1")
    return best.select(F.concat(F.lit("item:"), "left_id").alias("source"), F.concat(F.lit("reference:"), "right_id").alias("target"), F.lit("maps_to").alias("relation"), "confidence", F.col("match_score").alias("value"))


def representatives(items: DataFrame, words: DataFrame, said: str, logs: str) -> DataFrame:
    """For each word (word, i: a short list) the most logged item whose text holds it; each item with its first word's number."""
    hit = items.join(F.broadcast(words), F.contains(F.col(said), F.col("word")))
    best = hit.groupBy("word", "i").agg(F.min_by("item", F.struct(-F.col(logs), F.col("item"))).alias("item"))
    return best.groupBy("item").agg(F.min("i").alias("i"))


def seed(items: DataFrame, label: str, query: str, preferred: list[str], tie: str) -> DataFrame:
    """One item: the first that holds the query, else the first that holds a preferred term, in their order."""
    place = F.lit(len(preferred) + 1)
    for i, term in reversed(list(enumerate([query, *preferred]))):
        place = F.when(F.contains(F.lower(label), F.lit(term.lower())), F.lit(i)).otherwise(place)
    return items.orderBy(place, tie).limit(1)


def informative(counts: DataFrame, key: list[str], label: str, weight: str, generic: list[str], k: int) -> DataFrame:
    """Generic labels only where others do not fill the k places."""
    return top_k(counts.withColumn("is_generic", F.col(label).isin(generic)), key, [F.asc("is_generic"), F.desc(weight), F.asc(label)], k)


def evidence_weight(x: Column) -> Column:
    """1 + min(log1p(x), 8); 0.25 for none or less, 1 if missing."""
    return F.when(x.isNull(), F.lit(1.0)).when(x <= 0, F.lit(0.25)).otherwise(1 + F.least(F.log1p(x), F.lit(8.0)))


def union_edges(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def components(links: DataFrame) -> DataFrame:
    """id and component (the smallest id that links reach) of every end of links (a, b): large and small stars in turn until nothing moves.

    Each round is written, so a lost executor costs its tasks; the least neighbour of an end is an aggregate, so no task holds all neighbours.
    """
    now = written(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).where(F.col("id").isNotNull()).distinct()
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = None
    while (at := state(now)) != seen:
        seen = at
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        now = written(small.where(F.col("a") != F.col("b")))
    return ends.join(now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("_c")), "id", "left").select("id", F.coalesce("_c", "id").alias("component"))


def merged(graphs: list[tuple[DataFrame, DataFrame]], by_label: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Several graphs as one. Nodes of the kinds of by_label are named by their label (an expression); nodes that share an old or a new name,
    in whatever graph, are one, under the new name of the first (by graph, then name). Edges follow, lose their missing ends (C21), and those that
    become equal are one, with their number and largest value.
    """
    named = F.col("key")
    for kind, name in by_label.items():
        named = F.when(F.col("kind") == kind, name).otherwise(named)
    nodes = written(reduce(DataFrame.unionByName, (n.select("key", "kind", "label").withColumn("graph", F.lit(i)) for i, (n, _) in enumerate(graphs))).withColumn("name", named))
    old, new = F.concat(F.lit("key "), "key"), F.concat(F.lit("name "), "name")
    group = written(components(nodes.select(old.alias("a"), new.alias("b"))))
    placed = nodes.join(group, old == F.col("id")).select("component", "graph", "name", "kind", "label", "key")
    first = placed.groupBy("component").agg(F.min(F.struct("graph", "name", "key", "kind", "label")).alias("f"), F.countDistinct("graph", "key").alias("n_merged"))
    out = first.select("component", F.col("f.name").alias("key"), F.col("f.kind").alias("kind"), F.col("f.label").alias("label"), "n_merged")
    moved = placed.select(F.col("key").alias("old"), "component").distinct().join(out.select("component", F.col("key").alias("new")), "component").select("old", "new")
    edges = written(reduce(DataFrame.unionByName, (e.select("source", "target", "relation", "value") for _, e in graphs)))
    rows = edges.count()
    for side in ("source", "target"):
        edges = spread(edges, rows, side).join(moved.withColumnRenamed("old", side), side).drop(side).withColumnRenamed("new", side)
    edges = spread(edges, rows, "source", "target").groupBy("source", "target", "relation").agg(F.count(F.lit(1)).alias("n_merged"), F.max("value").alias("value"))
    return out.drop("component"), edges


def weighted_by(edges: DataFrame, info: DataFrame, metrics: list[str]) -> DataFrame:
    """Source, target, relation, value, metric, weighted_value under all metrics: edges meet the information once, and are stored by metric."""
    both = spread(edges, edges.count(), "relation", "target").join(info.select("relation", "target", *metrics), ["relation", "target"], "left")
    weight = lambda m: F.coalesce("value", F.lit(1.0)) * F.coalesce(m, F.lit(0.0))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), weight(m).alias("weighted_value")) for m in metrics)))
    return written(both.select("source", "target", "relation", "value", each.alias("_m")).select("source", "target", "relation", "value", "_m.*"), by=["metric"])


def thresholds(weighted: DataFrame, by: str = "metric", quantiles: tuple[float, ...] = (0.5, 0.75, 0.9, 0.95, 0.975, 0.99), usual: float = 0.9) -> DataFrame:
    """threshold_summary() for each value of a column of few values: by, quantile, threshold, edges_retained, sources_covered, median_edges, recommended."""
    rows = weighted.select(by, "source", "weighted_value")
    cuts = ranks(rows, "weighted_value", list(quantiles), by).select(by, "quantile", F.col("value").alias("threshold"))
    places = range(len(quantiles))
    cuts = cuts.groupBy(by).agg(*(F.max(F.when(F.col("quantile") == q, F.col("threshold"))).alias(f"_c{i}") for i, q in enumerate(quantiles)))
    counts = (F.count_if(F.col("weighted_value") >= F.col(f"_c{i}")).alias(f"_n{i}") for i in places)
    per = spread(rows, rows.count(), by, "source").join(F.broadcast(cuts), by).groupBy(by, "source").agg(*(F.first(f"_c{i}").alias(f"_c{i}") for i in places), *counts)  # cuts: a row a metric
    found = lambda i: F.when(F.col(f"_n{i}") > 0, F.col(f"_n{i}"))
    each = lambda i: F.struct(F.lit(quantiles[i]).alias("quantile"), F.first(f"_c{i}").alias("threshold"), F.sum(found(i)).alias("edges_retained"), F.count(found(i)).alias("sources_covered"), F.percentile(found(i), 0.5).alias("median_edges"))
    out = per.groupBy(by).agg(F.count("source").alias("_s"), F.array(*map(each, places)).alias("_e")).select(by, "_s", F.explode("_e").alias("_e")).select(by, "_e.*", "_s")
    viable = (F.col("sources_covered") >= 0.95 * F.col("_s")) & (F.col("median_edges") >= 20)
    best = F.coalesce(F.max(F.when(viable, F.col("quantile"))).over(Window.partitionBy(by)), F.lit(usual))
    return out.withColumn("recommended", F.col("quantile") == best).drop("_s")


def retained(weighted: DataFrame, summary: DataFrame, by: str = "metric") -> DataFrame:
    """The edges that reach the recommended threshold of their metric."""
    cut = summary.where("recommended").select(by, "quantile", "threshold")  # a row a metric
    return weighted.join(F.broadcast(cut), by).where(F.col("weighted_value") >= F.col("threshold"))


def without_dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    keys = nodes.select("key").distinct()
    return edges.join(keys.withColumnRenamed("key", "source"), "source", "left_semi").join(keys.withColumnRenamed("key", "target"), "target", "left_semi")
