"""Queries that put operators together: layers of an item, feature tables, review, subgraphs, embeddings and design matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import features, fuse, graph, match, quality, vectors, windows
from ..scratch import spread, written
from .catalogue import _CANON, _EDGES, _EVENTS, _INFO, _MAPPED, _NODES, _PANEL, _SCORED, _TIER, _candidates, _information, _left, _mapped, _panels, _right, canonical, edges, events, items, nodes, query, r, read

_SUPPLIED = "s AS (SELECT l_partkey AS item, l_suppkey, n_name AS label, l_returnflag, l_linestatus, l_orderkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"


def _supplied(spark, d):
    s = read(spark, d, "supplier").select("s_suppkey", "s_nationkey").join(read(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("label")), F.col("s_nationkey") == F.col("n_nationkey"))
    return read(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("item"), "l_suppkey", "label", "l_returnflag", "l_linestatus", "l_orderkey")


# Layers of an item


@query(f"""WITH {_SUPPLIED}, n AS (SELECT item, label, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, label) AS rank FROM n),
    x AS (SELECT item, string_agg(label, ' | ' ORDER BY rank) FILTER (rank <= 10) AS top_labels, '{{' || string_agg('"' || label || '":' || n, ',' ORDER BY label) || '}}' AS counts FROM t GROUP BY item)
    SELECT item, n_ids, top_labels, counts FROM x JOIN (SELECT item, count(DISTINCT l_suppkey) AS n_ids FROM s GROUP BY item) USING (item)""")
def chemistry_summary(spark, d):
    """Of each item distinct ids, its ten commonest labels in order, and the counts of all labels."""
    s = _supplied(spark, d)
    return graph.label_summary(s, "item", "label", 10).join(s.groupBy("item").agg(F.countDistinct("l_suppkey").alias("n_ids")), "item").select("item", "n_ids", "top_labels", "counts")


@query(f"""WITH {_SUPPLIED}, e AS (SELECT item, unnest(string_split(l_returnflag || ' | ' || l_linestatus || ' | ', '|')) AS raw FROM s), n AS (SELECT item, trim(raw) AS label, count(*) AS n FROM e WHERE trim(raw) <> '' GROUP BY ALL),
    t AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, label) AS rank FROM n), x AS (SELECT item, string_agg(label, ' | ' ORDER BY rank) FILTER (rank <= 3) AS top_labels, '{{' || string_agg('"' || label || '":' || n, ',' ORDER BY label) || '}}' AS counts FROM t GROUP BY item)
    SELECT item, n_compounds, n_orders, top_labels, counts FROM x JOIN (SELECT item, count(DISTINCT l_suppkey) AS n_compounds, count(DISTINCT l_orderkey) AS n_orders FROM s GROUP BY item) USING (item)""")
def bridge_summary(spark, d):
    """Pipe lists of linked records as labels, with distinct counts."""
    s = _supplied(spark, d).withColumn("labels", F.concat_ws(" | ", "l_returnflag", "l_linestatus", F.lit("")))
    each = s.select("item", F.explode(text.pipe_split(F.col("labels"))).alias("label"))
    sums = s.groupBy("item").agg(F.countDistinct("l_suppkey").alias("n_compounds"), F.countDistinct("l_orderkey").alias("n_orders"))
    return graph.label_summary(each, "item", "label", 3).join(sums, "item").select("item", "n_compounds", "n_orders", "top_labels", "counts")


@query(f"""WITH {_SUPPLIED}, a AS (SELECT item, count(*) AS n_returned, min(label) AS first_label FROM s WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND item % 3 = 0 GROUP BY item), b AS (SELECT item, count(DISTINCT l_suppkey) AS n_open FROM s WHERE l_linestatus = 'O' GROUP BY item)
    SELECT p_partkey AS item, coalesce(n_returned, 0) AS n_returned, coalesce(first_label, '') AS first_label, coalesce(n_open, 0) AS n_open FROM part LEFT JOIN a ON a.item = p_partkey LEFT JOIN b ON b.item = p_partkey""")
def condition_features(spark, d):
    """Features of several layers beside each item, 0 or blank where a layer lacks it."""
    s = _supplied(spark, d)
    a = s.where("l_returnflag = 'R' AND l_linestatus = 'F' AND item % 3 = 0").groupBy("item").agg(F.count(F.lit(1)).alias("n_returned"), F.min("label").alias("first_label"))
    b = s.where("l_linestatus = 'O'").groupBy("item").agg(F.countDistinct("l_suppkey").alias("n_open"))
    return features.joined_tables([read(spark, d, "part").select(F.col("p_partkey").alias("item")), a, b], "item").na.fill(0).na.fill("")


_FLAGS = ("A", "N", "R")


@query("""WITH k AS (SELECT l_partkey AS item, """ + ", ".join(f"sum(l_quantity) FILTER (l_returnflag = '{f}') AS kg_{f.lower()}" for f in _FLAGS) + """ FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY 1)
    SELECT p_partkey AS item, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice END AS price, p_size AS size, """ + ", ".join(f"round(coalesce(kg_{f.lower()}, 0), 2) AS kg_{f.lower()}" for f in _FLAGS) + " FROM part LEFT JOIN k ON item = p_partkey")
def downstream_features(spark, d):
    """Identity, matrix and pivoted graph features; nulls become 0 in the pivoted columns alone."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice")).alias("price"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))
    k = features.pivot_sum(read(spark, d, "lineitem").where("l_partkey % 5 <> 0").withColumnRenamed("l_partkey", "item"), ["item"], "l_returnflag", "l_quantity")
    out = features.feature_table(p.select(*features.columns_but(p, {"brand"})), features.prefixed(k, "kg_", keep=("item",)), "item")
    return out.withColumns({f"kg_{f.lower()}": r(f"kg_{f.lower()}", 2) for f in _FLAGS})


@query("""SELECT p_partkey AS item, p_brand AS label, n_lines, n_suppliers FROM part LEFT JOIN (SELECT l_partkey AS item, count(*) AS n_lines FROM lineitem GROUP BY 1) a ON a.item = p_partkey
    LEFT JOIN (SELECT l_partkey AS item, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY 1) b ON b.item = p_partkey""")
def layer_fold(spark, d):
    """Tables folded onto the first by key; a column that the left has already stays as it is there."""
    l = read(spark, d, "lineitem").withColumnRenamed("l_partkey", "item")  # noqa: E741
    first = read(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("label"))
    return features.joined_tables([first, l.groupBy("item").agg(F.count(F.lit(1)).alias("n_lines"), F.lit("no").alias("label")), l.groupBy("item").agg(F.countDistinct("l_suppkey").alias("n_suppliers"), F.lit(0).alias("n_lines"))], "item")


@query(f"""WITH m AS ({_MAPPED}) SELECT p_partkey AS item, 'price' AS feature, CASE WHEN p_partkey % 2 = 0 THEN round(value + 1e-7, 2) END AS value, CASE WHEN p_partkey % 2 = 0 AND value IS NOT NULL THEN 'panel' ELSE 'missing' END AS method FROM part LEFT JOIN m ON item = p_partkey
    UNION ALL SELECT p_partkey, 'size', p_size, 'panel' FROM part""")
def comparator_provenance(spark, d):
    """A wide panel as long rows with where each value came from."""
    m = _mapped(spark, d).select("item", r(F.col("value") + 1e-7, 2).alias("price"))
    p = read(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_size").cast("double").alias("size")).join(m, "item", "left").withColumn("price", F.when(F.col("item") % 2 == 0, F.col("price")))
    return fuse.long_form(p, ["item"], ["price", "size"]).withColumn("method", F.when(F.col("value").isNotNull(), "panel").otherwise("missing"))


@query("""SELECT c_custkey, c_mktsegment AS kind FROM customer WHERE c_custkey % 6 NOT IN (1, 3)""")
def category_map(spark, d):
    """Rows that are to be kept: yes, maybe, true, 1, or nothing said."""
    c, k = read(spark, d, "customer"), F.col("c_custkey") % 6
    keep = F.when(k == 0, "Yes").when(k == 1, "no").when(k == 2, " maybe").when(k == 3, "0").when(k == 4, "TRUE")
    return fuse.kept(c.select("c_custkey", F.col("c_mktsegment").alias("kind"), keep.alias("keep")), "keep").select("c_custkey", "kind")


@query("""WITH v AS (SELECT lower(p_brand) AS key, p_brand AS label, 'part' AS source, 1 AS seq, p_partkey AS pos FROM part UNION ALL SELECT lower(p_brand), upper(p_brand), 'other', 2, p_partkey FROM part WHERE p_partkey % 2 = 0)
    SELECT key, arg_min(label, {'s': seq, 'p': pos}) AS label, string_agg(DISTINCT source, ' | ' ORDER BY source) AS sources, count(*) AS n FROM v GROUP BY key""")
def entity_catalogue(spark, d):
    """The first attributes of an entity win; its sources and its annotations are counted."""
    p = read(spark, d, "part")
    a = p.select(F.lower("p_brand").alias("key"), F.col("p_brand").alias("label"), F.lit("part").alias("source"), F.lit(1).alias("seq"), F.col("p_partkey").alias("pos"))
    b = p.where("p_partkey % 2 = 0").select(F.lower("p_brand").alias("key"), F.upper("p_brand").alias("label"), F.lit("other").alias("source"), F.lit(2).alias("seq"), F.col("p_partkey").alias("pos"))
    both = a.unionByName(b)
    first = graph.first_nodes(both.select("key", "label", "seq", "pos"), F.struct("seq", "pos")).select("key", "label")
    return first.join(both.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("source")), " | ").alias("sources"), F.count(F.lit(1)).alias("n")), "key")


# Mapping


_SEEDS = f"foods AS (SELECT DISTINCT {_CANON} AS canonical_id, p_name FROM part), rep AS (SELECT {_CANON} AS canonical_id, arg_min(p_name, p_partkey) AS left_id FROM part GROUP BY 1)"


@query(f"""{_SCORED}, {_SEEDS} SELECT canonical_id, rep.left_id, right_id, coalesce(match_score, 0)::DOUBLE AS match_score, CASE WHEN coalesce(match_score, 0) >= 0.72 THEN 'accepted' ELSE 'review' END AS queue
    FROM rep LEFT JOIN (SELECT * FROM c WHERE candidate_rank = 1) c ON c.left_id = rep.left_id""")
def canonical_mapping(spark, d):
    """Canonical items as names to match, their best candidates and what is left for review."""
    rep = fuse.canonical_table(canonical(spark, d)).select("canonical_id", F.col("representative_name").alias("left_id"))
    best = match.with_unmatched(_left(spark, d), _candidates(spark, d)).where("candidate_rank = 1").select("left_id", "right_id", "match_score", "confidence")
    return rep.join(best, "left_id", "left").select("canonical_id", "left_id", "right_id", "match_score", F.when(F.col("confidence").isin("high", "medium"), "accepted").otherwise("review").alias("queue"))


@query(f"""{_SCORED}, b AS (SELECT *, {_TIER} AS confidence FROM c WHERE candidate_rank = 1) SELECT 'item:' || left_id AS source, 'reference:' || right_id AS target, 'maps_to' AS relation, confidence, match_score AS value FROM b""")
def mapping_graph(spark, d):
    """A graph of the best candidates."""
    c = _candidates(spark, d).withColumn("confidence", text.confidence_tier(F.col("match_score")))
    return graph.from_mapping(c).select("source", "target", "relation", "confidence", "value")


@query(f"""{_SCORED}, a AS (SELECT p_name || ' ' || p_type AS right_id, min(p_brand) AS brand, count(*) AS n_items FROM part GROUP BY 1) SELECT left_id, right_id, candidate_rank, brand, n_items FROM c JOIN a USING (right_id) WHERE candidate_rank <= 3""")
def candidate_layer(spark, d):
    """Candidates with the attributes of what they name."""
    a = read(spark, d, "part").groupBy(F.concat_ws(" ", "p_name", "p_type").alias("right_id")).agg(F.min("p_brand").alias("brand"), F.count(F.lit(1)).alias("n_items"))
    return match.candidates(_left(spark, d), _right(spark, d), k=3).join(a, "right_id").select("left_id", "right_id", "candidate_rank", "brand", "n_items")


@query(f"""{_SCORED}, a AS (SELECT p_name || ' ' || p_type AS right_id, max(p_retailprice) AS price FROM part GROUP BY 1) SELECT left_id AS item_name, right_id AS product_name, price::DOUBLE AS energy, NULL::DOUBLE AS grade FROM c JOIN a USING (right_id) WHERE candidate_rank = 1""")
def product_reference(spark, d):
    """The best product of each item; amounts read as numbers where they are, wanted columns that exist, renamed."""
    a = read(spark, d, "part").groupBy(F.concat_ws(" ", "p_name", "p_type").alias("right_id")).agg(F.max("p_retailprice").cast("string").alias("energy_kj"), F.lit("a").alias("grade"))
    best = _candidates(spark, d).where("candidate_rank = 1").join(a, "right_id").withColumns({c: F.col(c).try_cast("double") for c in ("energy_kj", "grade")})
    wanted = [c for c in ("left_id", "right_id", "energy_kj", "grade", "salt") if c in best.columns]
    return best.select(*wanted).withColumnsRenamed({"left_id": "item_name", "right_id": "product_name", "energy_kj": "energy"})


@query(f"""{_SCORED} SELECT p_partkey, right_id, match_score, p_size <= 10 AS reviewed FROM part JOIN c ON left_id = p_name WHERE candidate_rank = 1""")
def all_items_remapped(spark, d):
    """Every item by its name, those reviewed marked."""
    best = _candidates(spark, d).where("candidate_rank = 1").select("left_id", "right_id", "match_score")
    return read(spark, d, "part").join(best, F.col("p_name") == F.col("left_id")).select("p_partkey", "right_id", "match_score", (F.col("p_size") <= 10).alias("reviewed"))


# Identities, registries, prototypes


@query("""WITH x AS (SELECT 'a' AS origin, p_name AS name, p_brand AS code FROM part UNION ALL SELECT 'b', p_name, CASE WHEN p_partkey % 10 = 0 THEN 'other' ELSE p_brand END FROM part WHERE p_partkey % 2 = 0), u AS (SELECT DISTINCT name, code FROM x)
    SELECT name, count(*) AS n_codes, count(*) > 1 AS conflict, min(code) AS code FROM u GROUP BY name""")
def identity_conflicts(spark, d):
    """The distinct identities of all sources, and names with several codes."""
    p = read(spark, d, "part")
    a = p.select(F.col("p_name").alias("name"), F.col("p_brand").alias("code"))
    b = p.where("p_partkey % 2 = 0").select(F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 10 == 0, "other").otherwise(F.col("p_brand")).alias("code"))
    return fuse.identities([a, b], "name", "code")


@query("""WITH x AS (SELECT p_partkey AS item, 'brand' AS descriptor, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'form', CASE p_size % 3 WHEN 0 THEN 'solid' WHEN 1 THEN 'liquid' END FROM part)
    SELECT item, descriptor, coalesce(value, 'unknown') AS value, value IS NOT NULL AS known FROM x""")
def descriptor_frame(spark, d):
    """Descriptors in long form, known or not; a value outside its domain would be listed (there is none)."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("brand"), F.when(F.col("p_size") % 3 == 0, "solid").when(F.col("p_size") % 3 == 1, "liquid").alias("form"))
    outside = quality.outside_domain(p, "form", spark.createDataFrame([("solid",), ("liquid",), ("gas",)], "value string")).select("item")
    rows = fuse.long_form(p, ["item"], ["brand", "form"], "descriptor").withColumn("known", F.col("value").isNotNull()).withColumn("value", F.coalesce("value", F.lit("unknown")))
    return rows.join(outside, "item", "left_anti")


@query(f"""{_PANEL}, s AS (SELECT feature, count(value) AS n_known, count(*) AS n_items, CASE WHEN count(value) = count(*) THEN 'included' ELSE 'completion_pending' END AS status FROM a GROUP BY feature)
    SELECT status, count(*) AS n_features, sum(n_known)::BIGINT AS known, sum(n_items - n_known)::BIGINT AS unresolved FROM s GROUP BY status""")
def registry_splits(spark, d):
    """Features by status, with known and unresolved cells."""
    s = fuse.registry_status(_panels(spark, d)[0])
    return s.groupBy("status").agg(F.count(F.lit(1)).alias("n_features"), F.sum("n_known").alias("known"), F.sum(F.col("n_items") - F.col("n_known")).alias("unresolved"))


@query(f"""{_PANEL}, w AS (SELECT item, max(value) FILTER (feature = 'price') AS price, max(value) FILTER (feature = 'size') AS size FROM a GROUP BY item)
    SELECT item, 'both' AS feature, round(price + size, 4) AS value, 'price+size' AS lineage FROM w UNION ALL SELECT item, 'per_size', round(CASE WHEN size <> 0 THEN price / size END, 4), 'price/size' FROM w""")
def derived_features(spark, d):
    """Sums and ratios with what they were made of; a null or zero part makes null."""
    return fuse.derived(_panels(spark, d)[0], {"both": ["price", "size"]}, {"per_size": ("price", "size")}).withColumn("value", r("value"))


@query(f"""{_PANEL} SELECT feature, count(*) AS n, count(*) FILTER ((value IS NULL) <> (item % 3 = 0 AND item % 2 = 0)) AS n_conflicts FROM a GROUP BY feature""")
def provenance_conflicts(spark, d):
    """Cells whose value and provenance do not agree."""
    a = _panels(spark, d)[0]
    k = F.col("item")
    return quality.provenance_agrees(a, a.select("item", "feature", F.when((k % 3 == 0) & (k % 2 == 0), "missing").otherwise("panel").alias("method")), ["item", "feature"])


@query(f"""{_PANEL}, j AS (SELECT feature, a.value AS x, b.value AS y FROM a JOIN b USING (item, feature) WHERE a.value IS NOT NULL AND b.value IS NOT NULL)
    SELECT round(avg((abs(x - y) <= 1e-9 + 1e-9 * abs(y))::INT) * 100, 4) AS exact_pct, count(*) AS n FROM j""")
def overall_agreement(spark, d):
    """The exact share of all features, weighted by their cells."""
    a, b = _panels(spark, d)
    return quality.overall(quality.panel_agreement(a, b, ["item", "feature"], "feature"), "exact_pct", "n").withColumn("exact_pct", r("exact_pct"))


@query(f"""{_PANEL}, w AS (SELECT item, count(value) FILTER (feature = 'price') + count(value) FILTER (feature = 'size') AS n FROM a GROUP BY item)
    SELECT count(*) AS n_rows, 2::BIGINT AS n_columns, round(quantile_cont(n / 2.0, 0.5), 4) AS median_present FROM w""")
def scenario_matrix_summary(spark, d):
    """A39."""
    wide = features.pivot_mean(_panels(spark, d)[0], ["item"], "feature", "value", ["price", "size"])
    return quality.matrix_summary(wide, ["price", "size"]).withColumn("median_present", r("median_present"))


@query("""WITH x AS (SELECT p_partkey, p_size % 7 <> 0 AS comparable, p_size % 5 = 0 AS same_name, p_size % 3 = 0 AS same_source, CASE WHEN p_size > 40 THEN 'high' WHEN p_size > 25 THEN 'medium' WHEN p_size > 10 THEN 'low' ELSE 'review' END AS confidence,
        CASE WHEN p_partkey % 2 = 0 THEN 0.99 ELSE 0.5 END AS similarity, CASE WHEN p_partkey % 3 = 0 THEN 0.8 ELSE 0.1 END AS other_score FROM part),
    s AS (SELECT *, CASE WHEN NOT comparable THEN 'not_comparable' WHEN same_name THEN 'same_source_and_similar_name' WHEN same_source THEN 'same_source_different_item' ELSE 'different_source' END AS agreement_state FROM x)
    SELECT p_partkey, agreement_state, CASE WHEN agreement_state = 'same_source_and_similar_name' THEN 'agreement' WHEN confidence IN ('high', 'medium') AND similarity >= 0.98 THEN 'both_plausible_review'
        WHEN confidence IN ('low', 'review') AND other_score >= 0.72 THEN 'other_may_be_better_review' WHEN confidence IN ('high', 'medium') THEN 'ours_may_be_better_review' ELSE 'ambiguous_review' END AS review_priority FROM s""")
def review_priorities(spark, d):
    """P20: agreement of two donors, and what to review first."""
    size, k = F.col("p_size"), F.col("p_partkey")
    x = read(spark, d, "part").select(
        "p_partkey", (size % 7 != 0).alias("comparable"), (size % 5 == 0).alias("same_name"), (size % 3 == 0).alias("same_source"), F.when(size > 40, "high").when(size > 25, "medium").when(size > 10, "low").otherwise("review").alias("confidence"),
        F.when(k % 2 == 0, 0.99).otherwise(0.5).alias("similarity"), F.when(k % 3 == 0, 0.8).otherwise(0.1).alias("other_score"))
    return fuse.agreement(x).select("p_partkey", "agreement_state", "review_priority")


# Review


@query(f"""{_SCORED}, b AS (SELECT left_id, match_score, {_TIER} AS confidence FROM c WHERE candidate_rank = 1), u AS (SELECT p_name AS left_id, CASE WHEN max(p_size) > 30 THEN 'tier_1' ELSE 'tier_2' END AS tier FROM part GROUP BY 1), done AS (SELECT DISTINCT p_name AS left_id FROM part WHERE p_partkey % 4 = 0)
    SELECT tier, confidence, count(*) AS n, round(avg(match_score) + 1e-7, 4) AS mean_score FROM b JOIN u USING (left_id) WHERE left_id NOT IN (SELECT left_id FROM done) AND match_score BETWEEN 0.2 AND 1 GROUP BY ALL""")
def remaining_queue(spark, d):
    """The queue without what is decided, by score, and its numbers by tier."""
    p = read(spark, d, "part")
    b = _candidates(spark, d).where("candidate_rank = 1").withColumn("confidence", text.confidence_tier(F.col("match_score")))
    u = p.groupBy(F.col("p_name").alias("left_id")).agg(F.when(F.max("p_size") > 30, "tier_1").otherwise("tier_2").alias("tier"))
    done = p.where("p_partkey % 4 = 0").select(F.col("p_name").alias("left_id")).distinct()
    left = features.between(b.join(done, "left_id", "left_anti"), "match_score", 1.0, 0.2).join(u, "left_id")
    return left.groupBy("tier", "confidence").agg(F.count(F.lit(1)).alias("n"), r(F.avg("match_score") + 1e-7).alias("mean_score"))


@query(f"""{_SCORED}, one AS (SELECT min(id) AS id FROM lt) SELECT left_id, right_id, match_score, candidate_rank, 2 AS attempt FROM c WHERE left_id IN (SELECT id FROM one)""")
def remapped_item(spark, d):
    """One item mapped anew, as its next attempt."""
    names = _left(spark, d)
    one = names.join(F.broadcast(names.agg(F.min("id").alias("id"))), "id", "left_semi")  # one row
    log = one.select(F.col("id").alias("left_id"), F.lit(1).alias("attempt"))
    found = match.candidates(one, _right(spark, d)).select("left_id", "right_id", "match_score", "candidate_rank")
    return found.join(windows.next_attempt(log, ["left_id"], "attempt").withColumnRenamed("next_attempt", "attempt"), "left_id")


@query(f"""{_SCORED}, b AS (SELECT left_id, right_id FROM c WHERE candidate_rank = 1)
    SELECT 'item:' || left_id AS key, CASE WHEN length(left_id) % 2 = 0 THEN 'mapped' ELSE 'open' END AS state, CASE WHEN length(left_id) % 2 = 0 THEN right_id ELSE left_id END AS label FROM b""")
def saved_reviews(spark, d):
    """Decisions upserted into the graph's nodes."""
    best = _candidates(spark, d).where("candidate_rank = 1")
    old = best.select(F.concat(F.lit("item:"), "left_id").alias("key"), F.lit("open").alias("state"), F.col("left_id").alias("label"), F.lit(1).alias("seq"))
    new = best.where("length(left_id) % 2 = 0").select(F.concat(F.lit("item:"), "left_id").alias("key"), F.lit("mapped").alias("state"), F.col("right_id").alias("label"), F.lit(2).alias("seq"))
    return graph.upsert_nodes(old.unionByName(new), "key", "seq")


# Subgraphs


@query("""WITH w AS (SELECT * FROM (VALUES ('steel', 1), ('zzz', 2), ('brass', 3), ('a', 4)) v(word, i)), n AS (SELECT l_partkey AS item, count(*) AS logs FROM lineitem GROUP BY 1),
    h AS (SELECT word, i, p_partkey AS item, row_number() OVER (PARTITION BY word ORDER BY coalesce(logs, 0) DESC, p_partkey) AS rn FROM w JOIN part ON contains(lower(p_name || ' ' || p_type), word) LEFT JOIN n ON n.item = p_partkey)
    SELECT item, min(i) AS i FROM h WHERE rn = 1 GROUP BY item""")
def representative_items(spark, d):
    """For each word the most logged item that names it, each item once."""
    words = spark.createDataFrame([("steel", 1), ("zzz", 2), ("brass", 3), ("a", 4)], "word string, i int")
    n = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg(F.count(F.lit(1)).alias("logs"))
    its = read(spark, d, "part").select(F.col("p_partkey").alias("item"), F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("said")).join(n, "item", "left").withColumn("logs", F.coalesce("logs", F.lit(0)))
    return graph.representatives(its, words, "said", "logs")


@query("""SELECT p_partkey AS item, p_name AS name FROM part ORDER BY CASE WHEN lower(p_name) LIKE '%qq none%' THEN 0 WHEN lower(p_name) LIKE '%steel%' THEN 1 WHEN lower(p_name) LIKE '%a%' THEN 2 ELSE 3 END, p_partkey LIMIT 1""")
def chosen_seed(spark, d):
    """The item that a query names, else the first that a preferred term names."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("name"))
    return graph.seed(p, "name", "qq none", ["steel", "a"], "item")


_FOCUS = "SELECT source, target, relation FROM (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY target) AS rn FROM edges WHERE source = 'part:1') WHERE rn <= 10"


@query(f"""WITH {_EDGES}, {_NODES}, f AS ({_FOCUS}), pr AS (SELECT source, target, relation FROM (SELECT *, row_number() OVER (ORDER BY CASE split_part(target, ':', 1) WHEN 'brand' THEN 0 WHEN 'canonical' THEN 1 ELSE 999 END, target) AS rn FROM edges WHERE source = 'part:1') WHERE rn <= 3), e AS (SELECT * FROM f UNION SELECT * FROM pr)
    SELECT key, kind, substr(label, 1, 90) AS label, (SELECT count(*) FROM e) AS n_edges FROM nodes WHERE key IN (SELECT source FROM e UNION SELECT target FROM e)""")
def focused_subgraph(spark, d):
    """The edges of one item, ten a relation and the first three by priority, and the nodes they touch."""
    e = edges(spark, d).where("source = 'part:1'").select("source", "target", "relation")
    some = windows.top_k(e, ["relation"], [F.asc("target")], 10).drop("rank")
    first = windows.by_priority(e.withColumn("kind", F.substring_index("target", ":", 1)), ["source"], "kind", {"brand": 0, "canonical": 1}, "target", 3).drop("kind")
    both = some.unionByName(first).distinct()
    n = both.agg(F.count(F.lit(1)).alias("n_edges"))
    return graph.induced(nodes(spark, d), both).withColumn("label", F.substring("label", 1, 90)).crossJoin(F.broadcast(n))  # one row


@query(f"""WITH {_EDGES}, seeds AS (SELECT 'part:' || p_partkey AS source FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS rn FROM part) WHERE rn <= 180)
    SELECT source, target, relation FROM (SELECT *, row_number() OVER (PARTITION BY source, relation ORDER BY target) AS rn FROM edges JOIN seeds USING (source)) WHERE rn <= 5""")
def sampled_subgraph(spark, d):
    """Five edges a relation of the first 180 items."""
    first = read(spark, d, "part").orderBy("p_partkey").limit(180).select(text.node_key("part", F.col("p_partkey")).alias("source"))  # the feature is the sample
    return windows.top_k(edges(spark, d).join(F.broadcast(first), "source", "left_semi"), ["source", "relation"], [F.asc("target")], 5).select("source", "target", "relation")


@query(f"""WITH {_EDGES}, c AS (SELECT source, target, relation, value FROM (SELECT *, row_number() OVER (PARTITION BY source, relation ORDER BY coalesce(value, 0) DESC, target) AS rn FROM edges WHERE relation IN ('supplied_by', 'has_brand')) WHERE rn <= 4),
    s AS (SELECT 'part:' || l_partkey AS source, 'supplier:' || l_suppkey AS target, CASE WHEN l_returnflag = 'R' THEN 'negative' ELSE 'positive' END AS relation, count(*)::DOUBLE AS value FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL),
    m AS (SELECT 'brand:' || p_brand AS source, 'kind:' || lower(p_brand) AS target, 'same_name' AS relation, 1.0::DOUBLE AS value FROM part)
    SELECT DISTINCT source, target, relation, round(value, 2) AS value FROM (SELECT * FROM c UNION ALL SELECT * FROM s UNION ALL SELECT * FROM m)""")
def display_graph(spark, d):
    """Capped edges of each item, signed edges, and edges between nodes of one name, each once."""
    # The three kinds have relations of their own, so each is made distinct where its sources lie.
    n = read(spark, d, "lineitem").count() + 2 * read(spark, d, "part").count()
    e = spread(edges(spark, d).where("relation IN ('supplied_by', 'has_brand')"), n, "source")
    capped = windows.top_k(e, ["source", "relation"], [F.desc(F.coalesce("value", F.lit(0.0))), F.asc("target")], 4).drop("rank")
    l = spread(read(spark, d, "lineitem").where("l_linestatus = 'F'").select("l_partkey", "l_suppkey", "l_returnflag"), n, "l_partkey", "l_suppkey")  # noqa: E741
    signs = l.groupBy("l_partkey", "l_suppkey", F.when(F.col("l_returnflag") == "R", "negative").otherwise("positive").alias("relation")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    signed = signs.select(text.node_key("part", F.col("l_partkey")).alias("source"), text.node_key("supplier", F.col("l_suppkey")).alias("target"), "relation", "value")
    b = read(spark, d, "part").select("p_brand").distinct()
    left = b.select(text.node_key("brand", F.col("p_brand")).alias("id"), text.normalize(F.col("p_brand"), True).alias("norm"))
    right = b.select(F.concat(F.lit("kind:"), F.lower("p_brand")).alias("id"), text.normalize(F.lower("p_brand"), True).alias("norm"))
    named = match.exact_links(left, right).select(F.col("left_id").alias("source"), F.col("right_id").alias("target"), F.lit("same_name").alias("relation"), F.lit(1.0).alias("value"))
    rounded = lambda df: df.withColumn("value", r("value", 2))
    return graph.union_edges(rounded(capped).distinct(), rounded(signed), rounded(named).distinct())


@query(f"""{_INFO}, w AS (SELECT source, target, relation, round(weighted_value, 6) AS x FROM weighted WHERE source IN ('part:1', 'part:2', 'part:3'))
    SELECT 'base' AS scenario, 'idf_entropy' AS metric, source, target, relation, x AS weighted_value, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY x DESC, relation, target)::INTEGER AS rank FROM w) WHERE rank <= 3""")
def signature_rows(spark, d):
    """The heaviest edges of chosen items, by scenario and metric."""
    chosen = spark.createDataFrame([("part:1",), ("part:2",), ("part:3",)], "source string")
    e = written(edges(spark, d))
    some = e.join(F.broadcast(chosen), "source", "left_semi")  # targets are weighed by all edges, the chosen items' edges alone are ranked
    w = graph.weighted_edges(some, _information(spark, d, e), "idf_entropy").withColumn("weighted_value", r("weighted_value", 6))
    return graph.signatures(w, 3).select(F.lit("base").alias("scenario"), F.lit("idf_entropy").alias("metric"), "source", "target", "relation", "weighted_value", "rank")


@query(f"""WITH {_NODES}, old AS (SELECT key, kind, row_number() OVER (ORDER BY kind, key) - 1 AS no FROM nodes WHERE kind <> 'supplier'), o AS (SELECT count(*) AS n FROM old), new AS (SELECT key, kind, row_number() OVER (ORDER BY kind, key) - 1 AS no FROM nodes WHERE kind = 'supplier'),
    u AS (SELECT key, kind, no FROM old UNION ALL SELECT key, kind, no + n FROM new, o) SELECT key, kind, no::BIGINT AS no, row_number() OVER (PARTITION BY kind ORDER BY no) - 1 AS place FROM u""")
def node_union(spark, d):
    """Nodes that are new are numbered behind those there were; each has its place within its kind."""
    n = nodes(spark, d).select("key", "kind")
    old = windows.numbered(n.where("kind <> 'supplier'"), ["kind", "key"], "no")
    size = old.count()
    new = windows.numbered(n.join(old.select("key"), "key", "left_anti"), ["kind", "key"], "no", size)
    return windows.places(old.unionByName(new), "kind", "no", "place")


# Participants


@query("""WITH g AS (SELECT o_custkey AS k, o_totalprice AS v FROM orders), m AS (SELECT c_custkey AS old, 'P' || c_custkey AS new FROM customer WHERE c_custkey % 10 <> 0)
    SELECT new AS participant, count(*) AS n FROM g LEFT JOIN m ON k = old GROUP BY 1""")
def participant_lookup(spark, d):
    """Ids replaced, as the lookup knows most of them."""
    o = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("participant"), "o_totalprice")
    lookup = read(spark, d, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").cast("string").alias("old"), F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("new"))
    return features.remapped(o, "participant", lookup).groupBy("participant").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH n AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY ALL), t AS (SELECT user_id, sum(v) AS total FROM n WHERE v > 0 GROUP BY 1), p AS (SELECT user_id, v / total AS p FROM n JOIN t USING (user_id) WHERE v > 0),
    a AS (SELECT user_id, round(-sum(p * ln(p)), 6) AS shannon, count(*) AS richness FROM p GROUP BY 1), b AS (SELECT user_id, round(sum(v) + 1e-7, 4) AS click_like FROM n WHERE regexp_matches(event_type, '(?i)cl|pu') GROUP BY 1)
    SELECT user_id, shannon, richness, click_like FROM a FULL JOIN b USING (user_id)""")
def abundance_summary(spark, d):
    """A long table made wide, its diversity and the sum of matching columns, side by side."""
    e = read(spark, d, "events")
    kinds = features.values_of(e, "event_type")
    wide = features.shaped(e, "user_id", ("event_type", "value"), kinds)
    long = fuse.long_form(wide, ["user_id"], kinds, "event_type", "v").where("v > 0")
    share = long.join(long.groupBy("user_id").agg(F.sum("v").alias("t")), "user_id").withColumn("p", F.col("v") / F.col("t"))
    a = share.groupBy("user_id").agg(r(-F.sum(F.col("p") * F.ln("p")), 6).alias("shannon"), F.count(F.lit(1)).alias("richness"))
    hit = features.columns_with(wide.select(*kinds), ["cl", "pu"])
    parts = F.array(*(F.col(c) for c in hit))
    b = wide.where(F.exists(parts, lambda x: x.isNotNull())).select("user_id", r(F.aggregate(parts, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))) + 1e-7).alias("click_like"))
    return a.join(b, "user_id", "full")


@query(f"""WITH e AS ({_EVENTS}), x AS (SELECT participant, round(sum(p_retailprice * grams / 100), 4) AS price, round(sum(p_size * grams / 100), 4) AS size FROM e JOIN part ON item = p_partkey GROUP BY participant)
    SELECT participant, size AS second, 2 AS n_features, CASE WHEN participant % 10 < 7 THEN 'train' ELSE 'test' END AS split FROM x JOIN customer ON c_custkey = participant WHERE c_acctbal IS NOT NULL""")
def participant_artifact(spark, d):
    """One array a participant that has a target, with its split."""
    from ..operators import learn

    x = features.exposure(events(spark, d), items(spark, d), ["price", "size"], ["participant"])
    y = read(spark, d, "customer").select(F.col("c_custkey").alias("participant"), F.col("c_acctbal").alias("y"))
    rows = learn.aligned(x, y, ["participant"], "y").withColumns({"price": r("price"), "size": r("size")})
    splits = y.select("participant", F.when(F.col("participant") % 10 < 7, "train").otherwise("test").alias("split"))
    return features.participant_vectors(rows, "participant", ["price", "size"]).join(splits, "participant", "left").select("participant", F.element_at("embedding", 2).alias("second"), F.size("embedding").alias("n_features"), "split")


@query("""WITH q AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), b AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, q.label AS query_group, b.label AS donor, round(list_cosine_similarity(q.v, b.v), 9) AS cosine, b.vec_id AS base_id FROM q, b WHERE q.vec_id <> b.vec_id AND q.label <> b.label),
    t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, base_id) AS rn FROM s), v AS (SELECT query_group, donor, sum(query_id % 7 + 1) AS votes, count(*) AS n, avg(cosine) AS similarity FROM t WHERE rn = 1 GROUP BY ALL)
    SELECT query_group::VARCHAR AS query_group, donor::VARCHAR AS donor, votes::BIGINT AS votes, n FROM (SELECT *, row_number() OVER (PARTITION BY query_group ORDER BY votes DESC, n DESC, similarity DESC, donor::VARCHAR) AS rn FROM v) WHERE rn = 1""")
def donor_vote(spark, d):
    """Each group's donor with most weight, then number, then similarity; every vector votes."""
    e = read(spark, d, "embeddings")
    near = vectors.nearest(e, e, 1, group="label", skip_same_group=True)
    near = near.select("query_group", F.col("base_group").alias("donor"), "cosine", (F.col("query_id") % 7 + 1).alias("weight"))
    return vectors.donor_votes(near, e.select(F.col("label").cast("string").alias("donor")).distinct(), "weight").select("query_group", "donor", "votes", "n")


# Embeddings and design matrices


def _described(spark, d):
    s = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg(F.avg("l_quantity").alias("mean_quantity"), F.count(F.lit(1)).alias("n_lines"), F.countDistinct("l_suppkey").alias("n_suppliers"))
    p = read(spark, d, "part").select(F.col("p_partkey").alias("item"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice")).alias("price"), F.col("p_size").alias("size"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return p.join(s, "item", "left")


_BLOCKS = {"amounts": ["price"], "form": ["size"], "use": ["mean_quantity", "n_lines"], "sources": ["n_suppliers"]}
_ALL = [c for cs in _BLOCKS.values() for c in cs]


def _scaled(c: str, width: int) -> str:
    return f"(SELECT item, (f - avg(f) OVER ()) / coalesce(nullif(stddev_samp(f) OVER (), 0), 1) / sqrt({width}) AS {c} FROM (SELECT item, ln(1 + greatest(coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM p), 0), 0)) AS f FROM p))"


_VECTOR_SQL = f"""WITH s AS (SELECT l_partkey AS item, avg(l_quantity) AS mean_quantity, count(*) AS n_lines, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY 1),
    p AS (SELECT p_partkey AS item, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice END AS price, p_size AS size, p_name || ' ' || p_type AS text, mean_quantity, n_lines, n_suppliers FROM part LEFT JOIN s ON s.item = p_partkey),
    num AS (SELECT item, unnest([{", ".join(_ALL)}]) AS value, unnest(range({len(_ALL)})) AS dim FROM {" JOIN ".join(f"{_scaled(c, len(cs))} t_{c}" + (" USING (item)" if (b, i) != ("amounts", 0) else "") for b, cs in _BLOCKS.items() for i, c in enumerate(cs))}),
    t AS (SELECT item, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_-]+'), lambda x: length(x) >= 3)) AS token FROM p), c AS (SELECT item, token, count(*) AS n FROM t GROUP BY ALL),
    v AS (SELECT item, (('0x' || right(md5(token), 7))::BIGINT % 64) AS dim, sum(CASE WHEN ('0x' || right(md5('sign:' || token), 1))::INT % 2 = 1 THEN -1 ELSE 1 END * ln(1 + n)) AS v FROM c GROUP BY ALL),
    g AS (SELECT item, dim, coalesce(v, 0) AS v FROM (SELECT item, unnest(range(64)) AS dim FROM p) LEFT JOIN v USING (item, dim)), st AS (SELECT dim, avg(v) AS m, coalesce(nullif(stddev_pop(v), 0), 1) AS sd FROM g GROUP BY dim),
    vec AS (SELECT item, dim, value FROM num UNION ALL SELECT item, dim + {len(_ALL)}, (v - m) / sd / 8 FROM g JOIN st USING (dim))"""


@query(f"{_VECTOR_SQL} SELECT item, dim::INTEGER AS dim, round(value, 4) AS value FROM vec")
def multi_block_vectors(spark, d):
    """Four numeric blocks and a hashed text block, one after another."""
    v, _ = vectors.blocks_of(_described(spark, d), "item", _BLOCKS, "text")
    return v.select("item", F.posexplode("vector").alias("dim", "value")).withColumn("value", r("value"))


@query(f"{_VECTOR_SQL} SELECT item, count(*)::INTEGER AS n_dims, round(sqrt(sum(value * value)), 3) AS length FROM vec GROUP BY item")
def embedding_export(spark, d):
    """Vectors as an array column, written and read."""
    v, dims = vectors.blocks_of(_described(spark, d), "item", _BLOCKS, "text")
    back = written(v)
    assert sum(n for _, n in dims) == len(_ALL) + 64
    return back.select("item", F.size("vector").alias("n_dims"), r(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)), 3).alias("length"))


_SHARED = ["price", "size"]


@query("""WITH a AS (SELECT p_partkey AS item, p_retailprice AS price, p_size AS size FROM part), b AS (SELECT l_partkey AS item, avg(l_extendedprice) AS price, avg(l_quantity) AS size FROM lineitem GROUP BY 1),
    u AS (SELECT 'a' AS side, item, ln(1 + greatest(coalesce(price, 0), 0)) AS p, ln(1 + greatest(coalesce(size, 0), 0)) AS s FROM a UNION ALL SELECT 'b', item, ln(1 + price), ln(1 + size) FROM b),
    m AS (SELECT avg(p) AS mp, stddev_pop(p) AS sp, avg(s) AS ms, stddev_pop(s) AS ss FROM u), z AS (SELECT side, item, (p - mp) / sp AS p, (s - ms) / ss AS s FROM u, m)
    SELECT side, item, round(p / greatest(sqrt(p * p + s * s), 1e-12), 4) AS price, round(s / greatest(sqrt(p * p + s * s), 1e-12), 4) AS size FROM z""")
def shared_log_matrix(spark, d):
    """Two tables as log vectors, scaled by one mean and deviation of both, of length 1."""
    a = read(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))
    b = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg(F.avg("l_extendedprice").alias("price"), F.avg("l_quantity").alias("size"))
    x, y = vectors.shared_log_matrices(a, b, "item", _SHARED)
    both = x.withColumn("side", F.lit("a")).unionByName(y.withColumn("side", F.lit("b")))
    return both.select("side", "item", *(r(F.element_at("vector", i + 1)).alias(c) for i, c in enumerate(_SHARED)))


@query("SELECT p_partkey AS item, sha256(p_name) AS stamp, p_partkey % 2 = 0 AS first_run, 3 AS n_dims FROM part")
def resumed_encoding(spark, d):
    """Texts are encoded once; a second run encodes only those that are new or have changed."""
    from ..scratch import work_dir

    p = read(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("text"))
    path = f"{work_dir(spark)}/encoded"
    vector = lambda run: lambda t: F.array(F.length(t).cast("double"), F.crc32(t.cast("binary")).cast("double"), F.lit(float(run)))
    vectors.encoded_once(p.where("item % 2 = 0"), path, "item", "text", vector(1))
    out = vectors.encoded_once(p, path, "item", "text", vector(2))
    return out.select("item", "stamp", (F.element_at("vector", 3) == 1).alias("first_run"), F.size("vector").alias("n_dims"))


_DESIGN = f"e AS ({_EVENTS})"


@query(f"""WITH {_DESIGN}, w AS (SELECT participant, strftime(ts, '%Y') AS window_id, item, grams FROM e) SELECT participant, window_id, round(sum(p_retailprice * grams / 100), 3) AS price, round(sum(p_size * grams / 100), 3) AS size FROM w JOIN part ON item = p_partkey GROUP BY ALL""")
def design_matrix_enriched(spark, d):
    """Doses of items' features, by participant and year."""
    out = features.design_matrix("enriched", events(spark, d), "year", items=items(spark, d), columns=["price", "size"])
    return out.select("participant", "window_id", *(r(c, 3).alias(c) for c in ("price", "size")))


@query(f"""WITH {_DESIGN}, k AS (SELECT l_partkey AS item, coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0) AS a, coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0) AS n, coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS r FROM lineitem GROUP BY 1)
    SELECT participant, 'all' AS window_id, round(coalesce(sum(a * grams) / nullif(sum(grams), 0), 0), 4) AS a, round(coalesce(sum(n * grams) / nullif(sum(grams), 0), 0), 4) AS n, round(coalesce(sum(r * grams) / nullif(sum(grams), 0), 0), 4) AS r FROM e JOIN k USING (item) GROUP BY participant""")
def design_matrix_graph(spark, d):
    """Graph features of items, as means weighted by grams."""
    k = features.pivot_sum(read(spark, d, "lineitem").withColumnRenamed("l_partkey", "item"), ["item"], "l_returnflag", "l_quantity")
    out = features.design_matrix("kg", events(spark, d), "participant", items=k, columns=["a", "n", "r"])
    return out.select("participant", "window_id", *(r(c).alias(c) for c in ("a", "n", "r")))


@query(f"""WITH {_DESIGN}, n AS (SELECT count(*) AS n FROM embeddings), g AS (SELECT participant, item % n AS vec, sum(grams) AS g FROM e, n GROUP BY ALL), u AS (SELECT participant, g, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM g JOIN embeddings ON vec_id = vec),
    m AS (SELECT participant, dim, sum(v * g) / sum(g) AS x FROM u GROUP BY ALL) SELECT participant, 'all' AS window_id, count(*)::INTEGER AS n_dims, round(max(x) FILTER (dim = 0), 5) AS first FROM m GROUP BY participant""")
def design_matrix_embedding(spark, d):
    """Mean vectors of what participants logged, weighted by grams, as arrays."""
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("item"), "embedding")
    n = v.agg(F.count(F.lit(1)).alias("n"))
    e = events(spark, d).crossJoin(F.broadcast(n)).withColumn("item", F.col("item") % F.col("n")).drop("n")  # one row
    out = features.design_matrix("embedding", e, "participant", items=v)
    return out.select("participant", "window_id", F.size("embedding").alias("n_dims"), r(F.element_at("embedding", 1), 5).alias("first"))
