"""Queries of functions on columns: names, lists, labels, numbers, predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric, text
from ..operators import features, vectors
from ..scratch import written
from .catalogue import _CANON, _EDGES, _INFO, _weighted, edges, query, r, read


@query("SELECT doc_id, md5(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_%]+', ' ', 'g'))) AS digest FROM documents")
def unicode_names(spark, d):
    """whole texts, letters of all scripts kept."""
    return read(spark, d, "documents").select("doc_id", F.md5(text.normalize_unicode(F.col("text")).cast("binary")).alias("digest"))


@query("SELECT p_partkey, regexp_replace(lower(p_type), '[_\\s]+', '', 'g') AS loose, lower(p_name) AS folded FROM part")
def loose_names(spark, d):
    """Names that differ in case, underscores and spaces alone."""
    return read(spark, d, "part").select("p_partkey", text.loose_name(F.col("p_type")).alias("loose"), text.casefolded(F.col("p_name")).alias("folded"))


@query("SELECT p_partkey, lower(p_brand) AS taxon, regexp_matches(p_name, '(?i)an|ge') AS hit FROM part")
def taxon_names(spark, d):
    """Rank prefixes go; patterns are found in any letter case."""
    p = read(spark, d, "part")
    return p.select("p_partkey", text.strip_taxon(F.concat(F.lit("g__"), F.lower("p_brand"))).alias("taxon"), text.matches_any(F.col("p_name"), ["an", "GE"]).alias("hit"))


@query("""WITH l AS (SELECT p_partkey, list_filter([p_brand, p_type, upper(p_brand), '', p_name, p_container][1:1 + p_size % 7], lambda x: x <> '') AS l FROM (SELECT *, p_type || '!' AS p_container FROM part)),
    u AS (SELECT p_partkey, list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i) AS l FROM l), c AS (SELECT p_partkey, l[1:5] AS l FROM u)
    SELECT p_partkey, CASE len(l) WHEN 0 THEN 'unavailable' WHEN 1 THEN l[1] WHEN 2 THEN l[1] || ' and ' || l[2] ELSE array_to_string(l[1:len(l) - 1], ', ') || ', and ' || l[len(l)] END AS said FROM c""")
def english_lists(spark, d):
    """Parts that differ but for case, joined as in a sentence."""
    p = read(spark, d, "part")
    parts = F.slice(F.array("p_brand", "p_type", F.upper("p_brand"), F.lit(""), "p_name", F.concat("p_type", F.lit("!"))), F.lit(1), F.lit(1) + F.col("p_size") % 7)
    return p.select("p_partkey", text.english_list(F.filter(parts, lambda x: x != "")).alias("said"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN c_name WHEN 2 THEN c_name || ' ' || c_mktsegment WHEN 3 THEN '' ELSE c_mktsegment END AS label, 'segment:' || lower(c_mktsegment) AS key,
    'customer:' || c_custkey AS node FROM customer""")
def clean_labels(spark, d):
    """Missing labels are empty, keys do not depend on how a label is written."""
    c, k = read(spark, d, "customer"), F.col("c_custkey") % 5
    raw = F.when(k == 0, " NaN ").when(k == 1, F.concat(F.lit("  "), "c_name")).when(k == 2, F.concat("c_name", F.lit(" \n "), "c_mktsegment")).when(k == 3, "None").otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", text.clean_label(raw).alias("label"), text.label_key("segment", F.concat(F.lit(" "), "c_mktsegment")).alias("key"), text.node_key("customer", F.col("c_custkey").cast("double").cast("decimal(20,1)")).alias("node"))


_SHORT = "regexp_replace(regexp_replace({0}, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"


@query(f"""WITH x AS (SELECT p_partkey, p_size / 7.0::DOUBLE * CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 13 ELSE 170 END AS x FROM part)
    SELECT p_partkey, CASE WHEN x >= 100 THEN printf('%.0f', x) WHEN x >= 10 THEN {_SHORT.format("printf('%.1f', x)")} WHEN x >= 1 THEN {_SHORT.format("printf('%.2f', x)")} ELSE {_SHORT.format("printf('%.3f', x)")} END AS said FROM x""")
def adaptive_numbers(spark, d):
    """F15."""
    p = read(spark, d, "part")
    k = F.col("p_partkey") % 3
    return p.select("p_partkey", text.adaptive_number(F.col("p_size") / F.lit(7.0) * F.when(k == 0, 1).when(k == 1, 13).otherwise(170)).alias("said"))


_UNITS = {"Energy": "kcal", "Protein": "g", "Caffeine": "mg", "Vitamin A, IU": "IU", "Calcium, Ca": "mg or source-native mineral unit", "Vitamin K": "source-native vitamin unit", "Betaine": "g or source-native unit"}


@query("WITH u(name, unit, i) AS (VALUES " + ", ".join(f"('{n}', '{u}', {i})" for i, (n, u) in enumerate(_UNITS.items())) + """)
    SELECT p_partkey, name, unit, round(p_retailprice / 4.184, 4) AS kcal, round(p_retailprice / 40, 4) AS ug FROM part JOIN u ON p_partkey % 7 = i""")
def nutrient_units(spark, d):
    """F16 M07."""
    names = spark.createDataFrame([(n, i) for i, n in enumerate(_UNITS)], "name string, i int")
    p = read(spark, d, "part").join(F.broadcast(names), F.col("p_partkey") % 7 == F.col("i"))
    price = F.col("p_retailprice").cast("double")
    return p.select("p_partkey", "name", text.nutrient_unit(F.col("name")).alias("unit"), r(numeric.convert(price, "kJ", "kcal")).alias("kcal"), r(numeric.convert(price, "IU", "ug")).alias("ug"))


_FACTS = "list_filter([CASE WHEN p_size % 3 <> 0 THEN 'size ' || p_size END, CASE WHEN p_retailprice > 1200 THEN 'high price' END, p_brand], lambda x: x IS NOT NULL)"


@query(f"""WITH c AS (SELECT p_partkey, p_name, p_type, {_FACTS} AS l, 'base' AS scenario FROM part UNION ALL SELECT p_partkey, p_name, p_type, [p_brand], 'plain' FROM part)
    SELECT scenario, p_partkey, p_name || ' is a ' || lower(p_type) || ' item with ' || CASE len(l) WHEN 1 THEN l[1] WHEN 2 THEN l[1] || ' and ' || l[2] ELSE l[1] || ', ' || l[2] || ', and ' || l[3] END || '.' AS card FROM c""")
def item_cards(spark, d):
    """The cards of two scenarios, in one table."""
    p = read(spark, d, "part")
    facts = F.filter(F.array(F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("size "), "p_size")), F.when(F.col("p_retailprice") > 1200, F.lit("high price")), F.col("p_brand")), lambda x: x.isNotNull())
    card = lambda name, f: p.select(F.lit(name).alias("scenario"), "p_partkey", text.sentence(F.col("p_name"), F.col("p_type"), f).alias("card"))
    return card("base", facts).unionByName(card("plain", F.array("p_brand")))


@query("""WITH l AS (SELECT p_partkey, list_filter([{'name': 'price', 'value': round(p_retailprice::DOUBLE, 2)}, {'name': 'size', 'value': (p_size % 4)::DOUBLE}, {'name': 'code', 'value': (p_partkey % 2)::DOUBLE}], lambda x: x.value <> 0)[1:2] AS l FROM part)
    SELECT p_partkey, array_to_string(list_transform(l, lambda x: x.name), ' | ') AS names, round(list_sum(list_transform(l, lambda x: x.value)), 2) AS total FROM l""")
def first_nonzero_features(spark, d):
    """The first features of an item that are not zero."""
    p = read(spark, d, "part")
    each = F.array(*(F.struct(F.lit(n).alias("name"), v.cast("double").alias("value")) for n, v in (("price", F.round("p_retailprice", 2)), ("size", F.col("p_size") % 4), ("code", F.col("p_partkey") % 2))))
    kept = F.slice(F.filter(each, lambda x: x["value"] != 0), 1, 2)
    return p.select("p_partkey", F.array_join(F.transform(kept, lambda x: x["name"]), " | ").alias("names"), r(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x["value"]), 2).alias("total"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN p_size::DOUBLE ELSE 0 END AS filled, p_partkey % 4 = 3 AS counts, (p_partkey)::VARCHAR AS whole FROM part""")
def valid_numbers(spark, d):
    """NaN, infinities and nulls are 0 and not covered; ids are whole numbers."""
    p, k = read(spark, d, "part"), F.col("p_partkey") % 4
    x = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 3, F.col("p_size").cast("double"))
    return p.select("p_partkey", numeric.finite_or_zero(x).alias("filled"), numeric.covered(x).alias("counts"), numeric.required_id(F.concat(F.col("p_partkey").cast("string"), F.lit(".0"))).alias("whole"))


@query("SELECT vec_id, dim::INTEGER AS dim, round(x / greatest(norm, 1e-12), 6) AS value FROM (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y))) AS norm, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)")
def unit_vectors(spark, d):
    """Rows of length 1."""
    return read(spark, d, "embeddings").select("vec_id", F.posexplode(numeric.unit_vector(F.col("embedding"))).alias("dim", "value")).withColumn("value", r("value", 6))


# Predicates and columns


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.06")
def range_filter(spark, d):
    """Both bounds count, are clamped, and may be swapped."""
    return features.between(read(spark, d, "lineitem"), "l_discount", 0.06, 0.02).select("l_orderkey", "l_linenumber", "l_discount")


@query(f"WITH {_EDGES} SELECT source, substr(target, 10) AS supplier_id FROM edges WHERE starts_with(target, 'supplier:')")
def prefix_filter(spark, d):
    """Keys with a prefix, and what stands behind it."""
    return features.keyed(edges(spark, d), "target", "supplier:", "supplier_id").select("source", "supplier_id")


@query("SELECT doc_id FROM documents WHERE lower(text) LIKE '%ing%' OR lower(source) LIKE '%ing%'")
def text_search(spark, d):
    """A word in any of several columns."""
    return features.search(read(spark, d, "documents"), ["text", "source"], "ING").select("doc_id")


@query(f"WITH {_EDGES} SELECT source, target, relation FROM edges WHERE relation IN ('in_nation', 'in_region') OR lower(target) LIKE '%#1%' OR lower(target) LIKE '%steel%'")
def compound_edge_filter(spark, d):
    """Relations kept whole, or a keyword in the label; no keyword at all keeps everything."""
    e = edges(spark, d)
    kept = features.labelled_edges(e.where(features.contains_any(F.col("target"), [])), ["in_nation", "in_region"], ["#1", "STEEL"], "target")
    return kept.select("source", "target", "relation")


@query("""SELECT column_name, CASE WHEN regexp_matches(column_name, 'key$') THEN 'key' WHEN regexp_matches(column_name, 'date') THEN 'time' WHEN regexp_matches(column_name, 'price|discount|tax|quantity') THEN 'amount' ELSE 'other' END AS family
    FROM (DESCRIBE SELECT * FROM lineitem)""")
def column_families(spark, d):
    """Columns by the first pattern that their names have."""
    rules = [("key$", "key"), ("date", "time"), ("price|discount|tax|quantity", "amount")]
    return spark.createDataFrame(features.classified(read(spark, d, "lineitem").columns, rules, "other"), "column_name string, family string")


@query("SELECT c_custkey, c_acctbal AS target FROM customer WHERE c_custkey % 3 <> 0 AND c_mktsegment <> 'BUILDING'")
def approved_target_rows(spark, d):
    """Targets that exist and are numeric; rows that lack a key go."""
    c = read(spark, d, "customer").withColumn("c_nationkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey"))).withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    target = features.approved_targets(c, ["c_acctbal", "c_name", "no_such"], strict=False)[0]
    return features.complete(c, ["c_nationkey", "c_mktsegment"]).select("c_custkey", F.col(target).alias("target"))


@query("SELECT s_suppkey AS item__s_suppkey, s_acctbal AS item__s_acctbal, s_name FROM supplier")
def chosen_columns(spark, d):
    """Columns by exclusion, tokens, kind and alias, prefixed and in order."""
    s = read(spark, d, "supplier")
    name = features.resolved(s, "label", ["title", "S_NAME"])
    some = s.select(*features.columns_but(s, {"s_address", "s_phone", "s_comment"}))
    wanted = list(dict.fromkeys([*features.columns_with(some, ["KEY", "acct"]), *features.numeric_columns(some, ("s_nationkey",)), name]))
    return features.prefixed(features.reordered(some.select(*[c for c in wanted if c != "s_nationkey"]), [name]), "item__", keep=(name,))


@query("SELECT true AS iso, true AS recent")
def run_metadata(spark, d):
    """The time of the run in UTC."""
    now = features.stamped(spark.range(1))
    seconds = F.unix_timestamp(F.to_timestamp("generated_at"))
    return now.select(F.col("generated_at").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:]{8}Z$").alias("iso"), (F.abs(seconds - F.unix_timestamp(F.current_timestamp())) < 86_400).alias("recent"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'unsure' WHEN event_id % 3 = 1 THEN 'same' ELSE 'other' END AS verdict, CASE WHEN event_id % 3 = 1 THEN 0.75 ELSE 0.0 END::DOUBLE AS confidence FROM events""")
def verdict_parse(spark, d):
    """Verdicts as JSON, with a fallback for text that is no JSON."""
    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.lit("sorry, {not json")).when(k == 1, F.lit('{"verdict": "same", "confidence": 0.75}')).otherwise(F.lit('{"verdict": "other"}'))
    v = F.from_json(raw, "verdict string, confidence double")
    return read(spark, d, "events").select("event_id", F.coalesce(v["verdict"], F.lit("unsure")).alias("verdict"), F.coalesce(v["confidence"], F.lit(0.0)).alias("confidence"))


@query("SELECT l_orderkey, '[' || array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') || ']' AS donor_ids, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def provenance_id_arrays(spark, d):
    """Ids as JSON arrays."""
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_set("l_suppkey"))).alias("donor_ids"), F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size / 50.0 END AS e, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE (p_partkey % 50) / 50.0 END AS n FROM part)
    SELECT p_partkey, greatest(coalesce(e, 0), coalesce(n, 0))::DOUBLE AS match_score, CASE WHEN coalesce(n, 0) > coalesce(e, 0) THEN 'native' ELSE 'english' END AS match_language FROM s""")
def bilingual_scores(spark, d):
    """The better of two languages' scores; the native one only if it is larger."""
    from ..operators import match

    p, k = read(spark, d, "part"), F.col("p_partkey")
    s = p.select("p_partkey", F.when(k % 3 != 0, F.col("p_size") / F.lit(50.0)).alias("e"), F.when(k % 5 != 0, (k % 50) / F.lit(50.0)).alias("n"))
    return s.select("p_partkey", *match.bilingual("e", "n"))


@query(f"""WITH p AS (SELECT p_partkey, {_CANON} AS c, p_size FROM part) SELECT c AS canonical_id, count(*) AS n, sum(p_size)::BIGINT AS total, round(avg(CASE WHEN p_partkey % 2 = 0 THEN p_size END), 4) AS mean_even FROM p GROUP BY c""")
def comparison_aggregate(spark, d):
    """Counts and sums of each canonical item."""
    from .catalogue import canonical

    c = canonical(spark, d).select("item", "canonical_id").join(read(spark, d, "part").select(F.col("p_partkey").alias("item"), "p_size"), "item")
    return c.groupBy("canonical_id").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("total"), r(F.avg(F.when(F.col("item") % 2 == 0, F.col("p_size")))).alias("mean_even"))


@query("""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_-]+'), lambda x: length(x) >= 3)) AS token FROM documents), c AS (SELECT doc_id, token, count(*) AS n FROM t GROUP BY ALL),
    v AS (SELECT doc_id, (('0x' || right(md5(token), 7))::BIGINT % 64) AS dim, sum(CASE WHEN ('0x' || right(md5('sign:' || token), 1))::INT % 2 = 1 THEN -1 ELSE 1 END * ln(1 + n)) AS v FROM c GROUP BY ALL),
    g AS (SELECT doc_id, dim, coalesce(v, 0) AS v FROM (SELECT doc_id, unnest(range(64)) AS dim FROM documents) LEFT JOIN v USING (doc_id, dim)), s AS (SELECT dim, avg(v) AS m, coalesce(nullif(stddev_pop(v), 0), 1) AS sd FROM g GROUP BY dim)
    SELECT doc_id, dim::INTEGER AS dim, round((v - m) / sd / 8, 4) AS value FROM g JOIN s USING (dim)""")
def scaled_text_block(spark, d):
    """Whole texts of documents as hashed blocks, scaled with population deviations."""
    out = vectors.text_block(read(spark, d, "documents"), "doc_id", "text")
    return out.select("doc_id", F.posexplode("block").alias("dim", "value")).withColumn("value", r("value"))


@query(f"""{_INFO}, w AS (SELECT source, target, relation, round(weighted_value, 6) AS x FROM weighted), cut AS (SELECT quantile_cont(x, 0.9) AS t FROM w)
    SELECT source, target, relation, x AS weighted_value, 'idf_entropy' AS metric FROM w, cut WHERE x >= t""")
def threshold_filtered_edges(spark, d):
    """Edges from a quantile of their weights on."""
    from ..operators import windows

    w = written(_weighted(spark, d).select("source", "target", "relation", r("weighted_value", 6).alias("weighted_value")))  # read for the cut and for the edges
    cut = windows.quantiles(w, "weighted_value", [0.9]).select(F.col("value").alias("t"))
    return w.crossJoin(F.broadcast(cut)).where("weighted_value >= t").drop("t").withColumn("metric", F.lit("idf_entropy"))  # one row
