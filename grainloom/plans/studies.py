"""Queries of whole studies: targets along time, prototypes from donors, merged graphs, graphs under several metrics, reviews by version, names of all scripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import features, graph, intervals, match, prototype, versions
from ..scratch import work_dir, written
from .catalogue import _EDGES, _EVENTS, _INFO, _NODES, _SCORED, _SIDES, _TIER, _TOKENS, _information, _left, _right, edges, events, items, nodes, query, r, read

# Targets along time

_WHO = "CASE WHEN {0} % 3 = 0 THEN 0 ELSE {0} END"
_SPANS = f"""e AS ({_EVENTS}), w AS (SELECT {_WHO.format('participant')} AS who, date_trunc('quarter', ts) AS start, date_trunc('quarter', ts) + INTERVAL 3 MONTH AS until, round(sum(p_retailprice * grams / 100) + 1e-7, 2) AS dose, count(*) AS n_lines FROM e JOIN part ON item = p_partkey WHERE l_orderkey % 2 = 0 GROUP BY ALL)"""
_TARGETS = f"t AS (SELECT o_orderkey, {_WHO.format('o_custkey')} AS who, o_orderdate + INTERVAL 45 DAY AS at, o_totalprice AS y FROM orders)"


def _spans(spark, d):
    """Quarters in which a participant logged, with their doses; one participant has a third of all rows."""
    o = read(spark, d, "orders").where("o_orderkey % 2 = 0").select("o_orderkey", F.expr(_WHO.format("o_custkey")).alias("who"), F.date_trunc("quarter", "o_orderdate").cast("timestamp_ntz").alias("start"))
    lines = read(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"), "l_quantity").join(read(spark, d, "part").select("p_partkey", "p_retailprice"), "p_partkey")
    e = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return e.groupBy("who", "start").agg(r(F.sum(F.col("p_retailprice") * F.col("l_quantity") / 100) + 1e-7, 2).alias("dose"), F.count(F.lit(1)).alias("n_lines")).withColumn("until", F.expr("start + INTERVAL 3 MONTH"))


def _outcomes(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.expr(_WHO.format("o_custkey")).alias("who"), F.expr("o_orderdate + INTERVAL 45 DAY").alias("at"), F.col("o_totalprice").alias("y"))


@query(f"WITH {_SPANS}, {_TARGETS} SELECT o_orderkey, t.who, y, w.start, w.dose, w.n_lines FROM t ASOF LEFT JOIN w ON t.who = w.who AND t.at >= w.start")
def targets_as_of(spark, d):
    """Each target with its participant's last window of doses that began before it."""
    return intervals.asof(_outcomes(spark, d), _spans(spark, d), ["who"], "at", "start").select("o_orderkey", "who", "y", "start", "dose", "n_lines")


@query(f"WITH {_SPANS}, {_TARGETS} SELECT o_orderkey, t.who, w.start, w.until, w.dose FROM t LEFT JOIN w ON t.who = w.who AND t.at >= w.start AND t.at < w.until")
def targets_in_windows(spark, d):
    """Each target with the window of its participant that holds its time, if there is one."""
    spans = _spans(spark, d).select("who", "start", "until", "dose")
    return intervals.in_spans(_outcomes(spark, d), spans, ["who"], "at", "start", "until").select("o_orderkey", "who", "start", "until", "dose")


@query(f"""WITH e AS ({_EVENTS}), x AS (SELECT participant, strftime(ts, '%Y') AS window_id, round(sum(p_retailprice * grams / 100) + 1e-7, 3) AS price FROM e JOIN part ON item = p_partkey GROUP BY ALL)
    SELECT o_custkey AS participant, window_id, price, o_totalprice, 'missing' AS absent FROM orders JOIN x ON participant = o_custkey AND window_id = strftime(o_orderdate, '%Y') WHERE o_totalprice IS NOT NULL""")
def window_targets_aligned(spark, d):
    """The approved numeric targets by participant and year, beside the doses of the same window; a wanted column that is not there is named."""
    from ..operators import learn

    y = read(spark, d, "orders").withColumnRenamed("o_custkey", "participant")
    y, absent = intervals.window_targets(y, "participant", "o_orderdate", "year", ["o_totalprice", "o_orderstatus", "missing"])
    x = features.design_matrix("enriched", events(spark, d), "year", items=items(spark, d), columns=["price"])
    out = learn.aligned(x, y, ["participant", "window_id"], "o_totalprice")
    return out.select("participant", "window_id", r(F.col("price") + 1e-7, 3).alias("price"), "o_totalprice", F.lit(", ".join(absent)).alias("absent"))


# Prototypes

_KINDS = ["energy", "protein", "salt", "sugar"]
_COLUMNS = {"energy": "l_extendedprice", "protein": "l_quantity", "salt": "l_tax", "sugar": "l_discount"}
_FORMULAS: dict = {"minor": (["salt", "sugar"], []), "minor_to_protein": (["minor"], ["protein"]), "all_to_energy": (["minor", "protein"], ["energy"])}
_RECORDS = "r AS (" + " UNION ALL ".join(f"SELECT l_suppkey AS donor, '{k}' AS feature, round(avg({c}) + 1e-7, 4) AS amount, l_suppkey * 10 + {i} AS record FROM lineitem WHERE (l_suppkey + {i}) % 4 <> 1 GROUP BY l_suppkey" for i, (k, c) in enumerate(_COLUMNS.items())) + ")"
_DONORS = """q AS (SELECT l_partkey AS item, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY sum(l_quantity) DESC, l_suppkey) AS rn FROM lineitem GROUP BY l_partkey, l_suppkey), s AS (SELECT item, max(l_suppkey) FILTER (rn = 1) AS own, max(l_suppkey) FILTER (rn = 2) AS other FROM q GROUP BY item)"""
_CELLS = f"""WITH {_RECORDS}, {_DONORS}, f AS (SELECT unnest({_KINDS}) AS feature),
    j AS (SELECT s.item, f.feature, own, other, o.amount AS oa, o.record AS orec, p.amount AS pa, p.record AS prec, a.amount AS ob, a.record AS obr, b.amount AS pb, b.record AS pbr FROM s CROSS JOIN f LEFT JOIN r o ON o.donor = own AND o.feature = f.feature
          LEFT JOIN r p ON p.donor = other AND p.feature = f.feature AND f.feature IN ('salt', 'sugar') LEFT JOIN r a ON a.donor = own AND a.feature = 'protein' LEFT JOIN r b ON b.donor = other AND b.feature = 'protein'),
    k AS (SELECT *, CASE WHEN oa IS NULL AND pa IS NOT NULL AND pb > 0 THEN ob / pb END AS factor FROM j),
    c AS (SELECT item, feature, coalesce(oa, pa * factor) AS value, CASE WHEN oa IS NOT NULL THEN 'donor_transfer' WHEN factor IS NOT NULL THEN 'scaled_proxy' ELSE 'unresolved' END AS method, CASE WHEN oa IS NOT NULL THEN own WHEN factor IS NOT NULL THEN other END AS donor,
          CASE WHEN oa IS NOT NULL THEN 1 ELSE factor END AS scale_factor, CASE WHEN oa IS NOT NULL THEN [orec] WHEN factor IS NOT NULL THEN list_sort([prec, obr, pbr]) ELSE [] END AS sources, oa IS NULL AND factor IS NOT NULL AS proxy_used FROM k),
    m AS (SELECT item, 'minor' AS feature, CASE WHEN count(value) = 2 THEN sum(value) END AS value, list_sort(list_distinct(flatten(list(sources)))) AS sources, bool_or(proxy_used) AS proxy_used, 'salt, sugar' AS parts FROM c WHERE feature IN ('salt', 'sugar') GROUP BY item),
    u AS (SELECT item, feature, value, sources, proxy_used FROM c UNION ALL SELECT item, feature, value, sources, proxy_used FROM m),
    w AS (SELECT item, max(value) FILTER (feature = 'minor') AS minor, max(value) FILTER (feature = 'protein') AS protein, max(value) FILTER (feature = 'energy') AS energy FROM u GROUP BY item),
    d AS (SELECT item, 'minor_to_protein' AS feature, CASE WHEN protein > 0 THEN minor / protein END AS value, ['minor', 'protein'] AS parts FROM w UNION ALL SELECT item, 'all_to_energy', CASE WHEN energy > 0 THEN (minor + protein) / energy END, ['energy', 'minor', 'protein'] FROM w),
    x AS (SELECT d.item, d.feature, any_value(d.value) AS value, list_sort(list_distinct(flatten(list(u.sources)))) AS sources, bool_or(u.proxy_used) AS proxy_used, array_to_string(any_value(d.parts), ', ') AS parts FROM d JOIN u ON u.item = d.item AND list_contains(d.parts, u.feature) GROUP BY d.item, d.feature),
    cells AS (SELECT item, feature, value, method, donor::VARCHAR AS donor, scale_factor, array_to_string(sources, ',') AS lineage, proxy_used, '' AS parts FROM c
        UNION ALL SELECT item, feature, value, CASE WHEN value IS NULL THEN 'unresolved' ELSE 'derived' END, NULL, NULL, array_to_string(sources, ','), proxy_used, parts FROM m UNION ALL SELECT item, feature, value, CASE WHEN value IS NULL THEN 'unresolved' ELSE 'derived' END, NULL, NULL, array_to_string(sources, ','), proxy_used, parts FROM x)"""


def _cells(spark, d):
    line = read(spark, d, "lineitem")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), F.lit(i).alias("i"), F.col(f"m_{k}").alias("amount")) for i, k in enumerate(_COLUMNS))))
    means = line.groupBy(F.col("l_suppkey").alias("donor")).agg(*(r(F.avg(c) + 1e-7).alias(f"m_{k}") for k, c in _COLUMNS.items()))
    records = means.select("donor", each.alias("x")).where((F.col("donor") + F.col("x.i")) % 4 != 1).select(F.col("donor").cast("string").alias("donor"), "x.feature", "x.amount", (F.col("donor") * 10 + F.col("x.i")).alias("record"))
    weight = line.groupBy(F.col("l_partkey").alias("item"), "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    from ..operators import windows

    best = windows.top_k(weight, ["item"], [F.desc("q"), F.asc("l_suppkey")], 2)
    pick = lambda k: F.max(F.when(F.col("rank") == k, F.col("l_suppkey")))
    specs = best.groupBy("item").agg(pick(1).alias("donor"), pick(2).alias("proxy"))
    return prototype.derived(prototype.transferred(specs, records, _KINDS, ["salt", "sugar"], "protein"), _FORMULAS)


@query(f"{_CELLS} SELECT item, feature, round(value + 1e-9, 7) AS value, method, donor, round(scale_factor + 1e-9, 7) AS scale_factor, lineage, proxy_used, parts FROM cells")
def prototype_build(spark, d):
    """Features of items from their first donor, scaled by protein from the second where it lacks them, and derived features in order, each cell with donor, factor and lineage."""
    out = _cells(spark, d)
    return out.select("item", "feature", r(F.col("value") + 1e-9, 7).alias("value"), "method", "donor", r(F.col("scale_factor") + 1e-9, 7).alias("scale_factor"), F.array_join(F.col("sources").cast("array<string>"), ",").alias("lineage"), "proxy_used", F.array_join("parts", ", ").alias("parts"))


@query(f"""{_CELLS} SELECT feature, count(*) AS n_items, count(*) FILTER (method = 'donor_transfer') AS donor_transfer, count(*) FILTER (method = 'scaled_proxy') AS scaled_proxy, count(*) FILTER (method = 'derived') AS derived, count(*) FILTER (method = 'unresolved') AS unresolved,
    count(*) FILTER (method = 'derived' AND proxy_used) AS derived_with_proxy FROM cells GROUP BY feature""")
def prototype_coverage(spark, d):
    """Of each feature the cells by how they were made, and those that rest on a proxy."""
    return prototype.coverage(_cells(spark, d))


# Merged graphs and graphs under several metrics

_SECOND = """sn AS (SELECT 'maker:' || lower(p_brand) AS key, 'brand' AS kind, upper(p_brand) AS label FROM part UNION SELECT 'brand:' || p_brand, 'brand', p_brand || '0' FROM part WHERE p_brand LIKE '%1' OR p_brand LIKE '%2' UNION SELECT 'part:' || p_partkey, 'part', 'again ' || p_name FROM part WHERE p_partkey % 2 = 0),
    se AS (SELECT 'part:' || p_partkey AS source, 'maker:' || lower(p_brand) AS target, 'has_brand' AS relation, 2.0::DOUBLE AS value FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT 'part:' || p_partkey, 'nowhere:1', 'lost', 1 FROM part WHERE p_partkey % 5 = 0)"""
_MERGED = f"""WITH RECURSIVE {_EDGES}, {_NODES}, {_SECOND}, n0 AS (SELECT 0 AS graph, * FROM nodes UNION ALL SELECT 1, * FROM sn),
    n AS (SELECT *, CASE kind WHEN 'brand' THEN 'brand:' || trim(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '_') ELSE key END AS name FROM n0),
    l AS (SELECT DISTINCT 'key ' || key AS a, 'name ' || name AS b FROM n), both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    reach AS (SELECT a AS id, a AS root FROM both_ways UNION SELECT b, root FROM reach JOIN both_ways ON a = id WHERE root < b), comp AS (SELECT id, min(root) AS component FROM reach GROUP BY id),
    p AS (SELECT n.*, component FROM n JOIN comp ON id = 'key ' || key), f AS (SELECT component, arg_min({{'name': name, 'kind': kind, 'label': label}}, {{'g': graph, 'n': name, 'k': key, 'q': kind, 'l': label}}) AS f, count(DISTINCT {{'g': graph, 'k': key}}) AS n_merged FROM p GROUP BY component),
    mv AS (SELECT DISTINCT key AS old, f.name AS new FROM p JOIN f USING (component)), ae AS (SELECT source, target, relation, value FROM edges UNION ALL SELECT * FROM se)"""


def _both(spark, d):
    p = read(spark, d, "part")
    key = text.node_key("part", F.col("p_partkey"))
    makers = p.select(F.concat(F.lit("maker:"), F.lower("p_brand")).alias("key"), F.lit("brand").alias("kind"), F.upper("p_brand").alias("label"))
    clash = p.where("p_brand LIKE '%1' OR p_brand LIKE '%2'").select(F.concat(F.lit("brand:"), "p_brand").alias("key"), F.lit("brand").alias("kind"), F.concat("p_brand", F.lit("0")).alias("label"))
    again = p.where("p_partkey % 2 = 0").select(key.alias("key"), F.lit("part").alias("kind"), F.concat(F.lit("again "), "p_name").alias("label"))
    made = p.where("p_partkey % 4 = 0").select(key.alias("source"), F.concat(F.lit("maker:"), F.lower("p_brand")).alias("target"), F.lit("has_brand").alias("relation"), F.lit(2.0).alias("value"))
    lost = p.where("p_partkey % 5 = 0").select(key.alias("source"), F.lit("nowhere:1").alias("target"), F.lit("lost").alias("relation"), F.lit(1.0).alias("value"))
    second = makers.unionByName(clash).unionByName(again).distinct(), made.unionByName(lost)
    return graph.merged([(nodes(spark, d), edges(spark, d)), second], {"brand": text.label_key("brand", F.col("label"))})


@query(f"{_MERGED} SELECT f.name AS key, f.kind AS kind, f.label AS label, n_merged FROM f")
def merged_graph_nodes(spark, d):
    """Two overlapping graphs as one: brands go by their label, and nodes whose names collide in either graph become one."""
    return _both(spark, d)[0]


@query(f"{_MERGED} SELECT a.new AS source, b.new AS target, relation, count(*) AS n_merged, round(max(value), 2) AS value FROM ae JOIN mv a ON a.old = source JOIN mv b ON b.old = target GROUP BY ALL")
def merged_graph_edges(spark, d):
    """The edges of both graphs between merged nodes, without missing ends, equal ones once."""
    return _both(spark, d)[1].withColumn("value", r("value", 2))


@query(f"""WITH {_EDGES}, {_NODES}, k AS (SELECT * FROM nodes WHERE kind <> 'brand' AND key <> 'supplier:1') SELECT source, target, relation, CASE WHEN length(a.label || ' > ' || b.label) > 60 THEN substr(a.label || ' > ' || b.label, 1, 60) ELSE a.label || ' > ' || b.label END AS caption
    FROM edges JOIN k a ON a.key = source JOIN k b ON b.key = target""")
def full_graph_export(spark, d):
    """The edges whose ends are both in the export, with a caption of bounded length; edges of nodes that were left out go."""
    n = written(nodes(spark, d).where("kind <> 'brand' AND key <> 'supplier:1'"))
    whole = graph.labelled(graph.without_dangling(n, edges(spark, d)), n)
    return whole.select("source", "target", "relation", F.substring(F.concat_ws(" > ", "source_label", "target_label"), 1, 60).alias("caption"))


_METRICS = ["idf", "idf_entropy", "idf_entropy_divergence"]
_QUANTILES = (0.5, 0.75, 0.9, 0.95, 0.975, 0.99)
_BY_METRIC = f"""{_INFO}, wm AS ({" UNION ALL ".join(f"SELECT source, target, relation, '{m}' AS metric, round(coalesce(value, 1) * coalesce({m}, 0), 6) AS x FROM edges LEFT JOIN info USING (relation, target)" for m in _METRICS)}),
    cuts AS (SELECT metric, unnest({list(_QUANTILES)})::DOUBLE AS quantile, unnest(quantile_cont(x, {list(_QUANTILES)})) AS threshold FROM wm GROUP BY metric),
    per AS (SELECT metric, quantile, threshold, source, count(*) AS n FROM wm JOIN cuts USING (metric) WHERE x >= threshold GROUP BY ALL),
    o AS (SELECT metric, quantile, threshold, sum(n)::BIGINT AS edges_retained, count(*) AS sources_covered, quantile_cont(n, 0.5) AS median_edges FROM per GROUP BY ALL),
    best AS (SELECT metric, coalesce(max(quantile) FILTER (sources_covered >= 0.95 * s AND median_edges >= 20), 0.9) AS b FROM o JOIN (SELECT metric, count(DISTINCT source) AS s FROM wm GROUP BY 1) USING (metric) GROUP BY metric)"""


def _by_metric(spark, d):
    e = written(edges(spark, d))
    w = graph.weighted_by(e, _information(spark, d, e), _METRICS)
    return w.withColumn("weighted_value", r("weighted_value", 6))


@query(f"{_BY_METRIC} SELECT metric, quantile, round(threshold, 4) AS threshold, edges_retained, sources_covered, round(median_edges, 4) AS median_edges, quantile = b AS recommended FROM o JOIN best USING (metric)")
def metric_thresholds(spark, d):
    """The threshold table of each of three metrics, with its recommended quantile."""
    out = graph.thresholds(_by_metric(spark, d))
    return out.select("metric", "quantile", r("threshold").alias("threshold"), "edges_retained", "sources_covered", r("median_edges").alias("median_edges"), "recommended")


@query(f"{_BY_METRIC} SELECT metric, source, target, relation, x AS weighted_value, quantile FROM wm JOIN o USING (metric) JOIN best USING (metric) WHERE quantile = b AND x >= threshold")
def metric_graphs(spark, d):
    """Under each of three metrics the edges that reach its recommended threshold; edges are weighed once and stored by metric."""
    w = _by_metric(spark, d)
    return graph.retained(w, graph.thresholds(w)).select("metric", "source", "target", "relation", "weighted_value", "quantile")


# Reviews by version

_REVIEWS = f"""{_SCORED}, b AS (SELECT left_id, right_id, match_score, {_TIER} AS confidence FROM c WHERE candidate_rank = 1), i AS (SELECT min(p_partkey) AS item, p_name FROM part GROUP BY p_name),
    o AS (SELECT *, lead(p_name) OVER (ORDER BY p_name) AS next FROM i), d1 AS (SELECT item, p_name AS said, 'session 1' AS notes, 1 AS version FROM o WHERE item % 2 = 0), d2 AS (SELECT item, coalesce(next, p_name) AS said, 'session 2' AS notes, 2 AS version FROM o WHERE item % 3 = 0),
    decided AS (SELECT item, said, notes, version, right_id AS remapped, coalesce(match_score, 0)::DOUBLE AS remap_score, coalesce(confidence, 'review') AS remap_confidence FROM (FROM d1 UNION ALL FROM d2) LEFT JOIN b ON left_id = said),
    v AS (SELECT 1 AS as_of, * FROM decided WHERE version <= 1 UNION ALL SELECT 2, * FROM decided), now AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY as_of, item ORDER BY version DESC) AS rn FROM v) WHERE rn = 1)"""


def _reviews(spark, d):
    """Two sessions of decisions about items' names, each stored with what the names that were given map to; the second session corrects some of the first."""
    from ..operators import windows

    path = f"{work_dir(spark)}/reviews"
    i = read(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("item"))
    at = windows.numbered(i, ["p_name"], "n")
    following = at.select((F.col("n") - 1).alias("n"), F.col("p_name").alias("next"))
    o = written(at.join(following, "n", "left"))
    first = o.where("item % 2 = 0").select("item", F.col("p_name").alias("said"), F.lit("session 1").alias("notes"))
    second = o.where("item % 3 = 0").select("item", F.coalesce("next", "p_name").alias("said"), F.lit("session 2").alias("notes"))
    for decisions in (first, second):
        names = match.prepared(decisions.select("said").distinct(), "said", "said", ascii_only=True)
        found = match.with_unmatched(names, match.candidates(names, _right(spark, d))).where("candidate_rank = 1")
        found = found.select(F.col("left_id").alias("said"), F.col("right_id").alias("remapped"), F.col("match_score").alias("remap_score"), F.col("confidence").alias("remap_confidence"))
        versions.append(decisions.join(found, "said", "left").select("item", "said", "notes", "remapped", "remap_score", "remap_confidence"), path)
    return path


@query(f"{_REVIEWS} SELECT as_of, item, said, notes, remapped, remap_score, remap_confidence, version FROM now")
def reviews_as_of(spark, d):
    """Decisions as of each of two sessions; a later session appends, and remaps the names that it gives."""
    path = _reviews(spark, d)
    state = lambda v: versions.as_of(spark, path, ["item"], v).withColumn("as_of", F.lit(v))
    return state(1).unionByName(state(2)).select("as_of", "item", "said", "notes", "remapped", "remap_score", "remap_confidence", "version")


@query(f"""{_REVIEWS} SELECT 'item:' || item AS source, 'said:' || item || ':' || said AS target, 'corrected_to' AS relation, 'reviewed' AS confidence, NULL::DOUBLE AS score FROM now WHERE as_of = 2
    UNION ALL SELECT 'said:' || item || ':' || said, 'reference:' || remapped, 'remapped_to', remap_confidence, remap_score FROM now WHERE as_of = 2 AND remapped IS NOT NULL""")
def review_graph(spark, d):
    """The last decisions as edges: what an item was corrected to, and what that name maps to."""
    now = written(versions.as_of(spark, _reviews(spark, d), ["item"]))
    said = F.concat(F.lit("said:"), F.col("item").cast("string"), F.lit(":"), F.col("said"))
    a = now.select(F.concat(F.lit("item:"), F.col("item").cast("string")).alias("source"), said.alias("target"), F.lit("corrected_to").alias("relation"), F.lit("reviewed").alias("confidence"), F.lit(None).cast("double").alias("score"))
    b = now.where("remapped IS NOT NULL").select(said.alias("source"), F.concat(F.lit("reference:"), "remapped").alias("target"), F.lit("remapped_to").alias("relation"), F.col("remap_confidence").alias("confidence"), F.col("remap_score").alias("score"))
    return a.unionByName(b)


# Names of all scripts

_SCRIPTS = "CASE p_partkey % 3 WHEN 0 THEN translate({0}, 'abegiknoprst', 'абегикнопрст') WHEN 1 THEN translate({0}, 'aeioumn', 'αειουμν') ELSE translate({0}, 'aeiou', 'áéíóú') END"
_UNI = "trim(regexp_replace(lower({0}), '[^\\pL\\pN_%]+', ' ', 'g'))"
_UNI_SIDES = f"""l AS (SELECT id, {_UNI.format('id')} AS norm FROM (SELECT DISTINCT {_SCRIPTS.format('p_name')} AS id FROM part)), rr AS (SELECT id, {_UNI.format('id')} AS norm FROM (SELECT DISTINCT {_SCRIPTS.format("(p_name || ' ' || p_type)")} AS id FROM part)),
    lt AS (SELECT id, norm, {_TOKENS.format('norm')} AS toks FROM l), rt AS (SELECT id, norm, {_TOKENS.format('norm')} AS toks FROM rr)"""


def _scripts(c):
    change = lambda a, b: F.translate(c, a, b)
    return F.when(F.col("p_partkey") % 3 == 0, change("abegiknoprst", "абегикнопрст")).when(F.col("p_partkey") % 3 == 1, change("aeioumn", "αειουμν")).otherwise(change("aeiou", "áéíóú"))


@query(f"{_SCORED.replace(_SIDES, _UNI_SIDES)} SELECT left_id, right_id, match_score FROM s")
def unicode_similarity_pairs(spark, d):
    """The similarity of names in Cyrillic, Greek and accented Latin letters, by their code points; all pairs that share a word."""
    p = read(spark, d, "part")
    a = match.prepared(p.select(_scripts(F.col("p_name")).alias("n")).distinct(), "n", "n", unicode=True)
    b = match.prepared(p.select(_scripts(F.concat_ws(" ", "p_name", "p_type")).alias("n")).distinct(), "n", "n", unicode=True)
    return match.scored(match.all_pairs(a, b), a, b).select("left_id", "right_id", "match_score")
