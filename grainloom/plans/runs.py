"""Queries of runs with several outputs: communities, adapters, mapping and layer runs, comparisons from files, scenarios, identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import adapters, community, features, learn, runs
from ..scratch import work_dir, written
from ..sources import readers, writers
from .catalogue import _NORM, _SCORED, _TIER, _left, _right, events, items, query, r, read

# Communities

_GROUPS = {"active": r"(^|[|_;\s])(click|purchase)([|_;\s]|$)", "passive": r"(^|[|_;\s])view([|_;\s]|$)"}
_LONG = """raw AS (SELECT user_id::VARCHAR AS who, 'genus' AS level, 'g__' || event_type AS taxon, value FROM events UNION ALL SELECT user_id::VARCHAR, 'species', 'g__' || event_type || '|s__' || event_id % 7, value FROM events),
    long AS (SELECT who, level, taxon, avg(value) AS value FROM raw GROUP BY ALL), m AS (SELECT *, regexp_matches(replace(taxon, '__', '_'), '(?i)(^|[|_;\\s])(click|purchase)([|_;\\s]|$)') AS a, regexp_matches(replace(taxon, '__', '_'), '(?i)(^|[|_;\\s])view([|_;\\s]|$)') AS p, greatest(coalesce(value, 0), 0) AS v FROM long)"""


def _community(spark, d):
    e = read(spark, d, "events")
    genus = e.select("user_id", F.lit("genus").alias("level"), F.concat(F.lit("g__"), "event_type").alias("taxon"), "value")
    species = e.select("user_id", F.lit("species").alias("level"), F.concat(F.lit("g__"), "event_type", F.lit("|s__"), (F.col("event_id") % 7).cast("string")).alias("taxon"), "value")
    return written(community.averaged(genus.unionByName(species), "user_id", "level", "taxon", "value"))


@query(f"""WITH {_LONG}, t AS (SELECT who, level, sum(v) AS total FROM m GROUP BY ALL), x AS (SELECT who, level, coalesce(-sum(v / total * ln(v / total)) FILTER (v > 0), 0) AS shannon, 1 - coalesce(sum((v / total) * (v / total)) FILTER (total > 0), 0) AS simpson, count(*) FILTER (v > 0) AS richness, max(total) AS total FROM m JOIN t USING (who, level) GROUP BY ALL),
    g AS (SELECT who, level, coalesce(sum(value) FILTER (a), 0) AS active, coalesce(sum(value) FILTER (p), 0) AS passive, coalesce(sum(value) FILTER (a OR p), 0) AS groups_total FROM m GROUP BY ALL), n AS (SELECT level, count(DISTINCT taxon) FILTER (a OR p) AS n_matched FROM m GROUP BY level)
    SELECT who, level, round(shannon, 6) AS shannon, round(simpson, 6) AS simpson, richness, round(total + 1e-7, 4) AS total, round(active + 1e-7, 4) AS active, round(passive + 1e-7, 4) AS passive, round(groups_total + 1e-7, 4) AS groups_total, n_matched FROM x JOIN g USING (who, level) JOIN n USING (level)""")
def community_profiles(spark, d):
    """Of each participant and level the diversity, and the sums of two groups of taxa."""
    out = community.prepared(_community(spark, d), _GROUPS)
    return out.select("who", "level", r("shannon", 6).alias("shannon"), r("simpson", 6).alias("simpson"), "richness", *(r(F.col(c) + 1e-7).alias(c) for c in ("total", "active", "passive", "groups_total")), "n_matched")


@query(f"""WITH {_LONG}, h AS (SELECT level, count(DISTINCT who) AS n_rows, count(DISTINCT taxon) AS n_features, count(DISTINCT taxon) FILTER (a OR p) AS n_matched FROM m GROUP BY level)
    SELECT level, CASE WHEN n_rows IS NULL THEN 'missing' ELSE 'exported' END AS status, coalesce(n_rows, 0) AS n_rows, coalesce(n_features, 0) AS n_features, coalesce(n_matched, 0) AS n_matched FROM (VALUES ('genus'), ('species'), ('strain')) w(level) LEFT JOIN h USING (level)""")
def community_manifest(spark, d):
    """Which levels there are, their rows, features and matched features."""
    return community.manifest(_community(spark, d), ["genus", "species", "strain"], _GROUPS)


_TOP = f"t AS (SELECT taxon FROM long WHERE level = 'species' GROUP BY taxon ORDER BY count(DISTINCT who) DESC, taxon LIMIT 12)"


@query(f"""WITH {_LONG}, {_TOP}, s AS (SELECT * FROM long WHERE level = 'species') SELECT who, taxon, round(value + 1e-7, 4) AS value FROM (
    SELECT w.who, 'sp_' || trim(regexp_replace(lower(t.taxon), '[^a-z0-9]+', '_', 'g'), '_') AS taxon, coalesce(s.value, 0) AS value FROM (SELECT DISTINCT who FROM s) w CROSS JOIN t LEFT JOIN s ON s.who = w.who AND s.taxon = t.taxon
    UNION ALL SELECT who, 'sp_other', coalesce(sum(value) FILTER (taxon NOT IN (FROM t)), 0) FROM s GROUP BY who)""")
def community_matrix(spark, d):
    """The wide matrix of the twelve taxa of most participants, the others in one column (shown long)."""
    from ..operators import fuse

    wide = community.wide(_community(spark, d).where("level = 'species'").drop("level"), "sp_", 12)
    return fuse.long_form(wide, ["who"], wide.columns[1:], "taxon", "value").withColumn("value", r(F.col("value") + 1e-7))


# Adapters

_TASKS = "tasks(task, target, metric) AS (SELECT 'predict_' || lower(n_name), CASE n_nationkey % 3 WHEN 0 THEN 'balance' WHEN 1 THEN 'segment' ELSE 'unknown' END, CASE n_nationkey % 2 WHEN 0 THEN 'r2' ELSE 'auroc' END FROM nation)"
_MODES = "modes(mode, kind) AS (VALUES ('artifact_only', 'artifact'), ('outside_llm', 'artifact'), ('outside_llm', 'card'), ('tre_minimal', 'artifact'), ('tre_minimal', 'config'), ('full', 'artifact'), ('full', 'config'), ('full', 'card'))"
_YEARLY = "x AS (SELECT o_custkey AS participant, year(o_orderdate) AS y, avg(o_totalprice) AS price, CASE WHEN count(*) % 5 = 0 THEN NULL ELSE count(*)::DOUBLE END AS orders FROM orders GROUP BY ALL)"


def _tasks(spark, d):
    k = F.col("n_nationkey")
    return read(spark, d, "nation").select(F.concat(F.lit("predict_"), F.lower("n_name")).alias("task"), F.when(k % 3 == 0, "balance").when(k % 3 == 1, "segment").otherwise("unknown").alias("target"), F.when(k % 2 == 0, "r2").otherwise("auroc").alias("metric"))


def _yearly(spark, d):
    n = F.count(F.lit(1))
    return read(spark, d, "orders").groupBy(F.col("o_custkey").alias("participant"), F.year("o_orderdate").alias("y")).agg(F.avg("o_totalprice").alias("price"), F.when(n % 5 != 0, n.cast("double")).alias("orders"))


@query(f"""WITH {_TASKS}, {_MODES}, {_YEARLY}, o AS (SELECT 'artifact' AS kind, participant::VARCHAR AS name, 'v ' || round(avg(price) + 1e-7, 2)::DECIMAL(18, 2) AS content FROM x GROUP BY participant
    UNION ALL SELECT 'config', task, '{{"task":"' || task || '","target":"' || target || '","metric":"' || metric || '","features":"yearly","dimensions":2}}' FROM tasks
    UNION ALL SELECT 'card', task, '# ' || task || chr(10) || chr(10) || 'Predict ' || target || ' from yearly (2 columns); score by ' || metric || '.' FROM tasks) SELECT mode, kind, name, content FROM o JOIN modes USING (kind)""")
def adapter_builds(spark, d):
    """The outputs of four build modes from one plan: vectors (their first value shown), settings and cards."""
    built = adapters.outputs(_yearly(spark, d), "participant", ["price", "orders"], _tasks(spark, d), "yearly", list(adapters.MODES), policy="mean")
    first = F.concat(F.lit("v "), r(F.element_at("embedding", 1) + 1e-7, 2).cast("decimal(18,2)").cast("string"))
    return built.select("mode", "kind", "name", F.when(F.col("kind") == "artifact", first).otherwise(F.col("content")).alias("content"))


@query(f"""WITH {_MODES}, p AS (SELECT count(DISTINCT o_custkey) AS n FROM orders), t AS (SELECT count(*) AS n FROM nation)
    SELECT mode, max(CASE kind WHEN 'artifact' THEN p.n ELSE 0 END) AS n_vectors, 2 AS dimensions, max(CASE kind WHEN 'config' THEN t.n ELSE 0 END) AS n_configs, max(CASE kind WHEN 'card' THEN t.n ELSE 0 END) AS n_cards FROM modes, p, t GROUP BY mode""")
def adapter_summary(spark, d):
    """What each build mode holds."""
    return adapters.summary(adapters.outputs(_yearly(spark, d), "participant", ["price", "orders"], _tasks(spark, d), "yearly", list(adapters.MODES), policy="mean"))


# Runs

@query(f"""{_SCORED}, b AS (SELECT lt.id AS left_id, right_id, coalesce(match_score, 0)::DOUBLE AS match_score, coalesce(candidate_rank, 1) AS candidate_rank FROM lt LEFT JOIN c ON c.left_id = lt.id), t AS (SELECT *, {_TIER} AS confidence FROM b WHERE candidate_rank = 1)
    SELECT count(*) AS n, {', '.join(f"round(avg(CASE WHEN confidence = '{x}' THEN 100.0 ELSE 0.0 END), 2) AS {x}_pct" for x in ("high", "medium", "low", "review"))}, round(avg(match_score), 4) AS mean_score, (SELECT count(right_id) FROM b) AS n_candidates,
        count(right_id) AS n_edges, count(DISTINCT left_id) FILTER (right_id IS NOT NULL) AS n_sources, count(DISTINCT right_id) AS n_targets FROM t""")
def mapping_run(spark, d):
    """Names through candidates, placeholders, graph and validation, each stored, and the summary of the run."""
    return runs.mapping_run(_left(spark, d), _right(spark, d), f"{work_dir(spark)}/mapping")


_LAYERS = """a AS (SELECT l_partkey AS item, count(*) AS n_lines FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_partkey AS item, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem WHERE l_quantity > 45 GROUP BY 1 UNION ALL SELECT -1, 0)"""


def _layers(spark, d):
    line = read(spark, d, "lineitem").withColumnRenamed("l_partkey", "item")
    a = line.where("l_returnflag = 'R'").groupBy("item").agg(F.count(F.lit(1)).alias("n_lines"))
    b = line.where("l_quantity > 45").groupBy("item").agg(F.countDistinct("l_suppkey").alias("n_suppliers")).unionByName(spark.createDataFrame([(-1, 0)], "item long, n_suppliers long"))
    p = read(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("label"))
    return runs.layer_run(p, {"returns": a, "large": b.withColumn("label", F.lit("not used"))}, "item", f"{work_dir(spark)}/layers")


@query(f"WITH {_LAYERS} SELECT p_partkey AS item, p_brand AS label, n_lines, n_suppliers FROM part LEFT JOIN a ON a.item = p_partkey LEFT JOIN b ON b.item = p_partkey")
def layer_run(spark, d):
    """Layers stored one by one, checked for repeated keys, and folded onto the items."""
    return _layers(spark, d)[0]


@query(f"""WITH {_LAYERS} SELECT 'returns' AS layer, count(*) AS n_rows, count(*) FILTER (item IN (SELECT p_partkey FROM part)) AS n_items, 'n_lines' AS adds FROM a UNION ALL SELECT 'large', count(*), count(*) FILTER (item IN (SELECT p_partkey FROM part)), 'n_suppliers' FROM b""")
def layer_report(spark, d):
    """The rows of each layer, the items that it covers, and the columns that it adds."""
    return _layers(spark, d)[1]


# Scenarios, columns, keys, identities, texts, samples


@query("""WITH a AS (SELECT p_partkey AS item, p_retailprice AS price, p_size::DOUBLE AS size FROM part), b AS (SELECT l_partkey AS item, round(avg(l_extendedprice) + 1e-7, 2) AS price, NULL::DOUBLE AS size FROM lineitem GROUP BY 1), u AS (SELECT 'retail' AS scenario, * FROM a UNION ALL SELECT 'sold', * FROM b),
    w AS (FROM u UNION ALL SELECT 'combined', item, avg(price), avg(size) FROM u GROUP BY item) SELECT scenario, item, round(price + 1e-7, 4) AS price, p_name || ' is a ' || lower(p_type) || ' item with price ' || round(price + 1e-7, 2)::DECIMAL(18, 2) || CASE WHEN size IS NULL THEN '' ELSE ' and size ' || size::BIGINT END || '.' AS card FROM w JOIN part ON item = p_partkey""")
def scenario_cards(spark, d):
    """Cards of the items of two scenarios and of their means."""
    p = read(spark, d, "part")
    a = p.select(F.col("p_partkey").alias("item"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))
    b = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg(r(F.avg("l_extendedprice") + 1e-7, 2).alias("price")).withColumn("size", F.lit(None).cast("double"))
    w = runs.scenario_means({"retail": a, "sold": b}, "item", ["price", "size"]).join(p, F.col("item") == F.col("p_partkey"))
    facts = F.array_compact(F.array(F.concat(F.lit("price "), r(F.col("price") + 1e-7, 2).cast("decimal(18,2)").cast("string")), F.concat(F.lit("size "), F.col("size").cast("long").cast("string"))))
    return w.select("scenario", "item", r(F.col("price") + 1e-7).alias("price"), text.sentence(F.col("p_name"), F.col("p_type"), facts).alias("card"))


@query("SELECT 'p_retailprice' AS name, count(p_retailprice) AS n, 'schema' AS found_by FROM part UNION ALL SELECT unnest(['p_size', 'p_retailprice']), count(*), 'exclusion' FROM part")
def discovered_columns(spark, d):
    """The columns of amounts, by a table of columns and groups, and by what is left out."""
    p = read(spark, d, "part")
    schema = spark.createDataFrame([("p_retailprice", "amount"), ("p_name", "amount"), ("p_size", "form"), ("p_gone", "amount")], "column string, group string")
    pick = lambda names, how: p.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).isNotNull().cast("int").alias("k")) for c in names))).alias("x")).groupBy("x.name").agg(F.sum("x.k").alias("n")).withColumn("found_by", F.lit(how))
    return pick(runs.discovered(p, {"p_partkey"}, schema, ["amount"]), "schema").unionByName(pick(runs.discovered(p, {"p_partkey"}), "exclusion"))


@query("SELECT p_partkey, 'part:' || p_partkey AS key, 'brand:' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS label_key, p_partkey::VARCHAR AS whole FROM part")
def node_keys(spark, d):
    """Keys of nodes from ids that were read as floating numbers, and from labels."""
    p = read(spark, d, "part").withColumn("id", F.col("p_partkey").cast("double"))
    from ..functions import numeric

    return p.select("p_partkey", text.node_key("part", F.col("p_partkey").cast("decimal(20,1)")).alias("key"), text.label_key("brand", F.upper("p_brand")).alias("label_key"), numeric.whole_id(F.col("id").cast("decimal(20,1)")).alias("whole"))


@query(f"""WITH a AS (SELECT 'parts' AS source, p_partkey::VARCHAR AS id, {_NORM.format('p_name')} AS norm FROM part), b AS (SELECT DISTINCT 'brands' AS source, p_brand AS id, {_NORM.format('p_brand')} AS norm FROM part), c AS (SELECT 'lots' AS source, (p_partkey * 10)::VARCHAR AS id, {_NORM.format("upper(replace(p_name, ' ', '-'))")} AS norm FROM part WHERE p_partkey % 50 = 0),
    u AS (FROM a UNION ALL FROM b UNION ALL FROM c) SELECT x.source AS left_source, x.id AS left_id, y.source AS right_source, y.id AS right_id, norm FROM u x JOIN u y USING (norm) WHERE x.source < y.source AND norm <> ''""")
def identity_links(spark, d):
    """Records of three sources that carry one name, however it is written."""
    p = read(spark, d, "part")
    lots = p.where("p_partkey % 50 = 0").select((F.col("p_partkey") * 10).alias("lot"), F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("said"))
    return runs.identity_links({"parts": (p, "p_partkey", "p_name"), "brands": (p.select("p_brand").distinct(), "p_brand", "p_brand"), "lots": (lots, "lot", "said")})


@query("SELECT p_partkey, p_name || CASE WHEN trim(coalesce(CASE WHEN p_size % 4 <> 0 THEN p_type END, '')) = '' THEN '' ELSE ' | category: ' || p_type END AS query_text, p_brand || ' | category: ' || p_type AS reference_text FROM part")
def retrieval_texts(spark, d):
    """The texts that retrieval encodes, of queries (some without a category) and of references."""
    p = read(spark, d, "part")
    return p.select("p_partkey", text.embedding_text(F.col("p_name"), F.when(F.col("p_size") % 4 != 0, F.col("p_type"))).alias("query_text"), text.embedding_text(F.col("p_brand"), F.col("p_type")).alias("reference_text"))


@query("""WITH v AS (SELECT DISTINCT unnest(string_split(lower(p_type), ' ')) AS token FROM part WHERE p_size > 40), s AS (SELECT p_partkey, p_type FROM part WHERE p_partkey < 1500)
    SELECT p_partkey, p_type FROM s WHERE p_partkey IN (SELECT p_partkey FROM (SELECT p_partkey, unnest(regexp_split_to_array(lower(p_type), '[^a-z0-9%]+')) AS token FROM s) JOIN v USING (token)) ORDER BY p_partkey LIMIT 700""")
def capped_scan(spark, d):
    """The sampling reader: of the first 1,500 ids the first 700 rows with a wanted word."""
    p = read(spark, d, "part")
    words = p.where("p_size > 40").select(F.explode(F.split(F.lower("p_type"), " ")).alias("token"))
    return readers.wanted_rows(p, ["p_type"], "p_type", words, "p_partkey", scan=1500, keep=700).select("p_partkey", "p_type")


@query()
def feature_set_comparison(spark, d):
    """Two sets of features for two targets, the whole bank of models, from files to files."""
    path = work_dir(spark)
    x = features.exposure(events(spark, d), items(spark, d), ["price", "size"], ["participant"])
    y = x.join(read(spark, d, "customer").select(F.col("c_custkey").alias("participant"), "c_acctbal"), "participant")
    y = y.select("participant", (F.col("price") * 0.01 + F.col("size") * 0.1 + F.col("c_acctbal") * 0.001).alias("y"), (F.col("price") * 0.01 - F.col("c_acctbal") * 0.5).alias("z"))
    writers.write_table(x, f"{path}/x.parquet")
    writers.write_table(y, f"{path}/y.csv")
    return learn.run_from_files(spark, f"{path}/x.parquet", f"{path}/y.csv", ["participant"], {"price": ["price"], "both": ["price", "size"]}, ["y", "z"], f"{path}/out")
