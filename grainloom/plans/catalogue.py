"""The query catalogue: every operator applied to the driver tables, with the same query in DuckDB SQL.

Roles: part is the item catalogue, lineitem the event log (quantity as
grams), orders the event header (customer as participant, date as time),
supplier and nation graph nodes, embeddings item vectors. Each query reads
its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric, text
from ..operators import features, fuse, graph, match, quality, vectors, windows
from ..scratch import spread, written
from ..sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query, with its SQL if there is one."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r(c, digits: int = 4):
    """Rounded as in the SQL. Means of decimals that often end on a half get 1e-7 first, on both sides, as sums may differ in their last bit."""
    return F.round(c, digits)


# Views that several queries use, in both languages

_NORM = "trim(regexp_replace(regexp_replace(strip_accents(lower({0})), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9%]+', ' ', 'g'))"
_SLUG = f"coalesce(nullif(regexp_replace({_NORM}, '[ %]+', '_', 'g'), ''), 'unknown')"
_CANON = "'canonical:' || " + _SLUG.format("p_name") + " || ':' || " + _SLUG.format("p_type")
_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
_TOKENS = f"list_sort(list_distinct(list_filter(string_split({{0}}, ' '), lambda x: x <> '' AND NOT list_contains({_STOP}, x))))"
_EVENTS = "SELECT o_custkey AS participant, l_partkey AS item, l_quantity AS grams, o_orderdate AS ts, l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def events(spark, d) -> DataFrame:
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("participant"), F.col("o_orderdate").alias("ts"))
    return read(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("participant", F.col("l_partkey").alias("item"), F.col("l_quantity").alias("grams"), "ts")


def items(spark, d) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))


def canonical(spark, d) -> DataFrame:
    return fuse.crosswalk(read(spark, d, "part"), "p_partkey", "p_name", "p_type", ascii_only=True)


# Exposure


@query(f"""
    WITH e AS ({_EVENTS})
    SELECT participant, round(sum(p_retailprice * grams / 100), 4) AS price, round(sum(p_size * grams / 100), 4) AS size
    FROM e JOIN part ON item = p_partkey GROUP BY participant""")
def participant_exposure_per_100g(spark, d):
    """The dose of each feature a participant has had."""
    out = features.exposure(events(spark, d), items(spark, d), ["price", "size"], ["participant"])
    return out.select("participant", r("price").alias("price"), r("size").alias("size"))


@query(f"""
    WITH e AS ({_EVENTS})
    SELECT participant, round(coalesce(sum(p_retailprice * grams) / nullif(sum(grams), 0), 0), 4) AS price, round(coalesce(sum(p_size * grams) / nullif(sum(grams), 0), 0), 4) AS size
    FROM e JOIN part ON item = p_partkey GROUP BY participant""")
def participant_exposure_weighted_mean(spark, d):
    """A29."""
    out = features.exposure_mean(events(spark, d), items(spark, d), ["price", "size"], ["participant"])
    return out.select("participant", r("price").alias("price"), r("size").alias("size"))


_WINDOWS = {
    "day": "strftime(ts, '%Y-%m-%d')", "month": "strftime(ts, '%Y-%m')", "year": "strftime(ts, '%Y')",
    "week": "strftime(date_trunc('week', ts), '%Y-%m-%d') || '/' || strftime(date_trunc('week', ts) + INTERVAL 6 DAY, '%Y-%m-%d')",
}


def _by_window(unit: str):
    @query(f"""
        WITH e AS ({_EVENTS})
        SELECT participant, {_WINDOWS[unit]} AS window_id, round(sum(p_retailprice * grams / 100), 4) AS price
        FROM e JOIN part ON item = p_partkey GROUP BY ALL""", name=f"exposure_by_window_{unit}")
    def run(spark, d):
        out = features.exposure(features.windowed(events(spark, d), "ts", unit), items(spark, d), ["price"], ["participant", "window_id"])
        return out.select("participant", "window_id", r("price").alias("price"))

    run.__doc__ = "D01 A28."


for _unit in _WINDOWS:
    _by_window(_unit)


@query(f"""
    WITH e AS ({_EVENTS}), g AS (SELECT participant, sum(grams) AS t, sum(p_retailprice * grams / 100) AS x FROM e JOIN part ON item = p_partkey GROUP BY participant)
    SELECT participant, round(x / t * 1000, 4) AS price_per_kg, round(ln(1 + x / t * 1000), 4) AS price_log FROM g""")
def exposure_per_kilogram(spark, d):
    """Extension: exposure per 1,000 g logged."""
    e = events(spark, d)
    totals = e.groupBy("participant").agg(F.sum("grams").alias("total_grams"))
    out = features.per_kilogram(features.exposure(e, items(spark, d), ["price"], ["participant"]), totals, ["participant"], ["price"])
    return out.select("participant", r("price_per_kg").alias("price_per_kg"), r("price_log").alias("price_log"))


@query(f"""
    WITH e AS ({_EVENTS}), g AS (SELECT participant, round(sum(p_retailprice * grams / 100), 4) AS price FROM e JOIN part ON item = p_partkey GROUP BY participant),
         w AS (SELECT *, ntile(3) OVER (ORDER BY price, participant) AS t, percent_rank() OVER (ORDER BY price, participant) AS p FROM g)
    SELECT participant, price, t::INTEGER AS tertile, CASE WHEN p <= 0.1 THEN 'bottom' WHEN p >= 0.9 THEN 'top' ELSE 'middle' END AS decile_group FROM w""")
def exposure_groups(spark, d):
    """Extension: tertiles and outer deciles."""
    return features.exposure_groups(participant_exposure_per_100g(spark, d).select("participant", "price"), "participant", "price")


@query("""
    SELECT user_id, strftime(ts, '%Y-%m-%d') AS window_id, count(*) AS n_events, count(DISTINCT event_type) AS n_types, round(sum(value), 4) AS total, round(avg(value) + 1e-7, 4) AS mean, round(max(value), 4) AS largest
    FROM events GROUP BY ALL""")
def events_user_window_profile(spark, d):
    """The batch twin of the stream."""
    e = features.windowed(read(spark, d, "events"), "ts", "day")
    return e.groupBy("user_id", "window_id").agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("event_type").alias("n_types"), r(F.sum("value")).alias("total"), r(F.avg("value") + 1e-7).alias("mean"), r(F.max("value")).alias("largest"))


@query("""
    WITH day AS (SELECT user_id, ts::DATE AS day, sum(value) AS g FROM events GROUP BY ALL), l AS (SELECT *, day - lag(day) OVER (PARTITION BY user_id ORDER BY day) AS gap FROM day)
    SELECT user_id, count(*) AS n_days, round(quantile_cont(g, 0.5), 4) AS median_grams, round(coalesce(stddev_samp(g) / avg(g), 0), 4) AS variation, coalesce(max(gap), 0)::INTEGER AS largest_gap,
           count(*) >= 5 AND coalesce(max(gap), 0) <= 7 AS reliable FROM l GROUP BY user_id""")
def logging_quality_flags(spark, d):
    """Extension: reliable participants by their daily sums."""
    days = read(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("g"))
    out = features.logging_quality(days, "user_id", "day", "g")
    return out.select("user_id", "n_days", r("median_grams").alias("median_grams"), r("variation").alias("variation"), "largest_gap", "reliable")


# Sources, names, canonical items


@query("""
    SELECT 'part' AS source, count(*) AS n, count(DISTINCT p_name) AS n_names FROM part WHERE trim(p_name) <> '' UNION ALL SELECT 'supplier', count(*), count(DISTINCT s_name) FROM supplier WHERE trim(s_name) <> ''
    UNION ALL SELECT 'customer', count(*), count(DISTINCT c_name) FROM customer WHERE trim(c_name) <> ''""")
def source_inventory(spark, d):
    """A40 U01 S09."""
    return _records(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item_name").alias("n_names"))


def _records(spark, d):
    return readers.union_all([
        readers.records(read(spark, d, "part"), "part", "p_partkey", "p_name", "p_type", ("p_brand",)),
        readers.records(read(spark, d, "supplier"), "supplier", "s_suppkey", "s_name"),
        readers.records(read(spark, d, "customer"), "customer", "c_custkey", "c_name", "c_mktsegment"),
    ])


@query("""
    SELECT 'part' AS source, p_partkey::VARCHAR AS source_item_id, trim(p_name) AS item_name, coalesce(trim(p_type), '') AS category, p_brand FROM part WHERE trim(p_name) <> ''
    UNION ALL SELECT 'supplier', s_suppkey::VARCHAR, trim(s_name), '', NULL FROM supplier WHERE trim(s_name) <> ''
    UNION ALL SELECT 'customer', c_custkey::VARCHAR, trim(c_name), coalesce(trim(c_mktsegment), ''), NULL FROM customer WHERE trim(c_name) <> ''""")
def clean_records_union(spark, d):
    """S01 S09 U01."""
    return _records(spark, d)


@query(f"SELECT doc_id, {_NORM.format('text')} AS norm FROM documents")
def normalize_names(spark, d):
    """F01 over whole texts."""
    return read(spark, d, "documents").select("doc_id", text.normalize(F.col("text")).alias("norm"))


@query(f"SELECT p_partkey AS item, p_name AS name, p_type AS category, {_CANON} AS canonical_id FROM part")
def canonical_crosswalk(spark, d):
    """P01 F08."""
    return canonical(spark, d)


@query(f"""
    WITH c AS (SELECT p_partkey AS item, p_name AS name, p_type AS category, {_CANON} AS canonical_id FROM part),
         n AS (SELECT canonical_id, list_sort(list(DISTINCT name)) AS names FROM c GROUP BY canonical_id)
    SELECT canonical_id, min(item) AS representative, arg_min(name, item) AS representative_name, arg_min(category, item) AS category, count(DISTINCT item) AS item_count,
           any_value(array_to_string(names[1:12], ' | ')) AS examples, count(DISTINCT item) > 1 AS merged FROM c JOIN n USING (canonical_id) GROUP BY canonical_id""")
def canonical_foods(spark, d):
    """A04 W08 F08 T07."""
    return fuse.canonical_table(canonical(spark, d))


_LOGS = f"WITH l AS (SELECT l_partkey AS item, count(*) AS logs FROM lineitem GROUP BY 1), c AS (SELECT p_partkey AS item, {_CANON} AS canonical_id FROM part), i AS (SELECT c.*, coalesce(logs, 0) AS logs FROM c LEFT JOIN l USING (item))"


def _logged(spark, d):
    logs = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg(F.count(F.lit(1)).alias("logs"))
    return canonical(spark, d).join(logs, "item", "left").withColumn("logs", F.coalesce("logs", F.lit(0)))


@query(f"""
    {_LOGS}, s AS (SELECT canonical_id, sum(logs)::BIGINT AS total_loggings, count(DISTINCT item) AS item_count FROM i GROUP BY canonical_id),
    w AS (SELECT *, sum(total_loggings) OVER (ORDER BY total_loggings DESC, canonical_id ROWS UNBOUNDED PRECEDING)::DOUBLE / sum(total_loggings) OVER () AS share FROM s)
    SELECT canonical_id, total_loggings, item_count, round(share, 6) AS cumulative_logging_share,
           CASE WHEN share <= 0.80 THEN 'tier_1_high_usage_top_80pct' WHEN share <= 0.95 THEN 'tier_2_medium_usage_next_15pct' ELSE 'tier_3_low_usage_last_5pct' END AS usage_tier FROM w""")
def canonical_usage_tiers(spark, d):
    """A11 W02 P16."""
    out = fuse.usage(_logged(spark, d), "logs")
    return out.withColumn("cumulative_logging_share", r("cumulative_logging_share", 6))


# Matching. Left: distinct item names. Right: names with their types.

_SIDES = f"""l AS (SELECT DISTINCT p_name AS id, {_NORM.format('p_name')} AS norm FROM part),
    rr AS (SELECT DISTINCT p_name || ' ' || p_type AS id, {_NORM.format("(p_name || ' ' || p_type)")} AS norm FROM part),
    lt AS (SELECT id, norm, {_TOKENS.format('norm')} AS toks FROM l), rt AS (SELECT id, norm, {_TOKENS.format('norm')} AS toks FROM rr)"""
_GRAMS = "CASE WHEN norm = '' THEN [] WHEN length(norm) <= 3 THEN [replace(norm, ' ', '_')] ELSE list_transform(range(1, length(norm) - 1), lambda i: substr(replace(norm, ' ', '_'), i, 3)) END"
_SCORED = f"""WITH {_SIDES},
    p AS (SELECT a.id AS left_id, b.id AS right_id, count(*) AS shared FROM (SELECT id, unnest(toks) AS t FROM lt) a JOIN (SELECT id, unnest(toks) AS t FROM rt) b USING (t) GROUP BY ALL),
    lg AS (SELECT id, g, count(*) AS n FROM (SELECT id, unnest({_GRAMS}) AS g FROM lt) GROUP BY ALL), rg AS (SELECT id, g, count(*) AS n FROM (SELECT id, unnest({_GRAMS}) AS g FROM rt) GROUP BY ALL),
    ln AS (SELECT id, sqrt(sum(n * n)) AS len FROM lg GROUP BY id), rn AS (SELECT id, sqrt(sum(n * n)) AS len FROM rg GROUP BY id),
    dots AS (SELECT lg.id AS left_id, rg.id AS right_id, sum(lg.n * rg.n)::DOUBLE AS dot FROM lg JOIN rg USING (g) GROUP BY ALL),
    parts AS (SELECT p.*, coalesce(dot, 0) / (ln.len * rn.len) AS cos, len(list_intersect(a.toks, b.toks))::DOUBLE / len(list_distinct(list_concat(a.toks, b.toks))) AS jac,
                     CASE WHEN contains(a.norm, b.norm) OR contains(b.norm, a.norm) THEN least(length(a.norm), length(b.norm))::DOUBLE / greatest(length(a.norm), length(b.norm)) ELSE 0 END AS con, a.norm = b.norm AS same
              FROM p JOIN lt a ON a.id = left_id JOIN rt b ON b.id = right_id LEFT JOIN dots USING (left_id, right_id) JOIN ln ON ln.id = left_id JOIN rn ON rn.id = right_id),
    s AS (SELECT left_id, right_id, shared, cos, jac, CASE WHEN same THEN 1.0 ELSE round(0.55 * cos + 0.35 * jac + 0.10 * con, 4) END::DOUBLE AS match_score FROM parts),
    c AS (SELECT * FROM (SELECT left_id, right_id, match_score, shared, row_number() OVER (PARTITION BY left_id ORDER BY match_score DESC, shared DESC, right_id)::INTEGER AS candidate_rank FROM s WHERE match_score > 0) WHERE candidate_rank <= 5)"""
_TIER = "CASE WHEN match_score >= 0.86 THEN 'high' WHEN match_score >= 0.72 THEN 'medium' WHEN match_score >= 0.58 THEN 'low' ELSE 'review' END"


def _left(spark, d):
    return match.prepared(read(spark, d, "part").select("p_name").distinct(), "p_name", "p_name", ascii_only=True)


def _right(spark, d):
    return match.prepared(read(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("n")).distinct(), "n", "n", ascii_only=True)


def _candidates(spark, d):
    return match.candidates(_left(spark, d), _right(spark, d))


@query(f"WITH {_SIDES} SELECT t AS token, array_to_string(list_sort(list(DISTINCT id)), ' | ') AS ids, count(DISTINCT id) AS n FROM (SELECT id, unnest(toks) AS t FROM lt) GROUP BY t")
def token_inverted_index(spark, d):
    """F03."""
    return match.inverted_index(_left(spark, d)).withColumn("ids", F.array_join("ids", " | "))


@query(f"{_SCORED} SELECT left_id, right_id, shared, round(jac, 6) AS jaccard FROM s")
def token_jaccard_pairs(spark, d):
    """F06 over the pairs that blocking proposes."""
    a, b = _left(spark, d), _right(spark, d)
    p = match.all_pairs(a, b).join(a.select(F.col("id").alias("left_id"), F.col("toks").alias("x")), "left_id").join(b.select(F.col("id").alias("right_id"), F.col("toks").alias("y")), "right_id")
    return p.select("left_id", "right_id", "shared", r(text.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


@query(f"{_SCORED} SELECT left_id, right_id, round(cos, 6) AS cosine FROM s")
def trigram_cosine_pairs(spark, d):
    """F04 F05."""
    a, b = _left(spark, d), _right(spark, d)
    p = match.all_pairs(a, b).join(a.select(F.col("id").alias("left_id"), F.col("grams").alias("x")), "left_id").join(b.select(F.col("id").alias("right_id"), F.col("grams").alias("y")), "right_id")
    return p.select("left_id", "right_id", r(text.counted_cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


@query(f"{_SCORED} SELECT left_id, right_id, match_score FROM s")
def name_similarity_pairs(spark, d):
    """F07."""
    a, b = _left(spark, d), _right(spark, d)
    return match.scored(match.all_pairs(a, b), a, b).select("left_id", "right_id", "match_score")


@query(f"{_SCORED} SELECT * FROM c")
def candidate_topk_names(spark, d):
    """J09-J11 W03."""
    return _candidates(spark, d)


_EXTRA = "x AS (SELECT id AS left_id FROM lt UNION ALL SELECT 'Zzyzx Qwortle')"


@query(f"""{_SCORED}, {_EXTRA}, o AS (SELECT left_id, right_id, coalesce(match_score, 0)::DOUBLE AS match_score, coalesce(candidate_rank, 1)::INTEGER AS candidate_rank FROM x LEFT JOIN c USING (left_id))
    SELECT *, {_TIER} AS confidence FROM o""")
def candidate_outer_review(spark, d):
    """J11 P16, with a name that matches nothing."""
    names = _left(spark, d).select("id").unionByName(spark.createDataFrame([("Zzyzx Qwortle",)], "id string"))
    return match.with_unmatched(names, _candidates(spark, d))


@query(f"""{_SCORED}, {_EXTRA}, o AS (SELECT left_id, right_id, coalesce(match_score, 0)::DOUBLE AS match_score, coalesce(candidate_rank, 1)::INTEGER AS candidate_rank FROM x LEFT JOIN c USING (left_id)),
    t AS (SELECT *, {_TIER} AS confidence FROM o) SELECT left_id, right_id, match_score, confidence FROM t WHERE candidate_rank = 1 AND confidence NOT IN ('high', 'medium')""")
def review_queue(spark, d):
    """Best candidates that are not accepted."""
    return candidate_outer_review(spark, d).where((F.col("candidate_rank") == 1) & ~F.col("confidence").isin("high", "medium")).select("left_id", "right_id", "match_score", "confidence")


@query(f"""{_SCORED}, b AS (SELECT *, {_TIER} AS conf FROM c),
    f AS (SELECT left_id, conf AS first_confidence FROM b WHERE candidate_rank = 2), g AS (SELECT left_id, conf AS second_confidence FROM b WHERE candidate_rank = 1 AND length(left_id) % 2 = 0),
    j AS (SELECT lt.id AS left_id, first_confidence, second_confidence, coalesce(first_confidence, 'review') IN ('low', 'review') AS weak, coalesce(second_confidence, '') IN ('medium', 'high') AS strong
          FROM lt LEFT JOIN f ON f.left_id = lt.id LEFT JOIN g ON g.left_id = lt.id)
    SELECT left_id, first_confidence, second_confidence, CASE WHEN weak AND NOT strong THEN 'pending' ELSE 'auto_accept' END AS review_status, CASE WHEN strong THEN 'branded_or_packaged' ELSE 'generic_or_recipe' END AS identity_type,
           CASE WHEN strong AND weak THEN 'second layer is strong' WHEN strong THEN 'both layers are acceptable' WHEN weak THEN 'first layer is weak or ambiguous' ELSE 'first layer is acceptable' END AS review_reason FROM j""")
def hitl_routing(spark, d):
    """Second-best candidates as one layer, best ones of some names as the other."""
    c = _candidates(spark, d).withColumn("conf", text.confidence_tier(F.col("match_score")))
    first = c.where("candidate_rank = 2").select("left_id", F.col("conf").alias("first_confidence"))
    second = c.where("candidate_rank = 1 and length(left_id) % 2 = 0").select("left_id", F.col("conf").alias("second_confidence"))
    return fuse.routed(_left(spark, d).select(F.col("id").alias("left_id")).join(first, "left_id", "left").join(second, "left_id", "left"))


@query(f"""{_SCORED}, fix AS (SELECT DISTINCT p_name AS left_id, 'human' AS right_id FROM part WHERE p_partkey % 50 = 0)
    SELECT left_id, right_id, match_score, candidate_rank FROM c WHERE left_id NOT IN (SELECT left_id FROM fix) UNION ALL SELECT left_id, right_id, NULL, 0 FROM fix""")
def human_override_mapping(spark, d):
    """J24 J08."""
    fix = read(spark, d, "part").where("p_partkey % 50 = 0").select(F.col("p_name").alias("left_id"), F.lit("human").alias("right_id")).distinct()
    return match.overridden(_candidates(spark, d).select("left_id", "right_id", "match_score", "candidate_rank"), fix, "left_id")


@query(f"""
    WITH a AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id::VARCHAR END AS code, md5(text) AS name FROM documents), b AS (SELECT doc_id AS id, doc_id::VARCHAR AS code, md5(text) AS name FROM documents WHERE doc_id % 2 = 0),
    one AS (SELECT a.id AS left_id, b.id AS right_id, 1 AS tier FROM a JOIN b USING (code)), two AS (SELECT a.id, b.id, 2 FROM a JOIN b USING (name) WHERE a.id NOT IN (SELECT left_id FROM one))
    SELECT * FROM one UNION ALL SELECT * FROM two""")
def tiered_fallback_join(spark, d):
    """By code, and only without one by text."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("code"), F.md5(F.col("text").cast("binary")).alias("name"))
    left = docs.withColumn("code", F.when(F.col("id") % 3 != 0, F.col("code")))
    return match.tiered(left, docs.where("id % 2 = 0"), [("code", "code"), ("name", "name")])


@query(f"""
    WITH a AS (SELECT DISTINCT p_partkey AS id, {_NORM.format('p_name')} AS norm FROM part), b AS (SELECT DISTINCT p_brand AS id, {_NORM.format('upper(p_name)')} AS norm FROM part)
    SELECT DISTINCT a.id AS left_id, b.id AS right_id FROM a JOIN b USING (norm) WHERE norm <> ''""")
def exact_name_links(spark, d):
    """J16 U05."""
    p = read(spark, d, "part")
    return match.exact_links(p.select(F.col("p_partkey").alias("id"), text.normalize(F.col("p_name"), True).alias("norm")), p.select(F.col("p_brand").alias("id"), text.normalize(F.upper("p_name"), True).alias("norm")))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi_join_filter(spark, d):
    """J07."""
    return read(spark, d, "customer").join(read(spark, d, "orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_join_reviewed(spark, d):
    """J08."""
    return read(spark, d, "customer").join(read(spark, d, "orders").where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""
    WITH a AS (SELECT l_partkey AS item, count(*) AS n_lines FROM lineitem GROUP BY 1), b AS (SELECT l_partkey AS item, count(*) AS n_returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), c AS (SELECT p_partkey AS item, p_size FROM part WHERE p_partkey % 2 = 0)
    SELECT item, n_lines, n_returned, p_size FROM a FULL JOIN b USING (item) FULL JOIN c USING (item)""")
def full_outer_fold(spark, d):
    """Three aggregates by item."""
    l = read(spark, d, "lineitem").withColumnRenamed("l_partkey", "item")  # noqa: E741
    a, b = l.groupBy("item").agg(F.count(F.lit(1)).alias("n_lines")), l.where("l_returnflag = 'R'").groupBy("item").agg(F.count(F.lit(1)).alias("n_returned"))
    c = read(spark, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("item"), "p_size")
    return a.join(b, "item", "full").join(c, "item", "full")


@query("SELECT doc_id, quality, toxic, source FROM labels JOIN documents USING (doc_id)")
def checked_one_to_one_join(spark, d):
    """Fails on repeated keys."""
    return quality.checked_join(read(spark, d, "labels"), read(spark, d, "documents").select("doc_id", "source"), ["doc_id"])


# Fusion and provenance

_MASKED = "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice END"


@query(f"""
    {_LOGS} SELECT canonical_id, round(CASE WHEN sum(CASE WHEN v IS NOT NULL THEN w END) > 0 THEN sum(v * w) / sum(CASE WHEN v IS NOT NULL THEN w END) ELSE avg(v) END, 4) AS price, count(v) AS n
    FROM (SELECT canonical_id, {_MASKED} AS v, CASE WHEN item % 5 = 0 THEN 1.0 ELSE logs::DOUBLE END AS w FROM i JOIN part ON item = p_partkey) GROUP BY canonical_id""")
def weighted_mean_nutrients(spark, d):
    """Null weights count 1; null and NaN values go."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("item"), F.when(F.col("p_partkey") % 6 == 3, F.lit(float("nan"))).when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice")).alias("v"))
    i = _logged(spark, d).join(p, "item").withColumn("w", F.when(F.col("item") % 5 != 0, F.col("logs")))
    mean, n = fuse.weighted_mean("v", "w")
    return i.groupBy("canonical_id").agg(r(mean).alias("price"), n.alias("n"))


_MAPPED = "SELECT l_partkey AS item, 'price' AS feature, avg(l_extendedprice) AS value FROM lineitem GROUP BY 1"


def _observed(spark, d):
    return read(spark, d, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("item"), F.lit("price").alias("feature"), F.col("p_retailprice").alias("value"))


def _mapped(spark, d):
    return read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg(F.avg("l_extendedprice").alias("value")).withColumn("feature", F.lit("price"))


@query(f"""
    WITH o AS (SELECT p_partkey AS item, 'price' AS feature, p_retailprice AS value FROM part WHERE p_partkey % 3 <> 0), m AS ({_MAPPED})
    SELECT item, feature, round(coalesce(o.value, m.value) + 1e-7, 2) AS value, CASE WHEN o.value IS NOT NULL THEN 'observed' ELSE 'mapped' END AS method FROM o FULL JOIN m USING (item, feature) WHERE coalesce(o.value, m.value) IS NOT NULL""")
def impute_with_provenance(spark, d):
    """A07-A10."""
    return fuse.imputed(_observed(spark, d), _mapped(spark, d), ["item", "feature"]).withColumn("value", r(F.col("value") + 1e-7, 2))


@query(f"""
    WITH m AS ({_MAPPED}) SELECT p_partkey AS item, round(coalesce({_MASKED}, value) + 1e-7, 2) AS price, CASE WHEN {_MASKED} IS NOT NULL THEN 'observed' WHEN value IS NOT NULL THEN 'mapped' ELSE 'missing' END AS price_source
    FROM part LEFT JOIN m ON item = p_partkey""")
def scenario_hybrid_coalesce(spark, d):
    """A10 P22 P23."""
    m = _mapped(spark, d).select("item", F.col("value").alias("mapped"))
    p = read(spark, d, "part").select(F.col("p_partkey").alias("item"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice")).alias("observed")).join(m, "item", "left")
    return fuse.hybrid(p, "observed", "mapped", "price").select("item", r(F.col("price") + 1e-7, 2).alias("price"), "price_source")


@query(f"""
    WITH m AS ({_MAPPED}), t AS (SELECT CASE WHEN {_MASKED} IS NOT NULL THEN 'observed' WHEN value IS NOT NULL THEN 'mapped' ELSE 'missing' END AS price_source FROM part LEFT JOIN m ON item = p_partkey)
    SELECT price_source, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM t), 6) AS share FROM t GROUP BY price_source""")
def provenance_summary_share(spark, d):
    """A37."""
    return quality.share_table(scenario_hybrid_coalesce(spark, d), ["price_source"]).withColumn("share", r("share", 6))


@query("""
    SELECT p_type AS category, arg_max(conf, CASE conf WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'review' THEN 2 ELSE 1 END) AS best, any_value(brand) AS brand
    FROM (SELECT p_type, CASE WHEN p_size > 45 THEN 'high' WHEN p_size > 30 THEN 'medium' WHEN p_size > 10 THEN 'low' ELSE 'review' END AS conf FROM part) a
    JOIN (SELECT p_type AS t, p_brand AS brand FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) AS rn FROM (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL)) WHERE rn = 1) b ON p_type = t GROUP BY p_type""")
def mode_and_best_confidence(spark, d):
    """A07 A08."""
    p = read(spark, d, "part").withColumnRenamed("p_type", "category")
    conf = F.when(F.col("p_size") > 45, "high").when(F.col("p_size") > 30, "medium").when(F.col("p_size") > 10, "low").otherwise("review")
    return p.withColumn("conf", conf).groupBy("category").agg(fuse.best_confidence("conf").alias("best")).join(fuse.mode_text("p_brand", p, ["category"]).withColumnRenamed("p_brand", "brand"), "category")


@query("""
    WITH g AS (SELECT p_partkey AS item, f.feature, CASE WHEN f.feature = 'a' AND p_partkey % 4 <> 0 THEN p_size::DOUBLE WHEN f.feature = 'b' AND p_partkey % 2 = 0 THEN p_retailprice END AS own,
                      CASE WHEN f.feature = 'a' AND (p_partkey + 1) % 4 <> 0 THEN lead(p_size) OVER (PARTITION BY f.feature ORDER BY p_partkey)::DOUBLE WHEN f.feature = 'b' AND (p_partkey + 1) % 2 = 0 THEN lead(p_retailprice) OVER (PARTITION BY f.feature ORDER BY p_partkey) END AS other
               FROM part, (VALUES ('a'), ('b'), ('c')) f(feature))
    SELECT feature, count(coalesce(own, other * 0.5)) AS n_known, count(*) AS n_items, CASE WHEN count(coalesce(own, other * 0.5)) = count(*) THEN 'included' ELSE 'completion_pending' END AS status, round(coalesce(sum(coalesce(own, other * 0.5)), 0), 2) AS total FROM g GROUP BY feature""")
def catalog_coverage_registry(spark, d):
    """Each item's own amount, or half its neighbour's."""
    p = read(spark, d, "part")
    a = p.where("p_partkey % 4 <> 0").select(F.lit("a").alias("feature"), F.col("p_partkey").alias("donor"), F.col("p_size").cast("double").alias("amount"))
    b = p.where("p_partkey % 2 = 0").select(F.lit("b").alias("feature"), F.col("p_partkey").alias("donor"), F.col("p_retailprice").alias("amount"))
    its = p.select(F.col("p_partkey").alias("item"), F.col("p_partkey").alias("primary_id"), (F.col("p_partkey") + 1).alias("proxy_id"), F.lit(0.5).alias("ratio"))
    cells = fuse.coverage_registry(spark.createDataFrame([("a",), ("b",), ("c",)], "feature string"), its, a.unionByName(b))
    totals = cells.groupBy("feature").agg(r(F.coalesce(F.sum("value"), F.lit(0.0)), 2).alias("total"))
    return fuse.registry_status(cells).join(totals, "feature")


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n, round(avg(l_quantity), 4) AS mean_quantity, round(min(l_quantity), 4) AS least_quantity FROM lineitem GROUP BY ALL""")
def duplicate_policy_mean(spark, d):
    """Repeated keys averaged."""
    return read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), r(F.avg("l_quantity")).alias("mean_quantity"), r(F.min("l_quantity")).alias("least_quantity"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem) WHERE rn = 1""")
def duplicate_policy_first(spark, d):
    """The first row of repeated keys."""
    return windows.first_of(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), ["l_orderkey", "l_linenumber"], [F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")])


# Pivots, lists, text rules


@query("""
    SELECT l_partkey, """ + ", ".join(f"round(avg(l_quantity) FILTER (l_returnflag || '_' || l_linestatus = '{x}'), 4) AS {x}" for x in ("A_F", "A_O", "N_F", "N_O", "R_F", "R_O")) + " FROM lineitem GROUP BY l_partkey")
def pivot_mean_wide(spark, d):
    """A26."""
    values = ["A_F", "A_O", "N_F", "N_O", "R_F", "R_O"]
    out = features.pivot_mean(read(spark, d, "lineitem").withColumn("k", F.concat_ws("_", "l_returnflag", "l_linestatus")), ["l_partkey"], "k", "l_quantity", values)
    return out.select("l_partkey", *(r(v).alias(v) for v in values))


_EDGES = f"""edges AS (
    SELECT 'part:' || p_partkey AS source, {_CANON} AS target, 'is_a' AS relation, NULL::DOUBLE AS value FROM part UNION ALL SELECT 'part:' || p_partkey, 'brand:' || p_brand, 'has_brand', NULL FROM part
    UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'supplied_by', sum(l_quantity) FROM lineitem GROUP BY l_partkey, l_suppkey
    UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'in_nation', NULL FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'in_region', NULL FROM nation)"""
_NODES = f"""nodes AS (
    SELECT 'part:' || p_partkey AS key, 'part' AS kind, p_name AS label FROM part UNION SELECT {_CANON}, 'canonical', {_CANON} FROM part UNION SELECT 'brand:' || p_brand, 'brand', p_brand FROM part
    UNION SELECT 'supplier:' || s_suppkey, 'supplier', s_name FROM supplier UNION SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation UNION SELECT 'region:' || r_regionkey, 'region', r_name FROM region)"""


def edges(spark, d) -> DataFrame:
    """A20 A21 C16."""
    p, c = read(spark, d, "part"), canonical(spark, d)
    key = text.node_key
    none = F.lit(None).cast("double").alias("value")
    lines = read(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    supplied = spread(lines, lines.count(), "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").cast("double").alias("value"))
    s, n = read(spark, d, "supplier"), read(spark, d, "nation")
    pick = lambda df, a, b, rel, v=none: df.select(a.alias("source"), b.alias("target"), F.lit(rel).alias("relation"), v)
    return graph.union_edges(
        pick(c, key("part", F.col("item")), F.col("canonical_id"), "is_a"), pick(p, key("part", F.col("p_partkey")), key("brand", F.col("p_brand")), "has_brand"),
        pick(supplied, key("part", F.col("l_partkey")), key("supplier", F.col("l_suppkey")), "supplied_by", F.col("value")),
        pick(s, key("supplier", F.col("s_suppkey")), key("nation", F.col("s_nationkey")), "in_nation"), pick(n, key("nation", F.col("n_nationkey")), key("region", F.col("n_regionkey")), "in_region"),
    )


def nodes(spark, d) -> DataFrame:
    """A18 C16."""
    key = text.node_key
    pick = lambda df, k, kind, label: df.select(k.alias("key"), F.lit(kind).alias("kind"), F.col(label).alias("label"))
    p, c = read(spark, d, "part"), canonical(spark, d)
    all_of = graph.union_edges(
        pick(p, key("part", F.col("p_partkey")), "part", "p_name"), pick(c, F.col("canonical_id"), "canonical", "canonical_id"), pick(p, key("brand", F.col("p_brand")), "brand", "p_brand"),
        pick(read(spark, d, "supplier"), key("supplier", F.col("s_suppkey")), "supplier", "s_name"), pick(read(spark, d, "nation"), key("nation", F.col("n_nationkey")), "nation", "n_name"), pick(read(spark, d, "region"), key("region", F.col("r_regionkey")), "region", "r_name"),
    )
    return all_of.distinct()


@query(f"WITH {_EDGES} SELECT source, target, relation, round(value, 2) AS value FROM edges")
def kg_edges(spark, d):
    """A20."""
    return edges(spark, d).withColumn("value", r("value", 2))


@query(f"WITH {_NODES} SELECT * FROM nodes")
def kg_nodes(spark, d):
    """A18."""
    return nodes(spark, d)


@query("""
    WITH v AS (SELECT 'part:' || p_partkey AS key, p_name AS label, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS brand, 1 AS seq FROM part UNION ALL SELECT 'part:' || p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'late ' || p_name END, CASE WHEN p_partkey % 3 = 0 THEN 'late ' || p_brand END, 2 FROM part)
    SELECT key, arg_max(label, seq) FILTER (label IS NOT NULL) AS label, arg_max(brand, seq) FILTER (brand IS NOT NULL) AS brand FROM v GROUP BY key""")
def kg_upsert_merge(spark, d):
    """Later attributes win where they are not null."""
    p = read(spark, d, "part").withColumn("key", text.node_key("part", F.col("p_partkey")))
    a = p.select("key", F.col("p_name").alias("label"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("brand"), F.lit(1).alias("seq"))
    b = p.select("key", F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("late "), "p_name")).alias("label"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("late "), "p_brand")).alias("brand"), F.lit(2).alias("seq"))
    return graph.upsert_nodes(a.unionByName(b), "key", "seq")


@query(f"WITH {_EDGES}, {_NODES} SELECT a.kind AS source_kind, relation, b.kind AS target_kind, count(*) AS n FROM edges JOIN nodes a ON source = a.key JOIN nodes b ON target = b.key GROUP BY ALL")
def kg_schema_counts(spark, d):
    """A50."""
    return graph.schema_counts(nodes(spark, d), edges(spark, d))


_INFO = f"""WITH {_EDGES}, cat AS (SELECT 'part:' || p_partkey AS source, p_type AS category FROM part), bg AS (SELECT category, count(DISTINCT source) AS b FROM cat GROUP BY 1), tot AS (SELECT count(DISTINCT source) AS n_sources, count(DISTINCT category) AS n_categories FROM cat),
    cnt AS (SELECT relation, target, category, count(DISTINCT source) AS n FROM (SELECT DISTINCT source, target, relation FROM edges) JOIN cat USING (source) GROUP BY ALL),
    t AS (SELECT *, n / sum(n) OVER (PARTITION BY relation, target)::DOUBLE AS p, greatest(b / n_sources::DOUBLE, 1e-12) AS q FROM cnt JOIN bg USING (category), tot),
    i0 AS (SELECT relation, target, sum(n)::BIGINT AS prevalence, max(n_sources) AS n_sources, max(n_categories) AS n_categories, sum(-p * ln(p)) AS entropy, sum(-p * ln(q)) AS cross_entropy, sum(p * ln(p / q)) AS divergence FROM t GROUP BY ALL),
    i1 AS (SELECT *, ln((n_sources + 1)::DOUBLE / (prevalence + 1)) + 1 AS idf, greatest(0, 1 - (CASE WHEN n_categories > 1 THEN entropy / ln(n_categories) ELSE 0 END)) AS specificity FROM i0),
    info AS (SELECT *, idf * specificity AS idf_entropy, idf * specificity * ln(1 + greatest(divergence, 0)) AS idf_entropy_divergence FROM i1),
    weighted AS (SELECT source, target, relation, value, coalesce(value, 1) * coalesce(idf_entropy, 0) AS weighted_value FROM edges LEFT JOIN info USING (relation, target))"""


def _information(spark, d, e=None):
    cats = read(spark, d, "part").select(text.node_key("part", F.col("p_partkey")).alias("source"), F.col("p_type").alias("category"))
    return graph.node_information(written(edges(spark, d)) if e is None else e, cats)


def _weighted(spark, d):
    e = written(edges(spark, d))  # read for the information and for the weights
    return graph.weighted_edges(e, _information(spark, d, e), "idf_entropy")


_INFO_COLUMNS = ("entropy", "cross_entropy", "divergence", "idf", "specificity", "idf_entropy", "idf_entropy_divergence")


@query(f"{_INFO} SELECT relation, target, prevalence, {', '.join(f'round({c}, 6) AS {c}' for c in _INFO_COLUMNS)} FROM info")
def kg_node_information(spark, d):
    """A22 W11 M04 C17."""
    return _information(spark, d).select("relation", "target", "prevalence", *(r(c, 6).alias(c) for c in _INFO_COLUMNS))


@query(f"{_INFO} SELECT source, target, relation, round(weighted_value, 4) AS weighted_value FROM weighted")
def kg_weighted_edges(spark, d):
    """A23."""
    return _weighted(spark, d).select("source", "target", "relation", r("weighted_value").alias("weighted_value"))


@query(f"""{_INFO}, w AS (SELECT source, round(weighted_value, 6) AS x FROM weighted),
    cuts AS (""" + " UNION ALL ".join(f"SELECT {q}::DOUBLE AS quantile, quantile_cont(x, {q}) AS threshold FROM w" for q in (0.5, 0.75, 0.9, 0.95, 0.975, 0.99)) + """),
    per AS (SELECT quantile, threshold, source, count(*) AS n FROM w JOIN cuts ON x >= threshold GROUP BY ALL),
    o AS (SELECT quantile, threshold, sum(n)::BIGINT AS edges_retained, count(*) AS sources_covered, quantile_cont(n, 0.5) AS median_edges, quantile_cont(n, 0.1) AS p10_edges FROM per GROUP BY quantile, threshold),
    b AS (SELECT coalesce(max(quantile) FILTER (sources_covered >= 0.95 * (SELECT count(DISTINCT source) FROM w) AND median_edges >= 20), 0.9) AS best FROM o)
    SELECT quantile, round(threshold, 4) AS threshold, edges_retained, round(edges_retained / (SELECT count(*) FROM w)::DOUBLE, 6) AS retained_fraction, sources_covered, round(median_edges, 4) AS median_edges, round(p10_edges, 4) AS p10_edges, quantile = best AS recommended FROM o, b""")
def kg_threshold_summary(spark, d):
    """A24 N27 G07."""
    out = graph.threshold_summary(_weighted(spark, d).withColumn("weighted_value", r("weighted_value", 6)))
    return out.select("quantile", r("threshold").alias("threshold"), "edges_retained", r("retained_fraction", 6).alias("retained_fraction"), "sources_covered", r("median_edges").alias("median_edges"), r("p10_edges").alias("p10_edges"), "recommended")


@query(f"""{_INFO}, w AS (SELECT source, target, relation, round(weighted_value, 6) AS x FROM weighted)
    SELECT source, target, relation, x AS weighted_value, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY x DESC, relation, target)::INTEGER AS rank FROM w) WHERE rank <= 25""")
def kg_top_signatures(spark, d):
    """G10 W01."""
    return graph.signatures(_weighted(spark, d).withColumn("weighted_value", r("weighted_value", 6))).select("source", "target", "relation", "weighted_value", "rank")


@query(f"""{_INFO}, w AS (SELECT source, relation || '=' || target AS feature, round(weighted_value, 4) AS x FROM weighted), top AS (SELECT feature FROM w GROUP BY feature ORDER BY round(sum(x), 2) DESC, feature LIMIT 50)
    SELECT source, feature, round(sum(x), 4) AS value FROM w WHERE feature IN (FROM top) GROUP BY ALL""")
def kg_signature_matrix(spark, d):
    """The 50 features of most weight."""
    w = written(_weighted(spark, d).select("source", F.concat_ws("=", "relation", "target").alias("feature"), r("weighted_value").alias("x")))  # read for the features and for their values
    top = w.groupBy("feature").agg(r(F.sum("x"), 2).alias("t")).orderBy(F.desc("t"), "feature").limit(50).select("feature")
    return spread(w.join(F.broadcast(top), "feature", "left_semi"), w.count(), "source").groupBy("source", "feature").agg(r(F.sum("x")).alias("value"))


@query(f"""WITH {_EDGES}, p AS (SELECT source, regexp_replace(target, '[^a-zA-Z0-9]+', '_', 'g') AS t FROM edges WHERE relation = 'has_brand')
    SELECT source, {', '.join(f"count(*) FILTER (lower(t) = 'brand_brand_{i}')::DOUBLE AS brand_brand_{i}" for i in range(1, 26))} FROM p GROUP BY source""")
def kg_feature_pivot(spark, d):
    """A27 F09, over the 25 brand nodes."""
    e = edges(spark, d).where("relation = 'has_brand'").withColumn("value", F.coalesce("value", F.lit(1.0)))
    out = features.pivot_sum(e, ["source"], "target", "value")
    wanted = [f"brand_brand_{i}" for i in range(1, 26)]
    return out.select("source", *(F.col(c) if c in out.columns else F.lit(0.0).alias(c) for c in wanted))


@query(f"""WITH RECURSIVE {_EDGES}, capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, relation ORDER BY target) AS rn FROM edges) WHERE rn <= 5),
    h1 AS (SELECT source, target, relation, 1 AS hop FROM capped WHERE source = 'part:1'), h2 AS (SELECT source, target, relation, 2 AS hop FROM capped WHERE source IN (SELECT target FROM h1)), h3 AS (SELECT source, target, relation, 3 AS hop FROM capped WHERE source IN (SELECT target FROM h2))
    SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3""")
def ego_subgraph(spark, d):
    """Three hops around one item, five edges a relation."""
    return graph.ego(edges(spark, d), spark.createDataFrame([("part:1",)], "key string"), 3, 5).select("source", "target", "relation", "hop")


@query(f"""WITH {_EDGES} SELECT a.source, count(DISTINCT a.target) AS n_middle, count(DISTINCT b.target) AS n_end, count(*) AS n_paths FROM edges a JOIN edges b ON a.target = b.source WHERE a.relation = 'supplied_by' GROUP BY a.source""")
def two_hop_disease_counts(spark, d):
    """Item, supplier, nation."""
    e = written(edges(spark, d))
    return graph.path_counts(e.where("relation = 'supplied_by'"), e)


@query(f"""WITH {_EDGES}, {_NODES} SELECT source, target, relation, coalesce(a.label, source) AS source_label, coalesce(b.kind, 'unknown') AS target_kind FROM edges LEFT JOIN nodes a ON source = a.key LEFT JOIN nodes b ON target = b.key AND b.kind <> 'brand'""")
def edge_label_enrichment(spark, d):
    """With defaults for nodes that are missing."""
    n = nodes(spark, d)
    a = graph.labelled(edges(spark, d), n).select("source", "target", "relation", "source_label")
    kinds = n.where("kind <> 'brand'").select(F.col("key").alias("target"), F.col("kind").alias("target_kind"))
    return a.join(kinds, "target", "left").select("source", "target", "relation", "source_label", F.coalesce("target_kind", F.lit("unknown")).alias("target_kind"))


@query("SELECT user_id, event_type, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type)::INTEGER AS rank FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE rank <= 3")
def top_labels_per_group(spark, d):
    """T03 N11."""
    return graph.top_labels(read(spark, d, "events"), ["user_id"], "event_type", 3)


@query(f"""
    WITH t AS (SELECT lang, unnest(string_split({_NORM.format('text')}, ' ')) AS token FROM documents), n AS (SELECT lang, token, count(*) AS n, token IN ('the', 'of', 'and', 'de', 'la', 'der', 'die') AS is_generic FROM t WHERE token <> '' GROUP BY ALL)
    SELECT lang, token, n, is_generic, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY is_generic, n DESC, token)::INTEGER AS rank FROM n) WHERE rank <= 20""")
def informative_topk(spark, d):
    """The commonest words of each language, generic ones last."""
    t = read(spark, d, "documents").select("lang", F.explode(F.split(text.normalize(F.col("text")), " ")).alias("token")).where("token <> ''")
    n = t.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))
    return graph.informative(n, ["lang"], "token", "n", ["the", "of", "and", "de", "la", "der", "die"], 20).select("lang", "token", "n", "is_generic", "rank")


@query("""SELECT l_returnflag AS theme, count(*) AS n, round(sum(CASE WHEN x IS NULL THEN 1.0 WHEN x <= 0 THEN 0.25 ELSE 1 + least(ln(1 + x), 8) END), 2) AS weight
    FROM (SELECT l_returnflag, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_discount = 0 THEN 0 ELSE l_quantity END::DOUBLE AS x FROM lineitem) GROUP BY 1""")
def evidence_weighted_themes(spark, d):
    """A16."""
    x = F.when(F.col("l_linenumber") == 7, None).when(F.col("l_discount") == 0, F.lit(0.0)).otherwise(F.col("l_quantity").cast("double"))
    return read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("theme")).agg(F.count(F.lit(1)).alias("n"), r(F.sum(graph.evidence_weight(x)), 2).alias("weight"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)licen[cs]e|copyright') THEN 'legal' WHEN regexp_matches(text, '(?i)password|secret|token') THEN 'credentials' WHEN regexp_matches(text, '(?i)@[a-z0-9-]+\\.') THEN 'contact' ELSE lang END AS category FROM documents""")
def rule_categorise(spark, d):
    """Ordered rules over whole texts."""
    rules = [(r"licen[cs]e|copyright", "legal"), (r"password|secret|token", "credentials"), (r"@[a-z0-9-]+\.", "contact")]
    return read(spark, d, "documents").select("doc_id", fuse.categorised(F.col("text"), rules, F.col("lang")).alias("category"))


@query("""WITH c AS (SELECT p_partkey, p_name || ',' || p_type || ': x|' || p_brand || ' | ' || p_name AS s FROM part),
    p AS (SELECT p_partkey, list_transform(regexp_split_to_array(s, '[|,]'), lambda x: trim(string_split(x, ':')[1])) AS l FROM c), f AS (SELECT p_partkey, list_filter(l, lambda x: x <> '') AS l FROM p),
    u AS (SELECT p_partkey, l[1] AS a, l FROM f), o AS (SELECT p_partkey, unnest(l) AS label, generate_subscripts(l, 1) AS i FROM u), g AS (SELECT p_partkey, label, min(i) AS i FROM o GROUP BY ALL)
    SELECT p_partkey, label, (row_number() OVER (PARTITION BY p_partkey ORDER BY i) - 1)::INTEGER AS pos FROM g""")
def compact_list_explode(spark, d):
    """F12 R01 N14."""
    s = F.concat("p_name", F.lit(","), "p_type", F.lit(": x|"), "p_brand", F.lit(" | "), "p_name")
    return read(spark, d, "part").select("p_partkey", F.posexplode(text.compact_list(s)).alias("pos", "label"))


@query("SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag || l_linestatus)), ' | ') AS flags, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def pipe_join_sorted(spark, d):
    """F11 R02 R03."""
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(text.pipe_join(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("flags"), F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_-]+'), lambda x: length(x) >= 3)) AS token FROM documents), c AS (SELECT doc_id, token, count(*) AS n FROM t GROUP BY ALL)
    SELECT doc_id, (('0x' || right(md5(token), 7))::BIGINT % 64)::INTEGER AS dim, round(sum(CASE WHEN ('0x' || right(md5('sign:' || token), 1))::INT % 2 = 1 THEN -1 ELSE 1 END * ln(1 + n)), 5) AS value FROM c GROUP BY ALL""")
def hash_text_block(spark, d):
    """F18 F19."""
    return vectors.hashed_text(read(spark, d, "documents"), "doc_id", "text").withColumn("value", r("value", 5))


@query("""WITH l AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice END AS a, p_size AS b FROM part), m AS (SELECT quantile_cont(a, 0.5) AS ma, quantile_cont(b, 0.5) AS mb FROM l),
    f AS (SELECT p_partkey, ln(1 + greatest(coalesce(a, ma), 0)) AS a, ln(1 + greatest(coalesce(b, mb), 0)) AS b FROM l, m), s AS (SELECT avg(a) AS xa, avg(b) AS xb, coalesce(nullif(stddev_samp(a), 0), 1) AS sa, coalesce(nullif(stddev_samp(b), 0), 1) AS sb FROM f)
    SELECT p_partkey, round((a - xa) / sa / sqrt(2), 6) AS price, round((b - xb) / sb / sqrt(2), 6) AS size FROM f, s""")
def numeric_block_scaled(spark, d):
    """M01 W09 N21 N22."""
    p = read(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice")).alias("price"), F.col("p_size").alias("size"))
    return vectors.numeric_block(p, "p_partkey", ["price", "size"]).select("p_partkey", r("price", 6).alias("price"), r("size", 6).alias("size"))


# Vectors. Queries are the vectors whose id is divisible by 20, against all.

_COS = "WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 20 = 0), b AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), s AS (SELECT q.vec_id AS query_id, b.vec_id AS base_id, q.label AS ql, b.label AS bl, round(list_cosine_similarity(q.v, b.v), 9) AS cosine FROM q, b WHERE q.vec_id <> b.vec_id)"


def _queries(spark, d):
    e = read(spark, d, "embeddings")
    return e.where("vec_id % 20 = 0"), e


@query(f"{_COS} SELECT query_id, base_id, round(cosine, 6) AS cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, base_id)::INTEGER AS rank FROM s) WHERE rank <= 8")
def vector_cosine_topk(spark, d):
    """J14 T05 M03."""
    q, e = _queries(spark, d)
    return vectors.nearest(q, e, 8).select("query_id", "base_id", r("cosine", 6).alias("cosine"), "rank")


@query(f"{_COS} SELECT query_id, base_id, bl::VARCHAR AS base_group, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, base_id) AS rn FROM s WHERE ql <> bl) WHERE rn = 1")
def nearest_donor_by_label(spark, d):
    """The nearest vector of another label."""
    q, e = _queries(spark, d)
    return vectors.nearest(q, e, 1, group="label", skip_same_group=True).select("query_id", "base_id", "base_group", r("cosine", 6).alias("cosine"))


@query(f"""{_COS}, a AS (SELECT query_id, base_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, base_id) AS rn FROM s) WHERE rn <= 8), b2 AS (SELECT query_id, base_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id, bl ORDER BY cosine DESC, base_id) AS rn FROM s) WHERE rn <= 3), u AS (FROM a UNION FROM b2)
    SELECT query_id, base_id, round(cosine, 6) AS cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, base_id)::INTEGER AS rank FROM u""")
def source_balanced_retrieval(spark, d):
    """J15 W10."""
    q, e = _queries(spark, d)
    return vectors.balanced(q, e, 8, 3, "label").select("query_id", "base_id", r("cosine", 6).alias("cosine"), "rank")


@query(f"""WITH e AS ({_EVENTS}), n AS (SELECT count(*) AS n FROM embeddings), g AS (SELECT participant, item % n AS vec, sum(grams) AS g FROM e, n GROUP BY ALL), u AS (SELECT participant, g, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM g JOIN embeddings ON vec_id = vec)
    SELECT participant, dim::INTEGER AS dim, round(sum(v * g) / sum(g), 5) AS value FROM u GROUP BY ALL""")
def weighted_mean_embedding(spark, d):
    """Items take vectors by their number."""
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("item"), "embedding")
    n = v.agg(F.count(F.lit(1)).alias("n"))
    e = events(spark, d).crossJoin(F.broadcast(n)).withColumn("item", F.col("item") % F.col("n"))  # one row
    return features.vector_mean(e, v, ["participant"]).select("participant", "dim", r("value", 5).alias("value"))


@query()
def pca_projection(spark, d):
    """V02."""
    return vectors.pca(read(spark, d, "embeddings"), "vec_id", "embedding").select("vec_id", r("pc1", 6).alias("pc1"), r("pc2", 6).alias("pc2"))


@query()
def kmeans_clusters(spark, d):
    """V03."""
    return vectors.kmeans(read(spark, d, "embeddings"), "vec_id", "embedding", 8)


@query()
def cluster_patterns(spark, d):
    """A31."""
    return vectors.cluster_patterns(kmeans_clusters(spark, d), read(spark, d, "embeddings"), "vec_id", "label")


# Quality


_PROFILED = {"part": ["p_retailprice", "p_size"], "orders": ["o_totalprice", "o_custkey"]}


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count({c}) AS n_present, count(*) FILTER ({c} IS NULL) AS n_missing, count(*) FILTER ({c} = 0) AS n_zero, count(DISTINCT {c}) AS n_distinct, round(min({c})::DOUBLE, 4) AS least, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median, round(max({c})::DOUBLE, 4) AS largest, '{t}' AS table_name FROM {t}" for t, cs in _PROFILED.items() for c in cs))
def column_profile(spark, d):
    """A32 C28."""
    out = readers.union_all([quality.profile(read(spark, d, t), cs, t) for t, cs in _PROFILED.items()])
    return out.withColumns({c: r(c) for c in ("least", "median", "largest")})


_PANEL = """WITH a AS (SELECT p_partkey AS item, 'price' AS feature, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice END AS value FROM part UNION ALL SELECT p_partkey, 'size', CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_size END FROM part),
    b AS (SELECT p_partkey AS item, 'price' AS feature, p_retailprice + CASE WHEN p_partkey % 7 = 0 THEN 0.01 ELSE 0 END AS value FROM part UNION ALL SELECT p_partkey, 'size', CASE WHEN p_partkey % 7 = 0 THEN p_size + 0.01 ELSE p_size END FROM part WHERE p_partkey % 11 <> 0)"""


def _panels(spark, d):
    p = read(spark, d, "part").withColumnRenamed("p_partkey", "item")
    k, size = F.col("item"), F.col("p_size").cast("double")
    pick = lambda df, f, v: df.select("item", F.lit(f).alias("feature"), v.cast("double").alias("value"))
    a = pick(p, "price", F.when(k % 3 != 0, F.col("p_retailprice"))).unionByName(pick(p, "size", F.when(k % 4 == 0, 0.0).otherwise(size)))
    bump = F.when(k % 7 == 0, 0.01).otherwise(0.0)
    return a, pick(p, "price", F.col("p_retailprice") + bump).unionByName(pick(p.where(k % 11 != 0), "size", size + bump))


@query(f"""{_PANEL}, per AS (SELECT item, count(value) AS present, count(*) FILTER (value <> 0) AS nz, count(*) AS cells FROM a GROUP BY item)
    SELECT count(*) AS n_items, round(sum(present)::DOUBLE / sum(cells) * 100, 4) AS present_pct, round(sum(nz)::DOUBLE / sum(cells) * 100, 4) AS nonzero_pct, round(quantile_cont(nz, 0.5), 4) AS median_nonzero, round(quantile_cont(nz, 0.05), 4) AS p05_nonzero, round(quantile_cont(nz, 0.95), 4) AS p95_nonzero FROM per""")
def panel_coverage(spark, d):
    """A33 C30."""
    out = quality.panel_coverage(_panels(spark, d)[0])
    return out.select("n_items", *(r(c).alias(c) for c in out.columns[1:]))


@query(f"""{_PANEL}, j AS (SELECT feature, a.value AS x, b.value AS y, abs(a.value - b.value) AS dd FROM a JOIN b USING (item, feature) WHERE a.value IS NOT NULL AND b.value IS NOT NULL)
    SELECT feature, count(*) AS n, round(avg(dd), 4) AS mean_abs, round(quantile_cont(dd, 0.5), 4) AS median_abs, round(quantile_cont(dd, 0.95), 4) AS p95_abs, round(max(dd), 4) AS max_abs, round(avg(CASE WHEN y <> 0 THEN dd / abs(y) END), 4) AS mean_rel, round(avg((dd <= 1e-9 + 1e-9 * abs(y))::INT) * 100, 4) AS exact_pct FROM j GROUP BY feature""")
def panel_agreement(spark, d):
    """A34 M05 J04."""
    a, b = _panels(spark, d)
    out = quality.panel_agreement(a, b, ["item", "feature"], "feature")
    return out.select("feature", "n", *(r(c).alias(c) for c in out.columns[2:]))


@query(f"""{_PANEL}, j AS (SELECT a.item IS NOT NULL AND b.item IS NOT NULL AS shared, a.value IS NOT DISTINCT FROM b.value AS same FROM a FULL JOIN b ON a.item = b.item AND a.feature = b.feature)
    SELECT 'value' AS "column", count(*) FILTER (shared) AS n_shared, count(*) FILTER (shared AND same) AS n_equal, count(*) FILTER (NOT shared) AS n_one_sided FROM j""")
def compare_columns_nullsafe(spark, d):
    """A36 J25."""
    a, b = _panels(spark, d)
    return quality.compared(a, b, ["item", "feature"], ["value"])


@query(f"""{_SCORED}, t AS (SELECT *, {_TIER} AS confidence FROM c WHERE candidate_rank = 1)
    SELECT count(*) AS n, {', '.join(f"round(avg(CASE WHEN confidence = '{x}' THEN 100.0 ELSE 0.0 END), 2) AS {x}_pct" for x in ("high", "medium", "low", "review"))}, round(avg(match_score), 4) AS mean_score FROM t""")
def mapping_validation(spark, d):
    """A38."""
    return quality.mapping_summary(_candidates(spark, d).where("candidate_rank = 1").withColumn("confidence", text.confidence_tier(F.col("match_score"))))


@query("""WITH a AS (SELECT DISTINCT l_partkey AS item FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS item FROM lineitem WHERE l_linestatus = 'O')
    SELECT item, CASE WHEN a.item IS NULL THEN 'right_only' WHEN b.item IS NULL THEN 'left_only' ELSE 'both' END AS side FROM a FULL JOIN b USING (item)""")
def set_ops_names(spark, d):
    """U02 U03 U04."""
    l = read(spark, d, "lineitem").withColumnRenamed("l_partkey", "item")  # noqa: E741
    return windows.set_report(l.where("l_returnflag = 'R'"), l.where("l_linestatus = 'O'"), "item")


@query("""WITH n AS (SELECT user_id, event_type, count(*)::DOUBLE AS n FROM events GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS p FROM n)
    SELECT user_id, round(-sum(p * ln(p)), 6) AS shannon, round(1 - sum(p * p), 6) AS simpson, count(*) AS richness, sum(n)::BIGINT AS total FROM p GROUP BY user_id""")
def alpha_diversity(spark, d):
    """A41."""
    n = windows.shares(read(spark, d, "events"), ["user_id", "event_type"], ["user_id"], "p")
    return n.groupBy("user_id").agg(r(-F.sum(F.col("p") * F.ln("p")), 6).alias("shannon"), r(1 - F.sum(F.col("p") * F.col("p")), 6).alias("simpson"), F.count(F.lit(1)).alias("richness"), F.sum("n").alias("total"))


@query("SELECT l_orderkey, round(coalesce(sum(l_quantity) FILTER (l_returnflag IN ('A', 'R')), 0), 2) AS row_sum, 2 AS n_matched FROM lineitem GROUP BY l_orderkey")
def regex_column_rowsum(spark, d):
    """Over the columns that match."""
    wide = read(spark, d, "lineitem").groupBy("l_orderkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity")).withColumnsRenamed({"A": "flag_a", "N": "flag_n", "R": "flag_r"})
    import re

    cols = [c for c in wide.columns if re.search("flag_(a|r)$", c)]
    return wide.select("l_orderkey", r(sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0)), 2).alias("row_sum"), F.lit(len(cols)).alias("n_matched"))


@query("""SELECT vec_id, (row_number() OVER (ORDER BY label, vec_id) - 1)::BIGINT AS ordinal FROM embeddings""")
def global_ordinals(spark, d):
    """Numbered in order without one task."""
    return windows.numbered(read(spark, d, "embeddings").select("vec_id", "label"), ["label", "vec_id"]).select("vec_id", "ordinal")


@query("""WITH m AS (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY 1) SELECT conv_id, turn, role, length(text)::INTEGER AS n, (turn + 1)::BIGINT AS next_attempt FROM conversations JOIN m USING (conv_id, turn)""")
def latest_attempts(spark, d):
    """W04 W05."""
    c = read(spark, d, "conversations")
    return windows.latest(c, ["conv_id"], "turn").join(windows.next_attempt(c, ["conv_id"], "turn"), "conv_id").select("conv_id", "turn", "role", F.length("text").alias("n"), F.col("next_attempt").cast("long").alias("next_attempt"))


@query("SELECT page_id, regexp_replace(regexp_extract(url, '([^/\\\\]+)[/\\\\]*$', 1), '\\.[A-Za-z0-9]+$', '') AS stem FROM pages")
def url_stems(spark, d):
    """F21."""
    return read(spark, d, "pages").select("page_id", text.stem(F.col("url")).alias("stem"))


@query("SELECT p_partkey, p_name || ' | category: ' || p_type AS embedding_text, p_name || ' (' || p_brand || ')' AS label, lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', '_', 'g')) AS token, 2::INTEGER AS parts FROM part")
def text_labels(spark, d):
    """F09 F20 F22 F23."""
    p = read(spark, d, "part")
    return p.select("p_partkey", text.embedding_text(F.col("p_name"), F.col("p_type")).alias("embedding_text"), text.display_label(F.col("p_name"), F.col("p_brand")).alias("label"), text.feature_token(F.col("p_brand")).alias("token"), text.part_count(F.concat_ws(",", "p_name", "p_type")).alias("parts"))


@query("""SELECT event_id, coalesce(json_extract(props, '$.k')::BIGINT, 0) AS k, round(greatest(0, least(1, value / 100)), 6) AS clamped FROM events""")
def json_properties(spark, d):
    """X01 M09."""
    k = F.from_json("props", "k bigint")["k"]
    return read(spark, d, "events").select("event_id", F.coalesce(k, F.lit(0)).cast("long").alias("k"), r(text.clamp(F.col("value") / 100), 6).alias("clamped"))


from . import columns, composite, files, layers, runs, studies  # noqa: E402, F401  register more queries
