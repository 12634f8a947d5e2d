"""Operators on small tables with the values worked out by hand."""

import datetime
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainloom.functions import numeric, text
from grainloom.operators import features, fuse, graph, learn, match, quality, vectors, windows
from grainloom.plans import catalogue
from grainloom.streaming import streams


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_text(spark):
    lit = F.lit
    assert one(spark, text.normalize(lit("Crème  BRÛLÉE, 20% (fat)"))) == "creme brulee 20% fat"
    assert one(spark, text.normalize(lit(None).cast("string"))) == ""
    assert one(spark, text.normalize_unicode(lit("Ｃafé — חלב"))) == "café חלב"
    assert one(spark, text.tokens(lit("the raw rice of rice b"))) == ["b", "rice"]
    assert one(spark, text.trigrams(lit("ab cd"))) == ["ab_", "b_c", "_cd"] and one(spark, text.trigrams(lit("ab"))) == ["ab"] and one(spark, text.trigrams(lit(""))) == []
    assert one(spark, text.compact_list(lit("a: 1, b | a,, c:2"))) == ["a", "b", "c"]
    assert one(spark, text.english_list(F.array(lit("a"), lit("A"), lit("b"), lit("c")))) == "a, b, and c"
    assert one(spark, text.english_list(F.expr("cast(array() as array<string>)"))) == "unavailable"
    assert [one(spark, text.adaptive_number(lit(x))) for x in (1234.4, 12.0, 1.25, 0.5)] == ["1234", "12", "1.25", "0.5"]
    assert one(spark, text.slug(lit("--"))) == "unknown" and one(spark, text.feature_token(lit("A b/c"))) == "a_b_c"
    assert one(spark, text.nutrient_unit(lit("Energy"))) == "kcal" and one(spark, text.nutrient_unit(lit("Calcium, Ca"))).startswith("mg")
    assert one(spark, text.clean_label(lit(" NaN "))) == "" and one(spark, text.stem(lit("/a/b.c.csv"))) == "b.c"
    assert one(spark, text.window_label(F.lit("2024-01-03").cast("timestamp"), "week")) == "2024-01-01/2024-01-07"
    assert one(spark, text.window_label(F.lit(None).cast("timestamp"), "month")) == "missing_time"
    assert one(spark, text.strip_taxon(lit("g__Rothia"))) == "Rothia" and one(spark, text.pipe_split(lit("a| |b "))) == ["a", "b"]
    assert one(spark, text.sentence(lit("Rice"), lit("Grain"), F.array(lit("iron")))) == "Rice is a grain item with iron."


def test_numeric(spark):
    assert one(spark, numeric.tolerant_int(F.lit("12.7"))) == 12 and one(spark, numeric.tolerant_int(F.lit("x"))) == 0
    assert one(spark, numeric.finite_or_zero(F.lit(float("inf")))) == 0 and one(spark, numeric.covered(F.lit(-1.0))) is False
    assert one(spark, numeric.whole_id(F.lit("12.0"))) == "12" and one(spark, numeric.whole_id(F.lit("1.5"))) is None and one(spark, numeric.whole_id(F.lit(True))) is None
    assert abs(one(spark, numeric.convert(F.lit(41.84), "kJ", "kcal")) - 10) < 1e-9
    assert abs(one(spark, numeric.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) - 2**-0.5) < 1e-12


def test_windows(spark):
    df = spark.createDataFrame([("a", 3, 1), ("a", 5, 2), ("b", 5, 1)], "g string, v int, t int")
    assert {tuple(r) for r in windows.top_k(df, ["g"], [F.desc("v")], 1).select("g", "v").collect()} == {("a", 5), ("b", 5)}
    assert {tuple(r) for r in windows.latest(df, ["g"], "t").select("g", "v").collect()} == {("a", 5), ("b", 5)}
    n = windows.numbered(spark.range(1000).repartition(7), ["id"], "ord", 10)
    assert n.where(F.col("ord") != F.col("id") + 10).count() == 0
    z = {r.t: round(r.v, 6) for r in windows.z_scores(df.where("g = 'a'").withColumn("v", F.col("v").cast("double")), ["v"]).collect()}
    assert z == {1: -0.707107, 2: 0.707107}
    assert {r.side for r in windows.set_report(df.where("t = 1"), df.where("g = 'a'"), "g").collect()} == {"both", "left_only"}


def test_fusion(spark):
    df = spark.createDataFrame([("k", 1.0, 1.0), ("k", 3.0, None), ("k", None, 9.0), ("z", 2.0, -1.0), ("z", 4.0, 0.0)], "k string, v double, w double")
    mean, n = fuse.weighted_mean("v", "w")
    assert {r.k: (r.m, r.n) for r in df.groupBy("k").agg(mean.alias("m"), n.alias("n")).collect()} == {"k": (2.0, 2), "z": (3.0, 2)}
    p = spark.createDataFrame([(True, False, True, "high", 0.99, 0.1), (False, False, False, "low", 0.1, 0.8), (True, True, True, "low", 0.1, 0.1)], "comparable boolean, same_name boolean, same_source boolean, confidence string, similarity double, other_score double")
    assert {r.review_priority for r in fuse.agreement(p).collect()} == {"both_plausible_review", "other_may_be_better_review", "agreement"}
    # The catalogue-selection case: a zero counts as recorded, a proxy is scaled by protein, anything not finite is not covered.
    amounts = spark.createDataFrame([("1003", 1, 2.0), ("1003", 2, 1.0), ("1003", 3, 1.0), ("1213", 2, 0.1), ("1213", 3, 0.05), ("1259", 1, 0.0), ("1259", 2, 0.0), ("1265", 1, 0.5), ("9", 1, float("nan")), ("9", 2, -1.0)], "feature string, donor int, amount double")
    items = spark.createDataFrame([("a", 1, 3, 2.0), ("b", 2, None, None)], "item string, primary_id int, proxy_id int, ratio double")
    cells = fuse.coverage_registry(amounts.select("feature").distinct(), items, amounts)
    got = {(r.item, r.feature): (r.value, r.method) for r in cells.collect()}
    assert got["a", "1213"] == (0.1, "proxy") and got["b", "1265"] == (None, "unresolved") and got["a", "1259"] == (0.0, "recorded")
    status = {r.feature: r.status for r in fuse.registry_status(cells).collect()}
    assert status["1259"] == "included" and status["1265"] == status["9"] == "completion_pending"
    d = {(r.item, r.feature): r.value for r in fuse.derived(cells, {"s": ["1003", "1213"]}, {"q": ("1003", "1259")}).collect()}
    assert abs(d["a", "s"] - 2.1) < 1e-9 and d["a", "q"] is None


def test_exposure_by_hand(spark):
    e = spark.createDataFrame([("p1", "X", 50.0), ("p1", "X", 120.0), ("p2", "Y", 80.0), (None, "Y", 1.0), ("p2", "?", 5.0)], "who string, item string, grams double")
    f = spark.createDataFrame([("X", 10.0), ("Y", 20.0)], "item string, v double")
    assert {r.who: r.v for r in features.exposure(e, f, ["v"], ["who"]).collect()} == {"p1": 17.0, "p2": 16.0}
    zero = features.exposure_mean(e.withColumn("grams", F.lit(0.0)), f, ["v"], ["who"])
    assert {r.v for r in zero.collect()} == {0.0}
    assert features.resolved(f, None, ["id", "ITEM"]) == "item" and features.columns_with(f, ["V"]) == ["v"] and features.numeric_columns(f) == ["v"]
    assert features.search(f, ["item"], "x").count() == 1 and features.prefixed(f, "m_", ("item",)).columns == ["item", "m_v"]
    v = features.participant_vectors(spark.createDataFrame([("a", 1.0), ("a", 3.0)], "k string, v double"), "k", ["v"], "mean")
    assert v.first().embedding == [2.0]
    with pytest.raises(Exception, match="repeated"):
        features.participant_vectors(spark.createDataFrame([("a", 1.0), ("a", 3.0)], "k string, v double"), "k", ["v"]).collect()
    long = features.vector_mean(e.where("who = 'p1'"), spark.createDataFrame([("X", [1.0, 2.0])], "item string, embedding array<double>"), ["who"])
    assert features.assembled(long, ["who"]).first().embedding == [1.0, 2.0]


def test_matching(spark):
    left = match.prepared(spark.createDataFrame([("1", "Brown rice"), ("2", "zzz")], "id string, name string"), "id", "name")
    right = match.prepared(spark.createDataFrame([("a", "rice, brown"), ("b", "brown rice"), ("c", "rice milk")], "id string, name string"), "id", "name")
    got = match.candidates(left, right, 2).orderBy("candidate_rank").collect()
    assert [(r.left_id, r.right_id) for r in got] == [("1", "b"), ("1", "a")] and got[0].match_score == 1.0
    out = {r.left_id: r.confidence for r in match.with_unmatched(left, match.candidates(left, right, 1)).collect()}
    assert out == {"1": "high", "2": "review"}
    pool = match.candidate_pool(left, right, 2).where("left_id = '2'")
    assert [r.right_id for r in pool.orderBy("right_id").collect()] == ["a", "b"]
    assert one(spark, text.name_similarity(F.lit("rice"), F.lit(""), F.array(F.lit("x")), F.array(F.lit("x")), F.array(F.lit("x")), F.array(F.lit("x")))) == 0.0


def test_quality(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0), (2, None), (4, 3.0)], "k int, v double")
    r = quality.compared(a, b, ["k"], ["v"]).first()
    assert (r.n_shared, r.n_equal, r.n_one_sided) == (2, 2, 2)
    assert quality.checked_join(a, b, ["k"]).count() == 2
    with pytest.raises(Exception, match="repeated or null key"):
        quality.checked_join(a.union(a), b, ["k"]).collect()
    assert quality.outside_domain(a, "k", spark.createDataFrame([(1,), (2,)], "value int")).first().k == 3
    p = quality.provenance_agrees(a.withColumnRenamed("v", "value").withColumn("f", F.lit("x")), b.select("k", F.lit("x").alias("f"), F.lit("missing").alias("method")), ["k", "f"]).first()
    assert (p.n, p.n_conflicts) == (2, 1)
    assert quality.matrix_summary(a, ["k", "v"]).first().median_present == 1.0


def test_graph(spark):
    v = spark.createDataFrame([("k", "a", None, 1), ("k", None, "", 2), ("k", "c", None, 3)], "key string, x string, y string, seq int")
    assert tuple(graph.upsert_nodes(v, "key", "seq").first()) == ("k", "c", "")
    e = spark.createDataFrame([("a", "b", "r"), ("a", "c", "r"), ("b", "d", "r"), ("d", "a", "r")], "source string, target string, relation string")
    hops = graph.ego(e, spark.createDataFrame([("a",)], "key string"), 2, 1)
    assert [(r.source, r.target, r.hop) for r in hops.orderBy("hop").collect()] == [("a", "b", 1), ("b", "d", 2)]
    assert tuple(graph.path_counts(e.where("source = 'a'"), e).first()) == ("a", 1, 1, 1)
    cats = spark.createDataFrame([("a", "x"), ("b", "y")], "source string, category string")
    info = graph.node_information(e.where("source in ('a', 'b')"), cats).where("target = 'b'").first()
    assert info.prevalence == 1 and info.entropy == 0 and info.specificity == 1 and abs(info.divergence - 0.693147) < 1e-6


def test_vectors_and_models(spark):
    df = spark.createDataFrame([(i, [float(i), 2.0 * i + (i % 3), 1.0]) for i in range(1, 60)], "vec_id long, embedding array<double>")
    pc = vectors.pca(df, "vec_id", "embedding").collect()
    assert abs(sum(r.pc1 for r in pc)) < 1e-6 and [r.vec_id for r in sorted(pc, key=lambda r: r.pc1)][0] == 1
    km = {r.vec_id: r.cluster for r in vectors.kmeans(df, "vec_id", "embedding", 3).collect()}
    assert km[1] == km[2] != km[59] and len(set(km.values())) == 3
    y = df.select("vec_id", F.col("embedding")[0].alias("a"), F.col("embedding")[1].alias("b"), (F.col("embedding")[0] * 2 + 1).alias("y"))
    m = {(r.model, r.metric): r["mean"] for r in learn.summarised(learn.evaluated(y, "vec_id", ["a", "b"], "y", folds=2, names=["linear"])).collect()}
    assert m["linear", "r2"] > 0.999
    c = y.withColumn("y", (F.col("y") > 60).cast("double"))
    m = {(r.model, r.metric): r["mean"] for r in learn.summarised(learn.evaluated(c, "vec_id", ["a", "b"], "y", folds=2, names=["logistic"])).collect()}
    assert m["logistic", "auroc"] > 0.99 and learn.task_kind(c, "y") == "binary"


def test_stream_dedupe(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:00:01", 1.0), (2, "2024-01-01 00:00:02", 1.0)]
    spark.createDataFrame(rows, "id int, ts string, v double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = streams.deduplicated(streams.source(spark, str(tmp_path / "in")), "id", "ts")
    assert streams.finished(s, str(tmp_path / "w"), "dedupe_out", "append").count() == 2


def test_stream_totals_of_many_unordered_files(spark, tmp_path):
    path = str(tmp_path / "events.parquet")
    n = 40
    for i in range(n):  # the newest days come first
        rows = [(u, datetime.datetime(2024, 3, 1) + datetime.timedelta(days=3 * (n - i) - u % 2, hours=u), 1.5 + u) for u in range(4)]
        spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, value double").coalesce(1).write.mode("append").parquet(path)
    got = streams.daily_totals(spark, path, str(tmp_path / "w"))
    e = spark.read.parquet(path)
    want = e.groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("n_events"), F.round(F.sum("value"), 4).alias("total"))
    assert want.count() == 4 * n and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_kmeans_queries_against_plain_lloyd(spark, tmp_path):
    n, k = 400, 8
    x = np.random.default_rng(0).normal(size=(n, 2)) + 5  # settles after 25 rounds
    order = np.argsort(np.sqrt((x * x).sum(1)), kind="stable")
    c = x[order[[round(i * (n - 1) / (k - 1)) for i in range(k)]]]
    own = lambda c: ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
    for _ in range(80):
        c = np.array([x[own(c) == j].mean(0) if (own(c) == j).any() else c[j] for j in range(k)])
    want = own(c).tolist()
    labels = [i % 14 for i in range(n)]
    rows = [(i, v, y) for i, (v, y) in enumerate(zip(x.tolist(), labels, strict=True))]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert {r.vec_id: r.cluster for r in catalogue.QUERIES["kmeans_clusters"](spark, str(tmp_path)).collect()} == dict(enumerate(want))
    top = {}
    for j in range(k):
        counts = Counter(y for y, w in zip(labels, want, strict=True) if w == j)
        top |= {(j, y): m for y, m in sorted(counts.items(), key=lambda z: (-z[1], z[0]))[:12]}
    assert len(top) > 5 * k
    assert {(r.cluster, r.label): r.n for r in catalogue.QUERIES["cluster_patterns"](spark, str(tmp_path)).collect()} == top
