"""As-of joins, prototypes, merged graphs, metrics, versions, uncapped pairs and names of all scripts, against plain Python."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from grainloom.functions import text
from grainloom.operators import graph, intervals, match, prototype, versions, windows
from grainloom.scratch import work_dir

T0 = datetime.datetime(2020, 1, 1)


def times(r, n, who):
    return [(r.choice(who), T0 + datetime.timedelta(hours=r.randrange(24 * 900)), i) for i in range(n)]


def test_asof_against_a_loop(spark):
    r = random.Random(1)
    who = ["hot"] * 6 + ["a", "b", None]
    left, right = times(r, 400, who), times(r, 250, who)
    left += [("hot", None, 900), ("alone", T0, 901), (right[0][0], right[0][1], 902)]
    right += [("hot", None, 903), (right[1][0], right[1][1], 904)]
    df = spark.createDataFrame(left, "who string, at timestamp, n int")
    rf = spark.createDataFrame(right, "who string, since timestamp, value int")
    got = {x.n: (x.since, x.value) for x in intervals.asof(df, rf, ["who"], "at", "since", width=7 * intervals.DAY).collect()}

    def want(w, t):
        known = [(s, v) for k, s, v in right if w is not None and k == w and s is not None and t is not None and s <= t]
        return max(known, default=(None, None))

    assert got == {n: want(w, t) for w, t, n in left}
    assert intervals.asof(df.limit(0), rf, ["who"], "at", "since").count() == 0
    assert {x.since for x in intervals.asof(df, rf.limit(0), ["who"], "at", "since").collect()} == {None}
    plan = intervals.asof(df, rf, ["who"], "at", "since")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_spans(spark):
    day = lambda n: T0 + datetime.timedelta(days=n)
    spans = spark.createDataFrame([("a", day(0), day(10), 1), ("a", day(20), day(30), 2), ("b", day(0), day(400), 3)], "who string, start timestamp, until timestamp, n int")
    points = spark.createDataFrame([("a", day(0), "in"), ("a", day(10), "end"), ("a", day(25), "in"), ("b", day(399), "far"), ("c", day(1), "none")], "who string, at timestamp, said string")
    got = sorted((x.who, x.said, x.n) for x in intervals.in_spans(points, spans, ["who"], "at", "start", "until").collect())
    assert got == [("a", "end", None), ("a", "in", 1), ("a", "in", 2), ("b", "far", 3), ("c", "none", None)]
    assert intervals.overlapping(spans, ["who"], "start", "until").count() == 0
    assert intervals.overlapping(spans.unionByName(spans.where("n = 1").withColumn("n", F.lit(9))), ["who"], "start", "until").count() == 1


def test_window_targets(spark):
    y = spark.createDataFrame([(1, T0, 2.0, "x"), (1, None, 3.0, "y")], "participant int, ts timestamp, a double, b string")
    out, absent = intervals.window_targets(y, "participant", "ts", "year", ["a", "b", "c"])
    assert out.columns == ["participant", "window_id", "a"] and absent == ["c"]
    with pytest.raises(KeyError):
        intervals.window_targets(y, "participant", "ts", "year", ["a", "c"], strict=True)
    with pytest.raises(ValueError, match="numeric"):
        intervals.window_targets(y, "participant", "ts", "year", ["b"])


def test_prototype(spark):
    specs = spark.createDataFrame([(1, "d1", "d2"), (2, "d1", None), (3, "d3", "d2"), (4, "d2", "d0")], "item int, donor string, proxy string")
    records = spark.createDataFrame(
        [("d1", "protein", 2.0, 10), ("d1", "energy", 50.0, 11), ("d2", "protein", 8.0, 20), ("d2", "lysine", 4.0, 21), ("d2", "energy", float("nan"), 22), ("d3", "energy", 0.0, 31), ("d0", "protein", 0.0, 1), ("d0", "lysine", 1.0, 2), ("d0", "energy", 9.0, 3)],
        "donor string, feature string, amount double, record long")
    cells = prototype.transferred(specs, records, ["protein", "energy", "lysine"], ["lysine"], "protein")
    got = {(x["item"], x.feature): (x.value, x.method, x.donor, x.scale_factor, x.sources, x.proxy_used) for x in cells.collect()}
    assert len(got) == 12
    assert got[1, "lysine"] == (1.0, "scaled_proxy", "d2", 0.25, [10, 20, 21], True)  # 4 * 2 / 8
    assert got[2, "lysine"] == (None, "unresolved", None, None, [], False)
    assert got[3, "lysine"][1] == "unresolved"  # no protein of its own
    assert got[4, "lysine"] == (4.0, "donor_transfer", "d2", 1.0, [21], False)
    assert got[4, "energy"][1] == "unresolved"  # not a number at d2, and energy is not scaled
    formulas = {"ratio": (["both"], ["energy"]), "both": (["protein", "lysine"], [])}
    assert prototype.levels(formulas) == [["both"], ["ratio"]]
    made = {(x["item"], x.feature): (x.value, x.method, x.sources, x.proxy_used, x.parts) for x in prototype.derived(cells, formulas).where("method in ('derived', 'unresolved') and size(parts) > 0").collect()}
    assert made[1, "both"] == (3.0, "derived", [10, 20, 21], True, ["lysine", "protein"])
    assert made[1, "ratio"] == (0.06, "derived", [10, 11, 20, 21], True, ["both", "energy"])
    assert made[2, "both"][:2] == (None, "unresolved") and made[3, "ratio"][:2] == (None, "unresolved")
    with pytest.raises(ValueError, match="themselves"):
        prototype.levels({"a": (["b"], []), "b": ([], ["a"])})
    assert prototype.transferred(specs.limit(0), records, ["protein"], [], "protein").count() == 0


def test_components_against_union_find(spark):
    r = random.Random(3)
    links = [(f"n{r.randrange(150)}", f"n{r.randrange(150)}") for _ in range(110)] + [(f"c{i}", f"c{i + 1}") for i in range(60)] + [("s", f"s{i}") for i in range(80)] + [("self", "self")]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    got = {x.id: x.component for x in graph.components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {x: find(x) for x in root}
    assert graph.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_merged_graphs(spark):
    nodes = lambda rows: spark.createDataFrame(rows, "key string, kind string, label string")
    edges = lambda rows: spark.createDataFrame(rows, "source string, target string, relation string, value double")
    one = nodes([("f:1", "food", "Fig"), ("d:9", "disease", "Heart Disease"), ("d:8", "disease", "gout")]), edges([("f:1", "d:9", "r", 1.0), ("f:1", "gone", "r", 1.0)])
    two = nodes([("f:1", "food", "fig again"), ("x:1", "disease", "heart-disease"), ("d:8", "disease", "Podagra"), ("p:3", "disease", "podagra")]), edges([("f:1", "x:1", "r", 3.0), ("p:3", "f:1", "r", None)])
    n, e = graph.merged([one, two], {"disease": text.label_key("disease", F.col("label"))})
    assert sorted(tuple(x) for x in n.collect()) == [("disease:gout", "disease", "gout", 3), ("disease:heart_disease", "disease", "Heart Disease", 2), ("f:1", "food", "Fig", 2)]
    assert sorted(tuple(x) for x in e.collect()) == [("disease:gout", "f:1", "r", 1, None), ("f:1", "disease:heart_disease", "r", 2, 3.0)]
    assert graph.without_dangling(one[0], one[1]).count() == 1


def test_metrics_share_one_pass(spark):
    e = spark.createDataFrame([("a", "x", "r", None), ("b", "x", "r", 2.0), ("b", "y", "r", 4.0)], "source string, target string, relation string, value double")
    info = spark.createDataFrame([("r", "x", 1.0, 10.0), ("r", "y", 0.5, 0.0)], "relation string, target string, m1 double, m2 double")
    w = graph.weighted_by(e, info, ["m1", "m2"])
    assert sorted((x.metric, x.source, x.target, x.weighted_value) for x in w.collect()) == [("m1", "a", "x", 1.0), ("m1", "b", "x", 2.0), ("m1", "b", "y", 2.0), ("m2", "a", "x", 10.0), ("m2", "b", "x", 20.0), ("m2", "b", "y", 0.0)]
    table = graph.thresholds(w, quantiles=(0.0, 0.5), usual=0.5)
    assert sorted((x.metric, x.quantile, x.threshold, x.edges_retained, x.sources_covered, x.recommended) for x in table.collect()) == [("m1", 0.0, 1.0, 3, 2, False), ("m1", 0.5, 2.0, 2, 1, True), ("m2", 0.0, 0.0, 3, 2, False), ("m2", 0.5, 10.0, 2, 2, True)]
    assert sorted((x.metric, x.source, x.target) for x in graph.retained(w, table).collect()) == [("m1", "b", "x"), ("m1", "b", "y"), ("m2", "a", "x"), ("m2", "b", "x")]


def test_versions(spark):
    path = f"{work_dir(spark)}/log"
    rows = lambda x: spark.createDataFrame(x, "k int, said string")
    assert versions.versions(spark, path) == []
    assert [versions.append(rows(x), path) for x in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d"), (3, "e")], [(1, None)])] == [1, 2, 3]
    state = lambda v: sorted(tuple(x) for x in versions.as_of(spark, path, ["k"], v).select("k", "said", "version").collect())
    assert state(1) == [(1, "a", 1), (2, "b", 1)]
    assert state(2) == [(1, "a", 1), (2, "c", 2), (3, "e", 2)]
    assert state(None) == [(1, None, 3), (2, "c", 2), (3, "e", 2)]
    assert versions.log(spark, path).count() == 6


def test_pairs_have_no_cap(spark, monkeypatch):
    """A name keeps all of its 650 partners, whether or not its token is dealt out over blocks."""
    left = match.prepared(spark.createDataFrame([("red apple",), ("green pear",), ("alone",), ("",)], "n string"), "n", "n", ascii_only=True)
    right = match.prepared(spark.range(650).selectExpr("concat('apple ', id) AS n").union(spark.createDataFrame([("green tea",), ("red apple",)], "n string")), "n", "n", ascii_only=True)
    for split in (1_000_000, 10):
        monkeypatch.setattr(match, "SPLIT", split)
        got = {(x.left_id, x.right_id): x.shared for x in match.all_pairs(left, right).collect()}
        assert len(got) == 652 and got["red apple", "red apple"] == 2 and got["green pear", "green tea"] == 1
    assert match.candidate_pool(left, right).where("left_id = 'red apple'").count() == 500


def test_unicode_names_without_python(spark):
    names = ["Ünïted  Ｆoo", "ΚΑΛΟΣ λόγος", "ΛΌΓΟΣ", "Привет, МИР!", "שלום-עולם", "日本 の ラーメン", "a_b 50%", "x² ½", "é é", "", None, "  ", "ﬁg", "İi"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    import unicodedata

    import pandas as pd

    want = [pd.Series([unicodedata.normalize("NFKC", n or "")]).str.lower().str.replace(r"[^\w%]+", " ", regex=True).str.strip()[0] for n in names]
    assert [x[0] for x in df.select(text.normalize_unicode(F.col("n"))).collect()] == want
    a = match.prepared(df.where("n like '%МИР%' or n like 'ΚΑΛΟΣ%'"), "n", "n", unicode=True)
    b = match.prepared(spark.createDataFrame([("привет мир",), ("мир",), ("καλοσ λόγοσ",)], "n string"), "n", "n", unicode=True)
    got = {(x.left_id, x.right_id): x.match_score for x in match.scored(match.all_pairs(a, b), a, b).collect()}
    assert got["Привет, МИР!", "привет мир"] == 1.0 and 0 < got["Привет, МИР!", "мир"] < 1


@pytest.mark.parametrize("at_once", [0, 10_000])
def test_quantiles_both_ways(spark, monkeypatch, at_once):
    import numpy as np

    monkeypatch.setattr(windows, "AT_ONCE", at_once)
    r = random.Random(8)
    rows = [(r.choice("ab"), r.choice([None, r.random(), 1.0, -3.5])) for _ in range(3000)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    at = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = {(x.g, x.quantile): x.value for x in windows.quantiles(df, "v", at, "g").collect()}
    want = {(g, q): float(np.quantile([v for k, v in rows if k == g and v is not None], q)) for g in "ab" for q in at}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert sorted(x.quantile for x in windows.quantiles(df, "v", at).collect()) == at


def test_graph_steps_in_tasks_of_bounded_rows(spark, monkeypatch):
    """Repeated edges and categories count once, and shares of a task are dealt by rows, with the same results for any share."""
    from grainloom import scratch

    r = random.Random(4)
    rows = [(f"s{r.randrange(40)}", f"t{r.randrange(6)}", "r", r.choice([None, 1.0, 2.5])) for _ in range(400)]
    cats = [(f"s{i}", "xyz"[i % 3]) for i in range(40)] * 2 + [(None, "x")]
    e, c = spark.createDataFrame(rows, "source string, target string, relation string, value double"), spark.createDataFrame(cats, "source string, category string")
    found = []
    for share in (250_000, 7):
        monkeypatch.setattr(scratch, "TASK_ROWS", share)
        info = graph.node_information(e, c)
        w = graph.weighted_edges(e, info, "idf")
        found.append([sorted(map(repr, x.collect())) for x in (info.select("target", "prevalence", "n_sources", "n_categories"), w.select("source", "target", "value", F.round("weighted_value", 9)), graph.signatures(w, 2).select("source", "target", "rank"), graph.threshold_summary(w.withColumn("weighted_value", F.round("weighted_value", 6))))])
    assert found[0] == found[1]
    assert {(x.target, x.prevalence, x.n_sources, x.n_categories) for x in info.where("divergence IS NOT NULL").collect()} == {(t, len({s for s, u, *_ in rows if u == t}), 40, 3) for t in {x[1] for x in rows}}


def test_thresholds_without_arrays(spark, monkeypatch):
    """Cuts of any number of rows are compared as columns: no array is walked for each row."""
    monkeypatch.setattr(windows, "AT_ONCE", 0)
    w = spark.range(3000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("metric"), (F.col("id") % 50).cast("string").alias("source"), F.floor(F.col("id") / 2).cast("double").alias("weighted_value"))
    out = graph.thresholds(w, quantiles=(0.25, 0.5, 0.9))
    assert sorted((x.metric, x.quantile, x.threshold, x.edges_retained, x.sources_covered) for x in out.collect()) == sorted((m, q, 1499 * q, sum(v >= 1499 * q for v in range(1500)), 25) for m in "ab" for q in (0.25, 0.5, 0.9))
    assert "filter(" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_paths_and_merging_in_tasks_of_bounded_rows(spark, monkeypatch):
    """Shares of a task are dealt by rows, not by Spark's number of shuffle partitions, with the same results."""
    from grainloom import scratch

    r = random.Random(5)
    first = [(f"p{r.randrange(30)}", f"s{r.randrange(9)}", "a", r.choice([None, 1.0])) for _ in range(300)]
    second = [(f"s{r.randrange(9)}", f"n{r.randrange(4)}", "b", 2.0) for _ in range(20)]
    schema = "source string, target string, relation string, value double"
    a, b = spark.createDataFrame(first, schema), spark.createDataFrame(second, schema)
    n = a.unionByName(b).select(F.explode(F.array("source", "target")).alias("key")).distinct().select("key", F.lit("k").alias("kind"), F.col("key").alias("label"))
    found = []
    for share in (250_000, 10):
        monkeypatch.setattr(scratch, "TASK_ROWS", share)
        paths, edges = graph.path_counts(a, b), graph.merged([(n, a), (n, b)], {})[1]
        found.append([sorted(map(repr, x.collect())) for x in (paths, edges)])
    assert found[0] == found[1]
    both = [(s, t, e) for s, t, *_ in first for m, e, *_ in second if t == m]
    assert {(x.source, x.n_middle, x.n_end, x.n_paths) for x in paths.collect()} == {(s, len({t for k, t, _ in both if k == s}), len({e for k, _, e in both if k == s}), sum(k == s for k, *_ in both)) for s in {x[0] for x in both}}
    assert edges.agg(F.sum("n_merged")).first()[0] == 320
    assert paths._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1 and edges._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 3


def test_weights_are_stored_before_they_are_read_twice(spark):
    """The cut and the edges, and the features and their values, read one stored table; chosen items alone are weighed; capped and signed edges are dealt out by rows."""
    from grainloom.plans import catalogue

    d = "/root/testdata/sf0.001"
    plan = lambda q: catalogue.QUERIES[q](spark, d)._jdf.queryExecution().optimizedPlan().toString()
    for q in ("threshold_filtered_edges", "kg_signature_matrix"):
        assert "l_partkey" not in plan(q) and "specificity" not in plan(q)
    assert plan("display_graph").count("RepartitionByExpression") == 3


def test_hashed_text_without_shuffled_tokens(spark):
    """Keys of one row are counted where they stand; rows that share a key, null among them, are counted together."""
    from grainloom.operators import vectors

    whole = [(1, "Apple pie apple, of KELVIN Kelvin İstanbul"), (2, None), (3, "a b"), (4, "red-green red_blue 123 apple")]
    rows = [*whole, (5, "apple pear"), (5, "apple"), (None, "plum"), (None, "plum pear"), (6, None), (6, "")]
    df = lambda x: spark.createDataFrame(x, "k int, t string")
    got = {(x.k, x.dim): x.value for x in vectors.hashed_text(df(rows), "k", "t").collect()}
    joined = [*whole, (5, "apple pear apple"), (None, "plum plum pear"), (6, "")]
    plain = df(joined).select("k", F.explode(text.evidence_tokens(F.col("t"))).alias("w")).groupBy("k", "w").agg(F.count(F.lit(1)).alias("n"))
    plain = plain.groupBy("k", text.hash_bucket(F.col("w")).alias("dim")).agg(F.sum(text.hash_sign(F.col("w")) * F.log1p("n")).alias("v")).collect()
    assert got.keys() == {(x.k, x.dim) for x in plain} and all(abs(got[x.k, x.dim] - x.v) < 1e-12 for x in plain)
    assert sorted((x.k or 0) for x in vectors.text_block(df(rows), "k", "t").collect()) == [0, 1, 2, 3, 4, 5, 6]
    assert "Exchange" not in vectors.hashed_text(df(whole), "k", "t")._jdf.queryExecution().executedPlan().toString()


def test_nearest_in_tiles(spark, monkeypatch):
    from grainloom.operators import vectors

    r = random.Random(2)
    e = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(4)], i % 3) for i in range(200)], "vec_id int, embedding array<double>, label int")
    find = lambda: sorted(map(tuple, vectors.nearest(e.where("vec_id % 20 = 0"), e, 2, group="label", skip_same_group=True).collect()))
    want = find()
    monkeypatch.setattr(vectors, "TILE_ROWS", 7)
    monkeypatch.setattr(vectors, "TILE_QUERIES", 3)
    assert find() == want and len(want) == 20


def test_every_vector_votes(spark, monkeypatch, tmp_path):
    """No id is divisible by 20; an id repeats, and a row has no label."""
    from collections import defaultdict

    import numpy as np

    from grainloom.operators import vectors
    from grainloom.plans import layers

    g = np.random.default_rng(11)
    rows = [(i, g.normal(size=8), int(i % 5)) for i in range(1, 300) if i % 20]
    rows += [(7, rows[6][1], rows[6][2]), (1001, rows[2][1], None)]
    spark.createDataFrame([(i, x.tolist(), c) for i, x, c in rows], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    x = np.array([v for _, v, _ in rows]).astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    votes = defaultdict(list)
    for key, (i, c) in {key: (i, c) for i, (key, _, c) in enumerate(rows)}.items():
        if c is not None:
            cos, _, donor = min((-round(float(x[i] @ x[j]), 9), k2, c2) for j, (k2, _, c2) in enumerate(rows) if c2 is not None and c2 != c and k2 != key)
            votes[str(c), str(donor)].append((key % 7 + 1, -cos))
    each = [(a, b, sum(w for w, _ in v), len(v), sum(s for _, s in v) / len(v)) for (a, b), v in votes.items()]
    want = sorted(max((e for e in each if e[0] == a), key=lambda e: e[2:])[:4] for a in {e[0] for e in each})
    find = lambda: sorted(map(tuple, layers.donor_vote(spark, str(tmp_path)).collect()))
    assert find() == want and len(want) == 5
    for name, size in (("BLOCK_ROWS", 150), ("MANY_PAIRS", 20_000), ("TILE_ROWS", 7), ("TILE_QUERIES", 3)):
        monkeypatch.setattr(vectors, name, size)
    assert find() == want
