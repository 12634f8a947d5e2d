"""Models from moments, communities, adapters and runs, against numpy and plain Python."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainloom.operators import adapters, community, learn, moments, runs
from grainloom.scratch import work_dir
from grainloom.sources.writers import write_table


def table(spark, n=300, seed=2):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = r.gauss(1000, 5), r.random()
        y = 3 * a - 20 * b + r.gauss(0, 2)
        rows.append((i, a if r.random() > 0.1 else None, b if r.random() > 0.2 else None, 7.0, 2 * a, y if r.random() > 0.05 else None, float("inf") if i == 3 else r.random()))
    return spark.createDataFrame(rows, "id long, a double, b double, same double, twice double, y double, z double")


def plain(rows, columns, y, fold, model):
    """r2, rmse, pearson of one model on one fold, by definition."""
    rows = [r for r in rows if r[y] is not None and math.isfinite(r[y])]
    get = lambda part: (np.array([[np.nan if r[c] is None else r[c] for c in columns] for r in part], float), np.array([r[y] for r in part]))
    (x, t), (xt, tt) = get([r for r in rows if r[f"u{fold}"] >= 0.2]), get([r for r in rows if r[f"u{fold}"] < 0.2])
    mean = np.nanmean(x, axis=0)
    x, xt = np.where(np.isnan(x), mean, x), np.where(np.isnan(xt), mean, xt)
    std = x.std(axis=0)
    std[std < 1e-9] = 1
    x, xt = (x - mean) / std, (xt - mean) / std
    if model == "linear":
        w = np.linalg.lstsq(x, t - t.mean(), rcond=1e-10)[0]
    elif model == "ridge":
        w = np.linalg.solve(x.T @ x + np.eye(x.shape[1]), x.T @ (t - t.mean()))
    else:
        w = np.zeros(x.shape[1])
        for _ in range(3000):
            for j in range(len(w)):
                rho = x[:, j] @ (t - t.mean() - x @ w + x[:, j] * w[j])
                w[j] = np.sign(rho) * max(abs(rho) - len(t) * 0.01, 0) / max(x[:, j] @ x[:, j], 1e-12)
    p = xt @ w + t.mean()
    return {"r2": 1 - ((tt - p) ** 2).sum() / ((tt - tt.mean()) ** 2).sum(), "rmse": math.sqrt(((tt - p) ** 2).mean()), "pearson": np.corrcoef(tt, p)[0, 1]}


def test_bank_against_numpy(spark):
    df = table(spark).repartition(5)
    rows = [x.asDict() for x in df.select("*", *(learn.share_of("id", f).alias(f"u{f}") for f in range(3))).collect()]
    sets = {"one": ["a"], "two": ["a", "b"], "same": ["b", "same"], "twice": ["a", "twice"]}
    got = {(x.feature_set, x.target, x.model, x.fold, x.metric): x.value for x in moments.bank(df, "id", sets, ["y", "z"], folds=3).collect()}
    assert len(got) == 4 * 2 * 3 * 3 * 3
    for (s, y, model, fold, metric), value in got.items():
        if (s, model) == ("twice", "lasso"):
            continue  # its weights are not unique
        assert value == pytest.approx(plain(rows, sets[s], y, fold, model)[metric], rel=1e-5, abs=1e-5), (s, y, model, fold, metric)


def test_comparison_from_files(spark):
    path = work_dir(spark)
    df = table(spark, 200)
    write_table(df.select("id", "a", "b"), f"{path}/x.parquet")
    write_table(df.select("id", "y", F.when(F.col("y") > 3000, 1).otherwise(0).alias("c")), f"{path}/y.csv")
    out = learn.run_from_files(spark, f"{path}/x.parquet", f"{path}/y.csv", ["id"], {"both": ["a", "b"]}, ["y"], f"{path}/out", folds=2, names=["ridge", "lasso"])
    assert sorted((x.model, x.metric, x.n_folds) for x in out.collect()) == sorted((m, k, 2) for m in ("ridge", "lasso") for k in ("r2", "rmse", "pearson"))
    assert min(x["mean"] for x in out.where("metric = 'r2'").collect()) > 0.5
    two = learn.run_from_files(spark, f"{path}/x.parquet", f"{path}/y.csv", ["id"], {"both": ["a", "b"]}, ["c"], f"{path}/out2", folds=2, names=["logistic"])
    assert {x.metric for x in two.collect()} == {"accuracy", "f1_macro", "auroc", "auprc"}


PATTERNS = {"active": r"(^|[|_;\s])neisseria([|_;\s]|$)", "both": r"(^|[|_;\s])(neisseria|rothia)([|_;\s]|$)"}


def test_communities(spark):
    r = random.Random(4)
    taxa = ["g__Neisseria", "g__Rothia|s__x", "g__Prevotella", "neisseriales", "g__Rothia|s__X"]
    raw = [(r.choice(["p1", "p2", None]), r.choice(["genus", "species"]), r.choice([*taxa, None]), r.choice([0.0, 1.5, 2.0, -1.0, None, float("nan")])) for _ in range(200)] + [("zero", "genus", "g__Neisseria", 0.0)]
    long = community.averaged(spark.createDataFrame(raw, "who string, level string, taxon string, value double"), "who", "level", "taxon", "value").cache()
    means = defaultdict(list)
    for who, level, taxon, v in raw:
        if who and taxon:
            means[who, level, taxon] += [v] if v is not None and v == v else []
    by = defaultdict(dict)
    for (who, level, taxon), v in means.items():
        by[who, level][taxon] = sum(v) / len(v) if v else None
    got = {(x.who, x.level): x for x in community.prepared(long, PATTERNS).collect()}
    assert got.keys() == by.keys()
    for k, taxa_of in by.items():
        v = [max(x or 0, 0) for x in taxa_of.values()]
        total = sum(v)
        p = [x / total for x in v if x > 0] if total else []
        assert got[k].shannon == pytest.approx(-sum(x * math.log(x) for x in p)) and got[k].simpson == pytest.approx(1 - sum(x * x for x in p)) and got[k].richness == len(p) and got[k].total == pytest.approx(total)
        hit = lambda name, pattern: re.search(pattern, name.replace("__", "_"), re.I)
        for name, pattern in PATTERNS.items():
            assert got[k][name] == pytest.approx(sum(x or 0 for t, x in taxa_of.items() if hit(t, pattern)))
        assert got[k].groups_total == pytest.approx(got[k]["both"])
    report = {x.level: tuple(x)[1:] for x in community.manifest(long, ["genus", "species", "strain"], PATTERNS).collect()}
    assert report["strain"] == ("missing", 0, 0, 0) and report["genus"][0] == "exported"
    genus = long.where("level = 'genus'").drop("level")
    wide = community.wide(genus, "t_", most=2)
    assert len(wide.columns) == 4 and wide.columns[-1] == "t_other" and wide.count() == genus.select("who").distinct().count()
    total = genus.agg(F.sum("value")).first()[0]
    assert wide.agg(sum(F.sum(c) for c in wide.columns[1:])).first()[0] == pytest.approx(total)
    all_of = community.wide(genus, "t_")
    assert len(set(all_of.columns)) == len(all_of.columns) and {"t_g_rothia_s_x", "t_g_rothia_s_x_"} <= set(all_of.columns)


def test_adapters(spark):
    x = spark.createDataFrame([(1, 2.0, 3.0), (1, 4.0, None), (2, float("nan"), 1.0), (None, 1.0, 1.0)], "who long, a double, b double")
    tasks = spark.createDataFrame([("t1", "bmi", "r2"), ("t1", "age", "r2"), ("t2", "lost", "auroc")], "task string, target string, metric string")
    report = {r["check"]: (r.n_seen, r.n_failed, r.passed) for r in adapters.checks(x, "who", ["a", "b", "gone"], tasks, ["bmi", "age"]).collect()}
    assert report == {"participants are unique": (2, 1, False), "participants are known": (4, 1, False), "values are finite": (8, 2, False), "features are numeric columns": (3, 1, False), "tasks are unique": (2, 1, False), "targets are known": (3, 1, False)}
    good = x.where("who IS NOT NULL")
    built = adapters.outputs(good, "who", ["a", "b"], tasks, "set", ["full", "tre_minimal", "artifact_only"], policy="mean")
    assert sorted(map(tuple, adapters.summary(built).collect())) == [("artifact_only", 2, 2, 0, 0), ("full", 2, 2, 3, 3), ("tre_minimal", 2, 2, 3, 0)]
    assert built.where("mode = 'full' AND name = '1'").first().embedding == [3.0, 3.0]
    with pytest.raises(ValueError, match="unknown modes"):
        adapters.outputs(good, "who", ["a"], tasks, "set", ["other"])
    with pytest.raises(Exception, match="(?i)repeat|unique|duplicate|one row"):
        adapters.outputs(good, "who", ["a"], tasks, "set", ["full"])
    assert adapters.checks(x.limit(0), "who", ["a"], tasks.limit(0), []).where("NOT passed").count() == 0


def test_layers_columns_scenarios_identities(spark):
    items = spark.createDataFrame([(1, "x"), (2, "y")], "item long, label string")
    layer = spark.createDataFrame([(1, "no", 5), (9, "no", 6)], "item long, label string, n int")
    fold, report = runs.layer_run(items, {"one": layer}, "item", f"{work_dir(spark)}/l")
    assert sorted(map(tuple, fold.collect())) == [(1, "x", 5), (2, "y", None)] and [tuple(x) for x in report.collect()] == [("one", 2, 1, "n")]
    with pytest.raises(Exception, match="(?i)repeat|unique|duplicate|one row"):
        runs.layer_run(items, {"bad": layer.unionByName(layer)}, "item", f"{work_dir(spark)}/m")
    schema = spark.createDataFrame([("n", "amount"), ("label", "amount"), ("item", "key"), ("gone", "amount")], "column string, group string")
    assert runs.discovered(layer, {"item"}) == ["n"] and runs.discovered(layer, set(), schema, ["amount"]) == ["n"] and runs.discovered(layer, set(), schema) == ["item", "n"]
    a, b = spark.createDataFrame([(1, 2.0), (2, None)], "item long, v double"), spark.createDataFrame([(1, 4.0), (2, None), (3, 1.0)], "item long, v double")
    means = {x["item"]: x.v for x in runs.scenario_means({"a": a, "b": b}, "item", ["v"]).where("scenario = 'combined'").collect()}
    assert means == {1: 3.0, 2: None, 3: 1.0}
    people = spark.createDataFrame([(1, "Crème Brûlée"), (2, None), (3, "")], "id long, name string")
    links = runs.identity_links({"a": (people, "id", "name"), "b": (spark.createDataFrame([("k", "creme-brulee"), ("l", "")], "id string, name string"), "id", "name")})
    assert [tuple(x) for x in links.collect()] == [("a", "1", "b", "k", "creme brulee")]


@pytest.mark.parametrize("split", [1_000_000, 5])
def test_identity_links_of_a_common_name(spark, monkeypatch, split):
    """A name that many records of one source share: all pairs of different sources, and rows of one source never meet in the join."""
    monkeypatch.setattr(runs.match, "SPLIT", split)
    rows = lambda x: spark.createDataFrame(x, "id string, name string")
    a, b, c = rows([(f"a{i}", "one name") for i in range(40)]), rows([("b1", "One-Name"), ("b2", "two")]), rows([(f"c{i}", "ONE NAME") for i in range(3)] + [("c9", "two")])
    links = runs.identity_links({"z": (a, "id", "name"), "m": (b, "id", "name"), "c": (c, "id", "name")})
    got = sorted(tuple(x) for x in links.select("left_source", "left_id", "right_source", "right_id").collect())
    said = {"z": a, "m": b, "c": c}
    known = [(s, x.id, x.name.lower().replace("-", " ")) for s, df in said.items() for x in df.collect()]
    assert got == sorted((s, i, t, j) for s, i, n in known for t, j, m in known if s < t and n == m) and len(got) == 40 + 120 + 3 + 1
    assert "left_source#" not in "".join(x for x in links._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)  # sources are no condition on pairs


@pytest.mark.parametrize("cells", [1 << 20, 4])
def test_vector_means(spark, monkeypatch, cells):
    """Partial sums over tasks, a hot key, null keys and elements, weights of 0, and vectors of two lengths."""
    from grainloom.operators import features

    monkeypatch.setattr(features, "CELLS", cells)
    r = random.Random(5)
    vectors = [(i, [r.random() if r.random() > 0.1 else None for _ in range(r.choice([3, 5]))]) for i in range(12)] + [(90, None), (91, [])]
    events = [(r.choice(["hot"] * 8 + ["a", "b", None]), r.randrange(14), r.choice([0.0, 1.0, 2.5, None])) for _ in range(600)] + [("none", 0, 0.0)]
    df = spark.createDataFrame(events, "who string, item int, grams double").repartition(6)
    got = {(x.who, x.dim): x.value for x in features.vector_mean(df, spark.createDataFrame(vectors, "item int, embedding array<double>"), ["who"]).collect()}
    sums = defaultdict(lambda: [0.0, 0.0])
    known = dict(vectors)
    for who, item, g in events:
        for dim, v in enumerate(known.get(item) or []):
            sums[who, dim][0] += (v or 0) * (g or 0)
            sums[who, dim][1] += g or 0
    assert got.keys() == sums.keys()
    assert all(got[k] == pytest.approx(s / w if w else 0.0) for k, (s, w) in sums.items())


def test_vector_means_by_sums(spark):
    """A key has the dimensions of its own vectors only, whatever vectors other keys have, and no rows go to Python."""
    from grainloom.operators import features

    e = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("b", 3, 2.0), ("c", 4, 1.0)], "who string, item int, grams double").coalesce(1)
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [5.0, None]), (3, [1.0, 1.0, 7.0])], "item int, embedding array<float>")
    out = features.vector_mean(e, v, ["who"])
    assert sorted(tuple(x) for x in out.collect()) == [("a", 0, 4.0), ("a", 1, 0.5), ("b", 0, 1.0), ("b", 1, 1.0), ("b", 2, 7.0)]
    assert "InArrow" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert features.vector_mean(e, v.limit(0), ["who"]).count() == 0


@pytest.mark.parametrize("unit", ["participant", "year"])
def test_mean_vectors_meet_once(spark, unit):
    """Events are shuffled once on the way to mean vectors, which are never rows of single dimensions."""
    import datetime

    from grainloom.operators import features

    at = [datetime.datetime(2020, 1, 1), datetime.datetime(2021, 5, 1)]
    r = random.Random(6)
    events = [(r.choice([1, 2, None]), r.randrange(5), float(r.randrange(4)), r.choice([*at, None])) for _ in range(200)] + [(7, 99, 1.0, at[0]), (8, 4, 1.0, at[0])]
    e = spark.createDataFrame(events, "participant int, item int, grams double, ts timestamp")
    v = spark.createDataFrame([(i, [float(i), 1.0, i / 2][: 3 - i % 2]) for i in range(4)] + [(4, [])], "item int, embedding array<double>")
    out = features.design_matrix("embedding", e, unit, v)
    key = ["participant", "window_id"]
    want = features.assembled(features.vector_mean(features.windowed(e, "ts", unit), v, key), key)
    assert out.columns == want.columns and sorted(map(repr, out.collect())) == sorted(map(repr, want.collect()))
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("Repartition") == 1 and "collect_list" not in plan
    done = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert done.count("Exchange hashpartitioning") == 1
