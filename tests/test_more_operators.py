"""Operators against plain Python and numpy on small tables."""

import io
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from grainloom import scratch
from grainloom.functions import numeric, text
from grainloom.operators import features, fuse, graph, learn, quality, vectors, windows
from grainloom.sources import readers, sheets


def test_quantiles_against_numpy(spark):
    g = np.random.default_rng(3)
    groups = {"a": g.normal(size=2000), "b": np.repeat([1.0, 2.0, 2.0, 7.0], 3), "c": np.array([5.0]), "d": np.round(g.normal(size=500), 1)}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("a", None), ("e", None), (None, 1.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    at = [0.0, 0.1, 0.5, 0.9, 0.975, 1.0]
    got = {(r.g, r["quantile"]): r.value for r in windows.quantiles(df, "v", at, "g").collect()}
    for k, v in {**groups, None: np.array([1.0, 3.0])}.items():
        for q in at:
            assert got[k, q] == pytest.approx(np.quantile(v, q), abs=1e-12), (k, q)
    assert len(got) == 5 * len(at)
    assert windows.quantiles(df.limit(0), "v", at).count() == 0


def test_ranks_and_running_sums(spark):
    df = spark.createDataFrame([(i, i * 7 % 13) for i in range(200)], "id int, v int").repartition(6)
    out = windows.running_share(df, "v", "id").orderBy(F.desc("v"), "id").collect()
    total, run = sum(r.v for r in out), 0
    for r in out:
        run += r.v
        assert r.cumulative_share == pytest.approx(run / total)
    for n in (1, 2, 7, 20):
        got = features.exposure_groups(df.where(F.col("id") < n).withColumn("v", F.col("v").cast("double")), "id", "v").collect()
        want = spark.createDataFrame([tuple(r) for r in got]).toPandas().sort_values(["_2", "_1"])
        sizes = [n // 3 + (i < n % 3) for i in range(3)]
        assert want["_3"].tolist() == [t + 1 for t in range(3) for _ in range(sizes[t])]


def test_nearest_in_blocks(spark, monkeypatch):
    g = np.random.default_rng(5)
    x = g.normal(size=(120, 8))
    x[50] = x[40]
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(500, None, 1)], "vec_id long, embedding array<double>, label int").repartition(4)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = np.round(u @ u.T, 9)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 9)
    got = vectors.nearest(df.where("vec_id % 4 = 0"), df, 3).collect()
    for q in range(0, 120, 4):
        best = sorted((-cos[q, j], j) for j in range(120) if j != q)[:3]
        assert [r.base_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [j for _, j in best]


def test_projection_against_numpy(spark):
    g = np.random.default_rng(6)
    x = g.normal(size=(200, 5)) * [5, 3, 1, 0.5, 0.1] + 2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: (r.pc1, r.pc2) for r in vectors.pca(df, "vec_id", "embedding").collect()}
    c = x - x.mean(axis=0)
    load = np.linalg.svd(c, full_matrices=False)[2][:2].T
    load *= np.sign(load[np.abs(load).argmax(axis=0), [0, 1]])
    assert np.allclose([got[i] for i in range(200)], c @ load, atol=1e-8)


def test_blocks_against_numpy(spark):
    rows = [(1, 3.0, 0, "alpha beta beta"), (2, None, 5, "beta gamma"), (3, 10.0, 2, ""), (4, 1.0, 1, None)]
    df = spark.createDataFrame(rows, "k int, a double, b int, t string")
    v, dims = vectors.blocks_of(df, "k", {"x": ["a"], "y": ["b"]}, "t", 8)
    got = np.array([r.vector for r in v.orderBy("k").collect()])
    assert dims == [("x", 1), ("y", 1), ("text", 8)] and got.shape == (4, 10)
    a = np.log1p([3.0, 3.0, 10.0, 1.0])
    assert np.allclose(got[:, 0], (a - a.mean()) / a.std(ddof=1))
    b = np.log1p([0, 5, 2, 1])
    assert np.allclose(got[:, 1], (b - b.mean()) / b.std(ddof=1))
    assert np.allclose(got[:, 2:].mean(axis=0), 0) and np.allclose(got[2], np.r_[got[2, :2], got[3, 2:]])
    x, y = vectors.shared_log_matrices(df.select("k", "a", "b"), df.select("k", "a", "b"), "k", ["a", "b"])
    assert all(abs(np.linalg.norm(r.vector) - 1) < 1e-9 for r in x.unionByName(y).collect())


def test_encoded_once(spark):
    path = f"{scratch.work_dir(spark)}/e"
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, t string")
    runs = lambda n: lambda t: F.array(F.lit(float(n)))
    assert {r.vector[0] for r in vectors.encoded_once(df, path, "k", "t", runs(1)).collect()} == {1.0}
    again = vectors.encoded_once(spark.createDataFrame([(1, "a"), (2, "changed"), (4, "d")], "k int, t string"), path, "k", "t", runs(2))
    assert {r.k: r.vector[0] for r in again.collect()} == {1: 1.0, 2: 2.0, 4: 2.0}


def test_weighted_mean_masks_nan(spark):
    nan = float("nan")
    df = spark.createDataFrame([("k", 1.0, 1.0), ("k", nan, 5.0), ("k", 3.0, nan), ("z", nan, 1.0)], "k string, v double, w double")
    mean, n = fuse.weighted_mean("v", "w")
    assert {r.k: (r.m, r.n) for r in df.groupBy("k").agg(mean.alias("m"), n.alias("n")).collect()} == {"k": (2.0, 2), "z": (None, 0)}


def test_ids_targets_and_filters(spark):
    ids = spark.createDataFrame([("12.0",), (" 7 ",)], "x string").select(numeric.required_id(F.col("x")).alias("x"))
    assert sorted(r.x for r in ids.collect()) == ["12", "7"]
    for bad in ("1.5", "", "true", None):
        with pytest.raises(Exception, match="no whole id"):
            spark.createDataFrame([(bad,)], "x string").select(numeric.required_id(F.col("x"))).collect()
    df = spark.createDataFrame([("a:1", 0.5, "x"), ("b:2", 0.9, None)], "k string, s double, t string")
    assert features.approved_targets(df, ["s", "k"], strict=False) == ["s"]
    with pytest.raises(KeyError):
        features.approved_targets(df, ["s", "k"])
    assert [r.k for r in features.between(df, "s", 7.0, 0.6).collect()] == ["b:2"]
    assert [r.n for r in features.keyed(df, "k", "a:", "n").collect()] == ["1"]
    assert [r.k for r in features.complete(df, ["t"]).collect()] == ["a:1"]
    assert features.classified(["a_key", "a_date", "x"], [("key$", "key"), ("date", "time")], "other") == [("a_key", "key"), ("a_date", "time"), ("x", "other")]


def test_remapping_needs_half(spark):
    df = spark.createDataFrame([("1",), ("2",), ("3",)], "k string")
    lookup = lambda n: spark.createDataFrame([(str(i), f"P{i}") for i in range(1, n + 1)], "old string, new string")
    assert sorted(r.k for r in features.remapped(df, "k", lookup(1)).collect()) == ["1", "2", "3"]
    assert {r.k for r in features.remapped(df, "k", lookup(2)).collect()} == {"P1", "P2", None}


def test_wide_and_long_tables(spark):
    long = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 3.0), ("b", "y", 5.0)], "k string, n string, v double")
    assert {tuple(r) for r in features.shaped(long, "k", ("n", "v"), ["x", "y"]).collect()} == {("a", 2.0, None), ("b", None, 5.0)}
    assert {tuple(r) for r in features.shaped(long, "k", None).collect()} == {("a", 2.0), ("b", 5.0)}


def test_graph_choices(spark):
    df = spark.createDataFrame([(1, "Milk, whole", 5), (2, "Rice", 9), (3, "Brown rice", 9)], "item int, said string, logs int")
    low = df.withColumn("said", F.lower("said"))
    words = spark.createDataFrame([("rice", 1), ("brown", 2), ("none", 3)], "word string, i int")
    assert {tuple(r) for r in graph.representatives(low, words, "said", "logs").collect()} == {(2, 1), (3, 2)}
    assert graph.seed(df, "said", "RICE", ["milk"], "item").first().item == 2 and graph.seed(df, "said", "zzz", ["milk"], "item").first().item == 1
    top = windows.by_priority(df.withColumn("kind", F.lit("k")), ["kind"], "item", {3: 0}, "said", 2)
    assert {r.item for r in top.collect()} == {1, 3}
    s = graph.label_summary(spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("a", "w")], "k string, l string"), "k", "l", 2).first()
    assert (s.top_labels, s.counts) == ("y | w", '{"w":1,"x":1,"y":2}')


def test_scores_of_classes_by_hand(spark):
    from pyspark.ml.linalg import Vectors

    y, p = [1, 0, 1, 0, 0, 1], [0.9, 0.8, 0.7, 0.7, 0.2, 0.1]
    df = spark.createDataFrame([(float(a), float(b >= 0.5), Vectors.dense([1 - b, b])) for a, b in zip(y, p, strict=True)], ["_y", "prediction", "probability"])
    m = learn.classification_metrics(df).first()
    pairs = [(b > d) + (b == d) / 2 for a, b in zip(y, p, strict=True) if a for c, d in zip(y, p, strict=True) if not c]
    assert m.auroc == pytest.approx(np.mean(pairs)) and m.accuracy == pytest.approx(0.5)
    # Average precision with ties taken together: thresholds .9, .8, .7, .2, .1
    assert m.auprc == pytest.approx((1 * 1 + 0 * 0.5 + 1 * 2 / 4 + 0 + 1 * 3 / 6) / 3)


def test_split_by_class(spark):
    df = spark.range(400).withColumn("y", (F.col("id") % 10 == 0).cast("double"))
    train, test = learn.split(df, "id", 0, strata="y")
    assert train.join(test, "id").count() == 0 and train.count() + test.count() == 400
    assert {r.y: r["count"] for r in test.groupBy("y").count().collect()} == {0.0: 72, 1.0: 8}
    assert train.columns == df.columns


def test_sheets(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Code</t></si><si><r><t>Na</t></r><r><t>me</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="C3"><v>4.5</v></c></row></sheetData></worksheet>')
    got = sorted(map(tuple, sheets.read_xlsx(spark, str(tmp_path / "s.xlsx"), 3).collect()))
    assert got == [(1, "Code", None, "Name"), (3, None, None, "4.5")]
    (tmp_path / "t.xlsx").write_bytes(sheets.sheet_bytes([["Energy", None], ["kcal", "kJ"], [1, "<&>"]]))
    df = sheets.two_headers(sheets.read_xlsx(spark, str(tmp_path / "t.xlsx"), 2))
    assert df.columns == ["row", "Energy kcal", "Energy kJ"] and tuple(df.first()) == (3, "1", "<&>")
    assert sheets.column_by_prefix(df, "energy kj") == "Energy kJ"
    with pytest.raises(KeyError):
        sheets.column_by_prefix(df, "Energy")


def test_parquet_members(spark, tmp_path):
    part = io.BytesIO()
    pd.DataFrame({"id": [1, None], "x": ["a", None]}).astype({"id": "Int64"}).to_parquet(part)
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("a.parquet", part.getvalue())
    got = readers.read_zip_members(spark, str(tmp_path / "p.zip"), ".parquet", "id int, x string").collect()
    assert {tuple(r) for r in got} == {(1, "a"), (None, None)}
    with pytest.raises(Exception, match="lacks"):
        readers.read_zip_members(spark, str(tmp_path / "p.zip"), ".parquet", "id int, y string").collect()


def test_normalise_mixed_scripts(spark):
    rows = ["Plain Text", "Café Ü", None, "", "ﬁn"]
    df = spark.createDataFrame([(r,) for r in rows], "x string").select("x", text.normalize(F.col("x")).alias("n"))
    assert {r.x: r.n for r in df.collect()} == {"Plain Text": "plain text", "Café Ü": "cafe u", None: "", "": "", "ﬁn": "fin"}


def test_profiles_have_medians(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (9.0, None)], "a double, b double")
    got = {r.column: (r.n_present, r.median) for r in quality.profile(df, ["a", "b"], "t").collect()}
    assert got == {"a": (3, 2.0), "b": (0, None)}
