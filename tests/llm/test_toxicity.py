"""Held-out accuracy of the severity model, and its defined cases."""

import random

import numpy as np

from grainloom.llm import toxicity


def corpus(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ka", "lo", "mi", "ne", "su", "ta", "é"]) for _ in range(r.randint(1, 3)))
    out = []
    for i in range(n):
        w = [word() for _ in range(r.randint(15, 200))]
        bad = i % 5 == 0
        if bad:
            for _ in range(max(1, len(w) // r.choice([10, 40]))):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "scum", "grzl" + word()]))
        out.append((" ".join(w), int(bad)))
    return out


def test_held_out_accuracy_and_order():
    train, test = corpus(1, 900), corpus(2, 500)
    m = toxicity.fit([t for t, _ in train], [y for _, y in train])
    assert np.all(np.diff(m.thresholds) > 0)
    score = m.scorer()
    s, y = np.array([score(t) for t, _ in test]), np.array([y for _, y in test])
    assert (s[y == 1] >= toxicity.REJECT).mean() >= 0.97
    assert (s[y == 0] >= toxicity.REJECT).mean() <= 0.02
    assert score("scum " * 20) > score("scum " + "kalo mine sutata " * 15)


def test_defined_cases(spark):
    rows = corpus(3, 300)
    docs = spark.createDataFrame([(i, t, 1) for i, (t, _) in enumerate(rows)] + [(900, None, 1), (901, "", 1), (902, "...", 1), (None, rows[0][0], 1), (0, rows[0][0], 1)], "doc_id long, text string, severity int")
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(rows)] + [(0, 1, 1), (1, None, None), (None, 1, 1), (12345, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.grade(docs, model).collect()
    assert len(out) == 305 and all(r.severity == 0 and not r.toxic for r in out if r.doc_id in (900, 901, 902))
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r.toxic for r in out)
    none = toxicity.train(docs, labels.where("toxic = 0"))
    assert toxicity.grade(docs, none).where("toxic").count() == 0
    assert toxicity.grade(docs.limit(0), model).count() == 0
    assert toxicity.fit([], []).scorer()("idiot") == 0.0


def test_gradients_against_differences():
    r = np.random.default_rng(3)
    rows, cols, vals = r.integers(0, 12, 40), r.integers(0, 6, 40), r.random(40)
    grade, weight = r.integers(0, 3, 12), r.random(12)
    w, b = r.random(6), np.array([0.3, -0.2])
    f = lambda w, b: toxicity.loss(w, b, rows, cols, vals, grade, weight, 0.01)
    _, g_w, g_b = f(w, b)
    for v, g, at in ((w, g_w, 0), (b, g_b, 1)):
        for i in range(len(v)):
            up, down = v.copy(), v.copy()
            up[i] += 1e-6
            down[i] -= 1e-6
            ends = (f(up, b)[0], f(down, b)[0]) if at == 0 else (f(w, up)[0], f(w, down)[0])
            assert abs((ends[0] - ends[1]) / 2e-6 - g[i]) < 1e-5


def test_grades_follow_the_labels():
    """Texts of a higher grade get a higher expected severity."""
    r = random.Random(4)
    say = lambda n: " ".join("".join(r.choice(["ka", "lo", "mi", "ne", "su", "ta"]) for _ in range(r.randint(1, 4))) for _ in range(n))
    train = []
    for _ in range(600):
        g = r.choice([0, 0, 1, 2])
        train.append((" ".join([say(r.randint(20, 60)), *["idiot"] * (g > 0), *["scum"] * (4 if g == 2 else 0)]), g))
    m = toxicity.fit([t for t, _ in train], [g for _, g in train])
    assert len(m.thresholds) == 2
    score = m.scorer()
    assert score("kalo mine suta") < 0.5 <= score("kalo idiot suta mine neka") < score("kalo idiot scum scum scum scum mine suta neka")


def test_scores_against_a_plain_sum():
    m = toxicity.Severity({"scum": (1.0, 0.5), "^scu": (0.25, 0.0), "^idio": (2.0, 0.0)}, np.array([1.0, 3.0]))
    n, of = 2, 5
    s = 1.0 + 0.5 * np.log2(1 + 100 * n / of) + 0.25 + 2.0
    assert abs(m.scorer()("Scum a idiots SCUM b") - sum(1 / (1 + np.exp(c - s)) for c in (1.0, 3.0))) < 1e-12


def test_a_key_with_many_rows_teaches_once(spark):
    rows = corpus(5, 200)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)] + [(0, f"{rows[0][0]} {i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(rows)], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs, labels).telling.keys() >= {"idiot", "scum"}
