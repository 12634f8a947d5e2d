"""Held-out accuracy, and the defined cases."""

import random

import numpy as np

from grainloom.llm import langid


def rows(n):
    r = random.Random(4)
    parts = {"aa": ["ka", "lo", "mi", "ne"], "bb": ["sch", "ung", "er", "ü"], "cc": ["ción", "que", "os", "lo"]}
    out = []
    for i in range(n):
        k = r.choice(sorted(parts))
        out.append((i, " ".join("".join(r.choice(parts[k]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 60))), k))
    return out


def test_held_out_accuracy_and_cases(spark):
    data = rows(400)
    extra = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !? 4", "bb"), (1003, "x" * 200_000, None), (1004, data[0][1], None), (None, data[1][1], "bb"), (5, data[5][1], data[5][2])]
    df = spark.createDataFrame([(*d, 0.5) for d in data + extra], "doc_id long, text string, lang string, score double")
    model = langid.fit(df.where(~langid.held_out()))
    assert model.langs == ["aa", "bb", "cc"]
    out = langid.predict(df, model).join(df.select("doc_id", "lang", langid.held_out().alias("h")).distinct(), "doc_id").collect()
    held = [r for r in out if r.h and r.doc_id < 400]
    assert len(held) > 60 and np.mean([r.lang == r.lang_pred for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in out)
    assert all(r.lang_pred == "und" and r.score == 0 for r in out if r.doc_id in (1000, 1001, 1002))
    assert langid.predict(df, model).count() == len(data) + len(extra)
    none = langid.fit(df.where("lang is null"))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0


def test_vectors_are_bound_and_permuted():
    places = langid.letters()
    v, has = langid.bundle(["abc", "cba", "12", "ABC"], places)
    assert has.tolist() == [True, True, False, True]
    assert np.allclose(v[0], v[3]) and abs(float(v[0] @ v[1])) < 0.5


def test_prediction_against_a_plain_profile():
    """Cosines against profiles that are bound and bundled one trigram at a time."""
    places = langid.letters()

    def plain(text):
        s = langid.symbols(text)
        v = np.zeros(langid.DIM)
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            v += places[0][a].astype(float) * places[1][b] * places[2][c]
        return v / np.linalg.norm(v)

    texts = ["the cat sat", "der Hund läuft schnell", "日本語のテキスト", "a", "x" * 500 + " yz", "".join(chr(0x4E00 + i * 7 % 20000) for i in range(30000))]
    got, has = langid.bundle([*texts, None, "", "123"], places)
    assert has.tolist() == [True] * 6 + [False] * 3
    for t, v in zip(texts, got, strict=False):
        assert np.allclose(plain(t), v, atol=1e-4)
