"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from grainloom.llm import collocations as C

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, first=2000):
    """(lang, rank, phrase, a, l, r, n, score) by definition."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(_LOWER)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang or "und"] += len(w)
            f.update((lang or "und", *w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang in n:
        ours = {p[1:]: a for p, a in f.items() if p[0] == lang and len(p) > 2 and a >= least}
        rows = []
        for p, a in ours.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in ours.items()):
                continue
            s, _, left, right = min((2000000 * a // (f[(lang, *p[:k])] + f[(lang, *p[k:])]), k, f[(lang, *p[:k])], f[(lang, *p[k:])]) for k in range(1, len(p)))
            rows.append((-s, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:first], 1)]
    return sorted(out)


def invented(seed, documents=60):
    r = random.Random(seed)
    words = ["the", "The", "of", "a", "é", "Éa", "x", "new", "york", "city", "hall", "zz"]
    glue = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "; ", " ! ", "\x0b"]
    text = lambda: "".join(r.choice(words) + r.choice(glue) + ("new york city hall " if r.random() < 0.1 else "") for _ in range(r.randint(0, 80)))
    return [(text(), r.choice(["en", "fr", None, "und"])) for _ in range(documents)] + [(None, "en"), ("", "en"), (" \n.,", "de"), ("alone", "de"), ("a a a a a a a a", "de")] + [("same row again here", "fr")] * 40


@pytest.mark.parametrize(("seed", "least", "first"), [(1, 2, 2000), (2, 5, 2000), (3, 30, 2000), (4, 3, 7)])
def test_against_plain_counts(spark, monkeypatch, seed, least, first):
    monkeypatch.setattr(C, "SHARD_WORDS", 300)
    rows = invented(seed)
    df = spark.createDataFrame([(t, x, 1, "clash") for t, x in rows], "text string, lang string, n int, phrase string").repartition(3)
    got = sorted(tuple(r) for r in C.collocations(df, least=least, first=first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == plain(rows, least, first)


def test_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert C.collocations(spark.createDataFrame([(None, None), ("few words", "en")], "text string, lang string")).count() == 0


def test_full_tables_only_cost_work(spark, monkeypatch):
    monkeypatch.setattr(C, "FILTER_BITS", 1 << 15)
    monkeypatch.setattr(C, "bit_table", lambda hashes: np.full(4096, 255, np.uint8))  # all pass
    rows = invented(5)
    df = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(tuple(r) for r in C.collocations(df, least=4).collect()) == plain(rows, 4)


def test_cut():
    data, lengths, begins = C.cut(pa.array(["Ab c.d", None, "", "e\tÉf", "g"]))
    words = np.split(data, np.cumsum(lengths)[:-1])
    assert [bytes(w).decode() for w in words] == ["ab", "c", "d", "e", "Éf", "g"]
    assert begins.tolist() == [True, False, True, True, False, True]
    sliced = pa.array(["skip me", "x y", "z"]).slice(1)
    assert C.cut(sliced)[1].tolist() == [1, 1, 1]


def test_bitmaps_cross_containers_and_batches(monkeypatch):
    monkeypatch.setattr(C, "BATCH", 5)
    r = random.Random(0)
    words = np.array([r.randrange(4) for _ in range(200)])
    begins = np.array([i == 0 or r.random() < 0.1 for i in range(200)])
    signed = np.where(begins, -words - 1, words + 1).astype("<i4")
    shard = C.Bitmaps(200, pa.compress(signed, codec="zstd", asbytes=True), np.ones(4, bool))
    hashes = np.arange(1, 5, dtype=np.uint64)
    got = Counter()
    for numbers, counts in C.grown(shard, hashes, np.full(4096, 255, np.uint8)):
        for *p, n in zip(*numbers, counts, strict=True):
            got[tuple(map(int, p))] += int(n)
    want = Counter(tuple(map(int, words[i : i + k])) for k in (2, 3, 4) for i in range(201 - k) if not begins[i + 1 : i + k].any())
    assert got == want
