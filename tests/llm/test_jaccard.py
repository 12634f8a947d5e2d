"""The join against all pairs of plain Python sets."""

import random
import re

import numpy as np
import pytest

from grainloom.llm import jaccard


def plain_set(t):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(rows):
    sets = [(d, plain_set(t)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and None not in (a, b) and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted(((d, len(s), find(d)) for d, s in sets), key=str)


def texts(seed):
    r = random.Random(seed)
    vocab = ["a", "É", "é", "The", "the", "\x85x", " ", "w1", "w2"] + [f"v{i}" for i in range(40)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    shared = say(60)
    out = [None, "", " \n\t", "one", "ONE", "one two three four", "one two three  four", "a b c d e", "x" * 30000]
    for _ in range(30):
        base = say(r.choice([3, 6, 12, 40, 90, 160])) + (shared if r.random() < 0.5 else [])
        for _ in range(r.randint(1, 7)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 35))):
                w[r.randrange(len(w))] = r.choice(vocab)
            if r.random() < 0.3:
                w = w[: len(w) - len(w) // 7]
            out.append(r.choice([" ", "\n", "  "]).join(w))
    out += [" ".join(shared)] * 20 + [" ".join([*shared, *say(2)]) for _ in range(12)]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(spark, seed, monkeypatch):
    if seed == 2:  # frequent shingles last
        monkeypatch.setattr(jaccard, "COMMON", 4)
        monkeypatch.setattr(jaccard, "BROADCAST_KEYS", 0)
        monkeypatch.setattr(jaccard, "FAMILY", 3)
    if seed == 3:  # lists in pieces, and paired in blocks
        for name, value in (("LOCAL", 2), ("COMMON", 4), ("PIECE", 5), ("CROSS", 3), ("HEAP", 0)):
            monkeypatch.setattr(jaccard, name, value)
    rows = list(enumerate(texts(seed)))
    rows += [rows[30], rows[30], (31, "quite another text of six words"), (500, "quite another text of six words"), (None, rows[31][1])]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, n int, id int").repartition(5)
    got = sorted((tuple(x) for x in jaccard.join(df).collect()), key=str)
    want = [x if x[0] is not None else (None, x[1], None) for x in plain([(d, t) for d, t in rows])]
    assert got == sorted(want, key=str)


def test_search_and_empty(spark, monkeypatch):
    r = np.random.default_rng(4)
    for _ in range(60):
        base = np.unique(r.integers(0, 400, r.integers(1, 120)).astype(np.uint64))
        members = []
        for _ in range(30):
            keep = base[r.random(len(base)) > r.choice([0, 0.05, 0.15])]
            members.append(np.unique(np.concatenate([keep, r.integers(0, 400, r.integers(0, 12)).astype(np.uint64)])))
        want = [i for i, m in enumerate(members) if 100 * len(np.intersect1d(base, m)) >= 80 * len(np.union1d(base, m))]
        assert jaccard.t_occurrence(base, members) == want
        monkeypatch.setattr(jaccard, "HEAP", r.choice([0, 400, 1 << 30]))
        family = jaccard.Family([*members, base])
        assert family.search(30, np.ones(31, bool)).tolist() == want
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join(df).count() == 0


def test_repeated_rows_are_listed_once(spark, monkeypatch):
    """Two thousand repeats of a row leave the inverted lists and pairs as one does."""
    r = random.Random(9)
    words = [f"v{r.randrange(500)}" for _ in range(80)]
    near = [" ".join(w if r.random() > 0.01 else "other" for w in words) for _ in range(6)]
    made = []
    kept = jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df, label: [made.append((label, out := kept(df, label))), out][1])
    monkeypatch.setattr(jaccard, "discard", lambda *tables: None)
    sizes = {}
    for n in (1, 2000):
        made.clear()
        df = spark.range(n).selectExpr("3L AS doc_id", f"'{near[0]}' AS text").union(spark.createDataFrame([(i + 10, t) for i, t in enumerate(near[1:])], "doc_id long, text string"))
        out = jaccard.join(df).groupBy("doc_id", "component_id").count().collect()
        assert sorted(map(tuple, out)) == sorted((d, c, m) for (d, _, c), m in {row: n if row[0] == 3 else 1 for row in plain([(3, near[0])] + [(i + 10, t) for i, t in enumerate(near[1:])])}.items())
        sizes[n] = {k: df.count() for k, df in made if k in ("lists", "stars", "pairs")}
    assert sizes[2000] == sizes[1]
