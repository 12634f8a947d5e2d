"""Contamination against a plain Python search."""

import hashlib
import random
import re

from grainloom.llm import decontam


def tokens(t):
    low = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(docs, tests, size=10):
    wins = {}
    for i, t in tests:
        w = tokens(t)
        for k in range(max(len(w) - size, 0) + 1 if w else 0):
            wins.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, items = tokens(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit |= set(range(k, k + n))
                    items |= {i for i in wins[x] if i is not None}
        ids = sorted(map(str, items))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_against_plain_search(spark):
    r = random.Random(5)
    vocab = ["the", "of", "a", "É", "é", "x1", "İ", "ß", "zq", "Word", "word", "to", "in"]
    say = lambda n: r.choice([" ", ", ", ".\n"]).join(r.choice(vocab) for _ in range(n))
    tests = [(i, say(r.choice([1, 3, 9, 10, 11, 14, 25]))) for i in range(14)] + [(20, None), (21, ""), (22, "..."), (None, "rare words only here"), (23, "the")]
    docs = [(i, say(r.randint(0, 60))) for i in range(60)]
    for i in range(60, 110):
        t = r.choice([t for _, t in tests if t])
        docs.append((i, f"{say(r.randint(0, 5))}; {t.upper() if i % 3 == 0 else t}! {say(r.randint(0, 5))} {t}"))
    docs += [(200, None), (201, ""), (202, " ?"), (None, tests[0][1]), (None, None), docs[70], docs[70], (70, "other text the"), (203, (tests[5][1] + " ") * 300), (204, "a" * 20000)]
    df = spark.createDataFrame([(*d, 1, "c") for d in docs], "doc_id long, text string, n_words long, word string")
    tf = spark.createDataFrame([(*t, "c") for t in tests], "item_id long, text string, id string")
    out = decontam.contamination(df, tf)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    rows = out.collect()
    assert sorted([tuple(x)[:6] for x in rows], key=str) == plain(docs, tests)
    assert all(x.n_near >= x.n_items for x in rows)


def test_proximity(spark):
    test = "one two three four five six seven eight nine ten"
    docs = [(1, test), (2, test.replace("five", "five extra")), (3, test.replace("five six", "six five")), (4, "one two three"), (5, "ten nine")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_items, r.n_near) for r in decontam.contamination(df, spark.createDataFrame([(9, test)], "item_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (0, 1), 3: (0, 1), 4: (0, 0), 5: (0, 0)}


def test_empty(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(df.limit(0), none).count() == 0
    assert [tuple(x)[:4] for x in decontam.contamination(df, none).collect()] == [(1, 2, 0, 0)]


def test_repeated_rows_meet_once(spark, monkeypatch):
    """Two thousand repeats of one row take the matches of one, and each gets its result; a null key too."""
    test = " ".join(f"w{i}" for i in range(46))
    tf = spark.createDataFrame([(9, test)], "item_id long, text string")
    made = []
    kept = decontam.stored
    monkeypatch.setattr(decontam, "stored", lambda df, label: [made.append((label, out := kept(df, label))), out][1])
    sizes = {}
    for n in (1, 2000):
        made.clear()
        df = spark.range(n).selectExpr("cast(null AS long) AS doc_id", f"'{test}' AS text").union(spark.range(n).selectExpr("5L", f"'x {test}'"))
        out = decontam.contamination(df, tf).groupBy("doc_id", "n_words", "n_hit", "n_items", "n_near").count().collect()
        assert sorted((tuple(r) for r in out), key=str) == [(5, 47, 46, 1, 1, n), (None, 46, 46, 1, 1, n)]
        sizes[n] = dict(made)["matches"].count()
    assert sizes[2000] == sizes[1]


def test_without_broadcasts(spark, monkeypatch):
    """Where nothing may be broadcast, words are joined by shuffle, and results stay."""
    r = random.Random(6)
    say = lambda n: " ".join(r.choice(["the", "of", "É", "x1", "Word", "to", "zq", "in"]) for _ in range(n))
    tests = [(i, say(r.choice([2, 10, 14]))) for i in range(6)]
    docs = [(i, f"{say(r.randint(0, 20))} {r.choice(tests)[1]} {say(3)}" if i % 2 else say(r.randint(0, 30))) for i in range(30)] + [(90, None), (91, ""), (None, tests[0][1])] + [(92, tests[1][1])] * 3
    df, tf = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(tests, "item_id long, text string")
    want = sorted(map(tuple, decontam.contamination(df, tf).collect()), key=str)
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    got = sorted(map(tuple, decontam.contamination(df, tf).collect()), key=str)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == want and [x[:6] for x in got] == plain(docs, tests)
