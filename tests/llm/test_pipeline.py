"""Each stage against plain Python on a small corpus with hard rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int, row int, digest string, key int, _k int, _row int, at int, id int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    r = random.Random(2)
    word = lambda: "".join(r.choice(["ka", "lo", "mi", "ne", "su", "ta"]) for _ in range(r.randint(1, 3)))
    say = lambda n: " ".join(word() for _ in range(n))
    bad = ["idiot", "moron", "scum"]
    rows, labels = [], []
    for i in range(240):
        t = say(r.randint(20, 80))
        if i % 4 == 0:
            w = t.split()
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(bad))
            t = " ".join(w)
        rows.append([i, t, "en", "a", len(t), 1])
        if i < 200:
            labels.append((i, 1, int(i % 4 == 0)))
    bench = say(30)
    rows += [[300, rows[1][1], "en", "a", 0, 1], [301, rows[1][1] + " more", "en", "a", 0, 1], [302, say(20) + " " + bench + " " + say(5), "en", "a", 0, 1], [303, "mail a@b.cc and " + say(40), "en", "a", 0, 1]]
    rows += [[304, None, None, None, None, None], [305, "", "en", "a", 0, 1], [306, say(50), "en", "a", 0, 1], [306, say(45), "en", "a", 0, 1], [None, say(30), "en", "a", 0, 1], [None, bench, "en", "a", 0, 1]]
    rows.append(list(rows[246]))
    rows.append(list(rows[246]))
    spark.createDataFrame([(*x, 1, "c", 1, 1, 1, 1, 1) for x in rows], SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, bench), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows


def test_stages(spark, folder):
    d, rows = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)

    clean = stage["toxicity"](spark, docs, d).cache()
    assert clean.columns == columns
    assert ids(clean) == sorted((r[0] for r in rows if not (r[0] is not None and r[0] < 240 and r[0] % 4 == 0)), key=str)
    one = stage["ngram_jaccard"](spark, clean, d).cache()
    assert one.columns == columns
    kept = [(r[0], r[1]) for r in rows if r[0] is None or (r[0] >= 240 or r[0] % 4) and r[0] not in (300, 301)]
    # One row of each text that repeats; both unrelated texts of doc_id 306.
    assert ids(one) == sorted([None for i, _ in kept if i is None] + [i for i, _ in {x for x in kept if x[0] is not None}], key=str)
    sound = stage["decontamination"](spark, one, d).cache()
    assert sound.columns == columns and ids(sound) == sorted([x for x in ids(one) if x not in (302, None)] + [None], key=str)
    safe = stage["pii"](spark, sound, d).cache()
    assert safe.columns == columns and safe.count() == sound.count()
    assert safe.where("doc_id = 303").first().text.startswith("mail [EMAIL] and ")
    assert safe.where(F.col("n_chars") != F.length("text")).count() == 0
    assert safe.exceptAll(sound.withColumn("n_chars", F.length("text").cast("long"))).count() == 1
    assert stage["bpe"](spark, safe, d).count() == safe.count()
    assert corpus_pipeline.run(spark, d).exceptAll(stage["bpe"](spark, safe, d)).count() == 0


def test_empty(spark, folder, tmp_path):
    d, _ = folder
    none = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, none, d).count() == 0


def test_near_duplicates_by_row(spark, tmp_path):
    """Rows that share a doc_id and hold unrelated texts all stay; only those whose own text has a copy go."""
    r = random.Random(4)
    say = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(40))
    first, again, *own = (say() for _ in range(12))
    rows = [(1, first), (2, say()), (7, first + " more"), *((7, t) for t in own), (7, own[0]), (8, own[1]), (9, again), (9, again + " more"), (7, None), (7, None), (None, first)]
    spark.createDataFrame([(i, t, "en", "a", len(t or ""), 1, 1, "c", 1, 1, 1, 1, 1) for i, t in rows], SCHEMA).repartition(3).write.parquet(str(tmp_path / "docs"))
    out = corpus_pipeline.keep_one_of_each_group(spark, spark.read.parquet(str(tmp_path / "docs")), "").collect()
    got = sorted(((x.doc_id, x.text) for x in out), key=str)
    nine = [t for i, t in got if i == 9]
    assert len(nine) == 1 and nine[0] in (again, again + " more")
    assert [x for x in got if x[0] != 9] == sorted([(1, first), rows[1], *((7, t) for t in own), (7, None), (7, None), (None, first)], key=str)


def test_many_repeats_and_map_columns(spark, tmp_path):
    """Repeats of one row, with and without a key, end as one or as many; a column of maps passes through."""
    r = random.Random(6)
    say = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    one, none, bench = say(40), say(45), say(30)
    rows = [(1, one)] * 2000 + [(2, say(40)), (3, f"{say(9)} {bench}")] + [(None, none)] * 500 + [(None, bench)] * 500
    df = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long").selectExpr("*", "map('k', doc_id) AS extra")
    df.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, str(tmp_path)).cache()
    assert kept.columns == docs.columns
    count = lambda d: sorted(((x.doc_id, x["count"]) for x in d.groupBy("doc_id").count().collect()), key=str)
    assert count(kept) == [(1, 1), (2, 1), (3, 1), (None, 1000)]
    assert count(corpus_pipeline.remove_contaminated(spark, kept, str(tmp_path))) == [(1, 1), (2, 1), (None, 500)]
