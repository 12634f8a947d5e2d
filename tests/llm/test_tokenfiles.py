"""Token files against the tokenizers library, and what their index is for."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow.orc as orc
import pytest

from grainloom.llm import registry, tokenfiles
from grainloom.llm.common import folder

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " \n", "Hello, World it's 123", "Straße ÀÉÎÕÜ ÿ", "<|endoftext|> a", "日本語 x y", "ab" * 5000 + " c", "the the"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def expected(library, rows):
    """(key, start, n, crc) in ascending order of keys, nulls first; rows of one key in any order must be alike."""
    out, at = [], 0
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_round_trip(spark, library):
    rows = [(7 * i % 11 - 3, t) for i, t in enumerate(TEXTS)] + [(None, "no key"), (50, "twice"), (50, "twice"), (50, "twice")]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, ids string, part int").repartition(3)
    path = folder(spark, "test")
    tokenfiles.write(df, path, PATH)
    tokens = tokenfiles.read(spark, path)
    got = [tuple(r) for r in tokenfiles.checksums(tokens).orderBy("start").collect()]
    assert got == expected(library, rows)
    assert [r.ids for r in tokenfiles.read(spark, path, [50, 99]).collect()] == [[*library.encode("twice").ids, 1]] * 3
    files = spark.read.orc(f"{path}/files").orderBy("part").collect()
    assert sum(f.documents for f in files) == len(rows) and all(a.last_key <= b.first_key for a, b in zip(files, files[1:], strict=False) if None not in (a.last_key, b.first_key))


def test_empty_table(spark):
    path = folder(spark, "test")
    tokenfiles.write(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert tokenfiles.checksums(tokenfiles.read(spark, path)).count() == 0


def test_repeated_key_spreads(spark, library):
    path = folder(spark, "test")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these few rows would be one file
    tokenfiles.write(spark.range(4000).selectExpr("if(id % 3 = 0, 5, id) AS doc_id", "'same words' AS text"), path, PATH)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = tokenfiles.checksums(tokenfiles.read(spark, path)).orderBy("start").collect()
    assert [r.start for r in got] == list(range(0, 12000, 3)) and [r.doc_id for r in got] == sorted(r.doc_id for r in got)
    per_file = [r.documents for r in spark.read.orc(f"{path}/files").collect()]
    assert max(per_file) < 1334


def test_stripes_and_pruning(spark, monkeypatch):
    monkeypatch.setattr(tokenfiles, "STRIPE", 1 << 16)
    path = folder(spark, "test")
    tokenfiles.write(spark.range(0, 40000, 2).selectExpr("id AS doc_id", "concat('w', id, ' some words ', id * 7)  AS text"), path, PATH)
    local = [f.removeprefix("file://") for f in spark.read.orc(f"{path}/ids").inputFiles()]
    assert sum(orc.ORCFile(f).nstripes for f in local) > len(local)
    assert {orc.ORCFile(f).row_index_stride for f in local} == {tokenfiles.ROW_GROUP}
    plan = tokenfiles.read(spark, path, [10, 11])
    assert "PushedFilters: [In(doc_id" in plan._jdf.queryExecution().toString()
    assert [r.doc_id for r in plan.collect()] == [10]


def test_query_as_the_library(spark, library):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in registry.QUERIES["op12_token_files"](spark, d).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == sorted(expected(library, rows))
