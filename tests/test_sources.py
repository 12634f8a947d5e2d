"""Readers and writers on files made here."""

import zipfile

import pytest
from pyspark.sql import functions as F

from grainloom.sources import readers, writers


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/food.csv", 'fdc_id,name\n1,"a, b"\n2,\n')
        z.writestr("x/other.csv", "fdc_id\n9\n")
    df = readers.read_zip_members(spark, str(tmp_path / "a.zip"), "food.csv", "fdc_id int, name string")
    assert sorted(map(tuple, df.collect())) == [(1, "a, b"), (2, "")]
    with pytest.raises(Exception, match="members end with"):
        readers.read_zip_members(spark, str(tmp_path / "a.zip"), ".csv", "fdc_id int").collect()


def test_header_rows(spark):
    assert readers.flatten_header(["id", "Energy", None], [None, "kcal", "kJ"]) == ["id", "Energy kcal", "Energy kJ"]
    rows = [(0, "title", None), (1, "Item No.", "name"), (2, "1", "rice"), (3, "12 CEREALS", None), (4, "2", "oats")]
    df = spark.createDataFrame(rows, "n long, a string, b string")
    got = readers.from_header_row(df, "n", "^Item", ["id", "name"], drop=r"^\s*\d+\s+[A-Z ]+\s*$")
    assert sorted(map(tuple, got.collect())) == [("1", "rice", 2), ("2", "oats", 4)]


def test_records_and_optional(spark, tmp_path):
    df = spark.createDataFrame([(1, " a ", None), (2, " ", "x"), (3, None, "y")], "id int, name string, cat string")
    assert [tuple(r) for r in readers.records(df, "s", "id", "name", "cat").collect()] == [("s", "1", "a", "")]
    none = readers.read_optional(spark, str(tmp_path / "no.parquet"), "a int")
    assert none.count() == 0 and none.columns == ["a"]
    assert readers.union_all([df, none]).columns == ["id", "name", "cat", "a"]


def test_ndjson_skips_what_is_no_json(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "name": "x"}\nnot json\n{"id": 2}\n')
    assert sorted(map(tuple, readers.read_ndjson(spark, str(tmp_path / "a.jsonl"), "id int, name string").collect())) == [(1, "x"), (2, "")]


def test_validation(spark):
    ok = spark.createDataFrame([(1, 2, 0.5)], "a int, b int, v double")
    assert readers.valid_amounts(ok, ["a", "b"], "v").count() == 1
    for bad in [(1, 2, -1.0), (1, 2, float("inf")), (1, 2, float("nan"))]:
        with pytest.raises(Exception, match="bad v"):
            readers.valid_amounts(spark.createDataFrame([bad], "a int, b int, v double"), ["a", "b"], "v").collect()
    with pytest.raises(Exception, match="repeated or null key"):
        readers.allowed(spark.createDataFrame([(1, "x"), (1, "y")], "id int, secret string"), ["id"], "id").collect()
    assert readers.allowed(ok, ["a", "v"], "a").columns == ["a", "v"]


def test_small_readers(spark):
    assert readers.mock_participants(spark).groupBy("split").count().orderBy("split").collect()[0]["count"] == 12
    assert readers.detect_columns(["participant_id", "date", "x"]) == {"participant": ["participant_id"], "metadata": ["date"], "feature": ["x"]}
    big = spark.createDataFrame([(0, "red rice"), (1, "oats"), (2, "rice")], "n int, name string")
    vocab = spark.createDataFrame([("rice",)], "token string")
    assert [r.n for r in readers.wanted_rows(big, ["name"], "name", vocab, "n", keep=1).collect()] == [0]
    table = type("L", (), {"dfs": {"x": vocab}})()
    assert readers.table_from(table, "x") is vocab and readers.table_from(table, "y", required=False) is None
    with pytest.raises(KeyError):
        readers.table_from(table, "y")
    t = spark.createDataFrame([("a", "r", "b")], "head_id string, relation_id string, tail_id string")
    e = spark.createDataFrame([("a", "A", "k"), ("b", "B", "k")], "id string, name string, kind string")
    assert readers.named_relations(t, spark.createDataFrame([("r", "eats")], "relation_id string, name string"), e).first().relation == "eats"


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string")
    for name in ("x.csv", "x.csv.gz", "x.jsonl", "x.parquet"):
        writers.write_table(df, str(tmp_path / name))
        assert readers.read_any(spark, str(tmp_path / name), None).count() == 2
    writers.write_cards(df, str(tmp_path / "cards"), "s", "id", "text")
    assert {r.id for r in spark.read.json(str(tmp_path / "cards")).collect()} == {"s:1", "s:2"}
    writers.append_log(df, str(tmp_path / "log"))
    writers.append_log(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    assert writers.with_columns_of(df, [("text", "string"), ("new", "int")]).first().new is None
    digests = writers.file_digests(spark, str(tmp_path / "x.parquet"))
    assert digests.where(F.length("sha256") == 64).count() >= 1
    nodes = spark.createDataFrame([("k", "a"), ("k", "b")], "kind string, key string")
    edges = spark.createDataFrame([("a", "b", "r")], "source string, target string, relation string")
    writers.write_graph(nodes, edges, str(tmp_path / "g"))
    n, e = writers.read_graph(spark, str(tmp_path / "g"))
    index, coded = writers.encoded_edges(n, e)
    assert tuple(coded.first()) == (0, 1, "r")
    assert writers.export_tables({"t": df}, str(tmp_path / "out")).first().n_rows == 2
    assert writers.summary_json(df.orderBy("id")) == '{"id": 1, "text": "a"}'
    assert "- 1" in writers.config_yaml({"a": {"b": [1]}}) and "| x | y |" in writers.task_card("t", {"x": "y"})
