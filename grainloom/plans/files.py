"""Queries that go through files: archives, sheets, logs, graphs and manifests are written to the shared folder and read by the executors."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import adapters, quality
from ..scratch import work_dir
from ..sources import readers, sheets, writers
from .catalogue import _EDGES, _NODES, edges, nodes, query, read


def put(spark: SparkSession, path: str, content: bytes) -> str:
    """Writes one small file where Spark can read it."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(sc._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(content))
    out.close()
    return path


def _nation_rows(spark, d) -> list:
    """The 25 nations: a table of one size at every scale."""
    return read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()


# Archives and sheets


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def zip_csv_member(spark, d):
    """The one member with a suffix, other members beside it."""
    lines = "n_nationkey,n_name,n_regionkey\n" + "".join(f'{r[0]},"{r[1]}",{r[2]}\n' for r in _nation_rows(spark, d))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("data/nations.csv", lines)
        z.writestr("notes.txt", "no table")
    path = put(spark, f"{work_dir(spark)}/a.zip", out.getvalue())
    return readers.read_zip_members(spark, path, "nations.csv", read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").schema.simpleString()[7:-1].replace(":", " "))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def zip_parquet_member(spark, d):
    """A Parquet member with its required columns, and rows of one kind."""
    import pandas as pd

    part = io.BytesIO()
    pd.DataFrame([tuple(r) for r in _nation_rows(spark, d)], columns=["id", "name", "kind"]).to_parquet(part)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("nations.parquet", part.getvalue())
    path = put(spark, f"{work_dir(spark)}/b.zip", out.getvalue())
    got = readers.read_zip_members(spark, path, ".parquet", "id int, name string, kind int")
    return got.where("kind = 2").select(F.col("id").cast(read(spark, d, "nation").schema["n_nationkey"].dataType).alias("n_nationkey"), F.col("name").alias("n_name"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def xlsx_two_header_rows(spark, d):
    """A sheet with two header rows, columns found by the beginnings of their names."""
    rows = [["Nation", None, "Region"], ["key", "name", "key"], *([r[0], r[1], r[2]] for r in _nation_rows(spark, d))]
    path = put(spark, f"{work_dir(spark)}/c.xlsx", sheets.sheet_bytes(rows))
    df = sheets.two_headers(sheets.read_xlsx(spark, path, 3))
    pick = lambda p: F.col(f"`{sheets.column_by_prefix(df, p)}`")
    return df.select(pick("nation key").try_cast("bigint").alias("n_nationkey"), pick("nation name").alias("n_name"), pick("region").try_cast("bigint").alias("n_regionkey"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def xlsx_found_header(spark, d):
    """The header row is found by a pattern, and section rows go."""
    rows = [["A title"], [], ["Code", "Name"]]
    for i, r in enumerate(_nation_rows(spark, d)):
        rows += [[f"{i} SECTION"]] * (i % 5 == 0) + [[r[0], r[1]]]
    path = put(spark, f"{work_dir(spark)}/d.xlsx", sheets.sheet_bytes(rows))
    df = readers.from_header_row(sheets.read_xlsx(spark, path, 2).select("c0", "c1", "row"), "row", "^Code$", ["code", "name"], r"^\s*[0-9]+\s+[A-Z ]+\s*$")
    return df.where("name IS NOT NULL").select(F.col("code").try_cast("bigint").alias("n_nationkey"), F.col("name").alias("n_name"))


# Tables with conditions


@query("SELECT c_custkey, c_name AS shem, c_acctbal AS yitra, NULL::DOUBLE AS segment_number FROM customer")
def renamed_native_columns(spark, d):
    """Columns renamed, and read as numbers where they are."""
    path = f"{work_dir(spark)}/e.csv"
    writers.write_table(read(spark, d, "customer").select("c_custkey", F.col("c_name").alias("שם"), F.col("c_acctbal").cast("string").alias("יתרה"), F.col("c_mktsegment").alias("פלח")), path)
    df = readers.read_any(spark, path, f"c_custkey {read(spark, d, 'customer').schema['c_custkey'].dataType.simpleString()}, `שם` string, `יתרה` string, `פלח` string")
    return readers.renamed(df, {"שם": "shem", "יתרה": "yitra", "פלח": "segment_number"}, ("yitra", "segment_number"))


@query("SELECT 'here' AS source, s_suppkey, s_name, NULL::VARCHAR AS s_note FROM supplier")
def optional_sources(spark, d):
    """A source that is missing gives no rows, with its columns."""
    path = f"{work_dir(spark)}/f.parquet"
    writers.write_table(read(spark, d, "supplier").select(F.lit("here").alias("source"), "s_suppkey", "s_name"), path)
    schema = f"source string, s_suppkey {read(spark, d, 'supplier').schema['s_suppkey'].dataType.simpleString()}, s_name string"
    return readers.union_all([readers.read_optional(spark, path, schema), readers.read_optional(spark, f"{path}.none", f"{schema}, s_note string")])


@query("""SELECT s_name AS head, 'supplier' AS head_kind, 'lies in' AS relation, n_name AS tail, 'nation' AS tail_kind FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION ALL SELECT n_name, 'nation', 'belongs to', r_name, 'region' FROM nation JOIN region ON n_regionkey = r_regionkey""")
def three_table_graph(spark, d):
    """Triples with names of relations and entities."""
    key = text.node_key
    s, n, g = read(spark, d, "supplier"), read(spark, d, "nation"), read(spark, d, "region")
    triples = s.select(key("s", F.col("s_suppkey")).alias("head_id"), F.lit(1).alias("relation_id"), key("n", F.col("s_nationkey")).alias("tail_id")).unionByName(
        n.select(key("n", F.col("n_nationkey")).alias("head_id"), F.lit(2).alias("relation_id"), key("r", F.col("n_regionkey")).alias("tail_id")))
    entities = readers.union_all([df.select(key(k, F.col(i)).alias("id"), F.col(c).alias("name"), F.lit(kind).alias("kind")) for df, k, i, c, kind in ((s, "s", "s_suppkey", "s_name", "supplier"), (n, "n", "n_nationkey", "n_name", "nation"), (g, "r", "r_regionkey", "r_name", "region"))])
    relations = spark.createDataFrame([(1, "lies in"), (2, "belongs to")], "relation_id int, name string")
    return readers.named_relations(triples, relations, entities).select("head", "head_kind", "relation", "tail", "tail_kind")


_VOCABULARY = "SELECT DISTINCT token FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS token FROM part WHERE p_size <= 3) WHERE length(token) >= 3"


@query(f"""WITH v AS ({_VOCABULARY}), t AS (SELECT p_partkey, unnest(regexp_split_to_array(lower(p_name), '[^a-z0-9%]+')) AS token FROM part)
    SELECT p_partkey, p_name, p_type FROM part WHERE p_partkey IN (SELECT p_partkey FROM t JOIN v USING (token))""")
def huge_tsv_scan(spark, d):
    """A projection of the rows of a tab-separated file with a word of the vocabulary."""
    path = f"{work_dir(spark)}/g.tsv"
    p = read(spark, d, "part")
    p.write.option("header", True).option("sep", "\t").csv(path)
    df = readers.read_any(spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in p.schema))
    words = p.where("p_size <= 3").select(F.explode(F.split(F.lower("p_name"), " ")).alias("token")).where("length(token) >= 3")
    return readers.wanted_rows(df, ["p_name", "p_type"], "p_name", words, "p_partkey").select("p_partkey", "p_name", "p_type")


@query("SELECT p_partkey AS item, 'retail' AS stratum_was, p_retailprice AS value FROM part")
def stacked_panel_stratum(spark, d):
    """One stratum of a panel of several."""
    p = read(spark, d, "part")
    pick = lambda s, c: p.select(F.col("p_partkey").alias("item"), F.lit(s).alias("stratum"), F.col(c).cast("double").alias("value"))
    folder = work_dir(spark)
    writers.write_table(pick("retail", "p_retailprice").unionByName(pick("size", "p_size")), f"{folder}/panel.parquet")
    panel = readers.tables_of(spark, folder, ["panel"])["panel"]
    return readers.stratum(panel, "stratum", "retail").select("item", F.lit("retail").alias("stratum_was"), "value")


@query("SELECT c_custkey, c_mktsegment FROM customer")
def allowed_columns_only(spark, d):
    """Only listed columns, keys unique and not null."""
    return readers.allowed(read(spark, d, "customer"), ["c_custkey", "c_mktsegment"], "c_custkey")


@query("SELECT p_partkey, p_type, p_retailprice::DOUBLE AS amount, dense_rank() OVER (ORDER BY p_type) AS category_id FROM part")
def validated_amounts(spark, d):
    """Amounts with their categories; repeated keys and bad amounts would fail the read."""
    p = read(spark, d, "part").select("p_partkey", "p_type", F.col("p_retailprice").cast("double").alias("amount"))
    from ..operators.windows import numbered

    kinds = numbered(p.select("p_type").distinct(), ["p_type"], "category_id", 1)
    return readers.valid_amounts(p, ["p_partkey"], "amount").join(kinds, "p_type").select("p_partkey", "p_type", "amount", "category_id")


class _Loader:
    """What S22 adapts: tables by name, and paths of others."""

    def __init__(self, dfs: dict[str, DataFrame], paths: dict[str, str]):
        self.dfs, self.paths = dfs, paths


@query("SELECT 'region' AS name, r_regionkey AS key, r_name AS label FROM region UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation")
def loader_tables(spark, d):
    """Tables of a loader object, and bulk files found by a data dictionary."""
    dictionary = spark.createDataFrame([("nation", f"{d}/nation.parquet"), ("other", f"{d}/part.parquet"), ("nation", " "), ("region_table", f"{d}/region.parquet")], "name string, path string")
    paths = {r["name"]: r["path"] for r in readers.dictionary_paths(dictionary, "^reg", ["nation"]).collect()}
    loader = _Loader({"region": spark.read.parquet(paths["region_table"])}, {"nation": paths["nation"]})
    g, n = readers.table_from(loader, "region"), readers.table_from(loader, "nation", spark=spark)
    return g.select(F.lit("region").alias("name"), F.col("r_regionkey").alias("key"), F.col("r_name").alias("label")).unionByName(n.select(F.lit("nation").alias("name"), F.col("n_nationkey").alias("key"), F.col("n_name").alias("label")))


@query("SELECT 'mock_' || lpad((i + 1)::VARCHAR, 3, '0') AS participant_id, 'all' AS window_id, CASE WHEN i < 28 THEN 'train' ELSE 'test' END AS split, true AS in_range FROM range(40) t(i)")
def mock_table(spark, d):
    """40 rows, split 70 to 30."""
    df = readers.mock_participants(spark)
    good = [F.col(c).between(0, 100) for c in df.columns if c.startswith("feature_")]
    return df.select("participant_id", "window_id", "split", F.forall(F.array(*good), lambda x: x).alias("in_range"))


@query("""SELECT 'c_nationkey' AS column_name, 'orders_like' AS table_name, 1::BIGINT AS n UNION ALL SELECT 'c_acctbal', 'orders_like', 1 UNION ALL SELECT 'c_custkey', 'orders_like', 1""")
def table_choice(spark, d):
    """The table with the most numeric columns, columns told apart by their names, repeated columns once."""
    tables = {"orders_like": read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_name"), "names": read(spark, d, "nation").select("n_name", "n_nationkey")}
    best, numeric = readers.most_numeric(tables)
    kinds = readers.detect_columns([*numeric, "participant_id", "visit_date"])
    kept = list(dict.fromkeys(c for c in [*kinds["feature"], *numeric] if c in tables[best].columns))
    return spark.createDataFrame([(c, best, 1) for c in kept], "column_name string, table_name string, n long")


# Sinks


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def parquet_round_trip(spark, d):
    """K02 S21."""
    path = f"{work_dir(spark)}/h.parquet"
    writers.write_table(read(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    return readers.read_any(spark, path)


@query("SELECT 'base:' || p_partkey AS id, 'base' AS scenario, p_partkey AS item_id, p_name || ' | category: ' || p_type AS text FROM part")
def cards_jsonl(spark, d):
    """Cards as lines of JSON, projected."""
    path = f"{work_dir(spark)}/i.jsonl"
    p = read(spark, d, "part")
    writers.write_cards(p.withColumn("t", text.embedding_text(F.col("p_name"), F.col("p_type"))), path, "base", "p_partkey", "t")
    return readers.read_ndjson(spark, path, f"id string, scenario string, item_id {p.schema['p_partkey'].dataType.simpleString()}, text string")


@query("""SELECT 'customer' AS name, '{"n":' || count(*) || ',"n_segments":' || count(DISTINCT c_mktsegment) || '}' AS summary FROM customer UNION ALL SELECT 'part', '{"n":' || count(*) || ',"n_types":' || count(DISTINCT p_type) || '}' FROM part""")
def run_report(spark, d):
    """One-row summaries as JSON, put together."""
    import json

    c = read(spark, d, "customer").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c_mktsegment").alias("n_segments"))
    p = read(spark, d, "part").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_type").alias("n_types"))
    rows = [(n, json.dumps(json.loads(writers.summary_json(df)), sort_keys=True, separators=(",", ":"))) for n, df in (("customer", c), ("part", p))]
    return spark.createDataFrame(rows, "name string, summary string")


@query(f"WITH {_EDGES}, {_NODES} SELECT relation, b.kind AS target_kind, count(*) AS n FROM edges JOIN nodes b ON target = b.key GROUP BY ALL")
def graph_round_trip(spark, d):
    """Nodes and edges written and read."""
    path = f"{work_dir(spark)}/graph"
    writers.write_graph(nodes(spark, d), edges(spark, d), path)
    n, e = writers.read_graph(spark, path)
    return e.join(n.select(F.col("key").alias("target"), F.col("kind").alias("target_kind")), "target").groupBy("relation", "target_kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey AS item, 'accept' AS decision, NULL::VARCHAR AS reviewer FROM part WHERE p_size <= 25 UNION ALL SELECT p_partkey, 'reject', 'second' FROM part WHERE p_size > 25")
def decision_log(spark, d):
    """Appended to, and read with the columns that later entries have."""
    path = f"{work_dir(spark)}/log"
    p = read(spark, d, "part")
    writers.append_log(p.where("p_size <= 25").select(F.col("p_partkey").alias("item"), F.lit("accept").alias("decision")), path)
    writers.append_log(p.where("p_size > 25").select(F.col("p_partkey").alias("item"), F.lit("reject").alias("decision"), F.lit("second").alias("reviewer")), path)
    log = spark.read.option("mergeSchema", True).parquet(path)
    return writers.with_columns_of(log, [("item", p.schema["p_partkey"].dataType.simpleString()), ("decision", "string"), ("reviewer", "string")])


@query(f"""WITH {_EDGES}, {_NODES}, i AS (SELECT key, row_number() OVER (ORDER BY kind, key) - 1 AS no FROM nodes), g AS (SELECT DISTINCT relation FROM edges), k AS (SELECT relation, row_number() OVER (ORDER BY relation) - 1 AS relation_no FROM g)
    SELECT a.no::BIGINT AS source_no, b.no::BIGINT AS target_no, relation_no::BIGINT AS relation_no FROM edges JOIN i a ON source = a.key JOIN i b ON target = b.key JOIN k USING (relation)""")
def encoded_graph(spark, d):
    """Nodes, and relations, as numbers in the edges."""
    from ..operators.windows import numbered

    e = edges(spark, d)
    kinds = numbered(e.select("relation").distinct(), ["relation"], "relation_no")
    _, packed = writers.encoded_edges(nodes(spark, d), e)
    return packed.join(kinds, "relation").select("source_no", "target_no", "relation_no")


@query("SELECT 'm1.txt' AS name, 12::BIGINT AS bytes, sha256('grain' || chr(10) || 'grain' || chr(10)) AS sha256 UNION ALL SELECT 'm2.txt', 4, sha256('loom')")
def manifest_digests(spark, d):
    """Names, sizes and digests of files, computed where they are read."""
    folder = work_dir(spark)
    put(spark, f"{folder}/m1.txt", b"grain\n" * 2)
    put(spark, f"{folder}/m2.txt", b"loom")
    return writers.file_digests(spark, folder)


@query("""SELECT 'title: "parts"' || chr(10) || 'limits:' || chr(10) || '  rows: ' || max(n) || chr(10) || 'kinds:' || chr(10) || string_agg('  - "' || k || '"', chr(10) ORDER BY k) AS yaml,
    '# parts' || chr(10) || chr(10) || '| field | value |' || chr(10) || '|---|---|' || chr(10) || '| rows | ' || max(n) || ' |' AS card FROM (SELECT DISTINCT c_mktsegment AS k, (SELECT count(*) FROM customer) AS n FROM customer)""")
def config_and_card(spark, d):
    """Settings as YAML and a task card as Markdown."""
    c = read(spark, d, "customer")
    n, kinds = c.agg(F.count(F.lit(1)), F.array_sort(F.collect_set("c_mktsegment"))).first()
    return spark.createDataFrame([(writers.config_yaml({"title": "parts", "limits": {"rows": n}, "kinds": kinds}), writers.task_card("parts", {"rows": str(n)}))], "yaml string, card string")


@query("SELECT 'customer' AS name, count(*) AS n_rows, 2 AS n_columns FROM customer UNION ALL SELECT 'nation', count(*), 2 FROM nation")
def exported_tables(spark, d):
    """Tables written, with what was written."""
    return writers.export_tables({"customer": read(spark, d, "customer").select("c_custkey", "c_name"), "nation": read(spark, d, "nation").select("n_nationkey", "n_name")}, work_dir(spark))


@query("SELECT trim(c_mktsegment) AS option FROM customer WHERE trim(c_mktsegment) <> '' UNION SELECT trim(r_name) FROM region WHERE trim(r_name) <> ''")
def category_options(spark, d):
    """Distinct trimmed values of several columns."""
    pick = lambda t, c: read(spark, d, t).select(text.clean_label(F.col(c)).alias("option"))
    return pick("customer", "c_mktsegment").unionByName(pick("region", "r_name")).where("option <> ''").distinct()


@query("""WITH x AS (SELECT o_custkey AS participant, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders), t AS (SELECT 'predict_' || lower(n_name) AS task, CASE n_nationkey % 3 WHEN 0 THEN 'balance' WHEN 1 THEN 'segment' ELSE 'unknown' END AS target FROM nation),
    c("check", n_seen, n_failed) AS (SELECT 'participants are unique', count(*), count(*) FILTER (n > 1) FROM (SELECT count(*) AS n FROM x GROUP BY participant) UNION ALL SELECT 'participants are known', count(*), count(*) FILTER (participant IS NULL) FROM x UNION ALL SELECT 'values are finite', count(*), count(*) FILTER (price IS NULL) FROM x
        UNION ALL SELECT 'features are numeric columns', 3, 2 UNION ALL SELECT 'tasks are unique', count(DISTINCT task), 0 FROM t UNION ALL SELECT 'targets are known', count(*), count(*) FILTER (target NOT IN ('balance', 'segment')) FROM t) SELECT "check", n_seen::BIGINT AS n_seen, n_failed::BIGINT AS n_failed, n_failed = 0 AS passed FROM c""")
def checked_exports(spark, d):
    """The constraints of an adapter's export as rows of a report: what was seen, and what failed."""
    x = read(spark, d, "orders").select(F.col("o_custkey").alias("participant"), F.when(F.col("o_orderkey") % 50 != 0, F.col("o_totalprice")).alias("price"), "o_orderstatus")
    k = F.col("n_nationkey") % 3
    tasks = read(spark, d, "nation").select(F.concat(F.lit("predict_"), F.lower("n_name")).alias("task"), F.when(k == 0, "balance").when(k == 1, "segment").otherwise("unknown").alias("target"))
    return adapters.checks(x, "participant", ["price", "o_orderstatus", "gone"], tasks, ["balance", "segment"])
