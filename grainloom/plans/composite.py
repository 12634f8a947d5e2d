"""Queries that round through files, models and streams: no SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, learn, windows
from ..scratch import work_dir, written
from ..sources import readers, writers
from ..streaming import streams
from .catalogue import events, items, query, read


@query("SELECT conv_id, turn, role, text FROM conversations")
def ndjson_ingest(spark, d):
    """Written as lines of JSON and read with a schema."""
    path = f"{work_dir(spark)}/t.jsonl"
    writers.write_table(read(spark, d, "conversations"), path)
    return readers.read_ndjson(spark, path, "conv_id bigint, turn bigint, role string, text string")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, d):
    """Through compressed CSV with a stated schema."""
    path = f"{work_dir(spark)}/t.csv.gz"
    writers.write_table(read(spark, d, "customer"), path)
    return readers.read_any(spark, path, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


@query("SELECT p_partkey, p_name AS name, count(DISTINCT l_suppkey) AS supplier_count FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL")
def xml_ingest(spark, d):
    """Records with nested lists through XML."""
    path = f"{work_dir(spark)}/t.xml"
    lines = read(spark, d, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))).alias("supplier"))
    rows = read(spark, d, "part").join(lines, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", F.col("p_name").alias("name"), F.struct("supplier").alias("suppliers"))
    rows.write.format("xml").option("rowTag", "item").option("rootTag", "items").save(path)
    schema = "p_partkey bigint, name string, suppliers struct<supplier: array<string>>"
    out = readers.read_xml(spark, {"all": path}, "item", schema, "p_partkey", ("suppliers.supplier",))
    return out.select("p_partkey", "name", F.col("suppliers_count").cast("long").alias("supplier_count"))


#: A fifth of the rows of each class, as far as its median hash goes: the rows below the linear 0.2 quantile.
_SPLIT_SQL = """WITH e AS (SELECT o_custkey AS participant, l_partkey AS item, l_quantity AS grams FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    x AS (SELECT participant, sum(p_retailprice * grams / 100) AS price, sum(p_size * grams / 100) AS size FROM e JOIN part ON item = p_partkey GROUP BY participant),
    t AS (SELECT participant, price * 0.01 + size * 0.1 + c_acctbal * 0.001 AS y FROM x JOIN customer ON c_custkey = participant), c AS (SELECT (y > (SELECT quantile_cont(y, 0.5) FROM t))::INTEGER AS y, count(*) AS n FROM t GROUP BY 1),
    f AS (SELECT unnest(range(5))::INTEGER AS fold) SELECT fold, y, 'test' AS part, ceil((n - 1) * 0.2)::BIGINT AS n FROM c, f UNION ALL SELECT fold, y, 'train', n - ceil((n - 1) * 0.2)::BIGINT FROM c, f"""


def _design(spark, d):
    x = features.exposure(events(spark, d), items(spark, d), ["price", "size"], ["participant"])
    y = read(spark, d, "customer").select(F.col("c_custkey").alias("participant"), F.col("c_acctbal").alias("y"))
    return x.join(y, "participant").withColumn("y", F.col("price") * 0.01 + F.col("size") * 0.1 + F.col("y") * 0.001)


@query()
def ridge_regression_folds(spark, d):
    """Five repeated splits of the exposure table, the whole bank of regressions, mean and deviation of the metrics."""
    return learn.summarised(learn.evaluated(_design(spark, d), "participant", ["price", "size"], "y"))


def _classes(spark, d):
    df = written(_design(spark, d))
    cut = windows.quantiles(df, "y", [0.5]).select(F.col("value").alias("cut"))
    return written(df.crossJoin(F.broadcast(cut)).withColumn("y", (F.col("y") > F.col("cut")).cast("double")).drop("cut"))  # one row


@query()
def classification_folds(spark, d):
    """A two-class target, five splits by class, the whole bank of classifiers."""
    return learn.summarised(learn.evaluated(_classes(spark, d), "participant", ["price", "size"], "y"))


@query(_SPLIT_SQL)
def split_sizes(spark, d):
    """Repeated splits by class leave a fifth of each class for the test, and no row twice."""
    df = _classes(spark, d).select("participant", "y")
    sizes = None
    for fold in range(5):
        train, test = learn.split(df, "participant", fold, strata="y")
        each = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))).groupBy("y", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("fold", F.lit(fold))
        sizes = each if sizes is None else sizes.unionByName(each)
    return sizes.select("fold", F.col("y").cast("int").alias("y"), "part", "n")


@query("""
    SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_window_exposure(spark, d):
    """Windowed sums of a stream that counts all late events; equal to the batch query once the stream has ended."""
    return streams.daily_totals(spark, f"{d}/events.parquet", work_dir(spark))
