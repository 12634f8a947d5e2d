"""Structured Streaming twins: the same results as the batch queries, from a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files at path, a folder or one file of a folder."""
    schema = spark.read.parquet(path).schema
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16)
    return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString()) if single else reader.parquet(path)


def deduplicated(stream: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """First-seen events, with state bounded by the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def windowed_totals(stream: DataFrame, ts: str, key: str, value: str, size: str = "1 day", late: str | None = "2 days") -> DataFrame:
    """Counts and sums by key and window; late events count until the watermark has passed their window, or always without one (late=None)."""
    timed = stream.withColumn("_t", F.col(ts).cast("timestamp"))
    return (timed.withWatermark("_t", late) if late else timed).groupBy(key, F.window("_t", size).alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.sum(value).alias("total"))


def finished(stream: DataFrame, work: str, name: str, mode: str = "complete") -> DataFrame:
    """Runs the stream over what is there now, and reads its sink. The sink of complete mode is a table in memory of one row a group."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def finished_files(stream: DataFrame, work: str) -> DataFrame:
    """As finished(), through files: each micro-batch's groups are written, and the last state of each group counts."""
    path = f"{work}/sink"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(path).drop("batch")


def daily_totals(spark: SparkSession, path: str, work: str) -> DataFrame:
    """Daily totals of each user from the event stream.

    Files come in any order, so no event counts as late: the state holds every group until the end, as many rows as the result.
    """
    out = finished_files(windowed_totals(source(spark, path), "ts", "user_id", "value", late=None), work)
    last = out.groupBy("user_id", F.col("w.start").cast("timestamp_ntz").alias("day")).agg(F.max_by(F.struct("n_events", "total"), "_batch").alias("r"))
    return last.select("user_id", "day", "r.n_events", F.round("r.total", 4).alias("total"))
