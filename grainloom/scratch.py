"""Tables and folders that last as long as the application, in the place that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir (or the context's checkpoint folder; on one machine alone a temporary one); it goes when the application ends."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = sc._jsc.sc().getCheckpointDir()
        base = known.get() if known.isDefined() else None
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.gettempdir()
    p = sc._jvm.org.apache.hadoop.fs.Path(f"{base}/work-{uuid.uuid4().hex}")
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return p.toString()


def written(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """df, written and read again: what depends on partitions or on sampling is settled, and lost executors cost their tasks only. by: columns of few values that get folders of their own."""
    path = f"{work_dir(df.sparkSession)}/table"
    df.write.partitionBy(*(by or [])).parquet(path)
    return df.sparkSession.read.parquet(path)


#: Rows that a task of spread() gets, about.
TASK_ROWS = 250_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by keys in as many partitions as `rows` (about its number of rows) ask for, so that a task's share does not grow with the table; what groups or joins by these keys afterwards stays there."""
    return df.repartition(1 + rows // TASK_ROWS, *keys)
