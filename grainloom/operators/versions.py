"""Tables of decisions that are only ever appended to, read as of a version.

Each version is one partition of the stored table, written once; the
present state of a key is its last decision up to the version asked for,
found by one aggregate. Readers of an older version see what it was then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that are stored, in order."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))


def append(rows: DataFrame, path: str) -> int:
    """Stores rows as the next version, and returns its number. Earlier versions stay as they are."""
    number = max(versions(rows.sparkSession, path), default=0) + 1
    rows.write.parquet(f"{path}/version={number}")
    return number


def log(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """All decisions up to a version (default: all), with the version of each."""
    known = spark.read.option("basePath", path).parquet(path)
    return known if version is None else known.where(F.col("version") <= version)


def as_of(spark: SparkSession, path: str, key: list[str], version: int | None = None) -> DataFrame:
    """The last decision of each key up to a version; of several in one version the largest by all columns."""
    rows = log(spark, path, version)
    rest = [c for c in rows.columns if c not in key]
    by = F.struct("version", *(c for c in rest if c != "version"))
    return rows.groupBy(*key).agg(F.max(by).alias("_r")).select(*key, *(F.col("_r")[c].alias(c) for c in rest))
