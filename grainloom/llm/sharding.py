"""Sharding by jump consistent hashing: a stable key and the number of shards decide, no ring table is kept.

Growing from n to n + 1 shards moves only the rows that the new shard
takes. Rows of one shard get gapless slots without any task that sees the
whole shard: slots are numbered within (shard, input partition) and
offset by the counts before, so a hot key or a hot shard stays spread.

Defined cases: a null key is a key like any other (all null keys share a
shard); a null text has no bytes, so its size is the fixed overhead and
its checksum is null; repeated rows each get their own slot; an empty
table gives no rows; columns other than key and text are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Bytes that a row costs besides its text.
ROW_OVERHEAD = 16


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key (Lamping and Veach 2014), all keys at once."""
    key = keys.astype(np.uint64).copy()
    shard = np.full(len(key), -1, np.int64)
    jump = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(live):
            shard[live] = jump[live]
            key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
            step = (2.0**31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0)
            jump[live] = ((shard[live] + 1) * step).astype(np.int64)
            live = live[jump[live] < shards]
    return shard


def shard_rows(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 40, grow_by: int = 1) -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard for each row of df."""

    @F.pandas_udf("struct<shard: int, grown: int>")
    def place(keys: pd.Series) -> pd.DataFrame:
        raw = keys.to_numpy(np.int64).view(np.uint64)
        return pd.DataFrame({"shard": jump_hash(raw, shards).astype(np.int32), "grown": jump_hash(raw, shards + grow_by).astype(np.int32)})

    rows = df.select(
        F.col(key),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(F.col(text).cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(F.col(key).cast("string")).alias("_h"),
    )
    placed = rows.select("*", place("_h").alias("_p")).select(
        key, "size", "text_crc32", F.col("_p.shard").alias("shard"), F.col("_p.grown").alias("grown_shard"),
        F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_seq"),
    )
    # Written once, so that partition numbers and positions hold even if an executor is lost.
    placed = stored(placed, "shards")
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
        .select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    within = Window.partitionBy("shard", "_part").orderBy("_seq")
    return (
        placed.withColumn("_rank", F.row_number().over(within) - 1).join(starts, ["shard", "_part"])
        .select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.col("_rank")).cast("long").alias("slot"), "grown_shard")
    )
