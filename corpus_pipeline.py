"""From documents to tokens: five stages, each one operator over all that the stage before kept.

Rows of `documents` go through toxicity, near duplicates, benchmark
decontamination and personal data with their columns, and end as token
digests. Each stage's result is written as Parquet and read again.

Defined cases: a null text passes every filter (it is not toxic, has no
near copies, holds no benchmark words), stays null, and encodes as the
empty text; rows are near copies by their own texts, so rows that share a
doc_id but not a text count as different documents, and of rows that
repeat a text one stays (null and blank texts have no copies: all stay);
rows with a null doc_id are nobody's copies and stay; empty tables give
empty results; extra columns of documents pass through, whatever their names.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainloom.llm import bpe, decontam, jaccard, pii, toxicity
from grainloom.llm.common import BATCH_ROWS, discard, fresh, settled, stored, table
from grainloom.llm.registry import vocabulary_path

#: Rejected keys are broadcast up to this number (about 50 bytes each), and joined by shuffle beyond.
BROADCAST_KEYS = 1_000_000


def modest(spark: SparkSession) -> None:
    """From now on the session's Arrow batches hold BATCH_ROWS rows at most: texts may be long, and memory is as large as a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def _few(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go."""
    modest(spark)
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose texts link by n-gram Jaccard similarity, directly or through others, one with the smallest doc_id stays."""
    modest(spark)
    row, digest = fresh(docs, "row"), fresh(docs, "digest")
    number = F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]  # maps have no hash
    rows = stored(docs.withColumns({row: number, digest: F.xxhash64(*hashed)}), "rows")
    moved = stored(jaccard.join(rows, row).where(F.col(row) != F.col("component_id")).select(F.col(row).alias("at"), "component_id"), "moved")
    members = moved.unionByName(moved.select(F.col("component_id").alias("at"), "component_id").distinct())
    members = stored(rows.select(F.col(row).alias("at"), F.col("doc_id").alias("id"), F.col(digest).alias("digest")).join(_few(members), "at"), "members")
    first = members.groupBy("component_id").agg(F.min(F.struct("id", "digest", "at")).alias("first")).select("first.at")
    gone = stored(members.join(_few(first), "at", "left_anti").select(F.col("at").alias(row)), "gone")
    return rows.join(_few(gone), row, "left_anti").select(*docs.columns)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark text go."""
    key, digest = fresh(docs, "key"), fresh(docs, "digest")
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    bad = _few(stored(found.select(F.col("doc_id").alias(key), F.col("text_hash").alias(digest)).distinct(), "contaminated"))
    return docs.join(bad, (F.xxhash64("text") == F.col(digest)) & F.col("doc_id").eqNullSafe(F.col(key)), "left_anti")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data whose scores reach pii.MIN_SCORE are replaced by their kinds in brackets; n_chars follows."""
    text = F.when(F.col("text").isNotNull(), pii.redacted("text", pii.spans_of("text")))
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document left."""
    modest(spark)
    return bpe.digest_texts(docs, vocabulary_path())


STAGES = [
    ("toxicity", remove_toxic),
    ("ngram_jaccard", keep_one_of_each_group),
    ("decontamination", remove_contaminated),
    ("pii", redact_personal_data),
    ("bpe", encode),
]

#: SQL can express neither the regression nor BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settled(partial(stage, spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
