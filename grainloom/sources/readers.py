"""Sources (S01-S25, C11, C26, C34-C36): every reader gives a DataFrame, and files are read by Spark, not by the driver."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import clean_label


def records(df: DataFrame, source: str, id_col: str, name_col: str, category_col: str | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """(source, source_item_id, item_name, category, extras); rows without a name go."""
    name = F.trim(F.col(name_col).cast("string"))
    category = F.coalesce(F.trim(F.col(category_col).cast("string")), F.lit("")) if category_col else F.lit("")
    return df.where(name.isNotNull() & (name != "")).select(F.lit(source).alias("source"), F.col(id_col).cast("string").alias("source_item_id"), name.alias("item_name"), category.alias("category"), *extra)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """By extension; csv and tsv may be compressed and have a header."""
    low = path.lower().removesuffix("/")
    r = spark.read.schema(schema) if schema else spark.read
    if low.endswith((".csv", ".csv.gz")):
        return r.option("header", True).option("escape", '"').csv(path)
    if low.endswith((".tsv", ".tsv.gz", ".txt")):
        return r.option("header", True).option("sep", "\t").csv(path)
    if low.endswith((".json", ".jsonl", ".ndjson", ".jsonl.gz")):
        return r.json(path)
    if low.endswith(".orc"):
        return r.orc(path)
    return r.parquet(path)


def read_optional(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """An empty frame of the schema where nothing is at path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return read_any(spark, path, schema) if p.getFileSystem(conf).exists(p) else spark.createDataFrame([], schema)


def read_zip_members(spark: SparkSession, path: str, suffix: str, schema: str, one: bool = True) -> DataFrame:
    """Csv or parquet members of ZIP archives whose names end with suffix.

    Executors unpack archives (one task each); one: an archive with another number of such members is an error.
    """
    names = [f.name for f in spark.createDataFrame([], schema).schema]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for where, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    found = [n for n in z.namelist() if n.endswith(suffix)]
                    if one and len(found) != 1:
                        raise ValueError(f"{where}: {len(found)} members end with {suffix!r}")
                    for n in found:
                        with z.open(n) as f:
                            if n.endswith(".parquet"):
                                part = pq.read_table(io.BytesIO(f.read()))
                                if absent := set(names) - set(part.column_names):
                                    raise ValueError(f"{where}: {n} lacks {sorted(absent)}")
                                yield pa.table({c: part[c].cast(pa.string()) for c in names}).to_pandas()
                            else:
                                for chunk in pd.read_csv(f, dtype=str, chunksize=50_000, keep_default_na=False):
                                    yield chunk[names]

    text = ", ".join(f"`{n}` string" for n in names)
    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, text)
    typed = spark.createDataFrame([], schema).schema
    return raw.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in typed))


def renamed(df: DataFrame, names: dict[str, str], numbers: tuple[str, ...] = ()) -> DataFrame:
    """Columns renamed, and some read as numbers (null where they cannot be)."""
    out = df.withColumnsRenamed(names)
    return out.withColumns({c: F.col(c).try_cast("double") for c in numbers if c in out.columns})


def flatten_header(first: list[str | None], second: list[str | None]) -> list[str]:
    """One name a column from two header rows; a group's name reaches over the empty cells to its right."""
    out, group = [], ""
    for a, b in zip(first, second, strict=True):
        group = (a or "").strip() or group
        out.append(" ".join(x for x in (group, (b or "").strip()) if x))
    return out


def from_header_row(df: DataFrame, order: str, pattern: str, names: list[str], drop: str | None = None) -> DataFrame:
    """Rows below the first whose first column matches pattern, the header; rows that match drop (sections) go.

    df: string columns and the column `order` of row numbers.
    """
    cells = [c for c in df.columns if c != order]
    header = df.where(F.col(cells[0]).rlike(pattern)).agg(F.min(order).alias("_header"))
    body = df.crossJoin(F.broadcast(header)).where(F.col(order) > F.col("_header"))  # one row
    if drop:
        body = body.where(~F.coalesce(F.col(cells[0]).rlike(drop), F.lit(False)))
    return body.select(*(F.col(c).alias(n) for c, n in zip(cells, names, strict=False)), order)


def named_relations(triples: DataFrame, relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Head, relation and tail of a three-table graph by name, kinds of both ends beside."""
    head = entities.select(F.col("id").alias("head_id"), F.col("name").alias("head"), F.col("kind").alias("head_kind"))
    tail = entities.select(F.col("id").alias("tail_id"), F.col("name").alias("tail"), F.col("kind").alias("tail_kind"))
    return triples.join(relations.withColumnRenamed("name", "relation"), "relation_id").join(head, "head_id").join(tail, "tail_id")


def wanted_rows(df: DataFrame, columns: list[str], text: str, vocabulary: DataFrame, order: str, scan: int | None = None, keep: int | None = None) -> DataFrame:
    """A projection of the rows of which a word of text is in the vocabulary (column token); the first by order if capped."""
    rows = df.select(*columns, order)
    if scan is not None:
        rows = rows.where(F.col(order) < scan)
    words = rows.select(order, F.explode(F.array_distinct(F.split(F.lower(text), "[^a-z0-9%]+"))).alias("token"))
    hit = words.join(vocabulary.select("token").distinct(), "token", "left_semi").select(order).distinct()
    out = rows.join(hit, order, "left_semi")
    return out.orderBy(order).limit(keep) if keep is not None else out


def read_ndjson(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """A record a line; absent texts are empty, lines that are no JSON go."""
    out = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    out = out.where("_bad is null").drop("_bad")
    out = out.withColumns({f.name: F.coalesce(f.name, F.lit("")) for f in out.schema if f.dataType.simpleString() == "string"})
    return out.limit(limit) if limit is not None else out


def read_xml(spark: SparkSession, paths: dict[str, str], row: str, schema: str, key: str, lists: tuple[str, ...] = (), most: int = 200) -> DataFrame:
    """Records of several XML files, each with its label as `origin`; the first of a key stays, by label.

    lists: nested lists (dotted) joined to text with their number beside; a list of more than `most` is left blank (N16).
    """
    frames = []
    for label, path in sorted(paths.items()):
        df = spark.read.format("xml").option("rowTag", row).schema(schema).load(path)
        for c in lists:
            name, items = c.split(".")[0], F.coalesce(F.col(c), F.expr("cast(array() as array<string>)"))
            df = df.withColumn(f"{name}_count", F.size(items)).withColumn(f"{name}_text", F.when(F.size(items) > most, F.lit("")).otherwise(F.array_join(items, " | "))).drop(name)
        frames.append(df.withColumn("origin", F.lit(label)))
    from ..operators.windows import first_of

    return first_of(union_all(frames), [key], [F.col("origin")])


def stratum(df: DataFrame, column: str, value: str) -> DataFrame:
    """One stratum of a stacked panel, without its column."""
    return df.where(F.col(column) == value).drop(column)


def allowed(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Only the columns that may be seen; keys must be unique and not null (checked when rows are read)."""
    from ..operators.quality import checked_unique

    return checked_unique(df.select(*columns), [key])


def valid_amounts(df: DataFrame, key: list[str], amount: str) -> DataFrame:
    """Keys unique, amounts finite and not negative, or the read fails."""
    from ..operators.quality import checked_unique

    bad = F.isnan(amount) | (F.abs(F.col(amount)) == float("inf")) | (F.col(amount) < 0)
    return checked_unique(df, key).withColumn(amount, F.when(bad, F.raise_error(F.concat(F.lit(f"bad {amount}: "), F.col(amount).cast("string")))).otherwise(F.col(amount)))


def table_from(loader, name: str, required: bool = True, spark: SparkSession | None = None) -> DataFrame | None:
    """A table of a loader object: its `dfs`, its items, or a path it knows."""
    for get in (lambda: loader.dfs[name], lambda: loader[name], lambda: read_any(spark, loader.paths[name])):
        try:
            return get()
        except (AttributeError, KeyError, TypeError):
            continue
    if required:
        raise KeyError(name)
    return None


def dictionary_paths(dictionary: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """Paths of a data dictionary by pattern or name."""
    hit = F.lower(F.col("name")).rlike(pattern) | F.col("name").isin(names)
    return dictionary.where(hit & (clean_label(F.col("path")) != "")).select("name", "path").distinct()


def tables_of(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """S24."""
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def mock_participants(spark: SparkSession, rows: int = 40, features: int = 8, seed: int = 42) -> DataFrame:
    """A deterministic table of participants with a 70 : 30 split, for tests of adapters."""
    unit = lambda k: F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(k)), F.lit(1_000_003)) / 1_000_003
    return spark.range(rows).select(
        F.format_string("mock_%03d", (F.col("id") + 1).cast("int")).alias("participant_id"), F.lit("all").alias("window_id"),
        F.when(F.col("id") < int(rows * 0.7), "train").otherwise("test").alias("split"), *(F.round(unit(k) * 100, 4).alias(f"feature_{k}") for k in range(features)),
    )


def most_numeric(tables: dict[str, DataFrame], most: int = 500) -> tuple[str, list[str]]:
    """The table with the most numeric columns, and those columns up to a number (schemas alone are read)."""
    numeric = {n: [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint")] for n, df in tables.items()}
    best = max(sorted(numeric), key=lambda n: len(numeric[n]))
    return best, numeric[best][:most]


def detect_columns(columns: list[str]) -> dict[str, list[str]]:
    """Participant, metadata and feature columns by name."""
    import re

    who = [c for c in columns if re.fullmatch(r"(?i)(participant|subject|person|user)(_?(id|code))?|registration_?code", c)]
    meta = [c for c in columns if c not in who and re.search(r"(?i)date|time|cohort|stage|batch|version", c)]
    return {"participant": who, "metadata": meta, "feature": [c for c in columns if c not in who and c not in meta]}
