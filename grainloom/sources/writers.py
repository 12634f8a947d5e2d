"""Sinks (K01-K11): written by the executors; the driver writes only manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """By extension of path: csv (compressed if .gz), jsonl, or parquet."""
    low = path.lower()
    w = df.write.mode(mode)
    if ".csv" in low:
        w.option("header", True).option("compression", "gzip" if low.endswith(".gz") else "none").csv(path)
    elif low.endswith((".json", ".jsonl")):
        w.json(path)
    else:
        w.parquet(path)


def write_cards(df: DataFrame, path: str, scenario: str, key: str, text: str, whole: bool = False) -> None:
    """A JSON record a line: all columns, or (id, scenario, item, text)."""
    out = df if whole else df.select(F.concat_ws(":", F.lit(scenario), F.col(key).cast("string")).alias("id"), F.lit(scenario).alias("scenario"), F.col(key).alias("item_id"), F.col(text).alias("text"))
    out.write.mode("overwrite").json(path)


def summary_json(df: DataFrame) -> str:
    """A one-row summary as JSON text."""
    return json.dumps(json.loads(df.limit(1).toJSON().first() or "{}"), sort_keys=True)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """K05."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def append_log(df: DataFrame, path: str) -> None:
    """An append-only log of decisions."""
    df.write.mode("append").parquet(path)


def with_columns_of(df: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """Exactly the wanted columns in order; those missing are null."""
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in wanted))


def encoded_edges(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes numbered by kind and key, edges by those numbers."""
    from ..operators.windows import numbered

    index = numbered(nodes, ["kind", "key"], "node_no")
    a, b = (index.select(F.col("key").alias(c), F.col("node_no").alias(f"{c}_no")) for c in ("source", "target"))
    return index, edges.join(a, "source").join(b, "target").select("source_no", "target_no", "relation")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and SHA-256 of each file below path, computed where the files are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def config_yaml(config: dict, indent: int = 0) -> str:
    """A nested dictionary of plain values as YAML text."""
    lines = []
    for k, v in config.items():
        pad = " " * indent
        if isinstance(v, dict):
            lines += [f"{pad}{k}:", config_yaml(v, indent + 2)]
        elif isinstance(v, (list, tuple)):
            lines += [f"{pad}{k}:", *(f"{pad}  - {json.dumps(x)}" for x in v)]
        else:
            lines.append(f"{pad}{k}: {json.dumps(v)}")
    return "\n".join(lines)


def task_card(name: str, facts: dict[str, str]) -> str:
    """A task card as Markdown text."""
    return "\n".join([f"# {name}", "", "| field | value |", "|---|---|", *(f"| {k} | {v} |" for k, v in facts.items())])


def export_tables(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """All tables as Parquet, and what was written: name, rows, columns."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for n, df in sorted(tables.items()):
        df.write.mode("overwrite").parquet(f"{path}/{n}.parquet")
        rows.append((n, spark.read.parquet(f"{path}/{n}.parquet").count(), len(df.columns)))
    return spark.createDataFrame(rows, "name string, n_rows long, n_columns int")


