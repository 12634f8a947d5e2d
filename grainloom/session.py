"""Session builder and the shared scratch area."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "grainloom", cpus: str | None = None) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session you are given."""
    n = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
