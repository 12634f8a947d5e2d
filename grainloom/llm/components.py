"""Connected components of links, distributed.

Links are reduced to forests by tasks that hold about TASK of them each (a
union-find, at most as many links as vertices are left, so groups of
copies collapse early). If more than one task was needed, rounds follow
that hook every vertex to the smallest vertex it sees and reduce again,
until all links are stars around the smallest vertex. The number of tasks
grows with the links; nothing is gathered on the driver but counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: Links that one task reduces, and that one union-find holds.
TASK, CHUNK = 1_000_000, 2_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links a-b: (member, smallest member) for all other members."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        rx, ry = root[x], root[y]
        low = np.minimum(rx, ry)
        old = root.copy()
        np.minimum.at(root, rx, low)
        np.minimum.at(root, ry, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        if np.array_equal(old, root):
            break
    other = root != np.arange(len(ids))
    return ids[other], ids[root[other]]


def _reduce(links: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            a = np.concatenate([a, batch.column(0).to_numpy()])
            b = np.concatenate([b, batch.column(1).to_numpy()])
            if len(a) > CHUNK:
                a, b = forest(a, b)
                if len(a) > CHUNK // 2:  # a forest already: passed on
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                    a, b = a[:0], b[:0]
        if len(a):
            a, b = forest(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def _fewer(links: DataFrame) -> tuple[DataFrame, int]:
    """links (a stored table) in as many partitions as its number asks for, without a shuffle."""
    n = max(1, -(-links.count() // TASK))
    return links.coalesce(n), n


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """id and component (smallest id reachable) of each vertex of the undirected links (a, b: bigint, not null)."""
    raw = stored(_reduce(links.where(F.col("a") != F.col("b"))), "links")
    edges, tasks = _fewer(raw)
    edges = stored(_reduce(edges), "links")
    discard(raw)
    for _ in range(rounds):
        if tasks == 1:  # one union-find has seen all links
            break
        # Each vertex hooks to the smallest vertex it sees; links between neighbours move to their least ones.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        hooks = least.where(F.col("a") != F.col("m")).select("a", F.col("m").alias("b"))
        new = stored(moved.unionByName(hooks).where(F.col("a") != F.col("b")).distinct(), "links")
        discard(edges)
        few, tasks = _fewer(new)
        edges = stored(_reduce(few), "links")
        discard(new)
        # Stars only: nobody is both a member and a centre, and no member has two centres.
        sides = edges.select(F.col("a").alias("v"), F.lit(1).alias("as_a"), F.lit(0).alias("as_b")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("as_a"), F.lit(1).alias("as_b")))
        bad = sides.groupBy("v").agg(F.sum("as_a").alias("n"), F.max("as_b").alias("c")).where((F.col("n") > 1) | ((F.col("n") == 1) & (F.col("c") == 1)))
        if bad.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
