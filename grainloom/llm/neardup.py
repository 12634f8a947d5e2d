"""Embedding near-duplicates by collision counting over sorted random projections.

Unit vectors are projected on random directions. Vectors at the threshold
cosine differ on a direction by about a normal deviate of a known width,
so the windows are set from it. Each table sorts the vectors by one
projection, its lead; within the lead's window around every vector the
windows centred at it that the other falls into are counted over all
projections, and pairs whose count reaches a calibrated threshold are
verified by cosine in double precision.

In few dimensions a window around a vector holds a large share of all
vectors (a third in 64 dimensions at a cosine of 0.9), so sorting whole
tables of many vectors would count nearly all pairs. Tables therefore sort
within cells of further projections, quantised with random offsets: none
up to SHARED vectors, and about as many as keep the cells at that size
beyond. The number of tables follows from the recall wanted at the
threshold itself (more similar pairs are found more surely). A pair counts
in the first table where it meets, so tasks return sums of links and
forests of links, never all pairs of a group of copies.

Counting takes place on projections of one byte each, rounded so that no
collision is lost; whole vectors travel only for the members of pairs that
pass the count. Equal vectors form classes first, and one of each goes on
with its weight. Cells of many vectors are split into blocks, and pairs of
blocks.

Defined cases: vectors that are null, empty, zero, or hold a null or
non-finite component link with nothing, nor do vectors of different
lengths, nor rows with a null id (their component is null); an empty table
gives an empty result; repeated rows are vectors like any other, of one
vertex if their ids are equal; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components, forest

#: Projections whose window collisions are counted.
PROJECTIONS = 48
#: Half a window, half a lead's window, and a cell, in standard deviations at the threshold.
WINDOW, LEAD, CELL = 1.5, 2.5, 4.0
#: Recall of the tables at the threshold, and vectors that a query shares a cell with on average.
RECALL, SHARED = 0.998, 512
#: Cells beyond this size are split into blocks of about half of it.
BLOCK = 2048
#: Rows of crowded cells that are broadcast (24 bytes each), joined by shuffle beyond.
BROADCAST_ROWS = 1_000_000
#: Steps of a byte in half a window, and the largest byte kept (differences of two must not wrap round into a window).
STEPS, EDGE = 24, 100

_N = NormalDist()


@dataclass(frozen=True)
class Plan:
    """What one run uses: threshold, tables, projections in a table's cells, and the count that a pair must reach."""

    cosine: float
    tables: int
    in_table: int
    count: int


def plan(n: int, cosine: float, recall: float = RECALL) -> Plan:
    """Sets up the tables for n vectors."""
    near = 2 * _N.cdf(WINDOW) - 1
    u = CELL
    met = 1 - 2 * _N.cdf(-u) - 2 / (math.sqrt(2 * math.pi) * u) * (1 - math.exp(-u * u / 2))  # one cell in common, at the threshold
    v = CELL * math.sqrt(2 - 2 * cosine) / math.sqrt(2)
    chance = 1 - 2 * _N.cdf(-v) - 2 / (math.sqrt(2 * math.pi) * v) * (1 - math.exp(-v * v / 2))  # the same for unrelated vectors
    k = max(0, min(24, math.ceil(math.log(max(1.0, n / SHARED)) / -math.log(chance))))
    once = met**k * (2 * _N.cdf(LEAD) - 1)
    tables = math.ceil(math.log(1 - recall) / math.log(1 - once))
    # Four standard deviations below the mean count at the threshold.
    count = max(1, math.floor(PROJECTIONS * near - 4 * math.sqrt(PROJECTIONS * near * (1 - near))))
    return Plan(cosine, tables, k, count)


@functools.lru_cache(16)
def directions(dim: int) -> np.ndarray:
    """Unit vectors, as the columns of dim x PROJECTIONS."""
    r = np.random.default_rng(dim).standard_normal((dim, PROJECTIONS))
    return r / np.linalg.norm(r, axis=0)


@functools.lru_cache(4)
def drawn(p: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each table its lead, the projections of its cells, and their offsets."""
    g = np.random.default_rng(p.tables)
    picks = np.array([g.permutation(PROJECTIONS)[: p.in_table + 1] for _ in range(p.tables)])
    return picks[:, 0], picks[:, 1:], g.random((p.tables, p.in_table))


def width(dim: int, cosine: float) -> float:
    """Standard deviation of the difference on one direction, at the threshold."""
    return math.sqrt((2 - 2 * cosine) / dim)


def cells(projected: np.ndarray, dim: int, p: Plan) -> np.ndarray:
    """The cell (hash) of each vector in each table."""
    _, picks, offsets = drawn(p)
    w = CELL * width(dim, p.cosine)
    out = np.full((len(projected), p.tables), dim, np.uint64)
    for j in range(p.in_table):
        c = np.floor(projected[:, picks[:, j]] / w + offsets[:, j]).astype(np.int64).view(np.uint64)
        out = (out ^ c) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def steps(projected: np.ndarray, dim: int, cosine: float) -> np.ndarray:
    """Projections as bytes, STEPS to half a window; what lies far out is drawn in, which loses no collision."""
    return np.clip(np.rint(projected * (STEPS / (WINDOW * width(dim, cosine)))), -EDGE, EDGE).astype(np.int8)


def _unit(blobs: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(b, np.float64) for b in blobs])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


#: Differences in bytes that may be within half a window, and within half a lead's window (each rounding may add half a step).
_IN, _LED = STEPS + 1, math.ceil(STEPS * LEAD / WINDOW) + 1


def passing(q: np.ndarray, lead: int, side: np.ndarray, count: int, chunk: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs within the lead's window that collide often enough; both sides of a pair differ in `side` unless all are equal.

    Vectors are sorted by the lead, so what a run of them can meet is a stretch behind it.
    """
    order = np.argsort(q[:, lead], kind="stable")
    x, of = q[order].view(np.uint8), side[order]
    first = q[order, lead].astype(np.int16)
    columns = np.ascontiguousarray(x.T)
    within = side.min() == side.max()
    far = np.searchsorted(first, first + _LED, side="right")
    for a in range(0, len(x), chunk):
        b, e = min(a + chunk, len(x)), far[min(a + chunk, len(x)) - 1]
        total = np.zeros((b - a, e - a), np.uint8)
        for c in columns:
            total += (c[a:b, None] - c[None, a:e] + np.uint8(_IN)) <= np.uint8(2 * _IN)
        i, k = np.nonzero(total >= count)
        i, k = a + i, a + k
        ok = (k > i) & (k < far[i])
        if not within:
            ok &= of[i] != of[k]
        i, k = order[i[ok]], order[k[ok]]
        for c in range(0, len(i), 100_000):
            yield i[c : c + 100_000], k[c : c + 100_000]


def linked(u: np.ndarray, q: np.ndarray, key: np.ndarray, table: int, side: np.ndarray, p: Plan) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs in one cell of a table that pass the count there, link, and met in no table before."""
    leads = drawn(p)[0]
    for s, t in passing(q, int(leads[table]), side, p.count):
        ok = np.einsum("ij,ij->i", u[s], u[t]) >= p.cosine
        s, t = s[ok], t[ok]
        if table and len(s):
            met = (key[s, :table] == key[t, :table]) & (np.abs(q[s][:, leads[:table]].astype(np.int16) - q[t][:, leads[:table]]) <= _LED)
            ok = ~met.any(axis=1)
            s, t = s[ok], t[ok]
        if len(s):
            yield s, t


def spread(reps: DataFrame, p: Plan) -> DataFrame:
    """table, cell, id and bytes of the projections: a row for each vector and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                b = whole.slice(at, 512)
                blobs = b.column(1).to_pylist()
                for size in sorted({len(x) for x in blobs}):
                    own = [i for i, x in enumerate(blobs) if len(x) == size]
                    u = _unit([blobs[i] for i in own])
                    dim = u.shape[1]
                    projected = u @ directions(dim)
                    key, q = cells(projected, dim, p), steps(projected, dim, p.cosine)
                    rows = pa.array(np.repeat(np.arange(len(own)), p.tables))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.tile(np.arange(p.tables, dtype=np.int32), len(own))), pa.array(key.reshape(-1)), b.column(0).take(pa.array(own)).take(rows), pa.array([x.tobytes() for x in q], pa.binary()).take(rows)],
                        ["table", "cell", "id", "q"],
                    )

    return reps.select("id", "packed").mapInArrow(run, "table int, cell bigint, id bigint, q binary")


_BLOCK_OF = ["table", "cell", "x", "y"]


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Each block (table, cell, x, y) with its rows (the other columns); rows come sorted by block."""
    now, rows = None, []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if r[:4] != now:
                if rows:
                    yield now, rows
                now, rows = r[:4], []
            rows.append(r[4:])
    if rows:
        yield now, rows


def candidates(reps: DataFrame, p: Plan) -> DataFrame:
    """table, cell, x, y, side, id: the members of pairs that pass the count, in each block where they do."""
    every = spread(reps, p)
    crowded = every.groupBy("table", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("table", "cell", F.ceil(F.col("n") * 2 / BLOCK).cast("int").alias("blocks"))
    crowded = stored(crowded, "crowded")
    crowded = F.broadcast(crowded) if crowded.count() <= BROADCAST_ROWS else crowded
    placed = every.join(crowded, ["table", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # Each block meets itself and every other one.
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("table", "cell", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", "id", "q")
    placed = placed.repartition(*_BLOCK_OF).sortWithinPartitions(*_BLOCK_OF)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (table, cell, x, y), rows in _by_block(batches):
            if len(rows) < 2:
                continue
            side, ids = np.array([r[0] for r in rows], np.int32), np.array([r[1] for r in rows], np.int64)
            if x != y and side.min() == side.max():
                continue
            q = np.frombuffer(b"".join(r[2] for r in rows), np.int8).reshape(len(rows), PROJECTIONS)
            held = np.zeros(len(rows), bool)
            for s, t in passing(q, int(drawn(p)[0][table]), side, p.count):
                held[s] = held[t] = True
            if held.any():
                n = int(held.sum())
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(n, v), k) for v, k in ((table, pa.int32()), (cell, pa.int64()), (x, pa.int32()), (y, pa.int32()))), pa.array(side[held]), pa.array(ids[held])], [*_BLOCK_OF, "side", "id"])

    return placed.mapInArrow(run, "table int, cell bigint, x int, y int, side int, id bigint")


def links(reps: DataFrame, p: Plan) -> DataFrame:
    """Of reps (id, weight, packed): rows (a, b, n), which are forests of links where b is not null, and otherwise the weight n of what a links with."""
    members = candidates(reps, p).join(reps.select("id", "weight", "packed"), "id").select(*_BLOCK_OF, "side", "id", "weight", "packed")
    members = members.repartition(*_BLOCK_OF).sortWithinPartitions(*_BLOCK_OF)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = {}
        stars: list[tuple[np.ndarray, np.ndarray]] = []

        def batch() -> pa.RecordBatch:
            a, b = forest(np.concatenate([x for x, _ in stars]), np.concatenate([x for _, x in stars]))
            n = len(a)
            out = pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([a, np.array(list(sums), np.int64)])), pa.array([*b.tolist(), *[None] * len(sums)], pa.int64()), pa.array([*[None] * n, *sums.values()], pa.int64())], ["a", "b", "n"]
            )
            sums.clear()
            stars.clear()
            return out

        for (table, _, _, _), rows in _by_block(batches):
            side, ids, weight = (np.array([r[k] for r in rows], np.int64) for k in range(3))
            u = _unit([r[3] for r in rows])
            projected = u @ directions(u.shape[1])
            key, q = cells(projected, u.shape[1], p)[:, : table + 1], steps(projected, u.shape[1], p.cosine)
            total, found = np.zeros(len(ids), np.int64), []
            for s, t in linked(u, q, key, table, side, p):
                np.add.at(total, s, weight[t])
                np.add.at(total, t, weight[s])
                found.append(forest(ids[s], ids[t]))
            if found:
                stars.append(forest(np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])))
            for i in np.flatnonzero(total):
                sums[int(ids[i])] = sums.get(int(ids[i]), 0) + int(total[i])
            if len(sums) > 200_000 or sum(len(a) for a, _ in stars) > 500_000:
                yield batch()
        if stars:
            yield batch()

    return members.mapInArrow(run, "a bigint, b bigint, n bigint")


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """key (whole numbers), n_links, component_id and kept of each row of df."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(key).alias("id"), F.when(finite & F.col(key).isNotNull(), v).alias("v")).withColumn("id", F.col("id").cast("long"))
    # Equal vectors have equal hashes; 128 bits tell others apart.
    good = rows.where(F.col("v").isNotNull()).select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("again"), "v").alias("h2"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [np.array(x, np.float64).tobytes() for x in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(packed, pa.binary())], ["h1", "h2", "id", "weight", "packed"])

    classes = good.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("v").alias("v"))
    reps = stored(classes.mapInArrow(pack, "h1 bigint, h2 bigint, id bigint, weight bigint, packed binary"), "reps")
    n = reps.count()
    members = good.select("id", "h1", "h2").join(reps.select("h1", "h2", F.col("id").alias("rep"), "weight"), ["h1", "h2"]).select("id", "rep", "weight")
    if not n:
        out = rows.select("id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component"))
    else:
        found = stored(links(reps, plan(n, cosine)), "found")
        copies = members.where(F.col("id") != F.col("rep")).select(F.col("id").alias("a"), F.col("rep").alias("b"))
        sums = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("far"))
        whole = components(found.where(F.col("b").isNotNull()).select("a", "b").unionByName(copies))
        counts = members.join(sums, "rep", "left").groupBy("id").agg(F.max(F.col("weight") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
        out = rows.select("id").join(counts, "id", "left").join(whole, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
