"""Vectors (V01-V08, J13-J15, M01, M02, A31, A46): blocks, retrieval, projection, clusters.

Nearest-neighbour searches are stated query sets against all vectors, in
blocks of matrices on the executors; no pair becomes a row unless it is
among an item's best.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import unit_vector
from ..functions.text import evidence_tokens, hash_bucket, hash_sign
from ..scratch import written
from .windows import numbered, quantiles, top_k, z_scores

#: Vectors of the query side that one broadcast block holds, about.
BLOCK_ROWS = 50_000

#: Rows of the base, and of the queries, whose cosines a worker holds at once.
TILE_ROWS = 2_048
TILE_QUERIES = 512

#: Pairs of a block of queries and base from which on base is dealt out, and half of which a task then gets, about.
MANY_PAIRS = 200_000_000


def numeric_block(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Medians for what is missing, log1p of what is above 0, sample z-scores, over the root of the number of columns."""
    rows = df.select(key, *(F.col(c).cast("double").alias(c) for c in columns))
    each = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in columns))).alias("e")).select("e.*")
    found = quantiles(each, "v", [0.5], "c")
    medians = found.agg(*(F.coalesce(F.max(F.when(F.col("c") == c, F.col("value"))), F.lit(0.0)).alias(f"_{c}") for c in columns))
    logs = rows.crossJoin(F.broadcast(medians)).select(key, *(F.log1p(F.greatest(F.coalesce(c, f"_{c}"), F.lit(0.0))).alias(c) for c in columns))  # one row
    z = z_scores(logs, columns)
    return z.select(key, *((F.col(c) / float(len(columns)) ** 0.5).alias(c) for c in columns))


def hashed_text(df: DataFrame, key: str, text: str, dims: int = 64) -> DataFrame:
    """key, dim, value: signed hashed token counts, log1p of each count, in long form."""
    rows = hashed_rows(df, key, text, dims)
    return rows.select(key, F.explode(F.arrays_zip("_d", "_x")).alias("_e")).select(key, F.col("_e._d").alias("dim"), F.col("_e._x").alias("value"))


#: The same words as evidence_tokens() gives, of text in lower case.
EVIDENCE = re.compile("[a-z0-9_-]{3,}")

#: Tokens whose bucket and sign a worker remembers.
KNOWN = 500_000


def hashed_rows(df: DataFrame, key: str, text: str, dims: int = 64) -> DataFrame:
    """A row a key: the dimensions that its tokens fall into, and their values (both arrays empty without tokens).

    A key of one row is counted where it stands, so no token is shuffled; the rows of repeated keys come together by token.
    """
    rows = df.select(key, text)
    again = written(rows.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_k"))
    some = again.limit(1).count() > 0
    same = F.col(key).eqNullSafe(F.col("_k"))
    once = rows.join(again, same, "left_anti") if some else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, float]] = {}
        for b in batches:
            at, values = [], []
            for said in b.column(1):
                sums: dict[int, float] = {}
                for token, n in Counter(EVIDENCE.findall(said.as_py() or "")).items():
                    if (place := known.get(token)) is None:
                        if len(known) >= KNOWN:
                            known.clear()
                        bucket, sign = (int(hashlib.md5(f"{salt}{token}".encode()).hexdigest()[-7:], 16) for salt in ("", "sign:"))
                        place = known[token] = bucket % dims, -1.0 if sign % 2 else 1.0
                    sums[place[0]] = sums.get(place[0], 0.0) + place[1] * math.log1p(n)
                at.append(list(sums))
                values.append(list(sums.values()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], [key, "_d", "_x"])

    out = once.select(key, F.lower(text)).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, _d array<int>, _x array<double>")
    if not some:
        return out
    rows = rows.join(again, same, "left_semi")
    counts = rows.select(key, F.explode_outer(evidence_tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))
    sums = counts.select(key, hash_bucket(F.col("token"), dims).alias("_d"), (hash_sign(F.col("token")) * F.log1p("n")).alias("v")).groupBy(key, "_d").agg(F.sum("v").alias("_x"))
    held = F.collect_list(F.when(F.col("_d").isNotNull(), F.struct("_d", "_x")))
    return out.unionByName(sums.groupBy(key).agg(held.alias("_e")).select(key, F.col("_e._d").alias("_d"), F.col("_e._x").alias("_x")))


def text_block(df: DataFrame, key: str, text: str, dims: int = 64) -> DataFrame:
    """Key and block: the hashed counts as an array, each dimension less its mean over its population deviation, over the root of dims."""
    held = written(hashed_rows(df, key, text, dims)).withColumn("_m", F.map_from_arrays("_d", "_x"))  # read for the scale and for the blocks
    rows = held.select(key, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.col("_m")[i], F.lit(0.0))).alias("_v"))
    return standardised(rows, key, "_v", "block", float(dims) ** 0.5)


def standardised(rows: DataFrame, key: str, vector: str, name: str, over: float = 1.0, shared: DataFrame | None = None) -> DataFrame:
    """Key and name: each dimension less its mean over its population deviation (0 counts as 1), of rows or of `shared`."""
    each = (shared or rows).select(F.posexplode(vector).alias("i", "x"))
    stats = each.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).select(F.struct("i", "m", F.when(F.col("s") > 0, F.col("s")).otherwise(F.lit(1.0)).alias("s")).alias("t"))
    stats = stats.agg(F.array_sort(F.collect_list("t")).alias("_t"))  # a row of as many entries as dimensions
    return rows.crossJoin(F.broadcast(stats)).select(key, F.zip_with(vector, "_t", lambda x, t: (x - t["m"]) / t["s"] / over).alias(name))


def shared_log_matrices(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Key and vector of two tables: log1p, standardised by the mean and population deviation of both together, of length 1; missing values count 0."""
    logs = lambda df: df.select(key, F.array(*(F.log1p(F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))) for c in columns)).alias("_v"))
    x, y = logs(a), logs(b)
    both = x.select("_v").unionByName(y.select("_v"))
    done = lambda df: standardised(df, key, "_v", "vector", shared=both).withColumn("vector", unit_vector(F.col("vector")))
    return done(x), done(y)


def blocks_of(df: DataFrame, key: str, blocks: dict[str, list[str]], text: str, dims: int = 64) -> tuple[DataFrame, list[tuple[str, int]]]:
    """Key and vector: numeric blocks (M01) and a hashed text block (F19) one after another, and the dimensions of each."""
    every = [c for cs in blocks.values() for c in cs]
    z = numeric_block(df, key, every)  # over the root of all columns; each block is over the root of its own
    part = lambda cs: F.array(*(F.col(c) * (len(every) / len(cs)) ** 0.5 for c in cs))
    out = z.select(key, *(part(cs).alias(name) for name, cs in blocks.items()))
    out = out.join(text_block(df, key, text, dims).withColumnRenamed("block", "text"), key)
    return out.select(key, F.concat(*blocks, "text").alias("vector")), [*((n, len(c)) for n, c in blocks.items()), ("text", dims)]


def nearest(queries: DataFrame, base: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", group: str | None = None, skip_same_group: bool = False) -> DataFrame:
    """(query_id, query_group, base_id, base_group, cosine, rank): the k best of all base rows, or of each group; a row is not its own neighbour.

    skip_same_group: neighbours are of another group, so rows without one neither ask nor are found.
    Queries are broadcast in blocks of about BLOCK_ROWS; for each block base is scanned once, and each
    of its partitions returns its own best only. With several blocks each one's result is written.
    From MANY_PAIRS a block on, base is dealt out by id first, whatever files it comes in.
    """
    if skip_same_group:
        queries, base = (df.where(F.col(group).isNotNull()) for df in (queries, base))
    usable = queries.where(F.col(vector).isNotNull())
    n = usable.count()
    blocks = max(1, -(-n // BLOCK_ROWS))
    pairs = min(n, BLOCK_ROWS) * base.count()
    if pairs > MANY_PAIRS:
        tasks = max(2 * pairs // MANY_PAIRS, base.sparkSession.sparkContext.defaultParallelism)
        base = written(base.select(id_col, vector, *([group] if group else [])).repartition(tasks, id_col))
    parts = []
    for i in range(blocks):
        found, sent = _nearest(usable.where(F.pmod(F.xxhash64(id_col), F.lit(blocks)) == i) if blocks > 1 else usable, base, k, id_col, vector, group, skip_same_group)
        parts.append(written(found) if blocks > 1 else found)
        if blocks > 1:
            sent.destroy()  # what it was for is written
    return reduce(DataFrame.unionByName, parts)


def _nearest(queries: DataFrame, base: DataFrame, k: int, id_col: str, vector: str, group: str | None, skip_same_group: bool) -> tuple[DataFrame, Broadcast]:
    sent = queries.sparkSession.sparkContext.broadcast(_prepared(queries, id_col, vector, group))
    each = bool(group) and not skip_same_group
    kind = base.schema[id_col].dataType.simpleString()

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of each query (and group) the k best, ties by base id."""
        pdf = pdf.sort_values(["cosine", "base_id"], ascending=[False, True], kind="stable")
        return pdf.groupby(["query_id", "base_group"] if each else ["query_id"], sort=False).head(k)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qid, q, qg = sent.value
        kinds = pd.Index(pd.unique(qg))
        qk = kinds.get_indexer(qg)
        held: list[pd.DataFrame] = []
        for pdf in (whole.iloc[at : at + TILE_ROWS] for whole in parts for at in range(0, len(whole), TILE_ROWS)):
            pdf = pdf[pdf["v"].map(lambda x: x is not None and len(x) == q.shape[1])]
            if pdf.empty:
                continue
            b = np.stack(pdf["v"].to_numpy()).astype(np.float64)
            size = np.linalg.norm(b, axis=1)
            bid, bg = pdf["id"].to_numpy(), pdf["g"].to_numpy()
            order = np.argsort(bid, kind="stable")  # so that ties go to the smaller id
            order = order[np.isfinite(size[order])]
            if not len(order):
                continue
            b, bid, bg = b[order] / np.maximum(size[order, None], 1e-12), bid[order], bg[order]
            bk = kinds.get_indexer(bg)
            for at in range(0, len(q), TILE_QUERIES):
                s = q[at : at + TILE_QUERIES] @ b.T
                np.round(s, 9, out=s)
                s[bid[None, :] == qid[at : at + TILE_QUERIES, None]] = -np.inf
                if skip_same_group:
                    s[bk[None, :] == qk[at : at + TILE_QUERIES, None]] = -np.inf
                for g in pd.unique(bg) if each else [None]:
                    cols = np.arange(len(bid)) if g is None else np.flatnonzero(bg == g)
                    part = s if g is None else s[:, cols]
                    top = part.argmax(axis=1)[:, None] if k == 1 else np.argsort(-part, axis=1, kind="stable")[:, : min(k, len(cols))]
                    rows = np.repeat(np.arange(len(part)), top.shape[1])
                    asked = slice(at, at + TILE_QUERIES)
                    out = pd.DataFrame({"query_id": qid[asked][rows], "query_group": qg[asked][rows], "base_id": bid[cols[top.ravel()]], "base_group": bg[cols[top.ravel()]], "cosine": part[rows, top.ravel()]})
                    held.append(out[np.isfinite(out["cosine"])])
            if sum(map(len, held)) > 2 * k * max(1, len(q)):
                held = [best(pd.concat(held))]
        if held:
            yield best(pd.concat(held))

    g = F.col(group).cast("string") if group else F.lit("")
    found = base.select(F.col(id_col).alias("id"), g.alias("g"), F.col(vector).alias("v")).mapInPandas(run, f"query_id {kind}, query_group string, base_id {kind}, base_group string, cosine double")
    return top_k(found, ["query_id", "base_group"] if each else ["query_id"], [F.desc("cosine"), F.asc("base_id")], k), sent


def encoded_once(df: DataFrame, path: str, key: str, text: str, encode: Callable[[Column], Column]) -> DataFrame:
    """Key, stamp and vector of df's texts: those already at path under the same stamp (SHA-256 of the text) are not encoded again."""
    spark = df.sparkSession
    want = df.select(key, text, F.sha2(F.col(text).cast("binary"), 256).alias("stamp"))
    schema = want.select(key, "stamp", encode(F.col(text)).alias("vector")).schema
    from ..sources.readers import read_optional

    done = read_optional(spark, path, schema)
    want.join(done.select(key, "stamp"), [key, "stamp"], "left_anti").select(key, "stamp", encode(F.col(text)).alias("vector")).write.mode("append").parquet(path)
    return want.select(key, "stamp").join(spark.read.schema(schema).parquet(path), [key, "stamp"])


def _prepared(df: DataFrame, id_col: str, vector: str, group: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    g = F.col(group).cast("string") if group else F.lit("")
    pdf = df.select(F.col(id_col).alias("id"), F.col(vector).alias("v"), g.alias("g")).toPandas()  # about BLOCK_ROWS
    q = np.stack(pdf["v"].to_numpy()).astype(np.float64) if len(pdf) else np.zeros((0, 1))
    return pdf["id"].to_numpy(), q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12), pdf["g"].to_numpy()


def balanced(queries: DataFrame, base: DataFrame, k: int, per_group: int, group: str) -> DataFrame:
    """The k best of all together with the best of each group, ranked again."""
    a = nearest(queries, base, k).select("query_id", "base_id", "cosine")
    b = nearest(queries, base, per_group, group=group).select("query_id", "base_id", "cosine")
    return top_k(a.unionByName(b).distinct(), ["query_id"], [F.desc("cosine"), F.asc("base_id")], 1 << 30)


def donor_votes(neighbours: DataFrame, donors: DataFrame, weight: str) -> DataFrame:
    """Each group's donor with most weight, then count, then mean similarity. neighbours: query_group, donor, cosine, weight."""
    v = neighbours.groupBy("query_group", "donor").agg(F.sum(weight).alias("votes"), F.count(F.lit(1)).alias("n"), F.avg("cosine").alias("similarity")).join(donors, "donor", "left_semi")
    return top_k(v, ["query_group"], [F.desc("votes"), F.desc("n"), F.desc("similarity"), F.asc("donor")], 1)


def pca(df: DataFrame, key: str, vector: str, k: int = 2) -> DataFrame:
    """Key and k components of the centred vectors; of each loading the entry largest by size is positive.

    Sums of products are added up where the rows are; the driver sees one dim x dim matrix.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in parts:
            x = np.stack(pdf["v"].to_numpy()).astype(np.float64) if len(pdf) else None
            if x is not None:
                x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel()})

    got = df.select(F.col(vector).alias("v")).where("v is not null").mapInPandas(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    d = int(got["i"].max()) if len(got) else 0
    m = np.zeros((d + 1, d + 1))
    m[got["i"], got["j"]] = got["s"]
    n, mean = m[0, 0], m[0, 1:] / max(m[0, 0], 1)
    values, vectors = np.linalg.eigh(m[1:, 1:] - n * np.outer(mean, mean))
    load = vectors[:, ::-1][:, :k]
    load = load * np.sign(load[np.abs(load).argmax(axis=0), np.arange(load.shape[1])])
    comp = lambda c: F.aggregate(F.zip_with(F.col(vector), F.array(*map(F.lit, load[:, c].tolist())), lambda x, y: x.cast("double") * y), F.lit(-float(mean @ load[:, c])), lambda s, x: s + x)
    return df.where(F.col(vector).isNotNull()).select(key, *(comp(c).alias(f"pc{c + 1}") for c in range(load.shape[1])))


def kmeans(df: DataFrame, key: str, vector: str, k: int, rounds: int = 80) -> DataFrame:
    """Key and cluster of a deterministic k-means: seeds evenly spaced in the order of norms, empty clusters stay where they are."""
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    n = rows.count()
    if not n:
        return rows.select(F.col("id").alias(key), F.lit(0).alias("cluster"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    at = sorted({round(i * (n - 1) / max(1, k - 1)) for i in range(k)})
    centres = np.array([r["v"] for r in numbered(rows.withColumn("norm", norm), ["norm", "id"], "ord").where(F.col("ord").isin(at)).orderBy("ord").collect()], np.float64)

    def near(c: np.ndarray):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                if len(pdf):
                    x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
                    d = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :]
                    yield pd.DataFrame({"id": pdf["id"], "cluster": d.argmin(1).astype(np.int32)})

        return run

    def sums(c: np.ndarray):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(c), c.shape[1] + 1))
            for pdf in parts:
                if len(pdf):
                    x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
                    own = ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :]).argmin(1)
                    np.add.at(total, own, np.concatenate([np.ones((len(x), 1)), x], axis=1))
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel()})

        return run

    for _ in range(rounds):
        got = rows.mapInPandas(sums(centres), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
        m = np.zeros((len(centres), centres.shape[1] + 1))
        m[got["i"], got["j"]] = got["s"]
        new = np.where(m[:, :1] > 0, m[:, 1:] / np.maximum(m[:, :1], 1), centres)
        done = np.allclose(new, centres, rtol=0, atol=1e-9)
        centres = new
        if done:
            break
    return rows.mapInPandas(near(centres), f"id {df.schema[key].dataType.simpleString()}, cluster int").select(F.col("id").alias(key), "cluster")


def cluster_patterns(clusters: DataFrame, labels: DataFrame, key: str, label: str, k: int = 12, examples: int = 8) -> DataFrame:
    """The commonest labels of each cluster, and its first items as examples."""
    from .graph import top_labels

    both = clusters.join(labels, key)
    first = top_k(clusters.select("cluster", key), ["cluster"], [F.asc(key)], examples).groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string")), " | ").alias("examples"))
    return top_labels(both, ["cluster"], label, k).join(F.broadcast(first), "cluster")  # a row a cluster
