"""Toxicity as severity grades, by cumulative-link ordinal regression on sparse text features.

P(grade > k | x) = sigmoid(w.x - b_k), with one weight vector w for all
thresholds b_1 < b_2. Units are words and word beginnings of 3 to 7
letters; each unit gives two features, its presence and its rate among
the text's words. Grades come from the labels alone: 0 for a text that is
not toxic, 1 for a toxic text of quality, 2 for a toxic text without it.
Labels that know only one kind of toxic texts leave one threshold. The
expected severity of a text is the sum of P(grade > k); texts from REJECT
on are rejected.

Defined cases: a null or empty text has no features and severity 0 (it
carries no words to be toxic); without labelled texts of both kinds, or
without telling units, every severity is 0; an empty table gives an empty
result; texts are used whole; repeated rows are graded alike, and of the
rows of one key, and of a group of near copies, one teaches; extra
columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, slim

#: Labelled texts of a kind (toxic, clean) are sampled evenly by key down to about this many (documented bound of the fit).
TRAIN_ROWS = 3000
#: Bytes of text of a kind that the fit takes at most, and bytes of a text that it learns from (documented bounds of the fit).
TRAIN_BYTES, TRAIN_TEXT = 16 << 20, 1 << 20
#: Expected severity (0 to 2) from which a text is rejected.
REJECT = 0.5
#: Words must occur in so many toxic training texts, and so many standard errors more often than in clean ones, to be features.
MIN_TEXTS = 5
MIN_Z = 6.0

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def units(word: str) -> list[str]:
    """A word and its beginnings, those marked."""
    return [word, *(f"^{word[:n]}" for n in range(3, min(7, len(word)) + 1))]


def rate(n: float, of: int) -> float:
    return math.log2(1 + 100 * n / of)


def sketch(text: str, size: int = 4) -> list[int]:
    """The smallest hashes of a text's five-word shingles: near copies share most of them."""
    w = words(text)
    return heapq.nsmallest(size, {zlib.crc32(" ".join(w[i : i + 5]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(w) - 4))})


def distinct(texts: list[str]) -> list[int]:
    """Positions of texts that are no near copy of an earlier one, so that a group of copies teaches its words once."""
    seen: set[int] = set()
    out = []
    for i, t in enumerate(texts):
        if seen.isdisjoint(s := sketch(t)):
            out.append(i)
        seen.update(s)
    return out


@dataclass
class Severity:
    """Telling units with the weights of their presence and rate, and the ordered thresholds."""

    telling: dict[str, tuple[float, float]]
    thresholds: np.ndarray

    def scorer(self):
        """A function from texts to expected severities; it remembers the telling units of words, within bounds."""
        known: dict[str, tuple] = {}

        def expected(text: str | None) -> float:
            if not len(self.thresholds) or not (w := words(text)):
                return 0.0
            found: Counter = Counter()
            for word, n in Counter(w).items():
                if (u := known.get(word)) is None:
                    if len(known) > 100_000:
                        known.clear()
                    u = known[word] = tuple(x for x in units(word) if x in self.telling)
                for x in u:
                    found[x] += n
            s = sum(self.telling[u][0] + self.telling[u][1] * rate(n, len(w)) for u, n in sorted(found.items()))
            return float((1 / (1 + np.exp(-np.clip(s - self.thresholds, -500, 500)))).sum())

        return expected


def select(texts: list[str], toxic: np.ndarray) -> list[str]:
    """Units that toxic texts hold more often, by far more than chance over so many units tried."""
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    in1: Counter = Counter()
    for t in (t for t, bad in zip(texts, toxic, strict=True) if bad):
        in1.update({u for word in set(words(t)) for u in units(word)})
    in1 = Counter({u: k for u, k in in1.items() if k >= MIN_TEXTS})
    in0: Counter = Counter()
    known: dict[str, tuple[str, ...]] = {}
    for t in (t for t, bad in zip(texts, toxic, strict=True) if not bad):
        held: set[str] = set()
        for word in set(words(t)):
            if word not in known:
                known[word] = tuple(u for u in units(word) if u in in1)
            held.update(known[word])
        in0.update(held)
    kept = []
    for u, k in in1.items():
        p1, p0 = k / n1, in0[u] / n0
        p = (k + in0[u]) / (n1 + n0)
        if p1 >= 3 * p0 and (p1 - p0) / math.sqrt(max(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0)) >= MIN_Z:
            kept.append(u)
    return sorted(kept)


def loss(w: np.ndarray, b: np.ndarray, rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, grade: np.ndarray, weight: np.ndarray, ridge: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The penalised negative log likelihood and its gradients; b holds the first threshold and the logs of the steps to the next ones."""
    levels = len(b)
    cut = thresholds_of(b)
    s = np.bincount(rows, w[cols] * vals, len(grade))
    # P(grade = g) = F(g) - F(g + 1), with F(0) = 1 and F(levels + 1) = 0
    above = 1 / (1 + np.exp(-np.clip(s[:, None] - cut[None, :], -50, 50)))
    edge, at = np.zeros((len(grade), 1)), np.arange(len(grade))
    full = np.concatenate([edge + 1, above, edge], axis=1)
    slope = np.concatenate([edge, above * (1 - above), edge], axis=1)
    prob = np.maximum(full[at, grade] - full[at, grade + 1], 1e-9)
    g_s = -weight * (slope[at, grade] - slope[at, grade + 1]) / prob
    g_cut = np.array([np.sum(weight / prob * slope[:, k] * ((grade == k).astype(float) - (grade == k - 1).astype(float))) for k in range(1, levels + 1)])
    g_w = np.bincount(cols, g_s[rows] * vals, len(w)) + ridge * w
    g_b = np.concatenate([[g_cut.sum()], [np.exp(b[k]) * g_cut[k:].sum() for k in range(1, levels)]])
    return float(-(weight * np.log(prob)).sum() + ridge / 2 * (w @ w)), g_w, g_b


def thresholds_of(b: np.ndarray) -> np.ndarray:
    return b[0] + np.concatenate([[0.0], np.cumsum(np.exp(b[1:]))])


def fit(texts: list[str], grades: list[int], steps: int = 400, speed: float = 0.1, ridge: float = 2e-4) -> Severity:
    """Fits the regression to texts with grades from 0 by full gradient steps (Adam)."""
    once = distinct(texts)
    texts, grade = [texts[i] for i in once], np.asarray([grades[i] for i in once], np.int64)
    none = Severity({}, np.zeros(0))
    if not (grade > 0).any() or not (grade == 0).any():
        return none
    grade = np.searchsorted(np.unique(np.append(grade, 0)), grade)  # grades that do not occur need no threshold
    levels = int(grade.max())
    kept = select(texts, grade > 0)
    if not kept:
        return none
    index = {u: i for i, u in enumerate(kept)}
    known: dict[str, tuple[int, ...]] = {}
    at, unit, n, size = array("q"), array("q"), array("q"), array("q")
    for i, t in enumerate(texts):
        w = words(t)
        found: Counter = Counter()
        for word, k in Counter(w).items():
            if word not in known:
                known[word] = tuple(index[u] for u in units(word) if u in index)
            for u in known[word]:
                found[u] += k
        at.extend([i] * len(found))
        unit.extend(found.keys())
        n.extend(found.values())
        size.extend([len(w)] * len(found))
    rows, cols = np.tile(np.array(at), 2), np.concatenate([np.array(unit), np.array(unit) + len(kept)])
    vals = np.concatenate([np.ones(len(n)), np.log2(1 + 100 * np.array(n) / np.array(size))])
    weight = np.where(grade > 0, 0.5 / (grade > 0).sum(), 0.5 / (grade == 0).sum())  # both kinds count alike
    w = np.zeros(2 * len(kept))
    b = np.concatenate([[0.0], np.full(levels - 1, 0.5)])
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for t in range(1, steps + 1):
        _, g_w, g_b = loss(w, b, rows, cols, vals, grade, weight, ridge)
        for v, g, m, q in ((w, g_w, *state[:2]), (b, g_b, *state[2:])):
            m *= 0.9
            m += 0.1 * g
            q *= 0.999
            q += 0.001 * g * g
            v -= speed * (m / (1 - 0.9**t)) / (np.sqrt(q / (1 - 0.999**t)) + 1e-8)
        w[:] = np.maximum(w, 0)  # a telling unit never speaks for a text
    cut = thresholds_of(b)
    return Severity({u: (float(w[i]), float(w[i + len(kept)])) for u, i in index.items()}, cut)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", quality: str = "quality", rows: int = TRAIN_ROWS) -> Severity:
    """Fits on an even sample by key of about `rows` labelled texts of each kind (toxic, clean), within TRAIN_BYTES of each."""
    level = F.when(F.col(label) == 0, 0).when(F.col(quality) == 0, 2).otherwise(1) if quality in labels.columns else F.col(label)
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).alias("k"), F.col(label).alias("bad"), level.cast("int").alias("level"))
    marked = marked.groupBy("k").agg(F.max("bad").alias("bad"), F.max("level").alias("level"))
    sizes = {r[0]: r[1] for r in marked.groupBy("bad").agg(F.count(F.lit(1))).collect()}
    if len(sizes) < 2:
        return fit([], [])
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, rows / n)))])
    drawn = marked.withColumn("h", F.xxhash64(F.col("k").cast("string"), F.lit(5)))
    drawn = drawn.where(F.pmod("h", F.lit(1 << 20)) < F.element_at(share, F.col("bad")) * (1 << 20))
    sample = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.octet_length("t") <= TRAIN_TEXT).join(F.broadcast(drawn), "k")
    # One text of each key, so that the sample is as small as its labels; texts in the order of a hash as far as the bytes go.
    one = sample.groupBy("k", "h", "bad", "level").agg(F.min(F.struct(F.xxhash64("t"), "t"))["t"].alias("t"))
    before = F.sum(F.octet_length("t")).over(Window.partitionBy("bad").orderBy("h", "k"))
    got = sorted(one.withColumn("bytes", before).where(F.col("bytes") <= TRAIN_BYTES).select("k", "level", "t").collect(), key=lambda r: r[0])
    return fit([r[2] for r in got], [r[1] for r in got])


def grade(df: DataFrame, model: Severity, key: str = "doc_id", text: str = "text", reject: float = REJECT) -> DataFrame:
    """key, severity (0 to 2), grade (nearest) and toxic (rejected) of each row of df."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expected = model.scorer()
        for b in (s for batch in batches for s in slices(batch)):
            s = np.array([expected(t) for t in b.column(1).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.round(s, 6)), pa.array(np.rint(s).astype(np.int32)), pa.array(s >= reject)], [key, "severity", "grade", "toxic"]
            )
        slim()

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, severity double, grade int, toxic boolean")


def clean(df: DataFrame, model: Severity, text: str = "text", reject: float = REJECT) -> DataFrame:
    """The rows of df, with all their columns, whose text is not rejected."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expected = model.scorer()
        for b in (s for batch in batches for s in slices(batch, at)):
            yield b.filter(pa.array([expected(t) < reject for t in b.column(at).to_pylist()], pa.bool_()))
        slim()

    return df.mapInArrow(run, df.schema)
