"""Language identification with hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1; a trigram's vector
binds its letters' vectors, each permuted once more than the next, by
multiplication; a text's vector bundles (adds) the vectors of all its
trigrams; a language's prototype bundles the normalised vectors of its
training texts. A text gets the language of the prototype with the
largest cosine.

Defined cases: a null text, or one without a letter, is ``und`` with
score 0; a language that has no training text is never predicted; if
nothing can be learned, every text is ``und``; ties go to the language
that sorts first; an empty table gives an empty result; repeated rows are
predicted alike, and each teaches; texts are used whole, and memory is
bounded by a text and BLOCK vectors; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 512
#: Symbols: 0 for what is not a letter, 1 to 26 for a to z, the rest shared by all other letters.
SYMBOLS = 96
#: Training texts of a language are sampled evenly by key down to about this many (documented bound of the fit).
TRAIN_ROWS = 4000
#: Trigrams whose vectors are bound at once.
BLOCK = 16384


def letters(seed: int = 7) -> np.ndarray:
    """The symbols' vectors in the three places of a trigram: the same vectors, permuted by rotation."""
    base = np.random.default_rng(seed).integers(0, 2, (SYMBOLS, DIM), np.int8) * 2 - 1
    return np.stack([np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base]).astype(np.float32)


_TABLE = np.zeros(0x110000, np.uint8)


def symbols(text: str) -> np.ndarray:
    """The symbol of each code point, lower-cased, with one break around each word."""
    if not _TABLE[ord("a")]:
        _TABLE[ord("a") : ord("z") + 1] = np.arange(1, 27)
        rest = np.arange(128, 0x110000)
        other = np.array([chr(c).isalpha() for c in rest])
        _TABLE[128:][other] = 27 + rest[other] * np.uint32(2654435761) % np.uint32(1 << 31) % (SYMBOLS - 27)
    s = _TABLE[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    s = np.concatenate([[np.uint8(0)], s, [np.uint8(0)]])
    return s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """The distinct trigrams of a text and how often each occurs; None without a letter."""
    s = symbols(text).astype(np.int32)
    if not s.any():
        return None
    t = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
    if len(t) > 50_000:
        n = np.bincount(t, minlength=0)
        return (u := np.flatnonzero(n)), n[u]
    return np.unique(t, return_counts=True)


def bundle(texts: list[str | None], places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' vectors, normalised, and whether each has a letter."""
    out, has = np.zeros((len(texts), DIM), np.float32), np.zeros(len(texts), bool)
    found = [trigrams(t) if t else None for t in texts]
    if not any(x is not None for x in found):
        return out, has
    all_ids = np.unique(np.concatenate([x[0] for x in found if x is not None]))
    total = np.zeros((len(texts), DIM), np.float32)
    for i in range(0, len(all_ids), BLOCK):
        t = all_ids[i : i + BLOCK]
        vectors = places[0][t // SYMBOLS**2] * places[1][t // SYMBOLS % SYMBOLS] * places[2][t % SYMBOLS]
        for k, x in enumerate(found):
            if x is not None:
                a, b = np.searchsorted(x[0], (t[0], t[-1] + 1))
                if a < b:
                    total[k] += x[1][a:b].astype(np.float32) @ vectors[np.searchsorted(t, x[0][a:b])]
    norm = np.linalg.norm(total, axis=1)
    has[:] = norm > 0
    out[has] = total[has] / norm[has, None]
    return out, has


@dataclass
class Profiles:
    """The languages in order, and a normalised prototype for each."""

    langs: list[str]
    prototypes: np.ndarray


def held_out(key: str = "doc_id") -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _blocks(column: pa.Array, size: int = 1 << 21) -> Iterator[list[str | None]]:
    """Consecutive texts, about size characters together, so that memory is bounded by a text and a block."""
    block, n = [], 0
    for t in column.to_pylist():
        block.append(t)
        n += len(t or "")
        if n >= size:
            yield block
            block, n = [], 0
    if block:
        yield block


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> Profiles:
    """Learns from the rows of df that have a language and a text, an even sample of about `rows` for each language."""
    usable = df.select(key, text, lang).where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in usable.groupBy(lang).agg(F.count(F.lit(1))).collect()}
    if not sizes:
        return Profiles([], np.zeros((0, DIM), np.float32))
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, rows / n)))])
    drawn = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(11)), F.lit(1 << 20)) < F.element_at(share, F.col(lang)) * (1 << 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, sums = letters(), {}
        for b in batches:
            names = b.column(1).to_pylist()
            at = 0
            for block in _blocks(b.column(0)):
                v, has = bundle(block, places)
                for k in np.flatnonzero(has):
                    name = names[at + k]
                    sums[name] = sums.get(name, 0) + v[k].astype(np.float64)
                at += len(block)
        for name, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * DIM), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(np.round(v, 6))], ["lang", "dim", "value"])

    sums = usable.where(drawn).select(text, lang).mapInArrow(run, "lang string, dim int, value double").groupBy("lang", "dim").agg(F.sum(F.col("value").cast("decimal(28,6)")).cast("double").alias("value"))
    found: dict[str, np.ndarray] = {}
    for r in sums.collect():  # languages x DIM rows
        found.setdefault(r.lang, np.zeros(DIM))[r.dim] = r.value
    langs = sorted(found)
    p = np.array([found[k] for k in langs]).reshape(len(langs), DIM)
    return Profiles(langs, (p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)).astype(np.float32))


def predict(df: DataFrame, model: Profiles, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score (the cosine, from 0 to 1) of each row of df."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = letters()
        for b in batches:
            preds, scores = [], []
            for block in _blocks(b.column(1)):
                v, has = bundle(block, places)
                if not model.langs:
                    has[:] = False
                cos = v @ model.prototypes.T if model.langs else np.zeros((len(block), 1))
                best = cos.argmax(axis=1)
                preds += [model.langs[j] if h else "und" for j, h in zip(best, has, strict=True)]
                scores += [float(min(1.0, max(0.0, cos[i, j]))) if has[i] else 0.0 for i, j in enumerate(best)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], [key, "lang_pred", "score"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")
