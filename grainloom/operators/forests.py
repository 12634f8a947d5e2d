"""Random forests of all repeated splits from one pass over the rows.

As in pyspark.ml a forest sees its columns in BINS bins, so rows of the same
bins (a cell) only count by their sums. One pass draws, for each row and tree,
how often the tree's bootstrap takes the row (Poisson, from a hash of the key,
so partitions do not matter), and sums each fold's train rows by cell and tree,
and its test rows by cell. Sums of all tasks come together by fold and a few
trees, where the trees grow; a row's prediction is its cell's, so the metrics
follow from the test rows' sums. No tree reads the rows again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: As the bank's forests have them; trees that grow in one group.
TREES, DEPTH, BINS, GROUP = 300, 5, 32, 10

#: Cells (columns of BINS bins each) and classes up to which a forest comes from sums.
CELLS, CLASSES = BINS**2, 10

#: Rows whose draws a worker holds at once.
ROWS = 4_096

#: Draws from 16 random bits.
_POISSON = np.searchsorted(np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, i + 1, dtype=float)) for i in range(9)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(float)


def _drawing():
    # A function of a function goes to the workers by value, so they need no package.
    def draws(h: np.ndarray) -> np.ndarray:
        """How often each tree takes each row, by the rows' hashes (splitmix64 of the hash and the tree)."""
        z = h.astype(np.uint64)[:, None] + (np.arange(1, -(-TREES // 4) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z ^= z >> np.uint64(shift)
            z *= np.uint64(factor)
        z ^= z >> np.uint64(31)
        return _POISSON[z.view(np.uint16)[:, :TREES]]

    return draws


draws = _drawing()


def _growing():
    # A function of a function goes to the workers by value, so they need no package.
    def tree(n: np.ndarray, v: np.ndarray, bins: np.ndarray, ways: int, r: np.random.Generator) -> np.ndarray:
        """The means of v by cell of a tree on cells of weight n, sums v and bins (a column each): splits of the most variance, over `ways` random columns a node."""
        out = np.zeros_like(v)
        stack = [(np.arange(len(n)), 0)]
        while stack:
            at, depth = stack.pop()
            total, sums = n[at].sum(), v[at].sum(axis=0)
            out[at] = sums / total if total > 0 else 0.0
            base, best = (sums**2).sum() / total if total > 0 else 0.0, None
            gain = 1e-12 * total
            for j in r.permutation(bins.shape[1])[:ways] if depth < DEPTH and total > 0 else ():
                b = bins[at, j]
                left = np.cumsum(np.bincount(b, n[at], BINS))[:-1]
                good = np.flatnonzero((left > 0) & (total - left > 1e-9 * total))
                if not len(good):
                    continue
                part = np.stack([np.cumsum(np.bincount(b, v[at, c], BINS))[:-1] for c in range(v.shape[1])], axis=1)[good]
                found = (part**2).sum(axis=1) / left[good] + ((sums - part) ** 2).sum(axis=1) / (total - left[good]) - base
                if (top := int(np.argmax(found))) is not None and found[top] > gain:
                    gain, best = found[top], b <= good[top]
            if best is not None:
                stack += [(at[best], depth + 1), (at[~best], depth + 1)]
        return out

    return tree


tree = _growing()


def _regression(held: np.ndarray, p: np.ndarray, scale: float) -> dict[str, float]:
    """As learn.regression_metrics(), of cells: rows, their sums and squares of the target, and predictions."""
    n, y, yy = held.T
    p, total = p[:, 0], n.sum()
    error = max((yy - 2 * p * y + p * p * n).sum(), 0.0)
    spread_y, spread_p = yy.sum() - y.sum() ** 2 / total, (p * p * n).sum() - (p * n).sum() ** 2 / total
    both = (p * y).sum() - (p * n).sum() * y.sum() / total
    return {"r2": 1 - error / spread_y if spread_y > 1e-12 else 0.0, "rmse": scale * (error / total) ** 0.5, "pearson": both / (spread_y * spread_p) ** 0.5 if spread_y > 1e-12 and spread_p > 1e-12 else 0.0}


def _classes(held: np.ndarray, p: np.ndarray, classes: list[float]) -> dict[str, float]:
    """As learn.classification_metrics(), of cells: rows of each class, and probabilities."""
    said, total, f1 = p.argmax(axis=1), held.sum(), []
    for c in range(len(classes)):
        true, all_said, all_are = held[said == c, c].sum(), held[said == c].sum(), held[:, c].sum()
        if all_said or all_are:
            f1.append(2 * true / (all_said + all_are))
    at, place = np.unique(np.round(p[:, 1], 6) if p.shape[1] > 1 else np.zeros(len(p)), return_inverse=True)
    pos, neg = np.bincount(place, held @ np.array(classes), len(at)), np.bincount(place, held @ (np.array(classes) == 0), len(at))
    pairs = pos.sum() * neg.sum()
    down_pos, down = np.cumsum(pos[::-1]), np.cumsum((pos + neg)[::-1])
    precise = (pos[::-1] * np.divide(down_pos, down, out=np.zeros_like(down), where=down > 0)).sum()
    return {
        "accuracy": sum(held[said == c, c].sum() for c in range(len(classes))) / total, "f1_macro": float(np.mean(f1)),
        "auroc": (pos * (np.cumsum(neg) - neg / 2)).sum() / pairs if pairs else 0.5, "auprc": precise / pos.sum() if pos.sum() else 0.0,
    }


def scores(df: DataFrame, key: str, columns: list[str], target: str, tests: list[Column], classes: dict[float, int] | None = None, seed: int = 42) -> list[tuple[int, str, float]]:
    """fold, metric, value of the forests of all folds, whose test rows meet `tests`. classes: each class and its number of rows; None: a regression.

    Bins (by approximate quantiles) and the means of missing values are each fold's, of its train rows alone. Without train or test rows a fold has no scores.
    """
    from .moments import _centre

    number = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double"))
    rows = df.select(F.xxhash64(F.col(key), F.lit(seed), F.lit("bootstrap")).alias("_h"), number(target).alias("_v"), *(number(c).alias(f"_x{i}") for i, c in enumerate(columns)), *(t.alias(f"_t{f}") for f, t in enumerate(tests))).where("_v IS NOT NULL")
    folds, k, labels = len(tests), len(columns), sorted(classes) if classes else []
    train = lambda f, i: F.when(~F.col(f"_t{f}"), F.col(f"_x{i}"))
    at = [q / BINS for q in range(1, BINS)]
    known = rows.agg(*(g.alias(f"{a}_{f}_{i}") for f in range(folds) for i in range(k) for a, g in (("c", F.percentile_approx(train(f, i), at, 10_000)), ("m", F.avg(train(f, i)))))).first()
    cuts = [[np.unique(known[f"c_{f}_{i}"] or []) for i in range(k)] for f in range(folds)]
    fill = [[known[f"m_{f}_{i}"] or 0.0 for i in range(k)] for f in range(folds)]
    middle, scale = _centre(rows, ["_v"])["_v"]
    cells = BINS**k
    groups = -(-TREES // GROUP)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = len(labels) or 2
        sums, held = np.zeros((folds, wide, cells, TREES)), np.zeros((folds, cells, len(labels) or 3))
        for whole in batches:
            for start in range(0, len(whole), ROWS):
                b = whole.slice(start, ROWS)
                read = lambda c: b.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                y, w = np.asarray(read("_v"), float), draws(read("_h"))
                y = y if labels else (y - middle) / scale
                values = np.stack([y == c for c in labels] if labels else [np.ones_like(y), y], axis=1).astype(float)
                tested = values if labels else np.column_stack([values, y * y])
                x = [np.asarray(read(f"_x{i}"), float) for i in range(k)]
                for f in range(folds):
                    cell = np.zeros(len(y), int)
                    for i in range(k):
                        cell = cell * BINS + np.searchsorted(cuts[f][i], np.where(np.isnan(x[i]), fill[f][i], x[i]))
                    test = read(f"_t{f}").astype(bool)
                    for c in range(tested.shape[1]):
                        held[f, :, c] += np.bincount(cell[test], tested[test, c], cells)
                    order = np.flatnonzero(~test)
                    order = order[np.argsort(cell[order], kind="stable")]
                    if not len(order):
                        continue
                    first = np.flatnonzero(np.diff(cell[order], prepend=-1))
                    mine, taken = cell[order][first], w[order]
                    for c in range(wide):
                        sums[f, c, mine] += np.add.reduceat(taken * values[order, c, None], first, axis=0)
        out = [(f, -1, held[f].ravel()) for f in range(folds)] + [(f, g, sums[f, :, :, g * GROUP : (g + 1) * GROUP].ravel()) for f in range(folds) for g in range(groups)]
        for f, g, numbers in out:
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([g], pa.int32()), pa.array([numbers], pa.list_(pa.float64()))], ["fold", "part", "cells"])

    bins = np.stack(np.unravel_index(np.arange(cells), (BINS,) * k), axis=1)
    ways = int(np.ceil(k**0.5 if labels else k / 3))  # pyspark.ml's columns a node
    weights = np.array([1.0 / classes[c] for c in labels]) if labels else None

    def grow(table: pa.Table) -> pa.Table:
        f, g = table.column("fold")[0].as_py(), table.column("part")[0].as_py()
        total = sum(np.asarray(x.values) for x in table.column("cells"))
        if g >= 0:
            s, said = total.reshape(len(labels) or 2, cells, -1), 0.0
            for t in range(s.shape[2]):
                v = s[:, :, t].T * weights if labels else s[1, :, t, None]
                said = said + tree(v.sum(axis=1) if labels else s[0, :, t], v, bins, ways, np.random.default_rng([seed, f, g, t]))
            total = np.append(np.ravel(said), s[0].sum() if not labels else s.sum())
        return pa.table([pa.array([f], pa.int32()), pa.array([g], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["fold", "part", "cells"])

    schema = "fold int, part int, cells array<double>"
    found: dict[tuple[int, bool], np.ndarray] = {}
    for f, g, numbers in rows.mapInArrow(gather, schema).groupBy("fold", "part").applyInArrow(grow, schema).toLocalIterator():
        found[f, g < 0] = found.get((f, g < 0), 0.0) + np.array(numbers)
    out = []
    for f in range(folds):
        if (f, True) not in found or not found[f, False][-1]:
            continue
        held, p = found[f, True].reshape(cells, -1), found[f, False][:-1].reshape(cells, -1) / TREES
        tested = held.sum() if labels else held[:, 0].sum()
        if tested:
            out += [(f, m, float(x)) for m, x in (_classes(held, p, labels) if labels else _regression(held, p, scale)).items()]
    return out
