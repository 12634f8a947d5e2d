"""Links against all pairs in double precision."""

import numpy as np
import pytest

from grainloom.llm import neardup


def plain(ids, x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= 0.9
    comp = list(range(len(ids)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, j in zip(*np.nonzero(np.triu(hit, 1)), strict=True):
        a, b = find(i), find(j)
        comp[max(a, b)] = min(a, b)
    return {ids[i]: (int(hit[i].sum()) - 1, ids[find(i)]) for i in range(len(ids))}


@pytest.mark.parametrize("block", [2048, 40])
def test_against_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "SHARED", 16 if block == 40 else 512)
    g = np.random.default_rng(block)
    base = g.standard_normal((300, 64))
    x = [*base]
    for i in range(120):  # near the threshold and far above it
        x.append(base[i] + g.standard_normal(64) * g.choice([0.05, 0.2, 0.35]))
    x += [base[7] + g.standard_normal(64) * 0.05 for _ in range(150)] + [base[9]] * 90 + [base[9] * 3]
    x = np.array(x).astype(np.float32)
    ids = list(range(len(x)))
    rows = [(i, v.tolist(), 1, "c") for i, v in zip(ids, x, strict=True)]
    bad = [(1000, None), (1001, [0.0] * 64), (1002, [float("nan")] * 64), (1003, [1.0] * 63 + [None]), (1004, []), (1005, [float("inf")] * 64), (1006, x[0].tolist()[:32]), (None, x[1].tolist())]
    df = spark.createDataFrame([*rows, *((i, v, 1, "c") for i, v in bad)], "vec_id long, embedding array<float>, label int, id string").repartition(4)
    out = neardup.near_duplicates(df).collect()
    assert len(out) == len(rows) + len(bad)
    got = {r.vec_id: (r.n_links, r.component_id) for r in out}
    want = plain(ids, x.astype(np.float64))
    links, found = sum(n for n, _ in want.values()), sum(got[i][0] for i in ids)
    assert all(got[i][0] <= want[i][0] for i in ids) and found >= 0.99 * links
    assert sum(got[i] != want[i] for i in ids) <= 3
    for i, _ in bad:
        assert got[i] == (0, i)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in out)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_plan_follows_the_input():
    small, large = neardup.plan(1_000, 0.9), neardup.plan(10**9, 0.9)
    assert small.in_table < large.in_table and small.tables < large.tables and small.count == large.count


def test_doubles_and_extreme_values(spark):
    """Double vectors are compared as doubles; links do not depend on a vector's length."""
    a = np.zeros(64)
    a[0], a[1] = 0.9, np.sqrt(1 - 0.81)
    e = np.eye(64)[0]
    rows = [(1, e.tolist()), (2, (a * 1e200).tolist()), (3, (a * 1e-200).tolist()), (4, (e * 1.0 + np.eye(64)[2] * 1e-9).tolist()), (5, (-e).tolist())]
    out = {r.vec_id: (r.n_links, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert out[5] == (0, 5) and out[4][0] >= 1 and out[3][0] >= 1 and out[2][0] >= 1 and out[1][1] == 1


@pytest.mark.parametrize("spread", [3, 100])
def test_windows_count_like_a_plain_loop(spread):
    g = np.random.default_rng(1)
    q = np.clip(np.rint(g.standard_normal((90, neardup.PROJECTIONS)) * spread), -neardup.EDGE, neardup.EDGE).astype(np.int8)
    for side in (np.zeros(90, int), np.arange(90) % 2):
        for lead, count in ((0, 1), (5, 12), (7, 40)):
            got = {tuple(sorted(x)) for s, t in neardup.passing(q, lead, side, count, chunk=16) for x in zip(s.tolist(), t.tolist(), strict=True)}
            d = np.abs(q[:, None].astype(int) - q[None])
            ok = ((d <= neardup.STEPS + 1).sum(axis=2) >= count) & (d[:, :, lead] <= neardup._LED) & ((side[:, None] != side[None]) | (side.max() == 0))
            assert got == {(i, j) for i, j in zip(*np.nonzero(ok), strict=True) if i < j}
