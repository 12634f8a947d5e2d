"""Jump consistent hashing against the published scalar loop, and the laws of shards and slots."""

import zlib
from collections import Counter

import numpy as np

from grainloom.llm import sharding


def scalar(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_against_scalar_loop():
    keys = np.random.default_rng(1).integers(0, 2**64, 3000, np.uint64)
    for n in (1, 2, 7, 40, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [scalar(int(k), n) for k in keys]


def test_growth_and_balance():
    keys = np.random.default_rng(2).integers(0, 2**64, 200_000, np.uint64)
    a, b = sharding.jump_hash(keys, 40), sharding.jump_hash(keys, 41)
    assert set(b[a != b]) == {40} and abs((a != b).mean() - 1 / 41) < 0.003
    n = np.bincount(a, minlength=40)
    assert n.max() < 1.06 * n.mean() and n.min() > 0.94 * n.mean()


def test_frames(spark):
    rows = [(i, f"é{i}" * (i % 5), "x") for i in range(500)] + [(7, "same", "x")] * 300 + [(None, "t", "x"), (None, None, "x"), (1000, "", "x"), (1001, "y" * 100_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(6)
    out = sharding.shard_rows(df).collect()
    assert len(out) == len(rows)
    want = Counter((d, 16 + len((t or "").encode()), None if t is None else zlib.crc32(t.encode())) for d, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    slots: dict = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r.doc_id, r.shard, r.grown_shard) for r in out}) == len({r.doc_id for r in out})
    assert sharding.shard_rows(df.limit(0)).count() == 0
