import random

import pytest

from grainloom.llm import components as module
from grainloom.llm.components import components


def plain(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("kind", ["random", "path", "star", "none"])
@pytest.mark.parametrize("task", [1_000_000, 60])
def test_against_union_find(spark, kind, task, monkeypatch):
    monkeypatch.setattr(module, "TASK", task)
    r = random.Random(1)
    links = {
        "random": [(r.randrange(300), r.randrange(300)) for _ in range(220)],
        "path": [(i * 7919 % 257, (i + 1) * 7919 % 257) for i in range(200)],
        "star": [(5, i) for i in range(6, 200)] * 2,
        "none": [],
    }[kind]
    got = components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect()
    want = plain([x for x in links if x[0] != x[1]])
    assert {x.id: x.component for x in got} == want and len(got) == len(want)
