import random

import pytest

from assayer.llm.components import components

RNG = random.Random(3)
EDGES = {
    "path": [(i, i + 1) for i in range(60)],
    "star": [(0, i) for i in range(1, 40)] + [(7, 7)],
    "star on its largest": [(9, 1), (9, 2), (9, 3), (9, 3)],
    "loop": [(3, 3)],
    "nothing": [],
    "random": [(RNG.randint(0, 150), RNG.randint(0, 150)) for _ in range(90)],
}


def brute(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return sorted((n, root(n)) for n in parent)


@pytest.mark.parametrize("name", EDGES)
def test_against_brute_force(spark, name):
    found = components(spark.createDataFrame(EDGES[name], "a long, b long"))
    assert sorted((r.node, r.component) for r in found.collect()) == brute(EDGES[name])
