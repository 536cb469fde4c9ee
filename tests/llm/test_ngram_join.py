import random
import re

import pytest

from assayer.llm import ngram_join as nj
from assayer.llm.components import components


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    ids = sorted({d for d, _ in rows if d is not None})
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = [(d, shingle_set(t)) for d, t in rows if d is not None]
    for i, (a, s) in enumerate(own):
        for b, t in own[:i]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted(((d, len(shingle_set(t)), None if d is None else find(d)) for d, t in rows), key=str)


def got(df, **options):
    return sorted((tuple(r) for r in nj.near_groups(df, **options).collect()), key=str)


@pytest.mark.parametrize("block_sets", [256, 3])
def test_against_brute_force(spark, awkward, block_sets):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert got(awkward, block_sets=block_sets) == brute(rows)


def test_chains_and_edges_of_the_threshold(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for c in range(6):
        text = rng.choices(words, k=rng.choice([6, 12, 40, 90]))
        for i in range(12):
            rows.append((c * 100 + i, " ".join(text)))
            text = list(text)
            for _ in range(rng.choice([1, 1, 2])):
                text[rng.randrange(len(text))] = rng.choice(words)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, block_sets=5) == brute(rows)


def test_empty(nothing):
    assert got(nothing) == []


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 240)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    result = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert result == {x: find(x) for e in edges if e[0] != e[1] for x in e}
