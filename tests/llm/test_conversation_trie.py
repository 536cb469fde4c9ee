import hashlib
import random
import zlib

import pytest

from assayer.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string, name string, k int"


def key(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def brute(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), key(role, text), role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + v[h:])
    nodes = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes.setdefault(v[:d], []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in nodes)]
        ends = ",".join(str(c) for c in sorted(members) if built[c] == p)
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        children = sum(len(q) == len(p) + 1 for q in below)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(0, 2 * n), n):
        for t in range(rng.choice([0, 1, 2, 3, 5, 8, 12])):
            rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "bot", None]), rng.choice(["a", "é", "", None, "long text"]), "x", 9))
    rows += [(None, 1, "user", "a", "x", 1)] + [(200 + i, t, "user", "same", "x", 1) for i in range(12) for t in range(4)] + rows[:3]
    return rows


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("limit", [3, 40, ct.TURNS])
def test_against_brute_force(spark, seed, limit):
    rows = made(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = ct.prefix_trie(ct.rebuilt(ct.sequences(df)), limit)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_empty_and_turnless(spark):
    assert ct.prefix_trie(ct.rebuilt(ct.sequences(spark.createDataFrame([], SCHEMA)))).isEmpty()
    # 1 has one turn and a family without a first conversation: with h > 0 nothing is left of it.
    assert zlib.crc32(b"1") % 9 > 0
    got = [tuple(r) for r in ct.prefix_trie(ct.rebuilt(ct.sequences(spark.createDataFrame([(1, 0, "user", "a", "", 0)], SCHEMA)))).collect()]
    assert got == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]


def test_members_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(ct, "CHUNK", 7)
    rows = [(c, 0, "user", "same", "", 0) for c in range(-30, 95, 5)]
    assert sorted((tuple(r) for r in ct.prefix_trie(ct.rebuilt(ct.sequences(spark.createDataFrame(rows, SCHEMA)))).collect()), key=str) == brute(rows)


def test_deep_trie_without_recursion():
    trie = ct.Trie(1, 3)
    trie.add([i.to_bytes(4, "big") for i in range(50_000)], [1] * 50_000, 2, 7, "e")
    rows = list(trie.rows())
    assert len(rows) == 50_001 and rows[-1] == (7, 1, None, 2, 1, 1, 50_003, ct.EMPTY)
