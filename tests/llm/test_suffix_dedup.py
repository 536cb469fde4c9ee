import hashlib
import random

import numpy as np
import pytest

from assayer.llm import suffix_dedup as sd


def brute(rows):
    """(n_bytes, n_removed, n_spans, kept_sha256) of every row, in order."""
    first = {}
    for doc_id, text in rows:
        if doc_id is not None:
            t = (text or "").encode()
            for i in range(len(t) - 49):
                w = t[i : i + 50]
                first[w] = min(first.get(w, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        t = (text or "").encode()
        step = np.zeros(len(t) + 1, int)
        for i in range(len(t) - 49):
            if doc_id is not None and first[t[i : i + 50]] < doc_id:
                step[i] += 1
                step[i + 50] -= 1
        gone = np.cumsum(step[:-1]) > 0
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = int(gone[:1].sum()) + int((np.diff(gone.astype(int)) == 1).sum())
        out.append((doc_id, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r)[:5] for r in sd.without_repeats(df).collect()), key=str)


def test_against_brute_force(spark, awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert got(awkward) == brute(rows)
    assert got(nothing) == []


@pytest.mark.parametrize("seed", range(3))
def test_random_low_entropy(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(40):
        text = "".join(rng.choices("ab", k=rng.randint(0, 90)))
        if rows and rng.random() < 0.7:
            other = rng.choice(rows)[1]
            cut = rng.randint(0, len(other))
            text = text[: len(text) // 2] + other[cut : cut + rng.randint(40, 120)] + text[len(text) // 2 :]
        rows.append((rng.randint(0, 60), text))
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_intervals_and_left_diversity():
    words = [b"x" + bytes(range(97, 97 + 20)) * 3, b"y" + bytes(range(97, 97 + 20)) * 3, b"z" + bytes(range(97, 97 + 20)) * 3]
    data = b"".join(words)
    ctx = sd.contexts(data, np.array([0, 61, 122]), np.array([12, 12, 12]))
    number, context, start, covered = sd.maximal_repeats(ctx)
    lengths = {tuple(sorted(zip(context[number == n].tolist(), start[number == n].tolist(), strict=True))): int(covered[number == n][0]) + 49 for n in set(number.tolist())}
    assert lengths == {((0, 1), (1, 1), (2, 1)): 60}
    assert sd.intervals(np.array([0, 55, 55, 60, 10, 52])) == [(60, 2, 3), (55, 0, 3), (52, 4, 5)]


def test_repeat_groups_hold_all_occurrences(spark):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    passage = "".join(rng.choices(letters, k=80))
    rows = [(i, "".join(rng.choices(letters, k=30)) + passage + "".join(rng.choices(letters, k=30))) for i in range(5)]
    found = sd.repeat_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    groups = {}
    for r in found:
        groups.setdefault((r.bucket, r["repeat"], r.length), []).append(dict(rows)[r.doc_id][r.start : r.start + r.length])
    assert all(len(set(texts)) == 1 and len(texts) > 1 for texts in groups.values())
    assert {r.doc_id for r in found} == set(range(5))


def test_segments(monkeypatch):
    rng = random.Random(6)
    data = "".join(rng.choices("abcd", k=3000)).encode()
    ends = np.array([1000, 1000, 1030, 2990, 3000])
    whole = sd.anchors(data, ends)
    monkeypatch.setattr(sd, "SEGMENT", 300)
    parts = sd.anchors(data, ends)
    assert whole[1].sum() == parts[1].sum() == sum(max(0, b - a - 49) for a, b in zip([0, *ends[:-1]], ends, strict=True))
    covered = {f + i for f, c in zip(parts[0], parts[1], strict=True) for i in range(c)}
    assert covered == {f + i for f, c in zip(whole[0], whole[1], strict=True) for i in range(c)}
