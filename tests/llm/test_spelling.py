import random
import re
import zlib
from collections import Counter

import pytest

from assayer.llm import spelling as sp


def made_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(sp.UPPER, sp.LOWER))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def apart_by_one(a, b):
    edits = {b[:i] + b[i + 1 :] for i in range(len(b))} if len(b) == len(a) + 1 else set()
    return a in edits or (len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1) or (len(a) == len(b) + 1 and apart_by_one(b, a))


def brute(words):
    form, close = {}, {}
    for w in words:
        close[w] = [v for v in words if apart_by_one(w, v)]
        best = min(close[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, words[w], len(close[w]), form[w], words.get(form[w]), root))
    return out


def variants_of(rng, stem, n):
    out = []
    for _ in range(n):
        w = list(stem)
        for _ in range(rng.choice([1, 1, 2])):
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice([[], [rng.choice("abé")], [w[i], rng.choice("abé")]])
        out.append("".join(w))
    return out


@pytest.mark.parametrize(("segment_words", "shard_rows"), [(sp.SEGMENT_WORDS, sp.SHARD_ROWS), (5, 100), (1, 1000)])
def test_against_brute_force(spark, segment_words, shard_rows):
    rng = random.Random(segment_words)
    words = set("international abababab aaaaaaa aaaaaaaa aaaaaaaaa ééééééé éééééée".split())
    for stem in ("international", "interesting", "ababababab", "aaaaaaaaaa", "übermütig", "anticonstitutionnellement"):
        words.update(w for w in variants_of(rng, stem, 60) if len(w) >= 7)
    n = {w: rng.choice([2, 3, 25, 260, 2700]) for w in words}
    df = spark.createDataFrame(sorted(n.items()), "word string, n long")
    assert {tuple(r) for r in sp.variants(df, segment_words, shard_rows).select("word", "n", "n_near", "form", "form_n", "root").collect()} == brute(n)


def test_words_of_documents(spark, awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    rows += [(i, "Wonderful WONDERFUL wonder-ful naïveté×÷ Ωmega") for i in range(200, 290)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = made_words(rows)
    assert {tuple(r) for r in sp.edited_words(df).collect()} == set(want.items()) and "wonderful" in want
    assert {tuple(r) for r in sp.variants(sp.edited_words(df)).select("word", "n", "n_near", "form", "form_n", "root").collect()} == brute(want)
    assert sp.variants(sp.edited_words(nothing)).isEmpty()


def test_near():
    assert sp.near("abc", "abd") and sp.near("abc", "abcd") and sp.near("bc", "abc") and sp.near("ab", "acb")
    assert not sp.near("abc", "abc") and not sp.near("abc", "acb") and not sp.near("abc", "abcde") and not sp.near("abcd", "acbd")
