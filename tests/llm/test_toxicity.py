import random
import time
import zlib

import numpy as np
from pyspark.sql import functions as F

from assayer.llm import toxicity as tox
from tests.llm.conftest import prose

SMALL = tox.Settings(sample=400, epochs=6, dim=4)


def labelled(spark):
    rng = random.Random(2)
    rows = []
    for i in range(500):
        toxic = i % 4 == 0
        words = prose(rng, 40).split()
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron", "scum"]))
        rows.append((i, " ".join(words), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_held_out_accuracy_and_misspellings(spark):
    data = labelled(spark)
    model = tox.fit(data.select("doc_id", "text"), data.select("doc_id", "toxic").where(~tox.held_out()), SMALL)
    got = tox.score(data, model).where(tox.held_out()).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    assert sum((r.score >= 0.5) == bool(r.toxic) for r in got) / len(got) > 0.95
    rng = random.Random(3)
    clean = prose(rng, 30)
    a, b = model.score([clean, clean + " idiott idi0t morron scumm"])
    assert b > 0.5 > a


def test_awkward_rows(spark, awkward, nothing):
    data = labelled(spark)
    model = tox.fit(data.select("doc_id", "text"), data.select("doc_id", "toxic"), SMALL)
    got = tox.score(awkward, model).collect()
    assert len(got) == awkward.count() and set(got[0].asDict()) == set(awkward.columns)
    assert all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if not (r.text or "").strip()}) == 1
    assert len({r.score for r in got if r.doc_id in (11, 12) and r.text == got[0].text}) <= 1
    assert tox.score(nothing, model).count() == 0
    empty = tox.fit(nothing, nothing.select("doc_id", F.lit(1).alias("toxic")), SMALL)
    assert empty.score(["x", ""]).tolist() == [0.5, 0.5]


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tox, "CACHE_WORDS", 5)
    model = tox.train([("a b c", 0), ("d e f", 1)] * 20, SMALL)
    free = tox.Model(model.table, model.bias, SMALL)
    texts = ["a b c d", "e f g h i j k l", "a d", "x" * 100 + " a"]
    bounded = model.score(texts)
    monkeypatch.setattr(tox, "CACHE_WORDS", 10**6)
    assert abs(bounded - free.score(texts)).max() < 1e-12 and len(model.words) <= 8


def test_values_of_words(monkeypatch):
    """A word's value is the mean of its rows of the table, wherever its bytes are cut for hashing."""
    model = tox.Model(np.random.default_rng(1).normal(0, 1, 1 << 16).astype(np.float32), 0.0)
    words = ["a", "ab", "abc", "é", "日本語", "ΣΑΣ", "0", "idiot", "x" * 300, "日" * 50, "😀b"]
    want = {w: float(model.table[tox.subwords(w, model.settings)].astype(float).mean()) for w in words}
    for size in (1, 2, 7, 1 << 16):
        monkeypatch.setattr(tox, "HASHED_BYTES", size)
        got = model.learn(words)
        assert got.keys() == want.keys() and all(abs(got[w] - want[w]) < 1e-9 for w in words)
        assert got == {w: model.learn([w])[w] for w in words} == model.learn(words[::-1])


def test_grouped_texts_score_as_alone(monkeypatch):
    model = tox.Model(np.random.default_rng(1).normal(0, 0.1, 1 << 16).astype(np.float32), 0.0)
    rng = random.Random(5)
    texts = ["", "...", *(prose(rng, rng.randrange(60)) for _ in range(50)), "", "é" * 90 + " a"]
    alone = [tox.Model(model.table, 0.0).score([t])[0] for t in texts]
    for size in (1, 500, 1 << 17):
        monkeypatch.setattr(tox, "SCORED_CHARS", size)
        assert abs(model.score(texts) - alone).max() < 1e-12
    assert len(model.score([])) == 0


def test_new_words_are_hashed_by_columns():
    """Texts whose words are all new are scored in less time than their n-grams take one by one in Python."""
    model = tox.Model(np.zeros(1 << 16, np.float32), 0.0)
    words = [f"word{i}number{i * 7919}" for i in range(50_000)]
    texts = [" ".join(words[i : i + 100]) for i in range(0, len(words), 100)]

    def seconds(f):
        start = time.process_time()
        f()
        return time.process_time() - start

    plain = min(seconds(lambda: [tox.subwords(w, model.settings) for w in words]) for _ in range(2))
    assert min(seconds(lambda: tox.Model(model.table, 0.0).score(texts)) for _ in range(2)) < 0.8 * plain
