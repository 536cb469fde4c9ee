import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from assayer.llm import decontamination as dc

from .conftest import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans(dc.UPPER, dc.LOWER)


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(docs, items, window=10):
    """(doc_id, n_words, n_hit, item ids, mask of hit words) of every document, in order."""
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, names = [False] * len(w), set()
        for item, t in items:
            v = words(t)
            n = min(len(v), window)
            for j in range(len(v) - n + 1 if n else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == v[j : j + n]:
                        hit[i : i + n] = [True] * n
                        names.add("" if item is None else str(item))
        out.append((doc_id, len(w), sum(hit), sorted(names), hit))
    return out


def cleaned(text, hit):
    pieces = re.findall(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x7F]+", text)
    return "".join(p for i, p in enumerate(pieces) if i >= len(hit) or not hit[i])


def items_of(rng, rows):
    texts = [r.text for r in rows if r.text and len(words(r.text)) > 60]
    out = [(i, " ".join(t.split()[k : k + 25])) for i, (t, k) in enumerate(zip(texts, (0, 5, 30, 3, 40, 11), strict=False))]
    return [*out, (7, "one two"), (7, "One-TWO three"), (8, None), (9, " .. "), (None, "you IDIOT you"), (10, prose(rng, 30)), (11, out[0][1]), (12, "ab")]


@pytest.mark.parametrize("set_bytes", [dc.SET_BYTES, 0])
def test_against_brute_force(spark, awkward, nothing, set_bytes):
    rows = awkward.collect()
    items = items_of(random.Random(3), rows)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = brute([(r.doc_id, r.text) for r in rows], items)
    got = dc.contaminated(awkward, benchmark, set_bytes=set_bytes).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == sorted((x[:4] for x in want), key=str)
    assert sum(x[2] > 0 for x in want) > 5
    clean = dc.decontaminated(awkward, benchmark, set_bytes=set_bytes).collect()
    assert sorted(map(str, (tuple(r) for r in clean))) == sorted(str((r[0], cleaned(r.text, x[4]) if any(x[4]) else r.text, *r[2:])) for r, x in zip(rows, want, strict=True))
    left = dc.decontaminated(awkward, benchmark, remove="documents", set_bytes=set_bytes).collect()
    assert sorted(map(str, (tuple(r) for r in left))) == sorted(str(tuple(r)) for r, x in zip(rows, want, strict=True) if not x[2])
    assert dc.contaminated(nothing, benchmark).isEmpty() and dc.decontaminated(nothing, benchmark).isEmpty()
    none = dc.contaminated(awkward, benchmark.limit(0), set_bytes=set_bytes)
    assert none.count() == len(rows) and none.where("n_hit > 0 or size(items) > 0").isEmpty()


def test_only_native_plans(spark, awkward):
    benchmark = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    plan = dc.contaminated(awkward, benchmark)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "BroadcastHashJoin" in plan and "CartesianProduct" not in plan


def test_overlapping_occurrences_and_text_ids(spark):
    docs = spark.createDataFrame([("x", "a b a b a b c"), ("y", "A, b! A")], "doc_id string, text string").withColumn("items", F.lit("own"))
    benchmark = spark.createDataFrame([("i", "a b a")], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, [tuple(x) for x in r.runs], r["items"]) for r in dc.contaminated(docs, benchmark).collect()}
    assert got == {"x": (5, [(1, 6)], ["i"]), "y": (3, [(1, 4)], ["i"])}
    assert {tuple(r) for r in dc.decontaminated(docs, benchmark).collect()} == {("x", " b c", "own"), ("y", "", "own")}


def test_query(spark, tmp_path):
    rng = random.Random(8)
    passage = prose(rng, 30)
    docs = [(1, prose(rng, 40) + " " + passage), (2, prose(rng, 50)), (3, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, passage), (9, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in dc.op11_benchmark_decontamination(spark, str(tmp_path)).collect()}
    for doc_id, n, hit, names, _ in brute(docs, [(10, passage), (9, passage)]):
        assert got[doc_id] == (n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0)
