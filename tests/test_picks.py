import json
import random

import pytest
from pyspark.sql import functions as F

from assayer.functions import scenes
from assayer.operators import quality, selecting
from assayer.schemas import VARIANTS
from assayer.sources import writers


def one_after_the_other(rows, n, used):
    """Rows (key, group, flag, image) picked sequentially, with one set of used images."""
    used, out = set(used), []

    def pick(pool, most):
        got = []
        for r in pool:
            if len(got) >= most:
                break
            if r[3] is not None and r[3] not in used:
                used.add(r[3])
                got.append(r)
        return got

    for g in sorted({r[1] for r in rows}):
        pool = sorted(r for r in rows if r[1] == g)
        yes, no = [r for r in pool if r[2]], [r for r in pool if not r[2]]
        n1 = min(n // 2, len(yes))
        n2 = min(n - n1, len(no))
        chosen = pick(yes, n1)
        chosen += pick(no, n2)
        chosen += pick(pool, n - len(chosen))
        out += chosen
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_picks_equal_picking_one_after_the_other(spark, seed):
    rng = random.Random(seed)
    n_images = rng.choice([6, 25, 60])
    rows = [(k, rng.randrange(rng.choice([1, 4])), rng.random() < 0.4, rng.choice([None, *range(n_images)])) for k in range(120)]
    used = rng.sample(range(n_images), 3)
    df = spark.createDataFrame(rows, "k int, g int, hard boolean, image int").repartition(3)
    for n in (1, 5, 12):
        got = selecting.balanced_unshared(df, "hard", "image", ["k"], n, ["g"], spark.createDataFrame([(u,) for u in used], "image int")).collect()
        assert sorted(tuple(r) for r in got) == one_after_the_other(rows, n, used)


def test_an_image_that_is_not_picked_stays_free(spark):
    rows = [(1, 0, True, "x"), (2, 0, True, "y"), (3, 0, False, "y")]
    got = selecting.balanced_unshared(spark.createDataFrame(rows, "k int, g int, simple boolean, image string"), "simple", "image", ["k"], 2, ["g"]).collect()
    assert sorted(r.k for r in got) == [1, 3]


def items(factors, n, **changes):
    rows = [(f, f"{f}{t}", f"{f}{t}:{v}", "PASS", f"{t}.png") for f in factors for t in range(n) for v in VARIANTS]
    rows[4] = (*rows[4][:2], changes.get("item", rows[4][2]), changes.get("status", "PASS"), changes.get("image", "i.png"))
    return rows[: len(rows) - changes.get("short", 0)]


def test_freezes_are_published_only_through_their_gates(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "factor string, triplet_id string, item_id string, qc_status string, image_path string"

    def publish(rows):
        return writers.publish_gated(*(lambda df, gates: (df, path, gates))(*quality.united_freezes(spark.createDataFrame(rows, schema), ("count", "color"), 3, "V1")))

    assert publish(items(("count", "color"), 3))["items of count"] == 9
    before = spark.read.parquet(path).count()
    assert before == 18
    for change, match in (({"item": "count0:base"}, "items twice: 2"), ({"status": "FAIL"}, "not passed: 1"), ({"status": None}, "not passed: 1"), ({"image": None}, "without an image: 1"), ({"short": 1}, "items of color: 8, not 9"), ({"short": 9}, "triplets of color: 0, not 3")):
        with pytest.raises(ValueError, match=match):
            publish(items(("count", "color"), 3, **change))
    with pytest.raises(ValueError, match="other factors: 9"):
        publish(items(("count", "color", "shape"), 3))
    assert spark.read.parquet(path).count() == before and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_canonical_json_equals_a_sorted_dump(spark):
    texts = ["plain", 'q"\\/', "é😀\x7f\x01\n\t\b\f\r", "", None]
    rows = [(i, t, {"zé": [t, None], "a": [], "Z": None}, ([{"k": t or "", "b": i}], {"n": {"y": i, "x": -1}}), i % 2 == 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i long, t string, m map<string, array<string>>, s struct<z: array<map<string, string>>, a: map<string, map<string, int>>>, b boolean")
    df = df.select("i", F.struct("t", "m", "s", "b", F.lit(None).cast("int").alias("none")).alias("v"))
    want = {i: json.dumps({"t": t, "m": m, "b": b, "none": None, "s": {"z": [{k: str(v) for k, v in x.items()} for x in s[0]], "a": s[1]}}, sort_keys=True, separators=(",", ":")) for i, t, m, s, b in rows}
    assert {r.i: r.j for r in df.select("i", scenes.canonical_json("v", df.schema["v"].dataType).alias("j")).collect()} == want
    plan = df.select(scenes.canonical_json("v", df.schema["v"].dataType))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    values = [1.0, 1e16, 1e-5, 0.1, 2e-3, 5e-324, -0.0, 123456789.125, 1.1e23, None]
    floats = spark.createDataFrame([(i, {"b": x, "a": [x]}) for i, x in enumerate([[v] for v in values])], "i int, v struct<b: array<double>, a: array<array<double>>>")
    got = {r.i: r.j for r in floats.select("i", scenes.canonical_json("v", floats.schema["v"].dataType).alias("j")).collect()}
    assert got == {i: json.dumps({"a": [[v]], "b": [v]}, separators=(",", ":")) for i, v in enumerate(values)}
