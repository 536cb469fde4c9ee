import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.functions import expressions as X
from assayer.operators import integrity as I
from assayer.operators import judging, merging, quality
from assayer.plans.tables import _Scripted
from assayer.sources import readers, writers
from assayer.streaming import journals


def values(spark, expression, inputs, kind="string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in inputs], f"x {kind}").select(expression(F.col("x"))).collect()]


def test_answer_parser(spark):
    answers = {"A": "A", " B ": "B", "Answer: b": "B", "my choice - A.": "A", "preference:B": "B", "B) because": "B", "A.": "A", "a": "A", "Apple": None, "b": "B", "I pick B": "B", "A or B": None, "": None, None: None, "éA": None, "a dog": "A", "A1": "A", "straße B": "B"}
    assert values(spark, X.parse_ab, answers) == list(answers.values())


def test_scalars(spark):
    assert values(spark, X.whole_number, ["3", " 12 ", "-1", "1.5", "true", None]) == [3, 12, None, None, None, None]
    assert values(spark, X.numeric_tail, ["a12b7", "x", "007"]) == ["7", None, "007"]
    assert values(spark, X.split_bucket, ["1", "2", "3", "4"]) == ["static" if int(__import__("hashlib").sha256(f"20260912:{i}".encode()).hexdigest()[:8], 16) % 2 == 0 else "downstream" for i in range(1, 5)]
    assert values(spark, X.count_pool, [0, 3, 9], "long") == [[0, 1, 2, 3, 4, 5, 6, 7], [3, 2, 4, 1, 5, 0, 6, 7], [9, 8, 10, 7, 11, 6, 12, 5]]
    assert values(spark, lambda c: X.preference(c), ["A", "B", "C", None]) == ["A", "B", None, None]
    assert values(spark, lambda c: X.first_filled(c, F.lit("z")), ["", None, "y"]) == ["z", "z", "y"]
    with pytest.raises(Exception, match="negative"):
        values(spark, X.pair_count, [-1], "int")
    pool = X.filled_pool(F.lit("Red"), F.array(F.lit("red"), F.lit(""), F.lit("blue")), F.array(*[F.lit(str(i)) for i in range(9)]))
    assert spark.range(1).select(pool).first()[0] == ["Red", "blue", "0", "1", "2", "3", "4", "5"]


def test_flags(spark):
    texts = F.array(*[F.lit(x) for x in ("a.", "A.", "b", "a very long candidate")], F.lit(None).cast("string"))
    flags = X.pool_flags(F.lit("a."), texts, F.lit(2), F.lit(8))
    assert spark.range(1).select(flags).first()[0] == ["duplicate_candidates", "gold_duplication", "invalid_gold_index", "invalid_candidate_count", "length_gap", "punctuation_asymmetry", "empty_candidate"]


def test_shard_merge(spark):
    rows = [(0, "i1", "m", "A", "ok"), (0, "i2", "m", "B", "ok"), (1, "i1", "m", "B", "ok")]
    df = spark.createDataFrame(rows, "shard int, item_id string, model_id string, parsed_preference string, status string")
    merged, report = merging.merge_shards(df, ["shard"])
    assert tuple(report.first()) == (3, 2, 1, 1)
    assert {(r.key, r.parsed_preference) for r in merged.collect()} == {("m::i1", "A"), ("m::i2", "B")}
    again, second = merging.merge_shards(merged, ["shard"])
    assert tuple(second.first()) == (2, 2, 0, 0) and again.count() == 2


def test_integrity(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, v string")
    assert {tuple(r) for r in I.row_difference(a, a.dropDuplicates()).collect()} == {(1, "x", "left")}
    assert I.coverage(a, a.where("k = 1"), "k").collect()[0].problem == "missing"
    with pytest.raises(ValueError, match="overlap"):
        I.broken(a, "overlap")
    I.broken(a.limit(0), "nothing")


def test_readers_and_writers(spark, tmp_path):
    p = str(tmp_path)
    (tmp_path / "rows.jsonl").write_text('{"id": "a", "x": 1}\nbroken\n{"id": "b", "x": 2}\n')
    schema = "id string, x long"
    assert readers.jsonl(spark, f"{p}/rows.jsonl", schema).count() == 2 and readers.jsonl(spark, f"{p}/none.jsonl", schema).count() == 0
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        readers.jsonl(spark, f"{p}/rows.jsonl", schema, strict=True).collect()
    assert writers.repair_jsonl(spark, f"{p}/rows.jsonl", schema) == 1 and readers.jsonl(spark, f"{p}/rows.jsonl", schema, strict=True).count() == 2
    (tmp_path / "list.json").write_text(json.dumps([{"id": "a", "x": 1}]))
    (tmp_path / "wrapped.json").write_text(json.dumps({"records": [{"id": "a", "x": 1}, {"id": "b", "x": 2}]}))
    assert readers.json_items(spark, f"{p}/list.json", "struct<id: string, x: long>").count() == 1
    assert readers.json_items(spark, f"{p}/wrapped.json", "struct<id: string, x: long>").count() == 2
    (tmp_path / "maps").mkdir()
    (tmp_path / "maps" / "1.json").write_text(json.dumps({"q1": {"x": 1}, "q2": {"x": 2}}))
    (tmp_path / "maps" / "2.json").write_text(json.dumps({"q1": {"x": 5}}))
    assert {tuple(r) for r in readers.json_map(spark, f"{p}/maps", "struct<x: long>").collect()} == {("q1", 5), ("q2", 2)}
    (tmp_path / "t.csv").write_text("k,v\na,1\na,2\nb,3\n")
    assert {tuple(r) for r in readers.csv_index(spark, f"{p}/t.csv", "k string, v long", ["k"]).collect()} == {("a", 2), ("b", 3)}
    df = spark.createDataFrame([(1, ["x", "y"])], "k int, f array<string>")
    assert writers.write_once(df, f"{p}/once") and not writers.write_once(df, f"{p}/once")
    with pytest.raises(ValueError, match="other contents"):
        writers.write_once(df.withColumn("k", F.lit(2)), f"{p}/once")
    assert writers.text_once(spark, f"{p}/note.txt", "n") and not writers.text_once(spark, f"{p}/note.txt", "n")
    with pytest.raises(ValueError):
        writers.text_once(spark, f"{p}/note.txt", "m")
    assert writers.flat(df, ["k", "f", "z"], " | ").first().asDict() == {"k": 1, "f": "x | y", "z": None}
    assert "| 1 |" in writers.report_rows(df.select("k")) and len(readers.found_files(spark, f"{p}/maps", ("2",))) == 1
    with pytest.raises(ValueError, match="official"):
        writers.guard("/data/outputs/x", ("outputs",))
    listing = readers.files(spark, f"{p}/maps", "*.json")
    required = spark.createDataFrame([("1.json",), ("9.json",)], "name string")
    assert {r.name: r.status for r in readers.required_files(required, listing).collect()} == {"1.json": "ok", "2.json": "unexpected", "9.json": "missing"}
    assert readers.checksums(spark, f"{p}/maps").count() == 2 and readers.by_basename(listing).count() == 2 and readers.latest_file(listing).count() == 1


def test_journal_streams(spark, tmp_path):
    p = str(tmp_path)
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.jsonl").write_text('{"id": "a", "x": 1}\n{"id": "b", "x": 2}\n{"id": "c"')
    rows, torn = journals.journal_rows(spark, f"{p}/j", "id string, x long")
    assert rows.count() == 2 and torn.count() == 1
    (tmp_path / "j" / "a.jsonl").write_text('{"id": "a"\n{"id": "b", "x": 2}\n')
    with pytest.raises(Exception, match="corrupt line"):
        journals.journal_rows(spark, f"{p}/j", "id string, x long")[0].collect()

    def batch(name, rows):
        spark.createDataFrame(rows, "id string, x long").write.parquet(f"{p}/in/{name}")

    def run():
        stream = spark.readStream.schema("id string, x long").option("recursiveFileLookup", "true").parquet(f"{p}/in")
        journals.append_journal(stream, f"{p}/out", f"{p}/check", "id").start().awaitTermination()

    batch("1", [("a", 1), ("b", 2)])
    run()
    batch("2", [("b", 2), ("c", 3)])
    run()
    assert sorted(tuple(r) for r in spark.read.parquet(f"{p}/out").collect()) == [("a", 1), ("b", 2), ("c", 3)]
    batch("3", [("a", 9)])
    with pytest.raises(Exception, match="conflicting"):
        run()


def test_rates(spark, tmp_path):
    samples = [(1, "downstream", 100, 22400, 0.0), (1, "downstream", 380, 22400, 40.0), (2, "downstream", 400, 22400, 50.0), (2, "static", 5, 800, 60.0), (2, "static", 3, 800, 70.0)]
    state, out = None, []
    for pid, stage, done, total, now in samples:
        state, r = journals.measured(state, pid, stage, done, total, now)
        out.append(r[1:])
    assert out[0] == (None, None) and out[1] == (7.0, 22020 / 7) and out[2:] == [(None, None)] * 3
    schema = "worker string, pid long, stage string, done long, total long, observed_unix double"
    rows = spark.createDataFrame([("w", *s) for s in samples], schema)
    assert [r.rate for r in journals.rates_batch(rows).orderBy("observed_unix").collect()] == [None, 7.0, None, None, None]
    rows.coalesce(1).write.parquet(f"{tmp_path}/status")
    query = journals.rates(spark.readStream.schema(schema).parquet(f"{tmp_path}/status")).writeStream.format("memory").queryName("rates").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    query.awaitTermination()
    assert [r.rate for r in spark.table("rates").collect()] == [None, 7.0, None, None, None]


def test_judges(spark):
    items = spark.createDataFrame([("1", "q", "a", "b", None), ("1", "q", "a", "b", None), ("2", "FORCE_OOM", "a", "b", None), ("3", "FORCE_ERROR", "a", "b", None), ("4", "FORCE_PARSE", "a", "b", None), ("5", "q", "a", "b", None)], "item_id string, question string, candidate_a string, candidate_b string, image_path string")
    done = spark.createDataFrame([("5",)], "item_id string")
    got = {r.item_id: (r.status, r.parsed_preference) for r in judging.run_items(items, _Scripted, done).collect()}
    assert got == {"1": ("ok", "A"), "2": ("oom", None), "3": ("error", None), "4": ("parse_error", None)}
    assert judging.failure(TimeoutError()) == "timeout" and judging.failure(ValueError("CUDA OOM")) == "oom"


def test_triplet_rules(spark):
    for factor in ("count", "attribute", "presence", "spatial"):
        good = quality.generated_specs(spark, factor, 4)
        assert {r.status for r in quality.checked_triplets(good).collect()} == {"PASS"}
        same = good.withColumn("relevant", F.col("base"))
        report = quality.checked_triplets(same).collect()
        assert all(r.status == "FAIL" and "FAIL: relevant preference did not flip" in r.flags for r in report)
    edge = quality.generated_specs(spark, "presence", 2).withColumn("base", F.col("base").withField("objects", quality.moved(quality.recolored(F.col("base.objects"), "matched", "grey"), "matched", 1.0, 0.0)))
    assert quality.checked_triplets(edge).where("status = 'PASS'").count() == 2
    cached = quality.checked_triplets(good.limit(2))
    assert quality.incremental(good, cached).count() == 4 and quality.frozen(quality.checked_triplets(good), 3).count() == 3
    assert quality.variant_rows(good).count() == 12


def test_greedy_repair(spark):
    schema = "item_id string, factor string, carrier string, image string"
    down = spark.createDataFrame([("d1", "f", "c", "i1"), ("d2", "f", "c", "i2"), ("d3", "f", "c", "i3")], schema)
    static = spark.createDataFrame([("s", "f", "c", "i1"), ("t", "f", "c", "i2")], schema)
    pool = spark.createDataFrame([(f"p{i}", "f", "c", f"j{i // 2}") for i in range(6)] + [("p9", "f", "c", "i3"), ("p8", "g", "c", "k")], schema)
    got = quality.greedy_repair(down, static, static.limit(0), pool).collect()
    assert [r.item_id for r in got] == ["d1", "d2"] and len({r.image for r in got}) == 2 and all(r.image.startswith("j") for r in got)
    import hashlib

    key = lambda i: hashlib.sha256(f"repair|p{i}|j{i // 2}".encode()).hexdigest()
    assert got[0].replacement_id == f"p{min(range(6), key=key)}"
    with pytest.raises(Exception, match="no replacement"):
        quality.greedy_repair(down, static, static.limit(0), pool.limit(0)).collect()


def test_pictures(spark):
    a, b = [0.0] * 12, [0.0] * 9 + [10.0, 0.0, 0.0]
    r = quality.image_differences(spark.createDataFrame([("x", a, b)], "id string, a array<double>, b array<double>")).first()
    assert np.isclose(r.mean_abs, 10 / 12) and r.changed == 0.25


def test_greedy_repair_in_rounds_is_the_serial_choice(spark):
    import hashlib
    import random

    rng = random.Random(2)
    schema = "item_id string, factor string, carrier string, image string"
    down = [(f"d{i:02}", rng.choice("fg"), "c", f"i{i}") for i in range(12)]
    pool = [(f"p{i}", rng.choice("fg"), "c", f"j{rng.randint(0, 30)}") for i in range(90)]
    used, want = set(), []
    for item, factor, carrier, _ in down:
        free = [(hashlib.sha256(f"repair|{p}|{x}".encode()).hexdigest(), p, x) for p, f, _, x in pool if f == factor and x not in used]
        _, p, x = min(free)
        used.add(x)
        want.append((item, p, factor, carrier, x))
    frame = lambda rows: spark.createDataFrame(rows, schema)
    out = quality.greedy_repair(frame(down), frame(down), frame(down).limit(0), frame(pool))
    assert "InPandas" not in out._jdf.queryExecution().toString()
    assert [tuple(r) for r in out.collect()] == want
