import io
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.functions import scenes
from assayer.operators import bestofn, graphs, ranking, selecting, verification
from assayer.operators import statistics as S
from assayer.sources import archives, readers, writers


def test_steps_scenes_and_attributes(spark):
    schema = f"steps array<{scenes.STEP}>, scene map<string, {scenes.OBJECT}>, listed array<{scenes.OBJECT}>, annotated array<string>"
    rows = [([(None, "Relate", None, None, "left,x"), ("filter color", None, None, " Red ", None)], {"1": ("cup", ["blue"]), "2": ("box", ["red", "big"])}, None, ["2", "7"]), (None, None, [("cat", None)], None)]
    df = spark.createDataFrame(rows, schema)
    objects = scenes.scene_objects("scene", "listed")
    got = df.select(scenes.program_ops("steps"), scenes.program_args("steps"), scenes.scene_names(objects), scenes.scene_attributes(objects), scenes.scene_attribute("scene", "annotated", F.lit("RED"))).collect()
    assert [list(r) for r in got] == [[["relate", "filtercolor"], "left,x,red", ["cup", "box"], ["blue", "red", "big"], "big"], [[], "", ["cat"], [], None]]


def plain_tournament(decided, strict):
    """Counts by triples, as the definition says."""
    beats, nodes = set(decided), sorted({x for e in decided for x in e})
    alone = lambda a, b: (a, b) in beats and not (strict and (b, a) in beats)
    cycles = violations = 0
    for i, a in enumerate(nodes):
        for j in range(i + 1, len(nodes)):
            for c in nodes[j + 1 :]:
                b = nodes[j]
                cycles += (alone(a, b) and alone(b, c) and alone(c, a)) or (alone(b, a) and alone(c, b) and alone(a, c))
                violations += ((a, b) in beats and (b, c) in beats and (a, c) not in beats) + ((b, a) in beats and (c, b) in beats and (c, a) not in beats)
    return cycles, violations


@pytest.mark.parametrize("strict", [False, True])
def test_tournaments_against_triples(spark, strict):
    rng = np.random.default_rng(4)
    pools = {f"p{k}": [(f"u{a}", f"u{b}") for a in range(9) for b in range(9) if a != b and rng.random() < 0.45] for k in range(12)}
    df = spark.createDataFrame([(p, w, x) for p, es in pools.items() for w, x in es], "pool_id string, winner string, loser string")
    got = {r.pool_id: (r.n_cycle_triples, r.n_transitivity_violations) for r in bestofn.tournament(df, strict=strict).collect()}
    assert got == {p: plain_tournament(es, strict) for p, es in pools.items()}


class Counting:
    """Fails on one pool until a file is there; notes every call."""

    def __init__(self, folder):
        self.folder = folder

    def load(self):
        pass

    def judge(self, question, candidate_a, candidate_b, image_path):
        with open(f"{self.folder}/calls", "a") as f:
            f.write(f"{question}\n")
        if question == "bad" and not os.path.exists(f"{self.folder}/repaired"):
            raise TimeoutError("too slow")
        return "A" if candidate_a < candidate_b else "B"

    def close(self):
        pass


def test_a_graph_is_asked_once_and_failures_are_rows(spark, tmp_path):
    rows = [(p, f"u{i}", f"t{i}", i == 3, 2 if i in (0, 3) else 4 if i in (1, 2) else 8, "bad" if p == "b" else "good", None) for p in "ab" for i in range(8)]
    cands = spark.createDataFrame(rows, "pool_id string, uid string, text string, is_gold boolean, level int, question string, image_path string")
    run = lambda: sorted((r.pool_id, r.n or 0, r.selected_uid, r.status) for r in graphs.run_pools(cands, lambda: Counting(str(tmp_path)), str(tmp_path / "journal")).collect())
    good = [("a", n, "u0", "ok") for n in (2, 4, 8)]
    assert run() == [*good, ("b", 0, None, "timeout")]
    calls = open(tmp_path / "calls").read().split()
    assert calls.count("good") == calls.count("bad") == 28
    (tmp_path / "repaired").write_text("")
    assert run() == [*good, *[("b", n, "u0", "ok") for n in (2, 4, 8)]]
    calls = open(tmp_path / "calls").read().split()
    assert calls.count("good") == 28 and calls.count("bad") == 56


def test_shards_and_margins(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    parts = [[r.k for r in ranking.shard(df, ["k"], 3, i).collect()] for i in range(3)]
    assert [sorted(p) for p in parts] == [list(range(i, 1000, 3)) for i in range(3)]
    rows = [("a", 3.0), ("a", 3.0), ("a", 1.0), ("b", 2.0), ("b", 1.5), ("c", 1.0), (None, 4.0), (None, 1.0)]
    got = {r.g: (r.top, r.second, r.margin) for r in ranking.top_margin(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    assert got == {"a": (3.0, 3.0, 0.0), "b": (2.0, 1.5, 0.5), "c": (1.0, None, None), None: (4.0, 1.0, 3.0)}


def test_carriers_and_picks(spark):
    df = spark.createDataFrame([("count", "tallyqa"), ("spatial", "gqa")], "factor string, carrier string")
    assert [r.carrier for r in selecting.with_carrier(df, given="carrier").collect()] == ["tallyqa", "gqa"]
    with pytest.raises(Exception, match="wrong carrier"):
        selecting.with_carrier(df.withColumn("carrier", F.lit("gqa")), given="carrier").collect()
    rows = [(i, i % 4 == 0, i % 30) for i in range(90)]
    out = selecting.balanced_unshared(spark.createDataFrame(rows, "k int, hard boolean, image int").withColumn("g", F.lit(1)), "hard", "image", ["k"], 10, ["g"], spark.createDataFrame([(0,)], "image int")).collect()
    assert len(out) == 10 == len({r.image for r in out}) and 0 not in {r.image for r in out} and sum(r.hard for r in out) == 5


def test_fits(spark):
    rng = np.random.default_rng(3)
    rows = [(f"m{m}", f"f{m // 2}", f, *map(float, rng.random(4))) for m in range(8) for f in ("x", "y")]
    table = spark.createDataFrame(rows, "model_id string, family string, factor string, A double, PFC double, PSC double, U double")
    for r in S.nested_gains(table, ["factor"]).collect():
        own = np.array([x[3:] for x in rows if x[2] == r.factor])
        error = []
        for k in (1, 3):
            x = np.column_stack([np.ones(8), own[:, :k]])
            error.append(((own[:, 3] - x @ np.linalg.lstsq(x, own[:, 3], rcond=None)[0]) ** 2).sum())
        total = ((own[:, 3] - own[:, 3].mean()) ** 2).sum()
        assert abs(r.delta_r2 - (error[0] - error[1]) / total) < 1e-9 and abs(r.delta_rmse - (np.sqrt(error[0] / 8) - np.sqrt(error[1] / 8))) < 1e-9
    for r in S.analyze_factors(table, 200).collect():
        assert r.status == "ESTIMABLE" and r.low <= r.delta_mae <= r.high
    for r in S.leave_one_model_out(table, "U", "A").collect():
        own = np.array([(x[3], x[6]) for x in rows if x[2] == r.factor and x[0] != r.left_out])
        assert abs(r.adjusted_r2 - (1 - (1 - np.corrcoef(own.T)[0, 1] ** 2) * 6 / 5)) < 1e-9
    assert {r.family for r in S.regrouped(table, {"m0": "d"}).collect()} == {"d", "f0", "f1", "f2", "f3"}


def test_entries_zip_and_escapes(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n"x\\"1": {"v": 1},\n"y": {"v": 2}\n}\n')
    (tmp_path / "b.json").write_text('{"y": {"v": 3}}\n')
    assert sorted(tuple(r) for r in readers.json_map(spark, str(tmp_path / "*.json"), "v int").collect()) == [('x"1', 1), ("y", 3)]
    (tmp_path / "b.json").write_text("[1, 2]\n")
    with pytest.raises(Exception, match="not the kind of JSON document"):
        readers.json_map(spark, str(tmp_path / "*.json"), "v int").collect()
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w") as z:
        z.writestr("in/1.jpg", b"one")
        z.writestr("2.jpg", b"")
    (tmp_path / "z.zip").write_bytes(sink.getvalue())
    got = archives.members(spark, str(tmp_path)).select("name", "length").collect()
    assert sorted(tuple(r) for r in got) == [("1.jpg", 3), ("2.jpg", 0)]
    text = 'é "😀" plain'
    writers.write_jsonl(spark.createDataFrame([(text,), ("plain",)], "t string"), str(tmp_path / "ascii"), ascii_only=True)
    raw = b"".join(p.read_bytes() for p in (tmp_path / "ascii").glob("part-*"))
    assert raw.isascii() and {r.t for r in readers.jsonl(spark, str(tmp_path / "ascii"), "t string", strict=True).collect()} == {text, "plain"}
    assert writers.text_once(spark, str(tmp_path / "r.bin"), b"\xff\x00") and not writers.text_once(spark, str(tmp_path / "r.bin"), b"\xff\x00")


def test_publish_keeps_the_old_table_when_writing_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.publish(spark.range(3), path, "parquet")
    with pytest.raises(Exception, match="broken"):
        writers.publish(spark.range(3).select(F.raise_error(F.lit("broken")).alias("x")), path, "parquet")
    assert spark.read.parquet(path).count() == 3
    writers.publish(spark.range(5), path, "parquet")
    assert spark.read.parquet(path).count() == 5 and not [p for p in os.listdir(tmp_path) if ".old-" in p]


class Scoring(Counting):
    """Scores by the text's number; fails on one pool until a file is there, and once gives no finite score."""

    def score_candidate(self, image_path, question, candidate):
        with open(f"{self.folder}/calls", "a") as f:
            f.write(f"{question}\n")
        if question == "bad" and candidate == "5" and not os.path.exists(f"{self.folder}/repaired"):
            return float("nan")
        return float(candidate)


def test_a_scalar_judge_is_asked_once_for_each_candidate(spark, tmp_path):
    rows = [(m, p, f"u{i}", str(i // 2), i == 3, 2 if i in (0, 3) else 4 if i in (1, 2) else 8, "bad" if p == "b" else "good", None) for m in ("m", "n") for p in "ab" for i in range(8)]
    rows = [(*r[:3], "5" if r[2] == "u7" and r[1] == "b" else r[3], *r[4:]) for r in rows]
    cands = spark.createDataFrame(rows, "model_id string, pool_id string, uid string, text string, is_gold boolean, level int, question string, image_path string")
    run = lambda: sorted((r.model_id, r.pool_id, r.n or 0, r.n_pairs, r.ties, r.status) for r in graphs.score_pools(cands, lambda: Scoring(str(tmp_path)), str(tmp_path / "scores"), ("model_id", "pool_id")).collect())
    ok = lambda p: [(m, p, n, n * (n - 1) // 2, t, "ok") for m in ("m", "n") for n, t in ((2, 0), (4, 2), (8, 4 if p == "a" else 3))]
    failed = [(m, "b", 0, None, None, "error") for m in ("m", "n")]
    assert run() == sorted(ok("a") + failed)
    calls = open(tmp_path / "calls").read().split()
    assert calls.count("good") == calls.count("bad") == 16
    (tmp_path / "repaired").write_text("")
    assert run() == sorted(ok("a") + ok("b"))
    calls = open(tmp_path / "calls").read().split()
    assert calls.count("good") == 16 and calls.count("bad") == 18


def test_documents_keep_their_braces_whatever_the_sizes_of_shuffles(spark, tmp_path):
    """One file for each nation, though its entries fill several partitions and its braces one."""
    import __spark_entry__ as entry

    spark.range(60000).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name", "CAST(id % 7 AS INT) AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    sizes = {"spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k", "spark.sql.shuffle.partitions": "24"}
    before = {k: spark.conf.get(k) for k in sizes}
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        got = entry.queries()["keyed_documents"](spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((int(r["id"]), r["c_name"], r["c_nationkey"]) for r in got) == [(i, f"Customer#{i}", i % 7) for i in range(60000)]


def test_parts_of_a_small_file_are_dealt_to_all_tasks(spark):
    from assayer.plans import rendered

    rows = rendered.triplets(spark, "/root/testdata/sf0.001")
    assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_provenance_deals_rows_out_once_by_their_number(spark, monkeypatch):
    schema = "item long, factor string, status string"
    rows = spark.createDataFrame([(1, "a", "F"), (2, "b", "F"), (2, "x", "?"), (3, None, "O"), (None, "a", None), (None, "a", "F"), (9, "a", "F")], schema)
    source = spark.createDataFrame([(1, "a", ""), (2, "b", ""), (2, "c", ""), (3, None, ""), (4, "d", ""), (4, "d", ""), (None, "a", "")], schema)
    monkeypatch.setattr(verification, "ROWS_PER_TASK", 2)
    monkeypatch.setattr(verification, "REPEATED", 2)
    found = verification.provenance_problems(rows, source, "item", ("factor",), ("F", "O"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(_key" in plan and ", 7), REPARTITION_BY_NUM" in plan
    want = [("unknown item", "9"), *[("unknown item", None)] * 2, *[("missing item", "4")] * 2, ("missing item", None), ("repeated item", "2"), ("repeated item", None)]
    want += [*[("other fields", "2")] * 3, ("unknown status", "2"), ("unknown status", None)]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    many = spark.createDataFrame([(5, "a", "F")] * 9, schema)
    assert verification.provenance_problems(many, source.limit(0), "item", ("factor",), ("F",)).groupBy("check").count().orderBy("check").collect() == [("repeated item", 1), ("unknown item", 9)]
