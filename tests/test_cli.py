import json
import os
import subprocess
import sys

import pytest

from assayer import cli
from assayer.operators import statistics as S

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def read(spark, path):
    return [json.loads(r.value) for r in spark.read.text(path).collect()]


def table_rows():
    return [{"model_id": f"m{i}", "family": f"f{i // 2}", "factor": "count", "dataset": "t", "A": 0.6 + i / 200, "PFC": 0.3 + (i * 7 % 5) / 10, "PSC": 0.7 - (i * 3 % 4) / 10, "U": 0.5 + (i * 5 % 7) / 20} for i in range(8)]


def test_triplet_verbs(spark, tmp_path):
    variants = ("base", "relevant", "irrelevant")
    rows = [{"model_id": "m", "triplet_id": t, "variant": v, "parsed_preference": p, "status": "ok", "factor": "count"} for t, ps in (("a", "ABA"), ("b", "BBA")) for v, p in zip(variants, ps, strict=True)]
    rows.insert(0, {**rows[0], "parsed_preference": "B"})  # a later row of the same item counts
    judged = lines(tmp_path / "j.jsonl", rows)
    gold = lines(tmp_path / "g.jsonl", [{"item_id": f"{t}:{v}", "triplet_id": t, "factor": "count", "variant": v, "expected_preference": p} for t in "ab" for v, p in zip(variants, "ABA", strict=True)])
    out = str(tmp_path / "metrics.jsonl")
    assert cli.main(["audit-metrics", "--judgments", judged, "--expected", gold, "--out", out], spark) == 0
    assert read(spark, out) == [{"model_id": "m", "factor": "count", "n": 2, "n_cond": 1, "base_acc": 0.5, "PFC": 0.5, "PSC": 0.5, "PFC_cond": 1.0, "PSC_cond": 1.0}]
    static = lines(tmp_path / "s.jsonl", [{"model_id": "m", "factor": "count", "status": "ok", "parsed_preference": p, "expected_preference": "A"} for p in ("A", "B", "A", None)])
    cli.main(["static-A", "--judgments", static, "--out", str(tmp_path / "a.csv")], spark)
    got = spark.read.option("header", "true").csv(str(tmp_path / "a.csv")).collect()
    assert [(r.model_id, float(r.A), int(r.n)) for r in got] == [("m", 2 / 3, 3)]


def test_selection_verb_and_parquet(spark, tmp_path):
    rows = lines(tmp_path / "s.jsonl", [{"status": "ok", "model_id": "m", "factor": "count", "n": n, "utility_success": n == 4, "semantic_abstentions": 1, "n_pairs": n * (n - 1) // 2} for n in (4, 8)])
    cli.main(["downstream-U", "--selections", rows, "--out", str(tmp_path / "u")], spark)
    assert {(r.N, r.U, round(r.semantic_abstention_rate, 6)) for r in spark.read.parquet(str(tmp_path / "u")).collect()} == {(4, 1.0, 0.166667), (8, 0.0, 0.035714)}


def test_table_verbs(spark, tmp_path):
    rows = table_rows()
    table = tmp_path / "t.json"
    table.write_text(json.dumps(rows, indent=1))
    run = lambda verb, *more: (cli.main([verb, "--table", str(table), "--out", str(tmp_path / f"{verb}.jsonl"), *more], spark), read(spark, str(tmp_path / f"{verb}.jsonl")))[1]
    pairs = run("matched-pairs", "--bands", "0.5", "1")
    gaps = [abs(a["A"] - b["A"]) * 100 for i, a in enumerate(rows) for b in rows[i + 1 :]]
    assert len(pairs) == sum(g <= t + 1e-12 for g in gaps for t in (0.5, 1.0)) > 0
    assert [r["factor"] for r in run("incremental")] == ["count"]
    (got,) = run("bootstrap", "--stat-key", "A", "--n-boot", "50")
    want = S.cluster_bootstrap(spark.createDataFrame([(r["family"], r["A"], "A") for r in rows], "family string, A double, statistic string"), ["statistic"], "family", "A", S.bootstrap_mean, 50).first()
    assert (got["observed"], got["low"], got["high"]) == (want.observed, want.low, want.high)
    table.write_text(json.dumps([{"audit_factor": a, "downstream_factor": d, "score": float(a == d)} for a in ("count", "spatial") for d in ("count", "spatial")]))
    (got,) = run("specificity", "--factors", "count", "spatial")
    assert (got["diagonal"], got["off_diagonal"], got["z_difference"]) == (1.0, 0.0, 2.0)


def test_refusals(spark, tmp_path):
    with pytest.raises(ValueError, match="official"):
        cli.main(["static-A", "--judgments", "x", "--out", "/data/official/a"], spark)
    with pytest.raises(FileNotFoundError):
        cli.main(["static-A", "--judgments", str(tmp_path / "none.jsonl"), "--out", str(tmp_path / "a")], spark)
    with pytest.raises(SystemExit):
        cli.main(["no-such-verb"], spark)


def test_the_module_runs():
    done = subprocess.run([sys.executable, "-m", "assayer", "--help"], cwd=ROOT, capture_output=True, text=True, timeout=60)
    assert done.returncode == 0 and all(v in done.stdout for v in cli.VERBS)
