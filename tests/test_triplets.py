import random

import pytest
from pyspark.sql import functions as F

from assayer.operators import matching as M
from assayer.operators import triplets as T

J = "model_id string, triplet_id string, variant string, parsed_preference string, status string, factor string, seq int"
GOLD = "triplet_id string, base string, relevant string, irrelevant string, factor string"


def frame(spark, rows):
    return spark.createDataFrame([("m", t, v, p, s, "count", i) for i, (t, v, p, s) in enumerate(rows)], J)


def metrics(spark, rows, parsed_first=False):
    gold = spark.createDataFrame([("t", "A", "B", "A", "count")], GOLD)
    done = T.complete(T.pivoted(frame(spark, rows), F.col("seq"), parsed_first), gold)
    return [r.asDict() for r in T.audit_metrics(done).collect()]


WHOLE = [("t", "base", "A", "ok"), ("t", "relevant", "B", "ok"), ("t", "irrelevant", "A", "ok")]


def test_perfect_triplet(spark):
    (r,) = metrics(spark, WHOLE)
    assert r["n"] == r["n_cond"] == 1 and r["PFC"] == r["PSC"] == r["PFC_cond"] == r["PSC_cond"] == 1.0


def test_last_row_wins_and_unparsed_rows(spark):
    late = [*WHOLE, ("t", "base", None, "ok")]
    assert metrics(spark, late) == []
    assert metrics(spark, late, parsed_first=True)[0]["PFC"] == 1.0
    assert metrics(spark, [*WHOLE, ("t", "base", "B", "ok")])[0]["base_acc"] == 0.0
    assert metrics(spark, [*WHOLE, ("t", "base", None, "oom")])[0]["PFC"] == 1.0


def test_no_condition_is_null_not_zero(spark):
    (r,) = metrics(spark, [("t", "base", "B", "ok"), *WHOLE[1:]])
    assert r["PFC"] == 0.0 and r["PFC_cond"] is None and r["n_cond"] == 0


@pytest.fixture(scope="module")
def states(spark):
    rng = random.Random(1)
    counts = {s: rng.randint(0, 20) for s in T.STATES}
    rows, n = [], 0
    for s, k in counts.items():
        for _ in range(k):
            for v, right, gold in zip(T.VARIANTS, s, "ABA", strict=True):
                rows.append((f"t{n}", v, gold if right == "1" else "AB"[gold == "A"], "ok"))
            n += 1
    gold = spark.createDataFrame([(f"t{i}", "A", "B", "A", "count") for i in range(n)], GOLD)
    return counts, T.complete(T.pivoted(frame(spark, rows), F.col("seq")), gold).cache()


def test_state_counts_imply_the_metrics(states):
    counts, done = states
    wide, m = T.eight_states(done).first(), T.audit_metrics(done).first()
    assert {s: wide[f"n_{s}"] for s in T.STATES} == counts
    for a, b in (("base_accuracy", "base_acc"), ("RA", "PFC_cond"), ("II", "PSC_cond"), ("PFC", "PFC"), ("PSC", "PSC")):
        assert abs(wide[a] - m[b]) < 1e-12
    assert abs(m["PFC"] - m["base_acc"] * m["PFC_cond"]) < 1e-12 and abs(m["PSC"] - m["base_acc"] * m["PSC_cond"]) < 1e-12


def test_flips_agree_with_decomposition(states):
    _, done = states
    flips = T.flip_rates(done).first()
    rates = {r.arm: r for r in T.change_rates(T.flip_decomposition(done)).collect()}
    assert abs(rates["relevant"].p_dY - flips.F_R) < 1e-12 and abs(rates["irrelevant"].p_dY - flips.F_I) < 1e-12
    cells = T.transition_matrix(done).collect()
    assert len(cells) == 8 and sum(c.n for c in cells if c.arm == "relevant") == flips.n


def test_static_accuracy_and_utility(spark):
    rows = [("m", "f", "ok", "A", "A", None), ("m", "f", "ok", "B", "", "B"), ("m", "f", "ok", "A", None, "B"), ("m", "f", "ok", None, "A", None), ("m", "f", "error", "A", "A", None), ("m", "f", "ok", "A", "C", None)]
    r = T.static_accuracy(spark.createDataFrame(rows, "model_id string, factor string, status string, parsed_preference string, expected_preference string, gold_preference string")).first()
    assert (r.n, round(r.A, 6)) == (3, 0.666667)
    sel = [("ok", "m", "count", 4, True, None, 1, 6), ("ok", "m", "count", 8, True, None, 0, 28), ("ok", "m", "count", 8, False, None, 2, 28), ("failed", "m", "count", 8, True, None, 0, 28), ("ok", "m", "count", 3, True, None, 0, 3)]
    got = {r.N: r for r in T.utility(spark.createDataFrame(sel, "status string, model_id string, factor string, n int, utility_success boolean, success boolean, semantic_abstentions int, n_pairs int")).collect()}
    assert got[4].U == 1.0 and got[8].U == 0.5 and got[4].semantic_abstention_rate == 1 / 6 and got[8].semantic_abstention_rate == 2 / 56


def test_band_edges(spark):
    rows = [("a", "f", 0.81, 0.5, 0.5), ("b", "f", 0.80, 0.4, 0.7)]
    pairs = M.model_pairs(spark.createDataFrame(rows, "model_id string, factor string, A double, PFC double, PSC double"))
    gap = pairs.first().gap_pp
    assert gap > 1.0 and abs(gap - 1.0) < 1e-12
    assert M.in_bands(pairs, (1.0, 2.0)).count() == 2 and M.in_bands(pairs, (1.0, 2.0), 0.0).count() == 1
    r = M.band_summary(pairs, (2.0,), ("PFC",)).first()
    assert r.pairs == 1 and abs(r.median_PFC - 10) < 1e-9 and pairs.first().d_PFC > 0


def test_strict_merge(spark):
    audit = spark.createDataFrame([("m", "count", 0.5, 0.5)], "model_id string, factor string, PFC double, PSC double")
    static = spark.createDataFrame([("m", "count", 0.7, 10)], "model_id string, factor string, A double, n long")
    util = spark.createDataFrame([("m", "count", 8, 0.6, 5), ("m", "count", 4, 0.9, 5)], "model_id string, factor string, N int, U double, n_pools long")
    fam = spark.createDataFrame([("m", "x")], "model_id string, family string")
    r = M.primary_table(audit, static, util, fam, ("count",)).first()
    assert (r.A, r.U, r.family) == (0.7, 0.6, "x")
    for bad in ((audit.union(audit), static, util, fam), (audit, static.limit(0), util, fam), (audit, static, util, fam.limit(0))):
        with pytest.raises(Exception, match="incomplete or repeated key"):
            M.primary_table(*bad, ("count",)).collect()
    with pytest.raises(Exception, match="incomplete or repeated key"):
        M.primary_table(audit, static, util, fam, ("other",)).collect()


def test_reconstruction_nulls(spark):
    a = spark.createDataFrame([("m", 1.0, None), ("n", None, None)], "k string, x double, y double")
    b = spark.createDataFrame([("m", 1.0 + 1e-13, 2.0), ("n", None, 0.0)], "k string, x double, y double")
    got = {(r.k, r.metric): r.agrees for r in M.reconstruction(a, b, ["k"], ("x", "y")).collect()}
    assert got == {("m", "x"): True, ("m", "y"): False, ("n", "x"): True, ("n", "y"): False}


def test_casefold_equals_pythons(spark):
    from assayer.functions.expressions import casefold, normal

    chars = [chr(i) for i in range(1, 0x1F000) if not 0xD800 <= i < 0xE000 and (chr(i).casefold() != chr(i) or i < 0x500)]
    got = {r.c: r.f for r in spark.createDataFrame([(c,) for c in chars], "c string").select("c", casefold("c").alias("f")).collect()}
    assert {c: f for c, f in got.items() if f != c.casefold()} == {}
    words = ["Straße", "STRASSE", " ΟΔΟΣ", "οδος ", "İstanbul", "ısı", "ﬁne"]
    assert [r[0] for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i").select(normal("w")).collect()] == [w.strip().casefold() for w in words]
