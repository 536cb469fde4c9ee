import random

import numpy as np

from assayer.operators import statistics as S

TABLE = "model_id string, family string, factor string, A double, PFC double, PSC double, U double"


def table(spark, families=8, per=1, seed=1, factor="count"):
    rng = random.Random(seed)
    rows = [(f"m{f}{k}", f"f{f}", factor, rng.random(), rng.random(), rng.random(), rng.random()) for f in range(families) for k in range(per)]
    return spark.createDataFrame(rows, TABLE)


def test_solve_and_fit(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(4, 4)), rng.normal(size=4)
    assert np.allclose(S.solve(a, b), np.linalg.solve(a, b)) and S.solve(np.ones((2, 2)), np.ones(2)) is None
    df = table(spark, 10)
    r = S.ols(df, ["factor"], "U", ["A", "PFC", "PSC"]).first()
    pdf = df.toPandas()
    x = np.column_stack([np.ones(10), pdf[["A", "PFC", "PSC"]]])
    beta, *_ = np.linalg.lstsq(x, pdf["U"], rcond=None)
    assert np.allclose(r.beta, beta) and abs(r.rmse - np.sqrt(((x @ beta - pdf["U"]) ** 2).mean())) < 1e-9
    one = S.simple_regression(df, ["factor"], "U", "A").first()
    assert abs(one.pearson**2 - one.r2) < 1e-9


def test_folds(spark):
    df = table(spark, 8)
    pdf = df.toPandas()
    for r in S.leave_one_family_out(df).collect():
        train, test = pdf[pdf.family != r.held_out], pdf[pdf.family == r.held_out]
        beta, *_ = np.linalg.lstsq(np.column_stack([np.ones(len(train)), train["A"]]), train["U"], rcond=None)
        assert abs(r.m0_mae - np.abs(beta[0] + beta[1] * test["A"] - test["U"]).mean()) < 1e-9 and r.reason is None
    assert S.incremental_validity(S.leave_one_family_out(df)).first().status == "ESTIMABLE"


def test_four_families_are_never_identifiable(spark):
    folds = S.leave_one_family_out(table(spark, 4)).collect()
    assert all(r.m0_mae is not None and r.m1_mae is None and r.reason == "too few training rows" for r in folds)
    r = S.incremental_validity(S.leave_one_family_out(table(spark, 4))).first()
    assert r.status == "NOT_IDENTIFIABLE" and r.delta_mae is None
    loose = S.leave_one_family_out(table(spark, 4), strict=False).collect()
    assert all(r.m0_mae is None and r.reason == "singular" for r in loose)


def test_one_null_voids_the_factor(spark):
    df = table(spark, 8).union(spark.createDataFrame([("x", "f9", "count", None, 0.1, 0.1, 0.1)], TABLE))
    folds = S.leave_one_family_out(df).collect()
    assert len(folds) == 9 and all(r.m0_mae is None for r in folds)


def test_bootstrap_is_the_generators(spark):
    df = table(spark, 5, per=2)
    r = S.cluster_bootstrap(df, ["factor"], "family", "U", S.bootstrap_mean, 200, 7).first()
    groups = {}
    for x in sorted(df.collect(), key=lambda x: x.family):
        groups.setdefault(x.family, []).append(x.U)
    rng, names = random.Random(7), sorted(groups)
    draws = sorted(S.bootstrap_mean([v for n in rng.choices(names, k=5) for v in groups[n]]) for _ in range(200))
    assert abs(r.low - draws[5]) < 1e-12 and abs(r.high - draws[195]) < 1e-12 and r.n_clusters == 5
    p = S.paired_bootstrap(df, ["factor"], "A", "PFC", 100).first()
    assert p.low <= p.difference_pp <= p.high and p.n_items == 10


def test_specificity(spark):
    factors = ("count", "attribute", "presence", "spatial")
    rng = random.Random(5)
    cells = {(a, d): rng.random() + (a == d) for a in factors for d in factors}
    df = spark.createDataFrame([(a, d, s) for (a, d), s in cells.items()], "audit_factor string, downstream_factor string, score double")
    z = {}
    for d in factors:
        col = np.array([cells[a, d] for a in factors])
        z |= {(a, d): (cells[a, d] - col.mean()) / col.std() for a in factors}
    r = S.specificity(df, factors).first()
    diag, off = np.mean([z[f, f] for f in factors]), np.mean([v for (a, d), v in z.items() if a != d])
    assert abs(r.z_diagonal - diag) < 1e-9 and abs(r.z_difference - (diag - off)) < 1e-9
    flat = df.withColumn("score", df.score * 0 + 1)
    assert S.specificity(flat, factors).first().z_difference == 0
    assert S.specificity(df.union(spark.createDataFrame([("count", "count", None)], df.schema)), factors).first().diagonal is None


def test_paired_bootstrap_draws_from_counts(spark):
    rng = random.Random(9)
    items = [(f, rng.randint(0, 1), int(rng.random() < 0.7)) for f in "ab" for _ in range(400)]
    out = S.paired_bootstrap(spark.createDataFrame(items, "factor string, x int, y int"), ["factor"], "x", "y", 2000)
    assert "InPandas" not in out._jdf.queryExecution().optimizedPlan().toString().replace("MapInPandas", "")
    got = {r.factor: r for r in out.collect()}
    for f in "ab":
        d = np.array([(x - y) * 100 for g, x, y in items if g == f])
        source = np.random.default_rng(1)
        means = np.sort([d[source.integers(0, 400, 400)].mean() for _ in range(2000)])
        assert got[f].n_items == 400 and np.isclose(got[f].difference_pp, d.mean())
        assert abs(got[f].low - means[50]) < 1.2 and abs(got[f].high - means[1950]) < 1.2


def test_paired_bootstrap_over_blocks(spark):
    rng = np.random.default_rng(6)
    rows = [(f, float(x), float(y)) for f in ("a", "b") for x, y in rng.normal(0, 1, (300, 2))]
    df = spark.createDataFrame([*rows, ("a", 1.0, 1.0)], "factor string, x double, y double")
    whole = {r.factor: r for r in S.paired_bootstrap(df, ["factor"], "x", "y", 1200).collect()}
    dealt = {r.factor: r for r in S.paired_bootstrap(df, ["factor"], "x", "y", 1200, block_values=70).collect()}
    for f, r in dealt.items():
        own = np.array([(x - y) * 100 for g, x, y in [*rows, ("a", 1.0, 1.0)] if g == f])
        assert r.n_items == len(own) and abs(r.difference_pp - own.mean()) < 1e-9
        spread = own.std() / np.sqrt(len(own))
        for low, high in ((r.low, r.high), (whole[f].low, whole[f].high)):
            assert abs((own.mean() - low) / spread - 1.96) < 0.25 and abs((high - own.mean()) / spread - 1.96) < 0.25
