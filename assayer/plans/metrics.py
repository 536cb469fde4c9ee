"""Queries over triplets, static items and matched models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matching as M
from ..operators import ranking as R
from ..operators import statistics as S
from ..operators import triplets as T
from ..schemas import STATES
from .catalog import query, rounded
from .pools import chosen
from .proxies import CANDS, J, all_judgments, families, gold, judgments, seq, static_rows, t_sql


def done(spark: SparkSession, d: str, parsed_first: bool = False) -> DataFrame:
    return T.complete(T.pivoted(judgments(spark, d), seq(), parsed_first), gold(spark, d))


def audit(spark: SparkSession, d: str) -> DataFrame:
    return T.audit_metrics(done(spark, d))


def static(spark: SparkSession, d: str) -> DataFrame:
    return T.static_accuracy(static_rows(spark, d))


def merged(spark: SparkSession, d: str) -> DataFrame:
    """One row for each model and factor: static A, and the audit's joint and conditional rates."""
    return audit(spark, d).drop("base_acc", "n_cond").withColumnRenamed("n", "n_audit").join(static(spark, d), ["model_id", "factor"])


MG = f"WITH {t_sql()}, mg AS (SELECT model_id, factor, am.n AS n_audit, PFC, PSC, PFC_cond, PSC_cond, A, sa.n AS n FROM am JOIN sa USING (model_id, factor))"
AUDIT_OUT = "model_id, factor, n, n_cond, round(base_acc, 6) AS base_acc, round(PFC, 6) AS PFC, round(PSC, 6) AS PSC, round(PFC_cond, 6) AS PFC_cond, round(PSC_cond, 6) AS PSC_cond"


@query(f"WITH {t_sql()} SELECT {AUDIT_OUT} FROM am")
def audit_metrics(spark, d):
    return rounded(audit(spark, d))


@query(f"WITH {t_sql(True)} SELECT {AUDIT_OUT} FROM am")
def audit_metrics_parsed_first(spark, d):
    return rounded(T.audit_metrics(done(spark, d, parsed_first=True)))


@query(f"WITH {t_sql()} SELECT model_id, factor, round(A, 6) AS A, n FROM sa")
def static_accuracy(spark, d):
    return rounded(static(spark, d))


@query(f"""WITH {J}, k AS (SELECT *, row_number() OVER (PARTITION BY triplet_id, variant ORDER BY {', '.join(f'{c} DESC' for c in ('l_shipdate', 'l_partkey', 'l_suppkey', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'l_returnflag', 'l_linestatus'))}) AS rn FROM j)
SELECT triplet_id, max(CASE WHEN variant = 'base' THEN parsed_preference END) AS base, max(CASE WHEN variant = 'relevant' THEN parsed_preference END) AS relevant,
  max(CASE WHEN variant = 'irrelevant' THEN parsed_preference END) AS irrelevant, min(factor) AS factor FROM k WHERE rn = 1 GROUP BY triplet_id""")
def gold_pivot(spark, d):
    rows = judgments(spark, d).withColumn("_v", F.struct("parsed_preference"))
    out = T.gold_pivot(rows, seq(), "_v")
    return out.select("triplet_id", *[F.col(f"{v}.parsed_preference").alias(v) for v in ("base", "relevant", "irrelevant")], "factor")


@query(f"{MG} SELECT model_id, round(sum(A * n) / sum(n), 6) AS micro_A, round(avg(A), 6) AS macro_A, round(avg(PFC), 6) AS macro_PFC, round(avg(PSC), 6) AS macro_PSC, count(*) AS factors FROM mg GROUP BY model_id")
def micro_and_macro_means(spark, d):
    rows = merged(spark, d)
    return rounded(rows.groupBy("model_id").agg(T.weighted_mean("A", "n").alias("micro_A"), F.avg("A").alias("macro_A"), F.avg("PFC").alias("macro_PFC"), F.avg("PSC").alias("macro_PSC"), F.count("*").alias("factors")))


STATE_SQL = ", ".join(f"count(*) FILTER (WHERE s = '{s}') AS n_{s}" for s in STATES)
EIGHT = f"WITH {t_sql()}, es AS (SELECT model_id, factor, count(*) AS n, {STATE_SQL} FROM (SELECT *, CAST(c_b AS VARCHAR) || CAST(c_r AS VARCHAR) || CAST(c_i AS VARCHAR) AS s FROM t) GROUP BY model_id, factor), e8 AS (SELECT *, n_100 + n_101 + n_110 + n_111 AS n_B1 FROM es)"


@query(f"""{EIGHT} SELECT *, round(n_B1 / n, 6) AS base_accuracy, round((n_110 + n_111) / nullif(n_B1, 0), 6) AS RA, round((n_101 + n_111) / nullif(n_B1, 0), 6) AS II,
  round((n_110 + n_111) / n, 6) AS PFC, round((n_101 + n_111) / n, 6) AS PSC, {', '.join(f'round(n_{s} / n, 6) AS pi_{s}' for s in STATES)} FROM e8""")
def eight_states(spark, d):
    return rounded(T.eight_states(done(spark, d)))


@query(f"{EIGHT} {' UNION ALL '.join(f'''SELECT model_id, factor, '{s}' AS state, n_{s} AS count, round(n_{s} / n, 6) AS share FROM e8''' for s in STATES)}")
def eight_states_long(spark, d):
    return rounded(T.eight_states_long(done(spark, d)))


@query(f"WITH {t_sql()} SELECT factor, count(*) AS n, {', '.join(f'''count(*) FILTER (WHERE c_b = {s[0]} AND c_r = {s[1]} AND c_i = {s[2]}) AS n_{s}''' for s in STATES)} FROM t GROUP BY factor")
def eight_states_pooled(spark, d):
    return T.eight_states(done(spark, d), ("factor",)).select("factor", "n", *[f"n_{s}" for s in STATES])


@query(f"WITH {t_sql()} SELECT model_id, factor, count(*) AS n, round(avg(CAST(y_r <> y_b AS INT)), 6) AS F_R, round(avg(CAST(y_i <> y_b AS INT)), 6) AS F_I FROM t GROUP BY model_id, factor")
def flip_rates(spark, d):
    return rounded(T.flip_rates(done(spark, d)))


@query(f"""WITH {t_sql()}, l AS (SELECT model_id, factor, 'relevant' AS arm, y_b, y_r AS y FROM t UNION ALL SELECT model_id, factor, 'irrelevant', y_b, y_i FROM t),
grid AS (SELECT * FROM (SELECT DISTINCT model_id, factor FROM t), (SELECT unnest(['relevant', 'irrelevant']) AS arm), (SELECT unnest(['A', 'B']) AS y_b), (SELECT unnest(['A', 'B']) AS y)),
c AS (SELECT model_id, factor, arm, y_b, y, count(*) AS n FROM l GROUP BY ALL), tot AS (SELECT model_id, factor, count(*) AS m FROM t GROUP BY ALL)
SELECT model_id, factor, arm, y_b AS Y_B, y AS Y_arm, coalesce(n, 0) AS n, round(coalesce(n, 0) / m, 6) AS proportion FROM grid LEFT JOIN c USING (model_id, factor, arm, y_b, y) JOIN tot USING (model_id, factor)""")
def transition_matrix(spark, d):
    return rounded(T.transition_matrix(done(spark, d)))


DEC = ", ".join(f"count(*) FILTER (WHERE c_b = {b} AND c = {a} AND f = {f}) AS base{b}_arm{a}_flip{f}" for b in (0, 1) for a in (0, 1) for f in (0, 1))
DECOMP = f"WITH {t_sql()}, l AS (SELECT model_id, factor, 'relevant' AS arm, c_b, c_r AS c, CAST(y_r <> y_b AS INT) AS f FROM t UNION ALL SELECT model_id, factor, 'irrelevant', c_b, c_i, CAST(y_i <> y_b AS INT) FROM t), dc AS (SELECT model_id, factor, arm, count(*) AS n, {DEC} FROM l GROUP BY model_id, factor, arm)"


@query(f"{DECOMP} SELECT * FROM dc")
def flip_decomposition(spark, d):
    return T.flip_decomposition(done(spark, d))


@query(f"""{DECOMP} SELECT model_id, factor, arm, round(({' + '.join(f'base{b}_arm{a}_flip1' for b in (0, 1) for a in (0, 1))}) / n, 6) AS p_dY,
  round(({' + '.join(f'base{b}_arm{1 - b}_flip{f}' for b in (0, 1) for f in (0, 1))}) / n, 6) AS p_dC FROM dc""")
def change_rates(spark, d):
    return rounded(T.change_rates(T.flip_decomposition(done(spark, d))))


@query(f"""WITH {t_sql()} SELECT model_id, factor, {', '.join(f'round(avg(CAST(c_b = {b} AND c_i = {i} AS INT)), 6) AS p_{b}{i}' for b in (0, 1) for i in (0, 1))},
  round(avg(CAST(g_r <> g_b AS INT)), 6) AS gold_change_relevant, round(avg(CAST(g_i <> g_b AS INT)), 6) AS gold_change_irrelevant FROM t GROUP BY model_id, factor""")
def irrelevant_transitions(spark, d):
    return rounded(T.irrelevant_transitions(done(spark, d)))


@query(f"""WITH {t_sql()} SELECT r.*, c.triplets, c.incomplete, c.without_gold FROM
  (SELECT model_id, count(*) AS rows, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status <> 'ok') AS not_ok, count(*) FILTER (WHERE status = 'ok' AND parsed_preference IS NULL) AS ok_unparsed FROM j GROUP BY model_id) r
  LEFT JOIN (SELECT model_id, count(*) AS triplets, count(*) FILTER (WHERE NOT (y_b IS NOT NULL AND y_r IS NOT NULL AND y_i IS NOT NULL)) AS incomplete, count(*) FILTER (WHERE g.triplet_id IS NULL) AS without_gold
    FROM p LEFT JOIN g ON p.triplet_id = g.triplet_id GROUP BY model_id) c USING (model_id)""")
def triplet_bookkeeping(spark, d):
    return T.bookkeeping(judgments(spark, d), gold(spark, d), seq())


@query(f"""WITH {J} SELECT model_id, count(*) AS n, round(avg(CAST(parsed_preference IS NOT NULL AS INT)), 6) AS parse_rate, round(avg(CAST(parsed_preference = 'A' AS INT)), 6) AS a_rate,
  avg(CAST(parsed_preference IS NOT NULL AS INT)) >= 0.5 AND avg(CAST(parsed_preference = 'A' AS INT)) BETWEEN 0.02 AND 0.98 AS passes FROM j GROUP BY model_id""")
def parse_gate(spark, d):
    return rounded(T.parse_gate(judgments(spark, d)))


# ---------------------------------------------------------------- matched models

DEPS = ("PFC", "PSC", "PFC_cond", "PSC_cond")
PAIRS = f"""{MG}, pp AS (SELECT a.factor, a.model_id AS model_a, b.model_id AS model_b, abs(a.A - b.A) * 100.0 AS gap_pp, {', '.join(f'a.{x} - b.{x} AS d_{x}' for x in DEPS)}
  FROM mg a JOIN mg b ON a.factor = b.factor AND a.model_id < b.model_id)"""
BANDS = (1.0, 2.0, 3.0)
CURVE = (0.0, 0.5, 1.0, 2.0, 3.0, 5.0)


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return M.model_pairs(merged(spark, d), deps=DEPS)


@query(f"{PAIRS} SELECT factor, model_a, model_b, round(gap_pp, 6) AS gap_pp, {', '.join(f'round(d_{x}, 6) AS d_{x}' for x in DEPS)} FROM pp")
def model_pairs(spark, d):
    return rounded(pairs(spark, d))


def band_sql(thresholds: tuple, deps: tuple, tolerance: float, by: str = "") -> str:
    stats = ", ".join(f"round(median(abs(d_{x}) * 100.0), 6) AS median_{x}, round(avg(abs(d_{x}) * 100.0), 6) AS mean_{x}, round(max(abs(d_{x}) * 100.0), 6) AS max_{x}" for x in deps)
    return f"SELECT {by}band_pp, count(*) AS pairs, {stats} FROM pp, (SELECT CAST(unnest({list(thresholds)}) AS DOUBLE) AS band_pp) WHERE gap_pp <= band_pp + {tolerance:.13f} GROUP BY {by}band_pp"


@query(f"{PAIRS} {band_sql(BANDS, ('PFC', 'PSC'), 0.0, 'factor, ')}")
def matched_bands_strict(spark, d):
    return rounded(M.band_summary(pairs(spark, d), BANDS, ("PFC", "PSC"), 0.0, ("factor",)))


@query(f"{PAIRS} {band_sql(CURVE, DEPS, 1e-12)}")
def equivalence_curve(spark, d):
    return rounded(M.band_summary(pairs(spark, d), CURVE, DEPS))


@query(f"{PAIRS} SELECT factor, model_a, model_b, round(gap_pp, 6) AS gap_pp, array_to_string(list_filter([0.5, 1.0, 2.0, 3.0, 5.0], lambda x: gap_pp <= x), ',') AS bands FROM pp")
def satisfied_bands(spark, d):
    out = M.satisfied(pairs(spark, d), (0.5, 1.0, 2.0, 3.0, 5.0))
    return rounded(out.select("factor", "model_a", "model_b", "gap_pp", F.array_join(F.transform("bands", lambda b: F.format_string("%.1f", b)), ",").alias("bands")))


@query(f"""{PAIRS}, ex AS (SELECT *, unnest([1.0, 2.0, 3.0]) AS band FROM pp) SELECT factor, model_a, model_b, CAST(band AS DOUBLE) AS band_pp, round(gap_pp, 6) AS gap_pp, round(d_PFC, 6) AS d_PFC, round(d_PSC, 6) AS d_PSC
  FROM ex WHERE gap_pp <= CAST(band AS DOUBLE) + 0.000000000001""")
def nested_bands(spark, d):
    return rounded(M.in_bands(pairs(spark, d), BANDS).select("factor", "model_a", "model_b", "band_pp", "gap_pp", "d_PFC", "d_PSC"))


@query(f"""{MG}, mac AS (SELECT model_id, avg(A) AS A, avg(PFC) AS PFC, avg(PSC) AS PSC FROM mg GROUP BY model_id),
q AS (SELECT a.model_id AS model_a, b.model_id AS model_b, abs(a.A - b.A) * 100.0 AS gap_pp, abs(a.PFC - b.PFC) + abs(a.PSC - b.PSC) AS spread FROM mac a JOIN mac b ON a.model_id < b.model_id)
SELECT model_a, model_b, round(gap_pp, 6) AS gap_pp, round(spread, 6) AS spread FROM q WHERE gap_pp <= 2.0 ORDER BY q.spread DESC, model_a, model_b LIMIT 5""")
def closest_models(spark, d):
    macro = merged(spark, d).groupBy("model_id").agg(F.avg("A").alias("A"), F.avg("PFC").alias("PFC"), F.avg("PSC").alias("PSC"))
    return rounded(M.closest(M.model_pairs(macro, by=None), 2.0, ("PFC", "PSC")))


@query(f"""{PAIRS} SELECT count(*) AS pairs, round(quantile_cont(abs(d_PFC_cond) * 100.0, 0.9), 6) AS p90, {', '.join(f'count(*) FILTER (WHERE abs(d_PFC_cond) * 100.0 > {x}) AS over_{x}' for x in (1, 2, 5))} FROM pp""")
def gap_tails(spark, d):
    return rounded(M.gap_tails(pairs(spark, d), "PFC_cond", (1.0, 2.0, 5.0)))


@query(f"{PAIRS} SELECT factor, model_a, model_b, round(abs(d_PFC_cond), 6) AS gap, row_number() OVER (ORDER BY round(abs(d_PFC_cond), 6) DESC, factor, model_a, model_b) AS place FROM pp")
def gaps_in_order(spark, d):
    from pyspark.sql import Window

    rows = pairs(spark, d).select("factor", "model_a", "model_b", F.round(F.abs("d_PFC_cond"), 6).alias("gap"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("gap"), "factor", "model_a", "model_b")).cast("long"))


@query(f"{MG} SELECT a.model_id, b.factor AS audit_factor, a.factor AS downstream_factor, round(a.A, 6) AS A, round(b.PFC, 6) AS PFC, round(b.PSC, 6) AS PSC FROM mg a JOIN mg b ON a.model_id = b.model_id")
def substituted_predictors(spark, d):
    out = M.substituted_predictors(merged(spark, d).select("model_id", "factor", "A", "PFC", "PSC"))
    return rounded(out.select("model_id", "audit_factor", "downstream_factor", "A", "PFC", "PSC"))


@query(f"""WITH {t_sql()}, {CANDS.strip()}, ut AS (SELECT model_id, factor, n, avg(CAST(success AS INT)) AS U, count(*) AS n_pools FROM sel GROUP BY ALL),
f4 AS (SELECT model_id, CASE factor WHEN 'LOW' THEN 'count' WHEN 'HIGH' THEN 'attribute' WHEN 'MEDIUM' THEN 'presence' WHEN 'URGENT' THEN 'spatial' END AS factor, PFC, PSC FROM am),
s4 AS (SELECT model_id, CASE factor WHEN 'LOW' THEN 'count' WHEN 'HIGH' THEN 'attribute' WHEN 'MEDIUM' THEN 'presence' WHEN 'URGENT' THEN 'spatial' END AS factor, A, n FROM sa)
SELECT model_id, factor, 'f' || CAST(CAST(substr(model_id, 2) AS INT) // 2 AS VARCHAR) AS family, round(A, 6) AS A, round(PFC, 6) AS PFC, round(PSC, 6) AS PSC, round(U, 6) AS U, s4.n AS n_static, n_pools AS n_downstream, CAST(8 AS BIGINT) AS primary_n
  FROM f4 JOIN s4 USING (model_id, factor) JOIN ut USING (model_id, factor) WHERE factor IS NOT NULL AND ut.n = 8""")
def primary_table(spark, d):
    return rounded(primary(spark, d).withColumn("primary_n", F.col("primary_n").cast("long")))


FACTOR_NAMES = {"LOW": "count", "HIGH": "attribute", "MEDIUM": "presence", "URGENT": "spatial"}


def primary(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.bestofn import scalar_graph, selections, with_levels
    from .proxies import pool_candidates

    keys = ("model_id", "pool_id", "factor")
    cands = with_levels(pool_candidates(spark, d), keys=("model_id", "pool_id"))
    chosen = selections(cands, scalar_graph(cands, keys=keys), keys).withColumn("status", F.lit("ok")).withColumn("utility_success", F.col("success"))
    named = lambda df: df.where(F.col("factor").isin(*FACTOR_NAMES)).replace(FACTOR_NAMES, subset=["factor"])
    return M.primary_table(named(audit(spark, d)), named(static(spark, d)), T.utility(chosen), families(spark), tuple(FACTOR_NAMES.values()))


@query(f"""{MG}, st AS (SELECT model_id, factor, PFC AS a, PFC_cond * (CAST(n_cond AS DOUBLE) / n) AS b FROM am)
SELECT model_id, factor, 'PFC' AS metric, round(a, 6) AS canonical, round(b, 6) AS recomputed, coalesce(abs(a - b) <= 0.000000000001, a IS NULL AND b IS NULL) AS agrees FROM st""")
def reconstruction(spark, d):
    rows = audit(spark, d)
    other = rows.select("model_id", "factor", (F.col("PFC_cond") * (F.col("n_cond") / F.col("n"))).alias("PFC"))
    out = M.reconstruction(rows.select("model_id", "factor", "PFC"), other, ["model_id", "factor"], ("PFC",))
    return rounded(out.drop("difference"))


@query(f"""WITH {t_sql()}, st AS (SELECT model_id, l_linenumber, triplet_id, max(CAST(coalesce(parsed_preference, '') = 'A' AS INT)) AS v FROM j_all WHERE l_linenumber > 3 GROUP BY ALL),
l AS (SELECT l_linenumber, CAST(triplet_id AS BIGINT) // 8 AS slot, max(v) AS v FROM st WHERE model_id = 'm0' GROUP BY ALL), r AS (SELECT l_linenumber, CAST(triplet_id AS BIGINT) // 8 AS slot, max(v) AS v FROM st WHERE model_id = 'm1' GROUP BY ALL)
SELECT l_linenumber, count(*) AS items, round(avg(l.v - r.v) * 100.0, 6) AS difference_pp FROM l JOIN r USING (l_linenumber, slot) GROUP BY l_linenumber""")
def paired_items(spark, d):
    rows = all_judgments(spark, d).where("l_linenumber > 3").withColumn("slot", F.concat_ws(":", "l_linenumber", F.floor(F.col("triplet_id").cast("long") / 8).cast("string")))
    one = lambda m: rows.where(F.col("model_id") == m).groupBy("slot").agg(F.max((F.coalesce("parsed_preference", F.lit("")) == "A").cast("int")).alias("v"))
    both = M.paired_items(one("m0"), one("m1"), "slot", "v")
    out = both.groupBy(F.split("slot", ":")[0].cast("int").alias("l_linenumber"))
    return rounded(out.agg(F.count("*").alias("items"), (F.avg(F.col("left_value") - F.col("right_value")) * 100.0).alias("difference_pp")))


@query(f"""WITH {t_sql()}, a AS (SELECT CAST(triplet_id AS BIGINT) // 400 AS triplet_id, factor, max(c_r) AS r, max(c_i) AS i FROM t WHERE model_id = 'm0' AND c_b = 1 GROUP BY ALL), b AS (SELECT CAST(triplet_id AS BIGINT) // 400 AS triplet_id, factor, max(c_r) AS r, max(c_i) AS i FROM t WHERE model_id = 'm1' AND c_b = 1 GROUP BY ALL)
SELECT factor, count(*) AS n, round(avg(a.r), 6) AS RA_a, round(avg(b.r), 6) AS RA_b, round(avg(a.i), 6) AS II_a, round(avg(b.i), 6) AS II_b FROM a JOIN b USING (triplet_id, factor) GROUP BY factor""")
def common_support(spark, d):
    near = done(spark, d).where("c_b = 1").groupBy("model_id", F.floor(F.col("triplet_id").cast("long") / 400).alias("triplet_id"), "factor").agg(F.max("c_r").alias("c_r"), F.max("c_i").alias("c_i"), F.lit(1).alias("c_b"))
    return rounded(M.common_support(near, "m0", "m1"))


# ---------------------------------------------------------------- statistics


@query(f"""{MG}, rk AS (SELECT *, rank() OVER (PARTITION BY factor ORDER BY A) + (count(*) OVER (PARTITION BY factor, A) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY factor ORDER BY PFC) + (count(*) OVER (PARTITION BY factor, PFC) - 1) / 2.0 AS rb FROM mg)
SELECT factor, round(corr(A, PFC), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM rk GROUP BY factor""")
def correlations(spark, d):
    ranked = merged(spark, d).withColumns({"_a": R.average_rank("A", ["factor"]), "_b": R.average_rank("PFC", ["factor"])})
    return rounded(ranked.groupBy("factor").agg(S.correlation("A", "PFC").alias("pearson"), S.correlation("_a", "_b").alias("spearman")))


@query(f"{MG} SELECT factor, count(*) AS n, round(regr_slope(PFC, A), 6) AS slope, round(regr_intercept(PFC, A), 6) AS intercept, round(regr_r2(PFC, A), 6) AS r2, round(corr(PFC, A), 6) AS pearson, round(1 - (1 - regr_r2(PFC, A)) * (count(*) - 1) / (count(*) - 2), 6) AS adjusted_r2 FROM mg GROUP BY factor")
def simple_regression(spark, d):
    out = S.simple_regression(merged(spark, d), ["factor"], "PFC", "A")
    return rounded(out.withColumn("adjusted_r2", S.adjusted_r2(F.col("r2"), F.col("n"), 1)))


@query(f"""{MG}, r AS (SELECT factor, corr(PFC, A) AS r1, corr(PFC, PSC) AS r2, corr(A, PSC) AS r12, var_pop(PFC) AS v FROM mg GROUP BY factor),
f AS (SELECT factor, v, r1 * r1 AS small, (r1 * r1 + r2 * r2 - 2 * r1 * r2 * r12) / (1 - r12 * r12) AS large FROM r)
SELECT factor, round(large - small, 6) AS delta_r2, round(sqrt(v * (1 - small)) - sqrt(v * (1 - large)), 6) AS delta_rmse FROM f""")
def nested_gains(spark, d):
    return rounded(S.nested_gains(merged(spark, d), ["factor"], "PFC", ("A",), ("A", "PSC")).select("factor", "delta_r2", "delta_rmse"))


@query(f"""{MG} SELECT CASE model_id WHEN 'm0' THEN 'decoder' WHEN 'm5' THEN 'decoder' ELSE 'f' || CAST(CAST(substr(model_id, 2) AS INT) // 2 AS VARCHAR) END AS family, factor, count(*) AS models, round(avg(A), 6) AS A FROM mg GROUP BY ALL""")
def regrouped_families(spark, d):
    own = S.regrouped(merged(spark, d).join(families(spark), "model_id"), {"m0": "decoder", "m5": "decoder"})
    return rounded(own.groupBy("family", "factor").agg(F.count("*").alias("models"), F.avg("A").alias("A")))


@query(f"{MG} SELECT model_id, factor, round((PFC - avg(PFC) OVER w) / CASE WHEN stddev_pop(PFC) OVER w > 0 THEN stddev_pop(PFC) OVER w ELSE 1 END, 6) AS z FROM mg WINDOW w AS (PARTITION BY factor)")
def column_z_scores(spark, d):
    return rounded(merged(spark, d).select("model_id", "factor", R.z_score("PFC", ["factor"]).alias("z")))


@query(f"{MG} SELECT model_id, factor, round(greatest(0.0, PFC - 1.96 * sqrt(PFC * (1 - PFC) / n_audit)), 6) AS low, round(least(1.0, PFC + 1.96 * sqrt(PFC * (1 - PFC) / n_audit)), 6) AS high FROM mg")
def wald_intervals(spark, d):
    return rounded(merged(spark, d).select("model_id", "factor", *[c.alias(k) for k, c in S.wald_ci(F.col("PFC"), F.col("n_audit")).items()]))


@query(f"{MG} SELECT model_id, factor, round(greatest(0.0, PFC_cond + PSC_cond - 1.0), 6) AS low, round(least(PFC_cond, PSC_cond), 6) AS high FROM mg")
def joint_bounds(spark, d):
    from ..functions.expressions import frechet_bounds

    return rounded(merged(spark, d).select("model_id", "factor", *[c.alias(k) for k, c in frechet_bounds(F.col("PFC_cond"), F.col("PSC_cond")).items()]))


@query(f"""{MG}, m AS (SELECT b.factor AS af, a.factor AS df, corr(a.A, b.PFC) AS score FROM mg a JOIN mg b ON a.model_id = b.model_id WHERE a.factor IN ('HIGH', 'LOW', 'MEDIUM', 'URGENT') AND b.factor IN ('HIGH', 'LOW', 'MEDIUM', 'URGENT') GROUP BY 1, 2),
z AS (SELECT *, (score - avg(score) OVER w) / CASE WHEN stddev_pop(score) OVER w > 0 THEN stddev_pop(score) OVER w ELSE 1 END AS z FROM m WINDOW w AS (PARTITION BY df))
SELECT round(avg(score) FILTER (WHERE af = df), 6) AS diagonal, round(avg(score) FILTER (WHERE af <> df), 6) AS off_diagonal, round(avg(z) FILTER (WHERE af = df), 6) AS z_diagonal, round(avg(z) FILTER (WHERE af <> df), 6) AS z_off_diagonal,
  round(avg(z) FILTER (WHERE af = df) - avg(z) FILTER (WHERE af <> df), 6) AS z_difference FROM z""")
def factor_specificity(spark, d):
    factors = tuple(FACTOR_NAMES)
    both = M.substituted_predictors(merged(spark, d).where(F.col("factor").isin(*factors)).select("model_id", "factor", "A", "PFC"), ("PFC",))
    return rounded(S.specificity(both.groupBy("audit_factor", "downstream_factor").agg(S.correlation("A", "PFC").alias("score")), factors))


@query()
def multiple_regression(spark, d):
    return rounded(S.ols(merged(spark, d), ["factor"], "PFC_cond", ["A", "PFC", "PSC"]))


@query()
def leave_one_family_out(spark, d):
    return rounded(S.leave_one_family_out(primary(spark, d)))


@query()
def incremental_validity(spark, d):
    return rounded(S.incremental_validity(S.leave_one_family_out(primary(spark, d))))


@query()
def contribution_matrix(spark, d):
    table = primary(spark, d).select("model_id", "factor", "family", "A", "PFC", "PSC", "U")
    return rounded(S.contribution_matrix(table, M.substituted_predictors(table)))


@query()
def cluster_bootstrap(spark, d):
    return rounded(S.cluster_bootstrap(merged(spark, d).join(families(spark), "model_id"), ["factor"], "family", "PFC", S.bootstrap_mean))


@query()
def paired_bootstrap(spark, d):
    """Every pool that both judges chose from is a shared item: a contrast for each factor and pool size."""
    rows = chosen(spark, d)
    one = lambda m: rows.where(F.col("model_id") == m).select("pool_id", "factor", "n", F.col("success").cast("int").alias(m))
    return rounded(S.paired_bootstrap(one("m0").join(one("m1"), ["pool_id", "factor", "n"]), ["factor", "n"], "m0", "m1"))



@query("SELECT CAST(l_linenumber AS VARCHAR) AS stage, count(*) AS items, 8 AS candidates, CAST(4.0 * l_linenumber AS DOUBLE) AS rate, round(count(*) * 8 / (4.0 * l_linenumber) / 3600.0, 6) AS gpu_hours, round(count(*) * 8 / (4.0 * l_linenumber) / 3600.0 * 5.59, 6) AS price, round(count(*) * 8 / (4.0 * l_linenumber) / 3600.0 / 1, 6) AS wall_hours_1, round(count(*) * 8 / (4.0 * l_linenumber) / 3600.0 / 2, 6) AS wall_hours_2, round(count(*) * 8 / (4.0 * l_linenumber) / 3600.0 / 4, 6) AS wall_hours_4 FROM lineitem GROUP BY l_linenumber")
def cost_projection(spark, d):
    stages = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_linenumber").agg(F.count("*").alias("items"))
    stages = stages.select(F.col("l_linenumber").cast("string").alias("stage"), "items", F.lit(8).alias("candidates"), (4.0 * F.col("l_linenumber")).alias("rate"))
    return rounded(S.cost_projection(stages, 5.59))


@query(f"WITH {J} SELECT round(min(l_extendedprice), 6) AS shortest, round(max(l_extendedprice), 6) AS longest, round(sum(l_extendedprice), 2) AS total FROM j")
def run_timing(spark, d):
    return judgments(spark, d).agg(F.min("l_extendedprice").alias("shortest"), F.max("l_extendedprice").alias("longest"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
