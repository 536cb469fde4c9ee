"""Queries over candidate pools and preference graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import bestofn as B
from ..operators import graphs, merging, ranking
from ..operators import triplets as T
from .catalog import long, query, rounded
from .proxies import CANDS, pool_candidates

KEYS = ("model_id", "pool_id")
WITH = f"WITH {CANDS.strip()}"


def levels(spark: SparkSession, d: str) -> DataFrame:
    return B.with_levels(pool_candidates(spark, d), keys=KEYS)


def graph(spark: SparkSession, d: str) -> DataFrame:
    return B.scalar_graph(levels(spark, d), keys=(*KEYS, "factor"))


def chosen(spark: SparkSession, d: str) -> DataFrame:
    return B.selections(levels(spark, d), graph(spark, d), (*KEYS, "factor"))


@query(f"{WITH} SELECT model_id, pool_id, n, uid FROM lv, (SELECT unnest([2, 4, 8]) AS n) WHERE n >= level")
def nested_subsets(spark, d):
    return B.subsets(levels(spark, d)).select("model_id", "pool_id", "n", "uid")


@query(f"{WITH} SELECT model_id, pool_id, left_uid, right_uid, left_score, right_score, outcome FROM eo")
def scalar_pair_graph(spark, d):
    return graph(spark, d).select("model_id", "pool_id", "left_uid", "right_uid", "left_score", "right_score", "outcome")


@query(f"{WITH} SELECT model_id, pool_id, n, count(*) AS edges FROM en GROUP BY ALL")
def induced_edges(spark, d):
    cands = levels(spark, d)
    edges = B.scalar_graph(cands, keys=KEYS)
    return B.induced_edges(edges, B.subsets(cands), KEYS).groupBy(*KEYS, "n").agg(F.count("*").alias("edges"))


@query(f"{WITH} SELECT model_id, pool_id, uid, CAST(points AS DOUBLE) AS points FROM pt WHERE n = 8")
def copeland_points(spark, d):
    return B.points(graph(spark, d), KEYS)


@query(f"{WITH} SELECT model_id, pool_id, factor, n, selected_uid, gold_uid, success, n_pairs, ties FROM sel")
def selections(spark, d):
    return chosen(spark, d).select(*KEYS, "factor", "n", "selected_uid", "gold_uid", "success", "n_pairs", "ties")


@query(f"{WITH} SELECT model_id, factor, n AS N, round(avg(CAST(success AS INT)), 6) AS U, count(*) AS n_pools, round(0.0, 6)::DOUBLE AS semantic_abstention_rate FROM sel GROUP BY ALL")
def utility(spark, d):
    rows = chosen(spark, d).withColumns({"status": F.lit("ok"), "utility_success": F.col("success")})
    return rounded(T.utility(rows))


@query(f"""{WITH}, w AS (SELECT model_id, pool_id, max(CASE WHEN n = 2 THEN selected_uid END) AS a, max(CASE WHEN n = 4 THEN selected_uid END) AS b, max(CASE WHEN n = 8 THEN selected_uid END) AS c FROM sel GROUP BY ALL)
SELECT model_id, count(*) AS pools, round(avg(CAST(a = c AS INT)), 6) AS n2_eq_n8, round(avg(CAST(b = c AS INT)), 6) AS n4_eq_n8, round(avg(CAST(a = b AS INT)), 6) AS n2_eq_n4 FROM w GROUP BY model_id""")
def selection_stability(spark, d):
    return rounded(T.selection_stability(chosen(spark, d)))


@query(f"{WITH}, s AS (SELECT model_id, pool_id, points, row_number() OVER (PARTITION BY model_id, pool_id ORDER BY points DESC) AS k FROM pt WHERE n = 8) SELECT a.model_id, a.pool_id, CAST(a.points AS DOUBLE) AS top, CAST(b.points AS DOUBLE) AS second, CAST(a.points - b.points AS DOUBLE) AS margin FROM s a JOIN s b ON a.model_id = b.model_id AND a.pool_id = b.pool_id AND a.k = 1 AND b.k = 2")
def copeland_margins(spark, d):
    return ranking.top_margin(B.points(graph(spark, d), KEYS), list(KEYS), "points")


#: Pairs that are asked in both orders, and in the second order answered the other way.
TURNED = "CAST(left_score + right_score AS BIGINT) % 3 = 0"


def beats(turned: bool, strict: bool) -> str:
    more = f" UNION ALL SELECT model_id, pool_id, CASE WHEN outcome = 'left' THEN right_uid ELSE left_uid END, CASE WHEN outcome = 'left' THEN left_uid ELSE right_uid END FROM eo WHERE outcome <> 'tie' AND {TURNED}" if turned else ""
    on = lambda x, y: f"({x}{y} AND NOT {y}{x})" if strict else f"{x}{y}"
    cycle = f"({on('a', 'b')} AND {on('b', 'c')} AND {on('c', 'a')}) OR ({on('b', 'a')} AND {on('c', 'b')} AND {on('a', 'c')})"
    return f"""{WITH}, be AS (SELECT model_id, pool_id, CASE WHEN outcome = 'left' THEN left_uid ELSE right_uid END AS w, CASE WHEN outcome = 'left' THEN right_uid ELSE left_uid END AS l FROM eo WHERE outcome <> 'tie'{more}),
nd AS (SELECT DISTINCT model_id, pool_id, w AS u FROM be UNION SELECT DISTINCT model_id, pool_id, l FROM be),
tr AS (SELECT a.model_id, a.pool_id, a.u AS a, b.u AS b, c.u AS c FROM nd a JOIN nd b ON a.model_id = b.model_id AND a.pool_id = b.pool_id AND a.u < b.u JOIN nd c ON a.model_id = c.model_id AND a.pool_id = c.pool_id AND b.u < c.u),
tb AS (SELECT tr.*, {', '.join(f"EXISTS (SELECT 1 FROM be WHERE be.model_id = tr.model_id AND be.pool_id = tr.pool_id AND be.w = tr.{x} AND be.l = tr.{y}) AS {x}{y}" for x in 'abc' for y in 'abc' if x != y)} FROM tr),
ts AS (SELECT model_id, pool_id, count(*) AS n_triples, count(*) FILTER (WHERE {cycle}) AS n_cycle_triples,
  count(*) FILTER (WHERE ab AND bc AND NOT ac) + count(*) FILTER (WHERE ba AND cb AND NOT ca) AS n_transitivity_violations FROM tb GROUP BY ALL),
nc AS (SELECT model_id, pool_id, count(*) AS n_nodes FROM nd GROUP BY ALL), ec AS (SELECT model_id, pool_id, count(*) AS n_edges FROM be GROUP BY ALL),
wc AS (SELECT nd.model_id, nd.pool_id, nd.u, count(DISTINCT be.l) AS wins FROM nd LEFT JOIN be ON be.model_id = nd.model_id AND be.pool_id = nd.pool_id AND be.w = nd.u GROUP BY ALL),
wr AS (SELECT *, row_number() OVER (PARTITION BY model_id, pool_id ORDER BY wins DESC) AS k FROM wc),
cw AS (SELECT model_id, pool_id, count(*) FILTER (WHERE wins = n_nodes - 1) AS n_condorcet, max(CASE WHEN k = 1 THEN wins END) - max(CASE WHEN k = 2 THEN wins END) AS copeland_margin FROM wr JOIN nc USING (model_id, pool_id) GROUP BY ALL)
SELECT model_id, pool_id, n_nodes, n_edges, coalesce(n_triples, 0) AS n_triples, coalesce(n_cycle_triples, 0) AS n_cycle_triples, coalesce(n_transitivity_violations, 0) AS n_transitivity_violations,
  n_condorcet = 1 AS has_condorcet, n_condorcet, copeland_margin FROM nc JOIN ec USING (model_id, pool_id) JOIN cw USING (model_id, pool_id) LEFT JOIN ts USING (model_id, pool_id)"""


def decided(spark: SparkSession, d: str, turned: bool = False) -> DataFrame:
    """Decided edges of all graphs; turned adds the second asking of some pairs, with the other winner."""
    # Winners need no subsets, and edges that are dealt by KEYS stay where they are for the tournament.
    pairs = B.pool_pairs(pool_candidates(spark, d), ("score",), keys=KEYS)
    answered = {"outcome": X.score_outcome(F.col("left_score"), F.col("right_score")), "status": F.lit("ok"), "parsed_preference": F.lit(None).cast("string")}
    edges = B.winners(pairs.withColumns(answered)).select(*KEYS, "left_uid", "right_uid", "left_score", "right_score", "winner", "loser")
    if not turned:
        return edges
    again = edges.where(TURNED.replace("BIGINT", "LONG")).withColumns({"left_uid": F.col("right_uid"), "right_uid": F.col("left_uid"), "winner": F.col("loser"), "loser": F.col("winner")})
    return edges.union(again)


def tournaments(spark: SparkSession, d: str, turned: bool, strict: bool) -> DataFrame:
    out = B.tournament(decided(spark, d, turned), KEYS, strict)
    counts = ("n_nodes", "n_triples", "n_cycle_triples", "n_transitivity_violations", "n_condorcet", "copeland_margin")
    return out.select("model_id", "pool_id", "n_edges", "has_condorcet", *long(*counts))


@query(beats(False, False))
def tournament_stats(spark, d):
    return tournaments(spark, d, turned=False, strict=False)


@query(beats(True, True))
def tournament_stats_strict(spark, d):
    """Some pairs have both orders with different winners, so a cycle may have an edge whose reverse exists."""
    return tournaments(spark, d, turned=True, strict=True)


@query(f"{WITH} SELECT model_id, count(*) AS both_orders, count(*) FILTER (WHERE NOT {TURNED}) AS consistent FROM eo WHERE outcome <> 'tie' GROUP BY model_id")
def reciprocal_consistency(spark, d):
    """Every decided pair asked again in the other order; some answers differ."""
    edges = decided(spark, d).select(*KEYS, "left_uid", "right_uid", "winner", "loser", F.expr(TURNED.replace("BIGINT", "LONG")).alias("turned"))
    again = edges.select(*KEYS, F.col("right_uid").alias("left_uid"), F.col("left_uid").alias("right_uid"), F.when(F.col("turned"), F.col("loser")).otherwise(F.col("winner")).alias("winner"), "loser", "turned")
    per = B.reciprocal_consistency(edges.union(again), KEYS)
    return per.groupBy("model_id").agg(F.sum("both_orders").alias("both_orders"), F.sum("consistent").alias("consistent"))


@query(f"{WITH} SELECT model_id, pool_id, count(*) AS edges, count(*) AS pairs FROM eo WHERE CAST(pool_id AS BIGINT) % 5 <> 0 OR outcome <> 'tie' GROUP BY model_id, pool_id HAVING count(*) <> 28")
def graph_problems(spark, d):
    edges = graph(spark, d).where((F.col("pool_id").cast("long") % 5 != 0) | (F.col("outcome") != "tie"))
    return B.graph_problems(edges, keys=KEYS).select(*KEYS, "edges", "pairs")


@query(f"{WITH} SELECT pool_id, count(*) FILTER (WHERE n IN (2, 4, 8)) AS sizes FROM (SELECT DISTINCT pool_id, n FROM sel WHERE n <> 8 OR CAST(pool_id AS BIGINT) % 3 = 0) GROUP BY pool_id HAVING count(*) = 3")
def completed_pools(spark, d):
    rows = chosen(spark, d).where((F.col("n") != 8) | (F.col("pool_id").cast("long") % 3 == 0)).withColumn("status", F.lit("ok"))
    return merging.completed_pools(rows).select("pool_id", F.lit(3).cast("long").alias("sizes"))


@query(f"{WITH} SELECT e.model_id, count(*) AS still_to_ask FROM eo e WHERE NOT EXISTS (SELECT 1 FROM eo f WHERE f.model_id = e.model_id AND f.pool_id = e.pool_id AND f.left_uid = e.left_uid AND f.right_uid = e.right_uid AND f.outcome <> 'tie') GROUP BY e.model_id")
def pairs_still_to_ask(spark, d):
    rows, edge = graph(spark, d), [*KEYS, *graphs.ENDS]
    left = merging.remaining(rows.select(*edge), rows.where("outcome <> 'tie'"), edge)
    return left.groupBy("model_id").agg(F.count("*").alias("still_to_ask"))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS n, CAST(p_size * (p_size - 1) // 2 AS BIGINT) AS pairs, CASE WHEN p_size % 3 = 0 THEN 'left' WHEN p_size % 3 = 1 THEN 'right' ELSE 'abstain' END AS outcome, CASE WHEN p_size - 25 >= 0 THEN 'A' ELSE 'B' END AS by_margin, CASE WHEN p_size > 25 THEN 'left' WHEN p_size < 25 THEN 'right' ELSE 'tie' END AS by_score FROM part")
def pair_functions(spark, d):
    size = F.col("p_size")
    pref = F.when(size % 3 == 0, "A").when(size % 3 == 1, "B")
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", size.cast("long").alias("n"), X.pair_count("p_size").alias("pairs"), X.pair_outcome(pref).alias("outcome"), X.margin_preference(size - 25).alias("by_margin"), X.score_outcome(size, F.lit(25)).alias("by_score"))


@query("""WITH e AS (SELECT user_id, CASE event_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS p, event_id FROM events)
SELECT user_id, count(*) AS n, count(*) FILTER (WHERE p = 'A') AS left_wins, count(*) FILTER (WHERE p = 'B') AS right_wins, count(*) FILTER (WHERE p IS NULL) AS abstained FROM e GROUP BY user_id""")
def judged_outcomes(spark, d):
    outcome = X.pair_outcome(F.when(F.col("event_id") % 3 == 0, "A").when(F.col("event_id") % 3 == 1, "B"))
    rows = spark.read.parquet(f"{d}/events.parquet").withColumn("outcome", outcome)
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("outcome") == o).alias(name) for o, name in (("left", "left_wins"), ("right", "right_wins"), ("abstain", "abstained"))])
