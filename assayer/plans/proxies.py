"""The evaluation's tables, derived from the sample tables so that every query has whole-table input; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEQ = ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
FAMILIES = {f"m{i}": f"f{i // 2}" for i in range(8)}
FACTOR_OF_POOL = ("count", "attribute", "presence", "spatial")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seq() -> Column:
    return F.struct(*SEQ)


def all_judgments(spark: SparkSession, d: str) -> DataFrame:
    """A judgment for each line item: its order is the triplet, its line number the variant, its flag the answer."""
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    orders = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("m"), (F.col("o_custkey") % 8).cast("string")).alias("model_id"), F.substring("o_orderpriority", 3, 20).alias("factor"))
    return lines.join(orders, "l_orderkey").select(
        "model_id",
        F.col("l_orderkey").cast("string").alias("triplet_id"),
        "l_linenumber",
        F.when(F.col("l_linenumber") == 1, "base").when(F.col("l_linenumber") == 2, "relevant").when(F.col("l_linenumber") == 3, "irrelevant").alias("variant"),
        "factor",
        F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "N", "B").alias("parsed_preference"),
        F.when(F.col("l_discount") == 0.1, "parse_error").otherwise("ok").alias("status"),
        *SEQ,
    )


def judgments(spark: SparkSession, d: str) -> DataFrame:
    return all_judgments(spark, d).where("l_linenumber <= 3")


def static_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = all_judgments(spark, d).where("l_linenumber > 3")
    return rows.withColumns({"expected_preference": F.when(F.col("l_linestatus") == "F", "A").otherwise(""), "gold_preference": F.lit("B")})


def gold(spark: SparkSession, d: str) -> DataFrame:
    """The relevant edit flips the answer, the irrelevant one keeps it; every seventh order has none."""
    orders = table(spark, d, "orders").where("o_orderkey % 7 <> 0")
    return orders.select(F.col("o_orderkey").cast("string").alias("triplet_id"), F.substring("o_orderpriority", 3, 20).alias("factor"), F.lit("A").alias("base"), F.lit("B").alias("relevant"), F.lit("A").alias("irrelevant"))


def families(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FAMILIES.items()), "model_id string, family string")


def pool_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Eight parts in a row are a pool; every judge scores each from price and size, with ties on purpose."""
    parts = table(spark, d, "part")
    pool, index = F.floor(F.col("p_partkey") / 8), F.col("p_partkey") % 8
    rows = parts.select(pool.cast("string").alias("pool_id"), F.concat(F.lit("id:"), F.col("p_partkey").cast("string")).alias("uid"), (index == pool % 8).alias("is_gold"), F.element_at(F.array(*[F.lit(f) for f in FACTOR_OF_POOL]), (pool % 4 + 1).cast("int")).alias("factor"), F.floor("p_retailprice").alias("_price"), "p_size")
    judges = F.explode(F.array(*[F.lit(m) for m in range(8)]))
    rows = rows.withColumn("_m", judges)
    score = ((F.col("_price") + F.col("_m") * F.col("p_size")) % 5).cast("double")
    return rows.select(F.concat(F.lit("m"), F.col("_m").cast("string")).alias("model_id"), "pool_id", "uid", "is_gold", "factor", score.alias("score"))


J = """
j_all AS (
  SELECT 'm' || CAST(o_custkey % 8 AS VARCHAR) AS model_id, CAST(l_orderkey AS VARCHAR) AS triplet_id, l_linenumber,
    CASE l_linenumber WHEN 1 THEN 'base' WHEN 2 THEN 'relevant' WHEN 3 THEN 'irrelevant' END AS variant,
    substr(o_orderpriority, 3) AS factor, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'B' END AS parsed_preference,
    CASE WHEN l_discount = 0.1 THEN 'parse_error' ELSE 'ok' END AS status,
    l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
j AS (SELECT * FROM j_all WHERE l_linenumber <= 3),
g AS (SELECT CAST(o_orderkey AS VARCHAR) AS triplet_id, substr(o_orderpriority, 3) AS factor, 'A' AS g_b, 'B' AS g_r, 'A' AS g_i FROM orders WHERE o_orderkey % 7 <> 0)"""
ORDER = ", ".join(f"{c} DESC" for c in SEQ)


def t_sql(parsed_first: bool = False) -> str:
    more = " AND parsed_preference IS NOT NULL" if parsed_first else ""
    return f"""{J},
last AS (SELECT *, row_number() OVER (PARTITION BY model_id, triplet_id, variant ORDER BY {ORDER}) AS rn FROM j WHERE status = 'ok'{more}),
p AS (SELECT model_id, triplet_id, max(CASE WHEN variant = 'base' THEN parsed_preference END) AS y_b,
    max(CASE WHEN variant = 'relevant' THEN parsed_preference END) AS y_r, max(CASE WHEN variant = 'irrelevant' THEN parsed_preference END) AS y_i
  FROM last WHERE rn = 1 GROUP BY model_id, triplet_id),
t AS (SELECT p.*, g.factor, g_b, g_r, g_i, CAST(y_b = g_b AS INT) AS c_b, CAST(y_r = g_r AS INT) AS c_r, CAST(y_i = g_i AS INT) AS c_i
  FROM p JOIN g ON p.triplet_id = g.triplet_id WHERE y_b IS NOT NULL AND y_r IS NOT NULL AND y_i IS NOT NULL),
am AS (SELECT model_id, factor, count(*) AS n, CAST(sum(c_b) AS BIGINT) AS n_cond, avg(c_b) AS base_acc, avg(c_b * c_r) AS PFC, avg(c_b * c_i) AS PSC,
    avg(CASE WHEN c_b = 1 THEN c_r END) AS PFC_cond, avg(CASE WHEN c_b = 1 THEN c_i END) AS PSC_cond FROM t GROUP BY model_id, factor),
sa AS (SELECT model_id, factor, avg(CAST(p = gg AS INT)) AS A, count(*) AS n FROM (
    SELECT model_id, factor, parsed_preference AS p, CASE WHEN l_linestatus = 'F' THEN 'A' ELSE 'B' END AS gg FROM j_all
    WHERE l_linenumber > 3 AND status = 'ok' AND parsed_preference IS NOT NULL) GROUP BY model_id, factor)"""


CANDS = """
cands AS (
  SELECT 'm' || CAST(m AS VARCHAR) AS model_id, CAST(p_partkey // 8 AS VARCHAR) AS pool_id, 'id:' || CAST(p_partkey AS VARCHAR) AS uid,
    (p_partkey % 8) = (p_partkey // 8) % 8 AS is_gold,
    CASE (p_partkey // 8) % 4 WHEN 0 THEN 'count' WHEN 1 THEN 'attribute' WHEN 2 THEN 'presence' ELSE 'spatial' END AS factor,
    CAST((CAST(floor(p_retailprice) AS BIGINT) + m * p_size) % 5 AS DOUBLE) AS score
  FROM part, (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS m) ms),
lv AS (SELECT *, CASE WHEN is_gold THEN 2 WHEN k <= 1 THEN 2 WHEN k <= 3 THEN 4 ELSE 8 END AS level FROM (
    SELECT *, row_number() OVER (PARTITION BY model_id, pool_id, is_gold ORDER BY sha256('subset|' || pool_id || '|' || uid)) AS k FROM cands)),
pr AS (SELECT a.model_id, a.pool_id, a.factor, a.uid AS ua, b.uid AS ub, a.score AS sa, b.score AS sb, greatest(a.level, b.level) AS level,
    right(sha256('orientation|' || a.pool_id || '|' || a.uid || '|' || b.uid), 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') AS straight
  FROM lv a JOIN lv b ON a.model_id = b.model_id AND a.pool_id = b.pool_id AND a.uid < b.uid),
ed AS (SELECT model_id, pool_id, factor, level, CASE WHEN straight THEN ua ELSE ub END AS left_uid, CASE WHEN straight THEN ub ELSE ua END AS right_uid,
    CASE WHEN straight THEN sa ELSE sb END AS left_score, CASE WHEN straight THEN sb ELSE sa END AS right_score FROM pr),
eo AS (SELECT *, CASE WHEN left_score > right_score THEN 'left' WHEN right_score > left_score THEN 'right' ELSE 'tie' END AS outcome FROM ed),
en AS (SELECT eo.*, n FROM eo, (SELECT unnest([2, 4, 8]) AS n) ns WHERE n >= level),
pt AS (SELECT model_id, pool_id, n, uid, sum(p) AS points FROM (
    SELECT model_id, pool_id, n, left_uid AS uid, CASE outcome WHEN 'left' THEN 1.0 WHEN 'tie' THEN 0.5 ELSE 0.0 END AS p FROM en
    UNION ALL SELECT model_id, pool_id, n, right_uid, CASE outcome WHEN 'right' THEN 1.0 WHEN 'tie' THEN 0.5 ELSE 0.0 END FROM en) GROUP BY ALL),
win AS (SELECT model_id, pool_id, n, uid AS selected_uid, points FROM (
    SELECT *, row_number() OVER (PARTITION BY model_id, pool_id, n ORDER BY points DESC, sha256('tie|' || pool_id || '|' || uid)) AS k FROM pt) WHERE k = 1),
sel AS (SELECT w.model_id, w.pool_id, c.factor, w.n, w.selected_uid, c.uid AS gold_uid, w.selected_uid = c.uid AS success, e.n_pairs, e.ties
  FROM win w JOIN cands c ON c.model_id = w.model_id AND c.pool_id = w.pool_id AND c.is_gold
  JOIN (SELECT model_id, pool_id, n, count(*) AS n_pairs, count(*) FILTER (WHERE outcome = 'tie') AS ties FROM en GROUP BY ALL) e
    ON e.model_id = w.model_id AND e.pool_id = w.pool_id AND e.n = w.n)"""
