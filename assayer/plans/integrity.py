"""Queries on disjointness, coverage, equality, merging and ordered choices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import integrity as I
from ..operators import merging as G
from ..operators import quality as Q
from ..operators import ranking as R
from ..operators import selecting
from .catalog import long, query, rounded
from .proxies import ORDER, SEQ, table

ASC = ", ".join(SEQ)
BUCKET = "CASE WHEN CAST('0x' || substr(sha256('20260912:' || CAST({0} AS VARCHAR)), 1, 8) AS BIGINT) % 2 = 0 THEN 'static' ELSE 'downstream' END"


def customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").withColumn("split", X.split_bucket("c_custkey"))


CUST = f"WITH cu AS (SELECT *, {BUCKET.format('c_custkey')} AS split FROM customer)"


@query(f"{CUST} SELECT c_custkey, split FROM cu")
def split_buckets(spark, d):
    return customers(spark, d).select("c_custkey", "split")


@query(f"{CUST} SELECT o_orderpriority, count(*) AS orders FROM orders WHERE o_custkey IN (SELECT c_custkey FROM cu WHERE split = 'static') GROUP BY o_orderpriority")
def orders_of_split(spark, d):
    static = customers(spark, d).where("split = 'static'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(static, "o_custkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("orders"))


@query(f"""{CUST}, h AS (SELECT CAST(c_nationkey AS VARCHAR) || ':' || c_mktsegment AS image, split FROM cu)
SELECT 'image' AS identity, 'downstream' AS split_a, 'static' AS split_b, count(*) AS shared FROM (SELECT image FROM h WHERE split = 'static' INTERSECT SELECT image FROM h WHERE split = 'downstream')
UNION ALL SELECT 'nation', 'downstream', 'static', count(*) FROM (SELECT c_nationkey FROM cu WHERE split = 'static' INTERSECT SELECT c_nationkey FROM cu WHERE split = 'downstream')""")
def split_overlaps(spark, d):
    rows = customers(spark, d).select("split", F.concat_ws(":", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("image"), F.col("c_nationkey").alias("nation"))
    return I.split_overlaps(rows, "split", ["image", "nation"])


@query("""SELECT c_custkey, 'missing' AS problem FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 3 <> 0)
UNION ALL SELECT DISTINCT o_custkey, 'unexpected' FROM orders WHERE o_custkey % 3 <> 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def key_coverage(spark, d):
    asked = table(spark, d, "orders").where("o_custkey % 3 <> 0").select(F.col("o_custkey").alias("c_custkey"))
    return I.coverage(table(spark, d, "customer"), asked, "c_custkey")


@query("""WITH w AS (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW']) AS v), c AS (SELECT DISTINCT o_custkey FROM orders),
m AS (SELECT o_custkey, string_agg(v, ',' ORDER BY v) AS missing FROM c, w WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.o_custkey AND o_orderpriority = v) GROUP BY o_custkey),
r AS (SELECT o_custkey, count(o_orderpriority) - count(DISTINCT o_orderpriority) AS repeated FROM orders GROUP BY o_custkey)
SELECT o_custkey, coalesce(missing, '') AS missing, repeated FROM r LEFT JOIN m USING (o_custkey) WHERE missing IS NOT NULL OR repeated > 0""")
def missing_priorities(spark, d):
    out = I.missing_values(table(spark, d, "orders"), "o_custkey", "o_orderpriority", ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"))
    return out.withColumn("missing", F.array_join("missing", ","))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem), b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 100 = 0 THEN 'X' ELSE l_returnflag END AS l_returnflag FROM lineitem)
SELECT side, count(*) AS rows FROM (SELECT 'left' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'right', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) GROUP BY side""")
def row_difference(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_tax")
    other = rows.withColumn("l_returnflag", F.when(F.col("l_orderkey") % 100 == 0, "X").otherwise(F.col("l_returnflag")))
    return I.row_difference(rows, other, ("l_tax",)).groupBy("side").agg(F.count("*").alias("rows"))


@query("SELECT l_orderkey, count(DISTINCT l_returnflag) AS \"values\" FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) > 1")
def dependency_violations(spark, d):
    return I.dependency_violations(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag")


@query("SELECT sha256(coalesce(text, '')) AS physical_id, count(*) AS members, string_agg(printf('%09d', doc_id), '|' ORDER BY printf('%09d', doc_id)) AS names FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, d):
    rows = table(spark, d, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("physical_id"), F.format_string("%09d", "doc_id").alias("name"))
    return I.duplicate_groups(rows, "physical_id", "name")


@query(f"{CUST} SELECT substr(c_name, 17) AS tail, count(DISTINCT split) AS splits, count(*) AS rows FROM cu GROUP BY 1 HAVING count(DISTINCT split) > 1")
def cross_split_tails(spark, d):
    rows = customers(spark, d).withColumn("tail", F.substring(X.numeric_tail("c_name"), 8, 9))
    return I.cross_split_groups(rows, "tail", "split")


@query("SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS path, strlen(text) AS bytes, sha256(text) AS sha256 FROM documents")
def content_receipts(spark, d):
    rows = table(spark, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), "text")
    return I.receipts(rows, "path", "text")


@query("""SELECT path, CASE WHEN k = 0 THEN 'missing' WHEN k = 1 THEN 'different' ELSE 'unexpected' END AS problem FROM (SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS path, doc_id % 50 AS k FROM documents) WHERE k < 3""")
def receipt_problems(spark, d):
    rows = table(spark, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 50).alias("k"))
    actual = rows.where("k <> 0").withColumn("text", F.when(F.col("k") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return I.receipt_problems(I.receipts(rows.where("k <> 2"), "path", "text"), I.receipts(actual, "path", "text"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 20 = 0 AND o_orderkey % 30 = 0 THEN 'o_orderstatus,o_custkey' WHEN o_orderkey % 20 = 0 THEN 'o_orderstatus' ELSE 'o_custkey' END AS fields FROM orders WHERE o_orderkey % 20 = 0 OR o_orderkey % 30 = 0""")
def contract_differences(spark, d):
    rows = table(spark, d, "orders")
    other = rows.withColumns({"o_orderstatus": F.when(F.col("o_orderkey") % 20 == 0, "?").otherwise(F.col("o_orderstatus")), "o_custkey": F.when(F.col("o_orderkey") % 30 == 0, -1).otherwise(F.col("o_custkey"))})
    out = I.contract_differences(rows, other, "o_orderkey", ["o_orderstatus", "o_custkey", "o_orderpriority"])
    return out.withColumn("fields", F.array_join("fields", ","))


@query("SELECT 'k' AS field, count(*) AS rows FROM events WHERE props LIKE '{\"k\"%'")
def field_presence(spark, d):
    rows = table(spark, d, "events").select(F.from_json("props", "map<string, string>").alias("fields"))
    return I.field_presence(rows, "fields")


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY o_orderpriority")
def coverage_map(spark, d):
    return selecting.coverage(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ("F", "O", "P"))


@query("SELECT p_brand AS family, count(*) AS models FROM part WHERE p_size > 10 AND p_type <> 'ECONOMY' GROUP BY p_brand")
def family_counts(spark, d):
    models = table(spark, d, "part").select(F.col("p_brand").alias("family"), (F.col("p_size") > 10).alias("fast_track_primary"), F.when(F.col("p_type") == "ECONOMY", "INCOMPATIBLE").otherwise("OK").alias("status"))
    return selecting.family_counts(models)


@query("SELECT o_orderpriority AS factor, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"PASS\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"BORDERLINE\", CAST(0 AS BIGINT) AS \"FAIL\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"UNSCORED\" FROM orders GROUP BY 1")
def status_tallies(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "PASS").when(F.col("o_orderstatus") == "O", "BORDERLINE")
    return Q.tallies(table(spark, d, "orders").select(F.col("o_orderpriority").alias("factor"), status.alias("status")))


@query("""SELECT 'static' AS carrier, CAST(c_custkey AS VARCHAR) AS item_id, CASE WHEN c_nationkey = 0 THEN 'count' ELSE 'other' END AS factor, NULL::DOUBLE AS balance FROM customer WHERE c_nationkey <> 0
UNION ALL SELECT 'downstream', CAST(s_suppkey AS VARCHAR), CASE WHEN s_nationkey = 0 THEN 'count' ELSE 'other' END, round(s_acctbal, 6) FROM supplier""")
def union_of_carriers(spark, d):
    factor = lambda c: F.when(F.col(c) == 0, "count").otherwise("other").alias("factor")
    static = table(spark, d, "customer").select(F.lit("static").alias("carrier"), F.col("c_custkey").cast("string").alias("item_id"), factor("c_nationkey")).where("factor <> 'count'")
    other = table(spark, d, "supplier").select(F.lit("downstream").alias("carrier"), F.col("s_suppkey").cast("string").alias("item_id"), factor("s_nationkey"), F.col("s_acctbal").alias("balance"))
    return rounded(selecting.all_carriers(static, other))


@query(f"""{CUST} SELECT c_nationkey, count(*) AS candidates FROM cu WHERE split = 'downstream' AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 10 = 0)
  AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 4 = 0) GROUP BY c_nationkey""")
def replacement_candidates(spark, d):
    pool = customers(spark, d).where("split = 'downstream'").withColumn("image", F.col("c_nationkey").cast("string"))
    taken = table(spark, d, "supplier").where("s_suppkey % 10 = 0").select(F.col("s_nationkey").cast("string").alias("image"))
    used = table(spark, d, "orders").where("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return Q.eligible_replacements(pool, "image", taken).join(used, "c_custkey", "left_anti").groupBy("c_nationkey").agg(F.count("*").alias("candidates"))


@query("""WITH cu AS (SELECT CAST(c_custkey AS VARCHAR) AS item_id, c_mktsegment AS factor, CASE WHEN c_nationkey < 10 THEN 'a' ELSE 'b' END AS carrier, c_custkey AS k FROM customer),
c AS (SELECT *, row_number() OVER (PARTITION BY factor, carrier ORDER BY item_id) AS n FROM cu WHERE k IN (SELECT s_suppkey FROM supplier)),
p AS (SELECT *, row_number() OVER (PARTITION BY factor, carrier ORDER BY sha256('repair|' || item_id || '|p' || item_id)) AS n FROM cu)
SELECT c.item_id, p.item_id AS replacement_id, factor, carrier, 'p' || p.item_id AS image FROM c JOIN p USING (factor, carrier, n)""")
def greedy_repair(spark, d):
    """All customers against the images of all suppliers."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("item_id"), F.col("c_mktsegment").alias("factor"), F.when(F.col("c_nationkey") < 10, "a").otherwise("b").alias("carrier"))
    downstream, pool = (rows.withColumn("image", F.concat(F.lit(x), "item_id")) for x in "ip")
    static = table(spark, d, "supplier").select(F.concat(F.lit("i"), F.col("s_suppkey").cast("string")).alias("image"))
    return Q.greedy_repair(downstream, static, static.limit(0), pool)


# ---------------------------------------------------------------- merging

SHARDS = f"""WITH s AS (SELECT 'm' || CAST(l_suppkey % 4 AS VARCHAR) AS model_id, CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) AS item_id, l_returnflag AS parsed_preference, l_linestatus AS status, {ASC.replace('l_returnflag', 'l_returnflag AS f').replace('l_linestatus', 'l_linestatus AS z')} FROM lineitem),
k AS (SELECT *, row_number() OVER w AS n, first_value(parsed_preference) OVER w AS p1, first_value(status) OVER w AS s1 FROM s WINDOW w AS (PARTITION BY model_id, item_id ORDER BY {ASC.replace('l_returnflag', 'f').replace('l_linestatus', 'z')}))"""


def shards(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.concat(F.lit("m"), (F.col("l_suppkey") % 4).cast("string")).alias("model_id"), F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("item_id"), F.col("l_returnflag").alias("parsed_preference"), F.col("l_linestatus").alias("status"), *SEQ)


@query(f"{SHARDS} SELECT model_id || '::' || item_id AS key, parsed_preference, status FROM k WHERE n = 1")
def merged_shards(spark, d):
    return G.merge_shards(shards(spark, d), list(SEQ))[0].select("key", "parsed_preference", "status")


@query(f"{SHARDS} SELECT count(*) AS n_input_rows, count(*) FILTER (WHERE n = 1) AS n_merged, count(*) FILTER (WHERE n > 1) AS n_duplicates, count(*) FILTER (WHERE n > 1 AND (parsed_preference <> p1 OR status <> s1)) AS n_conflicts FROM k")
def merge_report(spark, d):
    return G.merge_shards(shards(spark, d), list(SEQ))[1]


@query(f"{SHARDS} SELECT model_id, item_id, count(*) FILTER (WHERE parsed_preference <> p1 OR status <> s1) AS conflicts FROM k GROUP BY ALL HAVING count(*) FILTER (WHERE parsed_preference <> p1 OR status <> s1) > 0")
def merge_conflicts(spark, d):
    return G.conflicts(shards(spark, d), list(SEQ))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {ASC}) AS n FROM lineitem) WHERE n = 1")
def first_wins(spark, d):
    return G.first_wins(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], list(SEQ)).select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {ORDER}) AS n FROM lineitem) WHERE n = 1")
def last_wins(spark, d):
    return G.last_wins(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], F.struct(*SEQ)).select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")


@query("SELECT o_orderpriority, count(*) AS remaining FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1) GROUP BY o_orderpriority")
def remaining_items(spark, d):
    done = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    return G.remaining(table(spark, d, "orders"), done, "o_orderkey").groupBy("o_orderpriority").agg(F.count("*").alias("remaining"))


# ---------------------------------------------------------------- ordered choices


@query("SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer WHERE c_acctbal > 0) WHERE r <= 20 AND n >= 20")
def frozen_subset(spark, d):
    rows = table(spark, d, "customer").where("c_acctbal > 0")
    return R.first_per_group(rows, ["c_mktsegment"], ["c_name"], 20, whole_groups_only=True).select("c_mktsegment", "c_custkey")


@query("SELECT c_custkey, c_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) AS r FROM customer) WHERE r = 1 ORDER BY c_name LIMIT 12")
def unique_pick(spark, d):
    return R.first_unique(table(spark, d, "customer"), "c_nationkey", ["c_name"], 12).select("c_custkey", "c_nationkey")


@query("""WITH a AS (SELECT *, c_acctbal > 9000 AS simple, CAST(row_number() OVER (PARTITION BY c_mktsegment, c_acctbal > 9000 ORDER BY c_custkey) > 10 AS INT) AS late FROM customer)
SELECT c_mktsegment, c_custkey, simple FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY late, c_custkey) AS r FROM a) WHERE r <= 20""")
def balanced_pick(spark, d):
    rows = table(spark, d, "customer").withColumn("simple", F.col("c_acctbal") > 9000)
    return R.balanced(rows, "simple", ["c_custkey"], 20, ["c_mktsegment"]).select("c_mktsegment", "c_custkey", "simple")


@query("SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY CAST(c_nationkey < 5 AS INT) DESC, c_custkey) AS r FROM customer) WHERE r <= 15")
def local_first(spark, d):
    rows = table(spark, d, "customer").withColumn("_local", (F.col("c_nationkey") < 5).cast("int"))
    return R.first_per_group(rows, ["c_mktsegment"], [F.desc("_local"), "c_custkey"], 15).select("c_mktsegment", "c_custkey")


@query("SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('7:' || CAST(o_orderkey AS VARCHAR))) AS r FROM orders) WHERE r <= 25")
def hash_sample(spark, d):
    return R.hash_sample(table(spark, d, "orders"), ["o_orderpriority"], "o_orderkey", 25, 7).select("o_orderpriority", "o_orderkey")


@query("SELECT o_orderkey, turn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderkey) AS BIGINT) AS turn FROM orders) ORDER BY turn, o_orderpriority, o_orderstatus LIMIT 50")
def round_robin(spark, d):
    return R.round_robin(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], ["o_orderkey"], 50).select("o_orderkey", *long("turn"))


@query("SELECT n_name, row_number() OVER (ORDER BY CASE n_regionkey WHEN 3 THEN 1 WHEN 1 THEN 2 WHEN 0 THEN 3 ELSE 4 END, n_nationkey) AS place FROM nation")
def enum_order(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "nation").withColumn("_r", F.col("n_regionkey").cast("string"))
    return rows.select("n_name", F.row_number().over(Window.orderBy(R.enum_position("_r", ("3", "1", "0")), "n_nationkey")).cast("long").alias("place"))


@query("SELECT n_nationkey, CAST((row_number() OVER (ORDER BY n_nationkey) - 1) % 4 AS BIGINT) AS shard FROM nation")
def modulo_shards(spark, d):
    nations = table(spark, d, "nation")
    out = R.shard(nations, ["n_nationkey"], 4, 0).withColumn("shard", F.lit(0))
    for k in (1, 2, 3):
        out = out.union(R.shard(nations, ["n_nationkey"], 4, k).withColumn("shard", F.lit(k)))
    return out.select("n_nationkey", *long("shard"))


@query("""SELECT c_mktsegment, c_nationkey, n, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, first_seen) AS place FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n, min(c_custkey) AS first_seen FROM customer GROUP BY ALL)""")
def most_common(spark, d):
    from pyspark.sql import Window

    counts = R.frequency(table(spark, d, "customer"), ["c_mktsegment"], "c_nationkey", "c_custkey")
    return counts.select("c_mktsegment", "c_nationkey", "n", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("n"), "first_seen")).cast("long").alias("place"))


@query("SELECT o_orderkey FROM orders ORDER BY CAST(o_orderpriority <> '1-URGENT' AS INT), o_orderkey LIMIT 100")
def priority_limit(spark, d):
    return table(spark, d, "orders").orderBy(F.col("o_orderpriority") != "1-URGENT", "o_orderkey").limit(100).select("o_orderkey")
