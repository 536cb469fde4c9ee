"""Queries of scalar functions, quality rules, streams' batch forms and judges over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import judging, quality, selecting
from ..sources import readers
from ..streaming import journals
from .catalog import long, query, rounded
from .proxies import table

RAW = "CASE event_id % 9 WHEN 0 THEN 'A' WHEN 1 THEN ' answer: b' WHEN 2 THEN 'B) because' WHEN 3 THEN 'I pick B' WHEN 4 THEN 'A or B' WHEN 5 THEN 'Apple' WHEN 6 THEN 'Preference - A, surely' WHEN 7 THEN '' ELSE event_type END"


@query(f"""WITH e AS (SELECT event_id, trim({RAW}) AS x FROM events), f AS (SELECT *, upper(regexp_extract(x, '(?i)(?:answer|preference|choice)\\s*[:\\-]\\s*([AB])', 1)) AS a, regexp_extract(replace(x, ' ', ''), '^([AB])(?:[^\\p{{L}}]|$)', 1) AS b,
  list_filter(regexp_split_to_array(upper(x), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w IN ('A', 'B')) AS w FROM e)
SELECT event_id, CASE WHEN x = '' THEN NULL WHEN x IN ('A', 'B') THEN x WHEN a <> '' THEN a WHEN b <> '' THEN b WHEN len(w) = 1 THEN w[1] END AS parsed FROM f""")
def parsed_answers(spark, d):
    return table(spark, d, "events").select("event_id", X.parse_ab(F.expr(RAW)).alias("parsed"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest, length(trim(lower(source))) AS source_length FROM documents")
def text_digests(spark, d):
    return table(spark, d, "documents").select("doc_id", X.sha(F.coalesce("text", F.lit(""))).alias("digest"), F.char_length(X.normal("source")).cast("long").alias("source_length"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'id:' || p_brand ELSE 'index:' || CAST(p_partkey % 8 AS VARCHAR) || '|text:' || p_name END AS uid FROM part")
def candidate_uids(spark, d):
    brand = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).when(F.col("p_partkey") % 3 == 1, "")
    return table(spark, d, "part").select("p_partkey", X.candidate_uid(F.col("p_partkey") % 8, "p_name", brand).alias("uid"))


NUMBER = "CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN ' ' || CAST(p_size AS VARCHAR) || ' ' WHEN 2 THEN '-' || CAST(p_size AS VARCHAR) ELSE p_type END"


@query(f"SELECT p_partkey, CASE WHEN regexp_full_match(trim({NUMBER}), '[0-9]{{1,18}}') THEN CAST(trim({NUMBER}) AS BIGINT) END AS number FROM part")
def whole_numbers(spark, d):
    return table(spark, d, "part").select("p_partkey", X.whole_number(F.expr(NUMBER.replace("VARCHAR", "STRING"))).alias("number"))


PATH = "CASE p_partkey % 4 WHEN 0 THEN './VG_100K/' || p_size || '.jpg' WHEN 1 THEN 'train2014/COCO_train2014_' || p_size || '.jpg' WHEN 2 THEN 'VG_2/' || p_size || '.png' ELSE 'other/' || p_name || '.tar.gz' END"


@query(f"""WITH x AS (SELECT p_partkey, regexp_replace({PATH}, '^[./]+', '') AS relpath FROM part)
SELECT p_partkey, CASE WHEN lower(relpath) LIKE '%vg_100k%' OR relpath LIKE 'VG\\_%' ESCAPE '\\' THEN 'vg' WHEN lower(relpath) LIKE '%train2014%' THEN 'coco' ELSE 'other' END AS source,
  regexp_replace(split_part(relpath, '/', -1), '\\.[^.]*$', '') AS stem, relpath FROM x""")
def image_keys(spark, d):
    return table(spark, d, "part").select("p_partkey", *[c.alias(k) for k, c in X.image_key(F.expr(PATH)).items()])


@query("""WITH g AS (SELECT p_partkey, CAST(p_size % 12 AS BIGINT) AS gold FROM part), s AS (SELECT p_partkey, gold, unnest([0, -1, 1, -2, 2, -3, 3, -4, 4, -5, 5, -6, 6, -7, 7, -8, 8, -9, 9, -10, 10]) AS step, generate_subscripts([0, -1, 1, -2, 2, -3, 3, -4, 4, -5, 5, -6, 6, -7, 7, -8, 8, -9, 9, -10, 10], 1) AS k FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY k) AS n FROM s WHERE gold + step >= 0)
SELECT p_partkey, any_value(gold) + 1 AS hard_negative, string_agg(CAST(gold + step AS VARCHAR), ',' ORDER BY k) FILTER (WHERE n <= 8) AS pool, min(CASE WHEN n = 2 THEN gold + step END) AS nearest FROM r GROUP BY p_partkey""")
def count_candidates(spark, d):
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 12).cast("long").alias("gold"))
    return rows.select("p_partkey", X.count_hard_negative("gold").alias("hard_negative"), F.array_join(X.count_pool("gold").cast("array<string>"), ",").alias("pool"), X.nearby_unused("gold", F.array("gold")).cast("long").alias("nearest"))


QUESTION = "CASE p_partkey % 6 WHEN 0 THEN 'How many rings are there?' WHEN 1 THEN 'What color is it?' WHEN 2 THEN 'Is there a ring?' WHEN 3 THEN 'Is it left of the box?' WHEN 4 THEN 'Which one?' ELSE 'Are there boxes?' END"
ANSWER = "CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS {0}) WHEN 1 THEN 'red' WHEN 2 THEN 'yes' WHEN 3 THEN 'left' ELSE 'No' END"
OPS = "CASE p_partkey % 7 WHEN 0 THEN 'count' WHEN 1 THEN 'querycolor' WHEN 2 THEN 'exist' WHEN 3 THEN 'relate' ELSE 'select' END"
ARGS = "CASE p_partkey % 4 WHEN 0 THEN 'ring,to the left of,s' ELSE 'box' END"
DETAILED = "CASE p_partkey % 11 WHEN 0 THEN 'chooseAttr' WHEN 1 THEN 'existRel' WHEN 2 THEN 'rel' ELSE 'other' END"
SEMANTIC = "CASE p_partkey % 3 WHEN 0 THEN 'attr' WHEN 1 THEN 'rel' ELSE 'obj' END"


@query(f"""WITH x AS (SELECT p_partkey, lower({QUESTION}) AS q, lower(trim({ANSWER.format('VARCHAR')})) AS a, {OPS} AS op, {ARGS} AS args, lower({DETAILED}) AS det, {SEMANTIC} AS sem FROM part),
y AS (SELECT *, args LIKE '%left%' OR args LIKE '%right%' AS sides, regexp_full_match(a, '[0-9]+') AS num, q LIKE '%how many%' AS many,
  det = 'chooseattr' OR sem = 'attr' OR op = 'querycolor' AS att, op = 'exist' OR det = 'existrel' AS exi FROM x),
z AS (SELECT *, CASE WHEN op = 'count' THEN 1 WHEN num AND sem IN ('obj', 'attr') AND many THEN 2 WHEN att AND many THEN 3 WHEN att AND NOT (sides AND sem = 'rel') THEN 4 WHEN op = 'relate' AND sides THEN 5
  WHEN det IN ('rel', 'existrel') AND sides THEN 6 WHEN exi AND a IN ('yes', 'no') AND sides THEN 7 WHEN exi AND a IN ('yes', 'no') AND op = 'exist' THEN 8 WHEN exi AND a IN ('yes', 'no') THEN 9
  WHEN num AND many THEN 10 WHEN q LIKE 'is there%' OR q LIKE 'are there%' THEN 11 WHEN q LIKE '%left of%' THEN 12 WHEN q LIKE '%what color%' THEN 13 END AS r FROM y)
SELECT p_partkey, CASE WHEN r IN (1, 2, 3, 10) THEN 'count' WHEN r IN (4, 13) THEN 'attribute' WHEN r IN (5, 6, 7, 12) THEN 'spatial' WHEN r IS NOT NULL THEN 'presence' END AS factor,
  CASE r WHEN 1 THEN 'program:count' WHEN 2 THEN 'types:count-or-numeric' WHEN 3 THEN 'count-overrides-attr' WHEN 4 THEN CASE WHEN sem = 'attr' OR det = 'chooseattr' THEN 'types:attr' ELSE 'program:attr' END WHEN 5 THEN 'program:relate+left/right' WHEN 6 THEN 'types:rel+left/right'
    WHEN 7 THEN 'exist+spatial-rel' WHEN 8 THEN 'program:exist' WHEN 9 THEN 'types:exist' WHEN 10 THEN 'keyword' WHEN 11 THEN 'keyword' WHEN 12 THEN 'keyword' WHEN 13 THEN 'keyword' END AS mapping_source,
  CASE WHEN r IN (1, 3, 4, 5, 6, 8) THEN 'high' WHEN r IN (2, 7, 9) THEN 'medium' WHEN r IS NOT NULL THEN 'low' END AS mapping_confidence FROM z""")
def classified_questions(spark, d):
    columns = X.classified_factor(F.expr(QUESTION), F.expr(ANSWER.format("STRING")), F.lit("query"), F.expr(SEMANTIC), F.expr(DETAILED), F.array(F.expr(OPS)), F.expr(ARGS))
    return table(spark, d, "part").select("p_partkey", *[c.alias(k) for k, c in columns.items()])


NEGATIVE_FACTOR = "CASE p_partkey % 4 WHEN 0 THEN 'count' WHEN 1 THEN 'presence' WHEN 2 THEN 'spatial' ELSE 'attribute' END"


@query(f"""WITH x AS (SELECT p_partkey, {NEGATIVE_FACTOR} AS f, lower(trim({ANSWER.format('VARCHAR')})) AS a, {ARGS} AS args, CASE WHEN p_partkey % 8 = 3 THEN p_type END AS scene FROM part),
y AS (SELECT *, CASE WHEN a = 'yes' THEN 'no' ELSE 'yes' END AS yn FROM x)
SELECT p_partkey, CASE WHEN f = 'count' AND regexp_full_match(a, '[0-9]+') THEN CAST(CAST(a AS BIGINT) + 1 AS VARCHAR) WHEN f = 'presence' AND a IN ('yes', 'no') THEN yn WHEN f = 'spatial' AND a IN ('left', 'yes', 'no') THEN CASE a WHEN 'left' THEN 'right' WHEN 'yes' THEN 'no' ELSE 'yes' END
    WHEN f = 'attribute' THEN coalesce(CASE WHEN lower(scene) <> a THEN scene END, CASE WHEN a = 'red' THEN 'white' END) END AS hard_negative,
  CASE WHEN f = 'count' AND regexp_full_match(a, '[0-9]+') THEN 'count_plus_minus_1' WHEN f = 'presence' AND a IN ('yes', 'no') THEN 'yes_no_flip' WHEN f = 'spatial' AND a IN ('left', 'yes', 'no') THEN 'spatial_inverse'
    WHEN f = 'attribute' AND lower(scene) <> a THEN 'attribute_scene_substitution' WHEN f = 'attribute' AND a = 'red' THEN 'attribute_palette_substitution' ELSE 'unresolved' END AS hard_negative_type FROM y""")
def hard_negatives(spark, d):
    scene = F.when(F.col("p_partkey") % 8 == 3, F.array("p_type"))
    columns = X.structured_negative(F.expr(NEGATIVE_FACTOR), F.expr(ANSWER.format("STRING")), F.expr(ARGS), scene)
    return table(spark, d, "part").select("p_partkey", *[c.alias(k) for k, c in columns.items()])


@query("""WITH s AS (SELECT p_partkey, unnest([p_type, lower(p_type), 'Red', 'red', '', 'blue', p_brand, 'green', 'white', 'black', 'pink', 'gray']) AS t, generate_subscripts([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12], 1) AS k FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, lower(t) ORDER BY k) AS r FROM s WHERE t <> ''), o AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY k) AS n FROM f WHERE r = 1)
SELECT p_partkey, string_agg(t, '|' ORDER BY k) AS pool FROM o WHERE n <= 8 GROUP BY p_partkey""")
def filled_pools(spark, d):
    words = [F.array(*[F.lit(w) for w in ws]) for ws in (("Red", "red", "", "blue"), ("green", "white", "black", "pink", "gray"))]
    pool = X.filled_pool(F.col("p_type"), F.array(F.lower("p_type")), words[0], F.array("p_brand"), words[1])
    return table(spark, d, "part").select("p_partkey", F.array_join(pool, "|").alias("pool"))


@query("""WITH x AS (SELECT p_partkey, p_name AS a, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 3 = 1 THEN p_name || '.' ELSE p_name || ' and much more of it' END AS b, CASE p_partkey % 5 WHEN 0 THEN 'C' WHEN 1 THEN NULL ELSE 'A' END AS lab FROM part)
SELECT p_partkey, concat_ws(',', CASE WHEN lower(a) = lower(b) THEN 'duplicate_candidates' END, CASE WHEN abs(length(a) - length(b)) >= 12 THEN 'length_gap' END, CASE WHEN (b LIKE '%.') <> (a LIKE '%.') THEN 'punctuation_asymmetry' END,
  CASE WHEN lab = 'C' THEN 'invalid_preference_label' END, CASE WHEN lower(a) = lower(b) THEN 'gold_duplication' END) AS flags FROM x""")
def pair_shortcuts(spark, d):
    k = F.col("p_partkey")
    b = F.when(k % 3 == 0, F.upper("p_name")).when(k % 3 == 1, F.concat("p_name", F.lit("."))).otherwise(F.concat("p_name", F.lit(" and much more of it")))
    label = F.when(k % 5 == 0, "C").when(k % 5 == 1, F.lit(None).cast("string")).otherwise("A")
    return table(spark, d, "part").select("p_partkey", F.array_join(X.pair_flags(F.col("p_name"), F.col("p_name"), b, label), ",").alias("flags"))


@query("""WITH x AS (SELECT p_partkey // 8 AS pool_id, list(p_type ORDER BY p_partkey) AS t, min(p_type) AS gold, count(*) AS n FROM part GROUP BY 1), y AS (SELECT *, list_transform(t, lambda v: lower(v)) AS low FROM x)
SELECT pool_id, concat_ws(',', CASE WHEN len(low) <> len(list_distinct(low)) THEN 'duplicate_candidates' END, CASE WHEN len(list_filter(low, lambda v: v = lower(gold))) > 1 THEN 'gold_duplication' END,
  CASE WHEN low[1] <> lower(gold) THEN 'invalid_gold_index' END, CASE WHEN n <> 8 THEN 'invalid_candidate_count' END, CASE WHEN list_max(list_transform(t, lambda v: length(v))) - list_min(list_transform(t, lambda v: length(v))) >= 12 THEN 'length_gap' END) AS flags FROM y""")
def pool_shortcuts(spark, d):
    pools = table(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 8).alias("pool_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_type"))), lambda x: x["p_type"]).alias("t"), F.min("p_type").alias("gold"))
    return pools.select("pool_id", F.array_join(X.pool_flags(F.col("gold"), F.col("t"), F.lit(0), F.lit(8)), ",").alias("flags"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tokens FROM documents")
def token_totals(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.alphanumeric_tokens("text")).cast("long").alias("tokens"))


@query("SELECT c_custkey, nullif(regexp_extract(c_name, '([0-9]+)[^0-9]*$', 1), '') AS tail FROM customer")
def numeric_tails(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.numeric_tail("c_name").alias("tail"))


@query("SELECT l_returnflag, count(*) FILTER (WHERE abs(l_tax - l_discount) <= 0.000000000001) AS close, count(*) FILTER (WHERE abs(l_tax - l_discount) <= 0.05) AS small_change FROM lineitem GROUP BY l_returnflag")
def close_values(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.groupBy("l_returnflag").agg(F.count_if(X.close("l_tax", "l_discount")).alias("close"), F.count_if(X.close("l_tax", "l_discount", 0.05)).alias("small_change"))


COCO = "CASE WHEN p_partkey % 2 = 0 THEN 'train2014/COCO_train2014_' || lpad(CAST(p_partkey AS {0}), 12, '0') || '.jpg' ELSE 'val2014/COCO_val2014_' || lpad(CAST(p_partkey AS {0}), 12, '0') || '.jpg' END"


@query(f"SELECT p_partkey, split_part({COCO.format('VARCHAR')}, '/', 1) AS split, split_part({COCO.format('VARCHAR')}, '/', 2) AS filename FROM part")
def image_paths(spark, d):
    return table(spark, d, "part").select("p_partkey", *[c.alias(k) for k, c in X.coco_path(F.expr(COCO.format("STRING"))).items()])


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT vec_id, round(v[1] * 1.0 + v[2] * 0.5 - v[3] * 0.25, 6) AS along, v[1] - v[4] > 0.2 AS beyond FROM e""")
def vector_relations(spark, d):
    v = F.col("embedding")
    direction = F.array(F.lit(1.0), F.lit(0.5), F.lit(-0.25))
    axis = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))
    rows = table(spark, d, "embeddings")
    return rounded(rows.select("vec_id", X.dot(F.slice(v, 1, 3), direction).alias("along"), X.relation_holds(F.slice(v, 1, 3), F.slice(v, 4, 3), axis).alias("beyond")))


@query("SELECT p_partkey, round(CASE WHEN p_type = 'ECONOMY' THEN 30.0 ELSE 16.0 END * (9.0 / greatest(p_size / 4.0, 1.0)), 6) AS radius, CASE WHEN p_size < 8 THEN 'FAIL' WHEN p_size < 20 THEN 'BORDERLINE' ELSE 'PASS' END AS status FROM part")
def radii_and_statuses(spark, d):
    size = F.when(F.col("p_type") == "ECONOMY", "large").otherwise("small")
    flags = X.compact(F.when(F.col("p_size") < 20, "BORDERLINE: near_edge"), F.when(F.col("p_size") < 8, "FAIL: out_of_frame"))
    return rounded(table(spark, d, "part").select("p_partkey", X.projected_radius(size, F.col("p_size") / 4.0).alias("radius"), X.status_of(flags).alias("status")))


@query("""SELECT event_id, printf('%02d:%02d:%02d', event_id // 3600, event_id % 3600 // 60, event_id % 60) AS duration, round(100.0 * (event_id % 50) / nullif(50, 0), 6) AS percent, round((event_id % 50) / nullif(value, 0.0), 6) AS rate,
  round(greatest(50 - event_id % 50, 0) / nullif((event_id % 50) / nullif(value, 0.0), 0.0), 6) AS eta FROM events""")
def progress_figures(spark, d):
    rows = table(spark, d, "events")
    done = F.col("event_id") % 50
    figures = X.progress(done, F.lit(50), F.col("value"))
    return rounded(rows.select("event_id", X.duration(F.col("event_id")).alias("duration"), *[c.cast("double").alias(k) for k, c in figures.items()]))


@query("SELECT user_id, round(greatest(coalesce(max(CASE WHEN event_type = 'error' THEN value END), 0.0), sum(value)), 4) AS seconds, max(CASE WHEN event_type = 'error' THEN value END) IS NULL AS is_lower_bound FROM events GROUP BY user_id")
def elapsed_bounds(spark, d):
    per = table(spark, d, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "error", F.col("value"))).alias("r"), F.sum("value").alias("s"))
    columns = X.elapsed_bound(F.col("r"), F.col("s"))
    return per.select("user_id", F.round(columns["seconds"], 4).alias("seconds"), columns["is_lower_bound"].alias("is_lower_bound"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN 'tallyqa' ELSE 'gqa' END AS carrier FROM customer
WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD') AND c_acctbal > 0 AND c_custkey IN (SELECT o_custkey FROM orders) AND lower(c_mktsegment) <> lower(c_name) AND c_name <> ''""")
def static_selection(spark, d):
    rows = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", F.col("c_mktsegment").alias("factor"), F.col("c_mktsegment").alias("answer"), F.col("c_name").alias("hard_negative"), "c_nationkey")
    split = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    chosen = selecting.selected_static(rows, split, "c_custkey", ("BUILDING", "HOUSEHOLD"))
    return chosen.select("c_custkey", selecting.carrier(F.when(F.col("c_nationkey") == 0, "count").otherwise("other")).alias("carrier"))


@query("SELECT l_linestatus, count(*) AS rows, count(*) FILTER (WHERE isnan(x) OR x IS NULL) AS not_finite, bool_or(isnan(x) OR x IS NULL) AS void FROM (SELECT l_linestatus, CASE WHEN l_orderkey % 500 = 0 AND l_linestatus = 'O' THEN NULL ELSE l_tax END AS x FROM lineitem) GROUP BY l_linestatus")
def void_groups(spark, d):
    from ..operators.matching import finite

    rows = table(spark, d, "lineitem").select("l_linestatus", F.when(~((F.col("l_orderkey") % 500 == 0) & (F.col("l_linestatus") == "O")), F.col("l_tax")).alias("x"))
    return rows.groupBy("l_linestatus").agg(F.count("*").alias("rows"), F.count_if(~finite("x")).alias("not_finite"), F.bool_or(~finite("x")).alias("void"))


@query("SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k, count(*) AS n FROM events GROUP BY event_type")
def nested_fields(spark, d):
    rows = table(spark, d, "events").withColumn("p", F.from_json("props", "k bigint"))
    return rows.groupBy("event_type").agg(F.sum("p.k").alias("k"), F.count("*").alias("n"))


STATUS = "SELECT event_id, user_id AS worker, CAST(user_id AS BIGINT) AS pid, event_type AS stage, event_id % 500 AS done, CAST(500 AS BIGINT) AS total, CAST(epoch_us(ts) AS DOUBLE) / CAST(1000000 AS DOUBLE) AS observed_unix FROM events"


@query(f"""WITH s AS ({STATUS}), n AS (SELECT *, CASE WHEN lag(stage) OVER w IS NOT DISTINCT FROM stage AND lag(pid) OVER w IS NOT DISTINCT FROM pid AND NOT done < lag(done) OVER w THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY worker ORDER BY observed_unix, event_id)),
c AS (SELECT *, sum(new) OVER (PARTITION BY worker ORDER BY observed_unix, event_id) AS session FROM n),
r AS (SELECT *, CASE WHEN observed_unix - first_value(observed_unix) OVER b > 0 THEN (done - first_value(done) OVER b) / (observed_unix - first_value(observed_unix) OVER b) END AS rate FROM c WINDOW b AS (PARTITION BY worker, session ORDER BY observed_unix, event_id))
SELECT event_id, worker, round(rate, 6) AS rate, round(CASE WHEN rate > 0 THEN greatest(total - done, 0) / rate END, 3) AS eta FROM r""")
def throughput(spark, d):
    return journals.rates_batch(status(spark, d)).select("event_id", "worker", F.round("rate", 6).alias("rate"), F.round("eta", 3).alias("eta"))


def status(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("worker"), F.col("user_id").alias("pid"), F.col("event_type").alias("stage"), (F.col("event_id") % 500).alias("done"), F.lit(500).cast("long").alias("total"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("observed_unix"))


@query("""SELECT worker, source, done FROM (SELECT user_id AS worker, CASE event_type WHEN 'click' THEN 'live' WHEN 'view' THEN 'task' ELSE 'control' END AS source, event_id AS done,
  row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END, event_id DESC) AS r FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type NOT IN ('click', 'view'))) WHERE r = 1""")
def latest_statuses(spark, d):
    source = F.when(F.col("event_type") == "click", "live").when(F.col("event_type") == "view", "task").otherwise("control")
    rows = table(spark, d, "events").select(F.col("user_id").alias("worker"), F.lit(1).alias("pid"), source.alias("source"), F.col("event_id").alias("done"), F.col("event_id").cast("double").alias("observed_unix"))
    control = rows.where("source = 'control'").groupBy("worker").agg(F.max_by(F.struct("pid", "source", "done", "observed_unix"), "observed_unix").alias("r")).select("worker", "r.*")
    return journals.latest_status(rows.where("source <> 'control'").unionByName(control), ("live", "task", "control")).select("worker", "source", "done")


@query("SELECT conv_id, turn, CASE WHEN right(left(sha256(coalesce(text, '') || '|' || role), 8), 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 'A' ELSE 'B' END AS preference FROM conversations")
def stand_in_judge(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", judging.stand_in("text", "role").alias("preference"))


class _Scripted:
    """A judge for tests and demonstrations: some questions fail on purpose."""

    def load(self) -> None:
        self.asked = 0

    def judge(self, question: str, candidate_a: str, candidate_b: str, image_path: str | None) -> str:
        self.asked += 1
        if "FORCE_OOM" in question:
            raise MemoryError("out of memory")
        if "FORCE_ERROR" in question:
            raise ValueError("broken")
        return "?" if "FORCE_PARSE" in question else "Answer: A" if candidate_a <= candidate_b else "B"

    def close(self) -> None:
        self.asked = 0


@query("""SELECT CAST(p_partkey AS VARCHAR) AS item_id, CASE p_partkey % 10 WHEN 0 THEN 'oom' WHEN 1 THEN 'error' WHEN 2 THEN 'parse_error' ELSE 'ok' END AS status, CASE WHEN p_partkey % 10 > 2 THEN CASE WHEN p_brand <= p_type THEN 'A' ELSE 'B' END END AS parsed_preference FROM part""")
def judged_items(spark, d):
    k = F.col("p_partkey") % 10
    question = F.when(k == 0, "FORCE_OOM").when(k == 1, "FORCE_ERROR").when(k == 2, "FORCE_PARSE").otherwise("Which?")
    items = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("item_id"), question.alias("question"), F.col("p_brand").alias("candidate_a"), F.col("p_type").alias("candidate_b"), F.lit(None).cast("string").alias("image_path"))
    return judging.run_items(items, _Scripted).select("item_id", "status", "parsed_preference")


FACTOR = ("count", "attribute", "presence", "spatial")
G = "g AS (SELECT p_partkey AS i, ['count', 'attribute', 'presence', 'spatial'][CAST((p_partkey // 2) % 4 AS INT) + 1] AS factor FROM part), t AS (SELECT *, factor || '-' || lpad(CAST(i AS VARCHAR), 6, '0') AS triplet_id FROM g)"


def generated(spark: SparkSession, d: str) -> DataFrame:
    """A generated triplet for every part, two parts in a row of each factor in turn."""
    ids = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.floor(F.col("p_partkey") / 2) % 4).alias("kind"))
    made = [quality.generated_specs(spark, factor, ids.where(F.col("kind") == k)) for k, factor in enumerate(FACTOR)]
    return made[0].union(made[1]).union(made[2]).union(made[3])


@query(f"WITH {G} SELECT triplet_id, factor, '' AS flags, 'PASS' AS status FROM t")
def generated_triplets_checked(spark, d):
    return quality.checked_triplets(generated(spark, d)).select("triplet_id", "factor", F.array_join("flags", " | ").alias("flags"), "status")


@query(f"""WITH {G} SELECT triplet_id || ':' || v AS item_id, triplet_id, factor, v AS variant, CASE WHEN (i % 2 = 0) = (v <> 'relevant') THEN 'A' ELSE 'B' END AS expected_preference,
  CAST(CASE factor WHEN 'count' THEN CASE v WHEN 'base' THEN 2 ELSE 3 END WHEN 'attribute' THEN 2 WHEN 'presence' THEN CASE v WHEN 'base' THEN 2 ELSE 1 END ELSE 3 END AS INTEGER) AS n_objects
FROM t, (SELECT unnest(['base', 'relevant', 'irrelevant']) AS v)""")
def generated_variants(spark, d):
    return quality.variant_rows(generated(spark, d)).select("item_id", "triplet_id", "factor", "variant", "expected_preference", F.size("objects").alias("n_objects"))


@query("SELECT unnest(['status is PASS', 'no FAIL flag']) AS rule, count(*) AS n, CAST(0 AS BIGINT) AS failures, true AS ok FROM part")
def generated_validation(spark, d):
    report = quality.checked_triplets(generated(spark, d))
    return quality.validation(report, {"status is PASS": F.col("status") == "PASS", "no FAIL flag": ~F.exists("flags", lambda f: f.startswith("FAIL:"))}).select("rule", *long("n", "failures"), "ok")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'B' END AS preferred, CASE c_custkey % 3 WHEN 0 THEN c_custkey || '.jpg' WHEN 1 THEN c_custkey || '.jpg' ELSE c_name || '.png' END AS file FROM customer""")
def letters_and_files(spark, d):
    """The letter of the candidate that is the answer, and the file that an image's id or path names."""
    k = F.col("c_custkey")
    image = F.when(k % 3 == 0, F.concat(F.lit("vg:"), k.cast("string"))).when(k % 3 == 1, k.cast("string")).otherwise(F.concat(F.lit("images/"), F.col("c_name"), F.lit(".png")))
    rows = table(spark, d, "customer").select("c_custkey", image.alias("image"), F.when(k % 2 == 0, F.col("c_name")).otherwise(F.col("c_mktsegment")).alias("answer"), F.col("c_name").alias("a"), F.col("c_mktsegment").alias("b"))
    return rows.select("c_custkey", X.preferred_for("a", "b", "answer").alias("preferred"), readers.raw_filename("image").alias("file"))
