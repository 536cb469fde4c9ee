"""Queries over rendered triplets: every part is one, its scenes made of its columns, with a defect of a known kind in most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality
from ..operators.bestofn import spread
from ..schemas import VARIANTS
from .catalog import long, query
from .proxies import table

FACTOR = ("count", "attribute", "presence", "spatial")
FIRST = {"count": "o1", "attribute": "target", "presence": "target", "spatial": "referent"}
D = "((p_partkey // 4) % 12)"


def _object(name: Column | str, shape: str, color: Column | str, place: Column | int, x: Column | float = 0.0) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    px = (60.0 + 40.0 * lit(place)).cast("double")
    at = lit(x).cast("double")
    return F.struct(lit(name).alias("object_id"), F.lit(shape).alias("shape"), lit(color).alias("color"), F.lit("large").alias("size"), at.alias("x"), F.lit(0.0).alias("y"), F.array(px, F.lit(120.0), F.lit(10.0)).alias("pixel_coords"), F.array(at, F.lit(0.0), F.lit(0.0)).alias("coords"))


def _objects(factor: str, d: Column, n: Column) -> dict[str, Column]:
    """Objects of the three scenes; defect 7 is one of the factor's own rule."""
    bad = d == 7
    if factor == "count":
        reds = lambda k: F.transform(F.sequence(F.lit(1), k), lambda i: _object(F.concat(F.lit("o"), i.cast("string")), "ball", "red", i % 6))
        blue = lambda name, place: F.array(_object(name, "cube", "blue", place))
        return {"base": F.concat(reds(n), blue("b1", 5)), "relevant": F.concat(reds(F.when(bad, n).otherwise(n + 1)), blue("b1", 5)), "irrelevant": F.concat(reds(n), blue("b1", 5), blue("b2", 0))}
    if factor == "attribute":
        both = lambda one, other: F.array(_object("target", "cube", one, 0), _object("matched", "ball", other, 2))
        return {"base": both("red", "red"), "relevant": both(F.when(bad, "red").otherwise("blue"), "red"), "irrelevant": both("red", "blue")}
    if factor == "presence":
        target, matched, other = _object("target", "cube", "red", 0), _object("matched", "ball", "red", 2), _object("other", "cone", "green", 4)
        return {"base": F.array(target, matched, other), "relevant": F.when(bad, F.array(target, matched, other)).otherwise(F.array(matched, other)), "irrelevant": F.array(target, other)}
    roles = lambda referent, distractor: F.array(_object("referent", "cube", "red", 0, referent), _object("anchor", "ball", "red", 2), _object("distractor", "cone", "red", 4, distractor))
    return {"base": roles(F.when(bad, 1.0).otherwise(-1.0), -3.0), "relevant": roles(1.0, -3.0), "irrelevant": roles(-1.0, -1.0)}


def triplets(spark: SparkSession, d: str) -> DataFrame:
    # A part is a few bytes of its file and much work, so the file's few splits are dealt to all cores.
    parts = spread(table(spark, d, "part"), ("p_partkey",))
    kind, defect = F.col("p_partkey") % 4, F.floor(F.col("p_partkey") / 4) % 12
    n = (1 + F.col("p_size") % 3).cast("int")
    made = {f: _objects(f, defect, n) for f in FACTOR}
    columns = {}
    for v in VARIANTS:
        objects = F.when(kind == 0, made["count"][v])
        for i, f in enumerate(FACTOR[1:], 1):
            objects = objects.when(kind == i, made[f][v])
        if v == "base":
            px = F.when(defect == 5, -5.0).when(defect == 6, 4.0)
            spoiled = lambda o: F.when(defect == 10, o.withField("pixel_coords", F.lit(None).cast("array<double>"))).when(px.isNotNull(), o.withField("pixel_coords", F.array(px, F.lit(120.0), F.lit(10.0)))).otherwise(o)  # noqa: B023, E731
            objects = F.transform(objects, lambda o, i: F.when(i == 0, spoiled(o)).otherwise(o))  # noqa: B023
        place = lambda k, moved: F.array(F.lit(1.0), F.lit(2.0), F.when(moved, 4.0).otherwise(3.0)).alias(k)
        never = F.lit(False)
        contract = F.struct(F.when((defect == 1) & F.lit(v == "relevant"), 8).otherwise(7).cast("long").alias("cycles_seed"), place("camera_location", (defect == 2) if v == "irrelevant" else never), place("lamp_key_location", never), place("lamp_fill_location", (defect == 3) if v == "relevant" else never), place("lamp_back_location", never), F.when((defect == 4) & F.lit(v == "base"), 0.5).otherwise(0.0).alias("camera_jitter"))
        preferred = F.when(defect == 9, "A").otherwise("B") if v == "relevant" else F.lit("A")
        count = F.when(kind == 0, F.when(defect == 8, n + 1).otherwise(n)) if v == "base" else F.lit(None)
        columns[v] = F.struct(preferred.alias("preferred"), count.cast("int").alias("target_count"), contract.alias("contract"), objects.alias("objects")).cast(quality.SCENE)
    axis = lambda x: F.array(F.lit(x), F.lit(0.0), F.lit(0.0))
    fixed = {"candidate_a": F.lit("yes"), "candidate_b": F.lit("no"), "target_shape": F.lit("cube"), "target_color": F.lit("red"), "color_to": F.lit("blue"), "left_vector": axis(-1.0), "right_vector": axis(1.0)}
    factor = F.element_at(F.array(*[F.lit(f) for f in FACTOR]), (kind + 1).cast("int"))
    return parts.select(F.col("p_partkey").cast("string").alias("triplet_id"), factor.alias("factor"), *[c.alias(k) for k, c in {**fixed, **columns}.items()])


CHECKED = f"""t AS (SELECT CAST(p_partkey AS VARCHAR) AS triplet_id, {D} AS d, CAST(1 + p_size % 3 AS VARCHAR) AS n, CAST(2 + p_size % 3 AS VARCHAR) AS more, ['count', 'attribute', 'presence', 'spatial'][CAST(p_partkey % 4 AS INT) + 1] AS factor, ['o1', 'target', 'target', 'referent'][CAST(p_partkey % 4 AS INT) + 1] AS first FROM part),
checked AS (SELECT triplet_id, factor, CASE d
  WHEN 1 THEN 'FAIL: cycles seed mismatch' WHEN 2 THEN 'FAIL: camera mismatch' WHEN 3 THEN 'FAIL: light mismatch lamp_fill_location' WHEN 4 THEN 'FAIL: camera jitter'
  WHEN 5 THEN 'FAIL: base ' || first || ' out_of_frame' WHEN 6 THEN 'BORDERLINE: base ' || first || ' near_edge' WHEN 9 THEN 'FAIL: relevant preference did not flip' WHEN 10 THEN 'FAIL: base missing pixel_coords'
  WHEN 7 THEN CASE factor
    WHEN 'count' THEN 'FAIL: relevant did not add one target (' || n || ' -> ' || n || ') | FAIL: relevant object cardinality'
    WHEN 'attribute' THEN 'FAIL: relevant target color | FAIL: relevant did not flip target attribute'
    WHEN 'presence' THEN 'FAIL: relevant did not remove target | FAIL: relevant still has target id'
    ELSE 'FAIL: base relation is not left-of | FAIL: displacement matching broken' END
  WHEN 8 THEN CASE factor WHEN 'count' THEN 'FAIL: base target count ' || n || ' != ' || more ELSE '' END ELSE '' END AS flags FROM t),
report AS (SELECT *, CASE WHEN flags LIKE 'FAIL%' THEN 'FAIL' WHEN flags LIKE 'BORDERLINE%' THEN 'BORDERLINE' ELSE 'PASS' END AS status FROM checked)"""


@query(f"WITH {CHECKED} SELECT triplet_id, factor, flags, status FROM report")
def checked_scenes(spark, d):
    return quality.checked_triplets(triplets(spark, d)).select("triplet_id", "factor", F.array_join("flags", " | ").alias("flags"), "status")


@query(f"WITH {CHECKED} SELECT factor, status, count(*) AS n FROM report GROUP BY ALL")
def incremental_checks(spark, d):
    """Half of the triplets have a cached status, which stays; the rest is checked."""
    rows = triplets(spark, d)
    cached = quality.checked_triplets(rows.where("CAST(triplet_id AS LONG) % 2 = 0"))
    return quality.incremental(rows, cached).groupBy("factor", "status").agg(F.count("*").alias("n"))


@query(f"""WITH {CHECKED} SELECT triplet_id || ':' || v AS item_id, triplet_id, factor, v AS variant, CASE WHEN v = 'relevant' AND d <> 9 THEN 'B' ELSE 'A' END AS expected_preference,
  CAST(CASE factor WHEN 'count' THEN CAST(n AS INT) + 1 + CASE WHEN v = 'irrelevant' OR (v = 'relevant' AND d <> 7) THEN 1 ELSE 0 END WHEN 'attribute' THEN 2 WHEN 'presence' THEN CASE WHEN v = 'base' OR (v = 'relevant' AND d = 7) THEN 3 ELSE 2 END ELSE 3 END AS INTEGER) AS n_objects
FROM t, (SELECT unnest(['base', 'relevant', 'irrelevant']) AS v)""")
def scene_variants(spark, d):
    return quality.variant_rows(triplets(spark, d)).select("item_id", "triplet_id", "factor", "variant", "expected_preference", F.size("objects").alias("n_objects"))


@query(f"""WITH {CHECKED} SELECT 'status is PASS' AS rule, count(*) AS n, count(*) FILTER (WHERE status <> 'PASS') AS failures, bool_and(status = 'PASS') AS ok FROM report
UNION ALL SELECT 'no FAIL flag', count(*), count(*) FILTER (WHERE status = 'FAIL'), bool_and(status <> 'FAIL') FROM report""")
def scene_validation(spark, d):
    report = quality.checked_triplets(triplets(spark, d))
    return quality.validation(report, {"status is PASS": F.col("status") == "PASS", "no FAIL flag": ~F.exists("flags", lambda f: f.startswith("FAIL:"))}).select("rule", *long("n", "failures"), "ok")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN i = 0 THEN 'FAIL: irrelevant image identical to base' || CASE WHEN r = 0 THEN ' | FAIL: relevant image identical to base' ELSE '' END
  WHEN r = 0 THEN 'FAIL: relevant image identical to base | BORDERLINE: relevant/irrelevant RGB magnitude ratio 0.000' WHEN r / i < 0.25 OR r / i > 4.0 THEN printf('BORDERLINE: relevant/irrelevant RGB magnitude ratio %.3f', r / i) ELSE '' END AS flags
FROM (SELECT *, floor(l_tax * 100 + 0.5) AS r, floor(l_discount * 100 + 0.5) AS i FROM lineitem)""")
def magnitude_checked(spark, d):
    r, i = (F.floor(F.col(c) * 100 + 0.5).cast("double") for c in ("l_tax", "l_discount"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(quality.magnitude_flags(r, i), " | ").alias("flags"))
