"""Accuracy-matched comparisons of models: pairs within a factor, bands by accuracy gap, and joins on shared items.

The tables are one row for each model and factor. The rule at a band's edge differs between published analyses, so the
tolerance is a parameter: 1e-12 by default, 0 for the strict form. Signed differences are the first row minus the second in
the order of `pos`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-12


def model_pairs(rows: DataFrame, by: str | None = "factor", key: str = "A", deps: tuple[str, ...] = ("PFC", "PSC"), pos: str = "model_id") -> DataFrame:
    """Unordered pairs of models (within by), their accuracy gap in percentage points, and signed differences of deps."""
    a, b = rows.alias("a"), rows.alias("b")
    on = F.col(f"a.{pos}") < F.col(f"b.{pos}")
    if by:
        on = (F.col(f"a.{by}") == F.col(f"b.{by}")) & on
    pairs = a.join(b, on).where("a.model_id <> b.model_id")
    head = [F.col(f"a.{by}").alias(by)] if by else []
    gap = (F.abs(F.col(f"a.{key}") - F.col(f"b.{key}")) * 100.0).alias("gap_pp")
    return pairs.select(*head, F.col("a.model_id").alias("model_a"), F.col("b.model_id").alias("model_b"), gap, *[(F.col(f"a.{d}") - F.col(f"b.{d}")).alias(f"d_{d}") for d in deps])


def in_bands(pairs: DataFrame, thresholds: tuple[float, ...], tolerance: float = TOLERANCE) -> DataFrame:
    """A row for each pair and each band that it lies in; pairs without a gap are in none."""
    each = pairs.withColumn("band_pp", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return each.where(F.col("gap_pp") <= F.col("band_pp") + F.lit(tolerance))


def band_summary(pairs: DataFrame, thresholds: tuple[float, ...], deps: tuple[str, ...], tolerance: float = TOLERANCE, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs in each band with median, mean and largest absolute differences in percentage points."""
    inside = in_bands(pairs, thresholds, tolerance)
    size = lambda d: F.abs(F.col(f"d_{d}")) * 100.0
    stats = [f for d in deps for f in (F.percentile(size(d), 0.5).alias(f"median_{d}"), F.avg(size(d)).alias(f"mean_{d}"), F.max(size(d)).alias(f"max_{d}"))]
    return inside.groupBy(*by, "band_pp").agg(F.count("*").alias("pairs"), *stats)


def satisfied(pairs: DataFrame, thresholds: tuple[float, ...], tolerance: float = 0.0) -> DataFrame:
    """Each pair with the list of bands that hold it."""
    bands = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col("gap_pp") <= t + F.lit(tolerance))
    return pairs.withColumn("bands", bands)


def gap_tails(pairs: DataFrame, dep: str, levels: tuple[float, ...] = (10.0, 20.0, 30.0)) -> DataFrame:
    """90th percentile (interpolated) of a difference and how many pairs pass each level, in percentage points."""
    size = F.abs(F.col(f"d_{dep}")) * 100.0
    return pairs.agg(F.count("*").alias("pairs"), F.percentile(size, 0.9).alias("p90"), *[F.count_if(size > level).alias(f"over_{level:.0f}") for level in levels])


def closest(pairs: DataFrame, most_pp: float, deps: tuple[str, str], k: int = 5, tolerance: float = 0.0) -> DataFrame:
    """The k pairs within a gap whose differences add up to most."""
    total = (F.abs(F.col(f"d_{deps[0]}")) + F.abs(F.col(f"d_{deps[1]}"))).alias("spread")
    inside = pairs.where(F.col("gap_pp") <= F.lit(most_pp) + F.lit(tolerance)).select("model_a", "model_b", "gap_pp", total)
    return inside.orderBy(F.desc("spread"), "model_a", "model_b").limit(k)


def substituted_predictors(table: DataFrame, predictors: tuple[str, ...] = ("PFC", "PSC")) -> DataFrame:
    """Every audit factor against every downstream factor: the rows of the one with the predictors of the other, by model."""
    audit = table.select("model_id", F.col("factor").alias("audit_factor"), *predictors)
    return table.drop(*predictors).withColumnRenamed("factor", "downstream_factor").join(audit, "model_id")


def primary_table(audit: DataFrame, static: DataFrame, utility: DataFrame, families: DataFrame, factors: tuple[str, ...] | None = None, primary_n: int = 8) -> DataFrame:
    """The strict three-way merge on (model_id, factor): a missing side, an unknown factor or a missing family raises.

    Duplicate keys raise as well; the check is part of the plan, not a second job.
    """
    keys = ["model_id", "factor"]
    once = lambda df, values: df.groupBy(*keys).agg(F.count("*").alias("_rows"), *[F.first(v).alias(v) for v in values])
    a = once(audit, ["PFC", "PSC"]).withColumnRenamed("_rows", "_a")
    s = once(static.withColumnRenamed("n", "n_static"), ["A", "n_static"]).withColumnRenamed("_rows", "_s")
    u = once(utility.where(F.col("N") == primary_n).withColumnRenamed("n_pools", "n_downstream"), ["U", "n_downstream"]).withColumnRenamed("_rows", "_u")
    both = a.join(s, keys, "full").join(u, keys, "full").join(families.select("model_id", "family"), "model_id", "left")
    known = F.col("factor").isin(*factors) if factors else F.lit(True)
    wrong = F.coalesce((F.col("_a") == 1) & (F.col("_s") == 1) & (F.col("_u") == 1) & known & F.col("family").isNotNull(), F.lit(False))
    checked = F.when(wrong, F.col("model_id")).otherwise(F.raise_error(F.concat(F.lit("incomplete or repeated key: "), F.coalesce("model_id", F.lit("?")), F.lit(" "), F.coalesce("factor", F.lit("?")))).cast("string"))
    return both.select(checked.alias("model_id"), "factor", "family", "A", "PFC", "PSC", "U", "n_static", "n_downstream", F.lit(primary_n).alias("primary_n"))


def reconstruction(canonical: DataFrame, recomputed: DataFrame, keys: list[str], metrics: tuple[str, ...], tolerance: float = TOLERANCE) -> DataFrame:
    """Long table of both values, their absolute difference and whether they agree; two nulls agree, one doesn't."""
    long = lambda df, name: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics])).alias("e")).select(*keys, "e.*")
    both = long(canonical, "canonical").join(long(recomputed, "recomputed"), [*keys, "metric"], "full")
    agree = F.when(F.col("canonical").isNull() | F.col("recomputed").isNull(), F.col("canonical").isNull() & F.col("recomputed").isNull()).otherwise(F.abs(F.col("canonical") - F.col("recomputed")) <= tolerance)
    return both.withColumns({"difference": F.abs(F.col("canonical") - F.col("recomputed")), "agrees": agree})


def paired_items(left: DataFrame, right: DataFrame, item: str, value: str) -> DataFrame:
    """The items that both judges have, with both values."""
    return left.select(item, F.col(value).alias("left_value")).join(right.select(item, F.col(value).alias("right_value")), item)


def common_support(done: DataFrame, model_a: str, model_b: str) -> DataFrame:
    """Conditional rates of two judges over the triplets on which both are right at the base."""
    pick = lambda m, p: done.where((F.col("model_id") == m) & (F.col("c_b") == 1)).select("triplet_id", "factor", F.col("c_r").alias(f"r_{p}"), F.col("c_i").alias(f"i_{p}"))
    both = pick(model_a, "a").join(pick(model_b, "b"), ["triplet_id", "factor"])
    return both.groupBy("factor").agg(F.count("*").alias("n"), *[F.avg(f"{x}_{p}").alias(f"{'RA' if x == 'r' else 'II'}_{p}") for x in "ri" for p in "ab"])


def finite(*columns: str) -> Column:
    """Whether all values are numbers; one that isn't voids its whole group."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != F.lit(float("inf")))
    return F.coalesce(ok, F.lit(False))
