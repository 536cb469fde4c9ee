"""Statistics on model-by-factor tables: least squares, leave-one-family-out, bootstrap, specificity and intervals.

Solves with several predictors, folds and the cluster bootstrap run per factor in grouped pandas functions; a group holds one
row for each judge. The paired bootstrap, whose items are many, draws each replicate from counts of equal differences.
Everything else is built-in aggregation.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import z_score

PIVOT = 1e-12


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """Solution of a linear system by elimination with the largest pivot of each column; None if one is below PIVOT."""
    work = np.column_stack([a.astype(float), b.astype(float)])
    size = len(b)
    for k in range(size):
        best = k + int(np.argmax(np.abs(work[k:, k])))
        if abs(work[best, k]) < PIVOT:
            return None
        work[[k, best]] = work[[best, k]]
        work[k] /= work[k, k]
        others = np.arange(size) != k
        work[others] -= np.outer(work[others, k], work[k])
    return work[:, -1]


def least_squares(y: np.ndarray, x: np.ndarray) -> np.ndarray | None:
    """Intercept and coefficients by the normal equations; None if they are singular."""
    full = np.column_stack([np.ones(len(y)), x])
    return solve(full.T @ full, full.T @ y)


def ols(df: DataFrame, by: list[str], y: str, predictors: list[str]) -> DataFrame:
    """Fit of y by group: beta, mae, rmse, r2 and n; a singular fit has nulls. r2 is null where y doesn't vary."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        target, x = pdf[y].to_numpy(float), pdf[predictors].to_numpy(float)
        beta = least_squares(target, x)
        row = {b: pdf[b].iloc[0] for b in by} | {"n": len(pdf), "beta": None, "mae": None, "rmse": None, "r2": None}
        if beta is not None:
            rest = target - np.column_stack([np.ones(len(target)), x]) @ beta
            total = float(((target - target.mean()) ** 2).sum())
            row |= {"beta": beta.tolist(), "mae": float(np.abs(rest).mean()), "rmse": float(np.sqrt((rest**2).mean())), "r2": None if total == 0 else 1 - float((rest**2).sum()) / total}
        return pd.DataFrame([row])

    schema = ", ".join(f"{b} {df.schema[b].dataType.simpleString()}" for b in by) + ", n long, beta array<double>, mae double, rmse double, r2 double"
    return df.select(*by, *[F.col(c).cast("double").alias(c) for c in (y, *predictors)]).groupBy(*by).applyInPandas(fit, schema)


def correlation(a: str, b: str) -> Column:
    """Pearson's correlation as an aggregate; null where one side doesn't vary."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def simple_regression(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """One predictor: slope, intercept, r2 and Pearson correlation by built-in aggregates."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), correlation(y, x).alias("pearson"))


def adjusted_r2(r2: Column, n: Column, predictors: int) -> Column:
    return 1 - (1 - r2) * (n - 1) / F.nullif(n - predictors - 1, F.lit(0))


M0, M1 = ["A"], ["A", "PFC", "PSC"]
FOLDS = "factor string, held_out string, n_train long, n_test long, m0_mae double, m0_rmse double, m1_mae double, m1_rmse double, reason string"


def held_out_error(train: pd.DataFrame, test: pd.DataFrame, columns: list[str], y: str) -> tuple[float, float] | None:
    beta = least_squares(train[y].to_numpy(float), train[columns].to_numpy(float))
    if beta is None:
        return None
    error = beta[0] + test[columns].to_numpy(float) @ beta[1:] - test[y].to_numpy(float)
    return float(np.abs(error).mean()), float(np.sqrt((error**2).mean()))


def leave_one_family_out(table: DataFrame, strict: bool = True, y: str = "U", family: str = "family") -> DataFrame:
    """A row for each factor and held-out family: errors of U ~ A and of U ~ A + PFC + PSC on the family.

    strict: a model needs as many training rows as coefficients, and a fold says why it has no fit. Otherwise a fold exists
    only with three training rows, and a singular system voids both models of the fold. A missing or non-finite metric
    voids the whole factor; no row is dropped.
    """

    def folds(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, factor = [], pdf["factor"].iloc[0]
        bad = not np.isfinite(pdf[[*M1, y]].to_numpy(float)).all()
        for held in sorted(pdf[family].unique()):
            train, test = pdf[pdf[family] != held], pdf[pdf[family] == held]
            row = {"factor": factor, "held_out": held, "n_train": len(train), "n_test": len(test), "m0_mae": None, "m0_rmse": None, "m1_mae": None, "m1_rmse": None, "reason": None}
            if bad:
                row["reason"] = "missing or non-finite metric"
            elif not strict and len(train) < 3:
                continue
            else:
                fits = [None if strict and len(train) < len(m) + 1 else held_out_error(train, test, m, y) for m in (M0, M1)]
                if not strict and None in fits:
                    fits = [None, None]
                for name, fit in zip(("m0", "m1"), fits, strict=True):
                    row[f"{name}_mae"], row[f"{name}_rmse"] = fit or (None, None)
                if None in fits:
                    row["reason"] = "too few training rows" if strict and len(train) < len(M1) + 1 else "singular"
            rows.append(row)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FOLDS.split(", ")])

    columns = ["factor", family, *[F.col(c).cast("double").alias(c) for c in (*M1, y)]]
    return table.select(*columns).groupBy("factor").applyInPandas(folds, FOLDS)


def incremental_validity(folds: DataFrame) -> DataFrame:
    """By factor: the mean gain in held-out error, only if every fold has both models."""
    gain = F.col("m0_mae") - F.col("m1_mae")
    out = folds.groupBy("factor").agg(F.count("*").alias("n_families"), F.count(gain).alias("_valid"), F.avg(gain).alias("_gain"))
    whole = F.col("_valid") == F.col("n_families")
    return out.select("factor", "n_families", F.when(whole, F.col("_gain")).alias("delta_mae"), F.when(whole, "ESTIMABLE").otherwise("NOT_IDENTIFIABLE").alias("status"))


def cluster_bootstrap(df: DataFrame, by: list[str], cluster: str, value: str, stat: Callable[[list[float]], float], n_boot: int = 1000, seed: int = 20260912, upper_exclusive: bool = False) -> DataFrame:
    """Percentile interval of a statistic over clusters drawn with replacement, by group.

    Clusters are drawn in sorted order by Python's generator, so a seed gives the same interval everywhere.
    """

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = {k: g[value].tolist() for k, g in pdf.groupby(cluster, sort=True)}
        names, source, samples = sorted(groups), random.Random(seed), []
        for _ in range(n_boot):
            samples.append(stat([v for name in source.choices(names, k=len(names)) for v in groups[name]]))
        samples.sort()
        high = int(0.975 * n_boot) - 1 if upper_exclusive else min(n_boot - 1, int(0.975 * n_boot))
        return pd.DataFrame([{b: pdf[b].iloc[0] for b in by} | {"observed": stat(pdf[value].tolist()), "low": samples[int(0.025 * n_boot)], "high": samples[high], "n_clusters": len(names)}])

    schema = ", ".join(f"{b} {df.schema[b].dataType.simpleString()}" for b in by) + ", observed double, low double, high double, n_clusters long"
    return df.select(*by, F.col(cluster).cast("string").alias(cluster), F.col(value).cast("double").alias(value)).groupBy(*by).applyInPandas(draw, schema)


#: Distinct differences that one task resamples together, and replicates that one row asks for.
BLOCK_VALUES, CHUNK_REPLICATES = 1 << 16, 500


def paired_bootstrap(pairs: DataFrame, by: list[str], left: str, right: str, n_boot: int = 10_000, seed: int = 20270915, block_values: int = BLOCK_VALUES) -> DataFrame:
    """Mean difference over shared items, in percentage points, with a percentile interval from resampled items.

    Equal differences are counted first. A resample of n items is a multinomial draw over those counts, each with the generator of
    its number. Right and wrong answers have three differences, however many items there are. Where there are many, they are dealt
    into blocks: how many items a block gets is a multinomial draw over the blocks, the same in every task, and the block draws its
    own from that; so no task holds all differences and nothing is broadcast.
    """
    d = ((F.col(left).cast("double") - F.col(right).cast("double")) * 100).alias("_d")
    each = pairs.select(*by, d).groupBy(*by, "_d").agg(F.count("*").alias("_n"))
    n_blocks = max(1, -(-each.count() // block_values))
    group = F.struct(*by).alias("_by") if by else F.lit(0).alias("_by")
    dealt = each.select(group, F.pmod(F.xxhash64("_d"), F.lit(n_blocks)).cast("int").alias("_b"), F.coalesce("_d", F.lit(math.nan)).alias("d"), F.col("_n").alias("n"))
    blocks = dealt.groupBy("_by", "_b").agg(F.sort_array(F.collect_list(F.struct("d", "n"))).alias("v"), F.sum("n").alias("_n"), F.sum(F.col("d") * F.col("n")).alias("_s"))
    totals = blocks.groupBy("_by").agg(F.sort_array(F.collect_list(F.struct("_b", "_n"))).alias("all"), F.sum("_n").alias("n_items"), (F.sum("_s") / F.sum("_n")).alias("difference_pp"))
    asked = blocks.join(totals.select("_by", "all"), "_by").select("_by", "_b", F.col("v.d").alias("d"), F.col("v.n").alias("n"), F.col("all._b").alias("bs"), F.col("all._n").alias("ns"), F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1), F.lit(CHUNK_REPLICATES))).alias("first"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                b, d, n, bs, ns, first = (batch.column(i)[row].as_py() for i in range(1, 7))
                d, n, ns = np.asarray(d, float), np.asarray(n, np.int64), np.asarray(ns, np.int64)
                own, sums = bs.index(b), []
                numbers = range(first, min(n_boot, first + CHUNK_REPLICATES))
                for i in numbers:
                    generator = np.random.default_rng([seed, i])
                    size = n.sum()
                    if len(bs) > 1:
                        size = generator.multinomial(ns.sum(), ns / ns.sum())[own]
                        generator = np.random.default_rng([seed, i, b])
                    drawn = generator.multinomial(size, n / n.sum())
                    sums.append((d * drawn)[drawn > 0].sum())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([row] * len(sums))), pa.array(list(numbers), pa.int32()), pa.array(sums, pa.float64())], names=["_by", "i", "s"])

    spread = asked.repartition(asked.sparkSession.sparkContext.defaultParallelism)
    drawn = spread.mapInArrow(draw, f"_by {dealt.schema['_by'].dataType.simpleString()}, i int, s double")
    sums = drawn.groupBy("_by", "i").agg(F.sum("s").alias("s")).join(totals.select("_by", "n_items"), "_by")
    means = sums.groupBy("_by").agg(F.sort_array(F.collect_list(F.col("s") / F.col("n_items"))).alias("_m"))
    at = lambda q: F.element_at("_m", int(q * n_boot) + 1)
    names = [F.col(f"_by.{b}").alias(b) for b in by]
    return means.join(totals, "_by").select(*names, "n_items", "difference_pp", at(0.025).alias("low"), at(0.975).alias("high"))


def analyze_factors(table: DataFrame, n_boot: int = 1000, seed: int = 20260912, strict: bool = True) -> DataFrame:
    """By factor: the mean gain in held-out error with a bootstrap interval over the held-out families; nulls where it isn't estimable."""
    folds = leave_one_family_out(table, strict)
    gains = folds.withColumn("gain", F.col("m0_mae") - F.col("m1_mae")).where("gain is not null")
    drawn = cluster_bootstrap(gains, ["factor"], "held_out", "gain", bootstrap_mean, n_boot, seed, upper_exclusive=True)
    both = incremental_validity(folds).join(drawn.select("factor", "low", "high"), "factor", "left")
    known = F.col("status") == "ESTIMABLE"
    return both.select("factor", "n_families", "delta_mae", *[F.when(known, F.col(c)).alias(c) for c in ("low", "high")], "status")


def nested_gains(table: DataFrame, by: list[str], y: str = "U", small: tuple[str, ...] = tuple(M0), large: tuple[str, ...] = tuple(M1)) -> DataFrame:
    """In-sample gain of more predictors by group: rise of R2 and fall of RMSE; null where a fit is singular."""
    a, b = (ols(table, by, y, list(m)).select(*by, F.col("r2").alias(f"r2_{n}"), F.col("rmse").alias(f"rmse_{n}")) for m, n in ((small, "small"), (large, "large")))
    return a.join(b, by).withColumns({"delta_r2": F.col("r2_large") - F.col("r2_small"), "delta_rmse": F.col("rmse_small") - F.col("rmse_large")})


def leave_one_model_out(table: DataFrame, y: str, x: str, by: str = "factor", model: str = "model_id") -> DataFrame:
    """Adjusted R2 of a one-predictor fit without each model in turn, by factor."""
    without = table.select(by, F.col(model).alias("left_out")).distinct()
    others = without.join(table, by).where(F.col(model) != F.col("left_out"))
    fits = simple_regression(others, [by, "left_out"], y, x)
    return fits.withColumn("adjusted_r2", adjusted_r2(F.col("r2"), F.col("n"), 1))


def regrouped(table: DataFrame, families: dict[str, str], column: str = "model_id") -> DataFrame:
    """The table with other families, such as those of the decoder; a model that has none keeps its own."""
    named = F.create_map(*[F.lit(x) for pair in families.items() for x in pair])
    return table.withColumn("family", F.coalesce(F.try_element_at(named, F.col(column)), F.col("family")))


def wald_ci(p: Column, n: Column) -> dict[str, Column]:
    """95 % interval of a share by the normal approximation, kept within 0 and 1."""
    half = 1.96 * F.sqrt(p * (1 - p) / F.nullif(n, F.lit(0)))
    return {"low": F.greatest(F.lit(0.0), p - half), "high": F.least(F.lit(1.0), p + half)}


def specificity(matrix: DataFrame, factors: tuple[str, ...]) -> DataFrame:
    """Mean of the diagonal and off it, raw and after standardising within each downstream factor. A repeated cell counts
    each time in the raw means, its last value in the standardised ones; one null cell voids the summary."""
    known = matrix.where(F.col("audit_factor").isin(*factors) & F.col("downstream_factor").isin(*factors))
    cells = known.groupBy("audit_factor", "downstream_factor").agg(F.last("score").alias("score"))
    z = cells.withColumn("z", z_score("score", ["downstream_factor"]))
    same = F.col("audit_factor") == F.col("downstream_factor")
    mean = lambda c, on: F.avg(F.when(on, F.col(c)))
    raw = matrix.agg(mean("score", same).alias("diagonal"), mean("score", ~same).alias("off_diagonal"), F.count_if(F.col("score").isNull()).alias("_null"))
    standard = z.agg(mean("z", same).alias("z_diagonal"), mean("z", ~same).alias("z_off_diagonal"))
    whole = F.col("_null") == 0
    both = raw.crossJoin(standard)  # one row each
    return both.select(*[F.when(whole, F.col(c)).alias(c) for c in ("diagonal", "off_diagonal", "z_diagonal", "z_off_diagonal")], F.when(whole, F.col("z_diagonal") - F.col("z_off_diagonal")).alias("z_difference"))


def contribution_matrix(table: DataFrame, substituted: DataFrame) -> DataFrame:
    """Gain of every audit factor's predictors on every downstream factor's utility."""
    named = substituted.withColumn("factor", F.concat_ws(">", "audit_factor", "downstream_factor"))
    gains = incremental_validity(leave_one_family_out(named))
    return gains.select(F.split("factor", ">")[0].alias("audit_factor"), F.split("factor", ">")[1].alias("downstream_factor"), F.col("delta_mae").alias("score"), "status")


def bootstrap_mean(values: list[float]) -> float:
    return math.fsum(values) / len(values)


def cost_projection(stages: DataFrame, price_per_hour: float, workers: tuple[int, ...] = (1, 2, 4)) -> DataFrame:
    """Hours and price of each stage (items * candidates / rate), and wall hours by number of workers; no rate, no estimate."""
    hours = F.col("items") * F.coalesce("candidates", F.lit(1)) / F.nullif(F.col("rate"), F.lit(0.0)) / 3600.0
    return stages.withColumns({"gpu_hours": hours, "price": hours * price_per_hour, **{f"wall_hours_{w}": hours / w for w in workers}})
