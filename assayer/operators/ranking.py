"""Ordered choices: first N per group, hash samples, interleaving, shards, average ranks and z-scores.

Every order is explicit; where a file's order matters the caller passes a sequence column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.writers import shared_folder


def first_per_group(df: DataFrame, by: list[str], order: list[str | Column], n: int, whole_groups_only: bool = False) -> DataFrame:
    """The first n rows of each group; with whole_groups_only, none of a group that has fewer."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    if whole_groups_only:
        ranked = ranked.withColumn("_size", F.count("*").over(Window.partitionBy(*by))).where(F.col("_size") >= n).drop("_size")
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def first_unique(df: DataFrame, unique: str, order: list[str | Column], n: int) -> DataFrame:
    """The first n rows in order that bring a new value of unique."""
    firsts = df.withColumn("_first", F.row_number().over(Window.partitionBy(unique).orderBy(*order))).where("_first = 1").drop("_first")
    return firsts.orderBy(*order).limit(n)


def balanced(df: DataFrame, flag: str, order: list[str | Column], n: int, by: list[str]) -> DataFrame:
    """n rows per group, half with and half without the flag, gaps filled from the rest in order."""
    half = Window.partitionBy(*by, flag).orderBy(*order)
    quota = F.when(F.col(flag), n // 2).otherwise(n - n // 2)
    ranked = df.withColumn("_late", (F.row_number().over(half) > quota).cast("int"))
    return first_per_group(ranked, by, ["_late", *order], n).drop("_late")


def hash_sample(df: DataFrame, by: list[str], key: str, n: int, seed: int) -> DataFrame:
    """n rows per group in the order of a seeded digest of the key."""
    return first_per_group(df, by, [F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key], n)


def round_robin(df: DataFrame, buckets: list[str], order: list[str | Column], n: int) -> DataFrame:
    """n rows, one of each bucket in turn."""
    turn = F.row_number().over(Window.partitionBy(*buckets).orderBy(*order))
    return df.withColumn("turn", turn).orderBy("turn", *buckets).limit(n)


def enum_position(value: str, names: tuple[str, ...]) -> Column:
    """Place of a value in a fixed list, for sorting; unknown values come last."""
    at = F.array_position(F.array(*[F.lit(x) for x in names]), F.col(value))
    return F.when(at == 0, len(names) + 1).otherwise(at)


def shard(df: DataFrame, order: list[str | Column], shards: int, k: int) -> DataFrame:
    """Every shards-th row of the ordered list, from the k-th on; rows that tie in order are in no set order.

    Rows are dealt out by range; a range counts its own rows and starts after those of the ranges before it, which are a row each.
    """
    first = order[0] if isinstance(order[0], Column) else F.col(order[0])
    shared_folder(df.sparkSession)
    ranged = df.repartitionByRange(first).withColumn("_range", F.spark_partition_id()).checkpoint()
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = sizes.select("_range", F.coalesce(F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1 + F.col("_before")
    return ranged.join(F.broadcast(before), "_range").withColumn("_at", at).where(F.col("_at") % shards == k).drop("_at", "_range", "_before")


def average_rank(value: str, by: list[str]) -> Column:
    """Rank from 1, ties share the mean of their places."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0


def z_score(value: str, by: list[str]) -> Column:
    """Distance from the group's mean in population standard deviations; a group without spread uses 1."""
    group = Window.partitionBy(*by)
    sd = F.stddev_pop(value).over(group)
    return (F.col(value) - F.avg(value).over(group)) / F.when(sd > 0, sd).otherwise(1.0)


def top_margin(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Largest value, second largest and their difference; null where there is no second."""
    per = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    top = per.groupBy(*by).agg(F.max(value).alias("top"), F.max_by("_n", value).alias("_n"))
    on = [F.col(f"v.{b}").eqNullSafe(F.col(f"t.{b}")) for b in by]
    rest = per.alias("v").join(top.alias("t"), [*on, F.col(f"v.{value}") < F.col("t.top")]).groupBy(*[F.col(f"v.{b}").alias(b) for b in by]).agg(F.max(f"v.{value}").alias("_below"))
    both = top.alias("t").join(rest.alias("r"), [F.col(f"t.{b}").eqNullSafe(F.col(f"r.{b}")) for b in by], "left")
    second = F.when(F.col("t._n") > 1, F.col("t.top")).otherwise(F.col("r._below"))
    return both.select(*[F.col(f"t.{b}").alias(b) for b in by], F.col("t.top").alias("top"), second.alias("second"), (F.col("t.top") - second).alias("margin"))


def frequency(df: DataFrame, by: list[str], value: str, seq: str) -> DataFrame:
    """How often each value occurs, and where it is seen first: the order of equal counts."""
    return df.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(seq).alias("first_seen"))
