"""Ordered deduplication, merging of shards and resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each key in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def last_wins(df: DataFrame, keys: list[str], seq: Column) -> DataFrame:
    """The last row of each key: an aggregate, so rows are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(*keys, "_r.*")


def merge_shards(shards: DataFrame, order: list[str | Column], model: str = "model_id", item: str = "item_id", compare: tuple[str, ...] = ("parsed_preference", "status")) -> tuple[DataFrame, DataFrame]:
    """(merged rows, one report row). The first row of a key stays; a later one with other values is a conflict."""
    ordered = Window.partitionBy(model, item).orderBy(*order)
    same = F.lit(True)
    for c in compare:
        same = same & F.col(c).eqNullSafe(F.first(c).over(ordered))
    ranked = shards.withColumns({"_n": F.row_number().over(ordered), "_same": same})
    merged = ranked.where("_n = 1").drop("_n", "_same").withColumn("key", F.concat_ws("::", model, item))
    report = ranked.agg(F.count("*").alias("n_input_rows"), F.count_if(F.expr("_n = 1")).alias("n_merged"), F.count_if(F.expr("_n > 1")).alias("n_duplicates"), F.count_if(F.expr("_n > 1") & ~F.col("_same")).alias("n_conflicts"))
    return merged, report


def conflicts(shards: DataFrame, order: list[str | Column], model: str = "model_id", item: str = "item_id", compare: tuple[str, ...] = ("parsed_preference", "status")) -> DataFrame:
    """Keys whose rows disagree, with how many later rows differ from the first."""
    ordered = Window.partitionBy(model, item).orderBy(*order)
    differs = F.lit(False)
    for c in compare:
        differs = differs | ~F.col(c).eqNullSafe(F.first(c).over(ordered))
    return shards.withColumn("_d", differs).groupBy(model, item).agg(F.count_if(F.expr("_d")).alias("conflicts")).where("conflicts > 0")


def growing(df: DataFrame) -> DataFrame:
    """df for a side of a join that has as many rows as the data. Spark guesses sizes from files, and rows that are made of a
    file's can be many times that; the hint keeps such a side from being collected on the driver and broadcast."""
    return df.hint("merge")


def remaining(items: DataFrame, done: DataFrame, key: str | list[str]) -> DataFrame:
    """Items still to do: not completed, and of repeated ids one."""
    keys = [key] if isinstance(key, str) else key
    return items.dropDuplicates(keys).join(growing(done.select(*keys)), keys, "left_anti")


def completed_pools(selections: DataFrame, sizes: tuple[int, ...] = (2, 4, 8)) -> DataFrame:
    """Pools with a selection for every size."""
    have = selections.where("status = 'ok'").groupBy("pool_id").agg(F.collect_set("n").alias("_n"))
    return have.where(F.forall(F.array(*[F.lit(n) for n in sizes]), lambda n: F.array_contains("_n", n))).select("pool_id")


def appended(journal: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows to append, conflicts): a new key is appended, an identical row ignored, a different one a conflict."""
    values = [c for c in new.columns if c != key]
    both = new.alias("n").join(journal.alias("j"), key, "left")
    same = F.lit(True)
    for c in values:
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"j.{c}"))
    known = journal.select(key, F.lit(True).alias("_known"))
    fresh = new.join(known, key, "left_anti").dropDuplicates([key])
    return fresh, both.join(known, key, "left_semi").where(~same).select(key)
