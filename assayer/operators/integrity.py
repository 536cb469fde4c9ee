"""Integrity of tables: disjointness, coverage, equality, receipts and dependencies. Each check returns the rows that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broken(problems: DataFrame, what: str) -> None:
    """Raise with the first problems if there are any; only those rows come to the driver."""
    found = problems.limit(3).collect()
    if found:
        raise ValueError(f"{what}: {[r.asDict() for r in found]}")


def split_overlaps(df: DataFrame, split: str, identities: list[str]) -> DataFrame:
    """How many values of each identity two splits share: one grouped pass for each identity, not an intersection for each pair."""
    parts = []
    for name in identities:
        held = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("_v")).agg(F.array_sort(F.collect_set(split)).alias("_s")).where(F.size("_s") > 1)
        pairs = F.flatten(F.transform("_s", lambda a, i: F.transform(F.slice("_s", i + 2, F.size("_s")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
        parts.append(held.select(F.explode(pairs).alias("p")).groupBy(F.lit(name).alias("identity"), F.col("p.a").alias("split_a"), F.col("p.b").alias("split_b")).agg(F.count("*").alias("shared")))
    return reduce(DataFrame.unionByName, parts)


def coverage(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has: missing or unexpected. Empty when the sets are equal."""
    missing = required.select(key).distinct().join(present.select(key), key, "left_anti").withColumn("problem", F.lit("missing"))
    return missing.union(present.select(key).distinct().join(required.select(key), key, "left_anti").withColumn("problem", F.lit("unexpected")))


def missing_values(df: DataFrame, group: str, value: str, wanted: tuple[str, ...]) -> DataFrame:
    """Groups that lack one of the wanted values or repeat one, with the values missing."""
    want = F.array(*[F.lit(w) for w in wanted])
    out = df.groupBy(group).agg(F.array_sort(F.array_except(want, F.collect_set(value))).alias("missing"), (F.count(value) - F.count_distinct(value)).alias("repeated"))
    return out.where((F.size("missing") > 0) | (F.col("repeated") > 0))


def row_difference(left: DataFrame, right: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Rows that one side has more often than the other, apart from ignored columns."""
    a, b = left.drop(*ignore), right.drop(*ignore)
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))


def dependency_violations(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with several values where one is allowed."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(value).alias("values")).where("values > 1")


def duplicate_groups(df: DataFrame, identity: str, member: str) -> DataFrame:
    """Identities that several members share, with the members in order."""
    return df.groupBy(identity).agg(F.count("*").alias("members"), F.concat_ws("|", F.array_sort(F.collect_list(member))).alias("names")).where("members > 1")


def cross_split_groups(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that occur in more than one split."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(split).alias("splits"), F.count("*").alias("rows")).where("splits > 1")


def receipts(df: DataFrame, path: str, content: str) -> DataFrame:
    """Path, size and SHA-256 of contents."""
    return df.select(F.col(path).alias("path"), F.octet_length(content).cast("long").alias("bytes"), F.sha2(content, 256).alias("sha256"))


def receipt_problems(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Files whose receipt is missing, unexpected or different."""
    both = expected.alias("e").join(actual.alias("a"), "path", "full")
    problem = F.when(F.col("a.sha256").isNull(), "missing").when(F.col("e.sha256").isNull(), "unexpected").when((F.col("a.sha256") != F.col("e.sha256")) | (F.col("a.bytes") != F.col("e.bytes")), "different")
    return both.select("path", problem.alias("problem")).where("problem is not null")


def contract_differences(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys of both sides whose selected fields differ, with the names of those that do."""
    both = a.select(key, F.struct(*fields).alias("_a")).join(b.select(key, F.struct(*fields).alias("_b")), key)
    differ = F.array_compact(F.array(*[F.when(~F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}")), f) for f in fields]))
    return both.select(key, differ.alias("fields")).where(F.size("fields") > 0)


def field_presence(df: DataFrame, map_col: str) -> DataFrame:
    """How many rows have each key of an open-ended map."""
    return df.select(F.explode(F.map_keys(map_col)).alias("field")).groupBy("field").agg(F.count("*").alias("rows"))
