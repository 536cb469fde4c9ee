"""Checks of stored results: selections derived again, bundles of files, provenance of rows, published values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import close
from .bestofn import selections

#: Rows of both sides that one task of provenance_problems gets, about.
ROWS_PER_TASK = 1 << 19
REPEATED = 4096
CHOSEN = ("n", "selected_uid", "success")


def rederived(stored: DataFrame, cands: DataFrame, graph: DataFrame, keys: tuple[str, ...] = ("pool_id",), salt: str = "tie") -> DataFrame:
    """Stored selections that differ from those that the graph gives, and those that only one side has: keys, n, both winners, what."""
    again = selections(cands, graph, keys, salt).select(*keys, "n", F.col("selected_uid").alias("derived_uid"), F.col("success").alias("derived_success"))
    both = stored.select(*keys, "n", "selected_uid", "success", F.lit(True).alias("_stored")).join(again.withColumn("_derived", F.lit(True)), [*keys, "n"], "full")
    what = (
        F.when(F.col("_stored").isNull(), "not stored")
        .when(F.col("_derived").isNull(), "not derived")
        .when(~F.col("selected_uid").eqNullSafe(F.col("derived_uid")), "another winner")
        .when(~F.col("success").eqNullSafe(F.col("derived_success")), "another success")
    )
    return both.select(*keys, "n", "selected_uid", "derived_uid", what.alias("problem")).where("problem is not null")


def bundle_problems(required: DataFrame, present: DataFrame, references: DataFrame, checksums: DataFrame, splits: DataFrame) -> DataFrame:
    """(check, name) for what is wrong with a bundle.

    required and references have a name that must be present; present has name and sha256; checksums the sha256 that a name
    should have; splits has split and name, and a name in two splits is an overlap.
    """
    have = present.select("name", "sha256")
    listed = lambda df, check: df.select("name").distinct().join(have.select("name"), "name", "left_anti").select(F.lit(check).alias("check"), "name")
    wrong = checksums.select("name", F.col("sha256").alias("_want")).join(have, "name").where("sha256 <> _want").select(F.lit("checksum").alias("check"), "name")
    twice = splits.groupBy("name").agg(F.count_distinct("split").alias("_n")).where("_n > 1").select(F.lit("overlap").alias("check"), "name")
    return reduce(DataFrame.union, [listed(required, "missing file"), listed(references, "missing image"), wrong, twice])


def _times(df: DataFrame, n: Column) -> DataFrame:
    """Each row n times; a large n in two steps, so that no array is longer than REPEATED unless n is over its square."""
    many = df.withColumn("_n", n).where("_n > 0").withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(REPEATED).cast("long"))))
    return many.withColumn("_at", F.explode(F.array_repeat(F.lit(0), F.least(F.col("_n") - F.col("_at"), F.lit(REPEATED)).cast("int")))).drop("_n", "_at")


def provenance_problems(rows: DataFrame, source: DataFrame, key: str, fields: tuple[str, ...], statuses: tuple[str, ...], status: str = "status") -> DataFrame:
    """(check, key) for rows without a source, sources without a row, repeated keys, unknown statuses and fields that differ.

    Both sides are counted when this is called, and dealt out once by key into so many tasks that one gets about ROWS_PER_TASK
    rows, whatever their number. A null key has no partner on the other side.
    """
    tagged = rows.select(F.col(key).alias("_key"), *fields, F.lit(1).alias("_r"), F.lit(0).alias("_s")).union(source.select(F.col(key).alias("_key"), *fields, F.lit(0).alias("_r"), F.lit(1).alias("_s")))
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tagged.count() // ROWS_PER_TASK))
    alike = tagged.repartition(tasks, "_key").groupBy("_key", *fields).agg(F.sum("_r").alias("_r"), F.sum("_s").alias("_s"))
    keys = alike.groupBy("_key").agg(F.sum("_r").alias("_r"), F.sum("_s").alias("_s"), F.sum(F.col("_r") * F.col("_s")).alias("_same"))
    r, s, same, null = F.col("_r"), F.col("_s"), F.col("_same"), F.col("_key").isNull()
    counts = {
        "unknown item": F.when(null | (s == 0), r),
        "missing item": F.when(null | (r == 0), s),
        "repeated item": (r > 1).cast("long"),
        "other fields": F.when(~null, r * s - same),
    }
    found = keys.select(F.col("_key").cast("string").alias(key), F.explode(F.array(*[F.struct(F.lit(check).alias("check"), F.coalesce(n, F.lit(0)).cast("long").alias("n")) for check, n in counts.items()])).alias("_c"))
    dealt = _times(found, F.col("_c.n")).select("_c.check", key)
    return dealt.union(rows.where(~F.coalesce(F.col(status).isin(*statuses), F.lit(False))).select(F.lit("unknown status").alias("check"), F.col(key).cast("string").alias(key)))


def certificates(values: DataFrame, published: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Every published value beside the recomputed one (columns name, value), and whether they agree; a missing one doesn't."""
    both = published.select("name", F.col("value").alias("published")).join(values.select("name", F.col("value").alias("recomputed")), "name", "left")
    return both.withColumn("agrees", F.col("recomputed").isNotNull() & close("published", "recomputed", tolerance))
