"""Building of item tables: cleaning, static selection, carriers, balanced picks without shared images, pools, mapping reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import col, normal, whole_number
from ..sources.writers import shared_folder
from .ranking import first_per_group

COUNT_WORDS = ("how many", "number of", "count")


def looks_like_count(question: str | Column) -> Column:
    """Whether a question asks for a number of things."""
    q = F.lower(F.coalesce(col(question), F.lit("")))
    out = F.lit(False)
    for words in COUNT_WORDS:
        out = out | q.contains(words)
    return out


def cleaned(rows: DataFrame, sources: tuple[str, ...], question: str = "question", answer: str = "answer", source: str = "source") -> DataFrame:
    """Rows with a whole number as answer, a question that asks for one, and a known source; gold is the number."""
    gold = whole_number(answer)
    ok = gold.isNotNull() & (F.trim(F.coalesce(col(question), F.lit(""))) != "") & looks_like_count(question) & col(source).isin(*sources)
    return rows.withColumn("gold", gold).where(ok)


def selected_static(rows: DataFrame, split: DataFrame, image: str, factors: tuple[str, ...], factor: str = "factor", answer: str = "answer", negative: str = "hard_negative") -> DataFrame:
    """Rows of the factors whose image is in the split and whose hard negative differs from the answer, case aside."""
    usable = col(factor).isin(*factors) & (F.coalesce(F.trim(col(negative)), F.lit("")) != "") & (normal(negative) != normal(answer))
    return rows.where(usable).join(split.select(image), image, "left_semi")


def carrier(factor: str | Column) -> Column:
    """Counting questions come from one source, all others from another."""
    return F.when(col(factor) == "count", "tallyqa").otherwise("gqa")


def with_carrier(rows: DataFrame, factor: str = "factor", given: str | None = None) -> DataFrame:
    """rows with their carrier; where a carrier is given and differs, reading raises."""
    own = carrier(factor)
    if given:
        own = F.when(F.coalesce(col(given) == own, F.lit(True)), own).otherwise(F.raise_error(F.concat(F.lit("wrong carrier "), F.coalesce(col(given), F.lit("?")), F.lit(" for factor "), F.coalesce(col(factor), F.lit("?")))).cast("string"))
    return rows.withColumn("carrier", own)


def all_carriers(static: DataFrame, downstream: DataFrame) -> DataFrame:
    """Both tables in one, missing columns null."""
    return static.unionByName(downstream, allowMissingColumns=True)


def balanced_unshared(rows: DataFrame, flag: str, image: str, order: list[str | Column], n: int, by: list[str], used: DataFrame | None = None) -> DataFrame:
    """n rows per group, half with and half without the flag, gaps filled from the rest, no image twice and none that is used.

    Groups pick in order of by, each of its halves and its rest in order, and an image goes to the first row that picks it; one
    that a row didn't need stays free for the next. The result is that of picking one after the other, in rounds: all groups pick
    at once, leaving out what earlier groups picked in the round before, until no pick changes. After k rounds the first k groups
    are final, and without an image that two groups want the first round is. Of a group only rows that can be picked take part.
    """
    place, own = F.struct(*order).alias("_o"), F.struct(*by)
    dealt = rows.withColumns({"_f": F.coalesce(F.col(flag), F.lit(False)), "_o": place, "_by": own})
    sizes = dealt.groupBy("_by").agg(F.count_if("_f").alias("_yes"), F.count_if(~F.col("_f")).alias("_no"))
    n_yes = F.least(F.lit(n // 2), F.col("_yes"))
    sizes = sizes.select("_by", n_yes.alias("_n1"), F.least(n - n_yes, F.col("_no")).alias("_n2"))
    free = dealt if used is None else dealt.join(used.select(image), image, "left_anti")
    # The first row of each kind that has an image in a group.
    row = F.struct(*[F.col(c) for c in rows.columns])
    firsts = free.where(F.col(image).isNotNull()).groupBy("_by", F.col(image).alias("_image"), "_f").agg(F.min("_o").alias("_o"), F.min_by(row, "_o").alias("_row"))
    firsts = firsts.join(sizes, "_by")
    shared_folder(rows.sparkSession)
    now = None
    while True:
        open_ = firsts
        if now is not None:
            taken = now.groupBy("_image").agg(F.min("_by").alias("_taken"))
            open_ = firsts.join(taken, "_image", "left").where(F.col("_taken").isNull() | (F.col("_taken") >= F.col("_by"))).drop("_taken")
        picked = _picked(open_, n).checkpoint()
        if now is None:
            if picked.groupBy("_image").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
                break
        elif picked.select("_by", "_image", "_o").exceptAll(now.select("_by", "_image", "_o")).isEmpty():
            break
        now = picked
    return picked.select("_row.*")


def _picked(firsts: DataFrame, n: int) -> DataFrame:
    """A group's picks from its images: _n1 rows with the flag, _n2 without it, then whatever comes first up to n rows."""
    group = Window.partitionBy("_by")
    # An image of the other half is lost to at most n picks, so the first 2n images of each kind are enough.
    near = firsts.withColumn("_k", F.row_number().over(Window.partitionBy("_by", "_f").orderBy("_o"))).where(F.col("_k") <= 2 * n)
    images = near.groupBy("_by", "_image").agg(*[F.max(F.when(F.col("_f") == f, F.struct("_o", "_row"))).alias(c) for f, c in ((True, "_with"), (False, "_without"))], F.first("_n1").alias("_n1"), F.first("_n2").alias("_n2"))
    rank = lambda c: F.row_number().over(group.orderBy(F.col(c).isNull(), F.col(f"{c}._o")))
    one = F.col("_with").isNotNull() & (rank("_with") <= F.col("_n1"))
    images = images.withColumn("_one", one).withColumn("_second", F.when(~F.col("_one"), F.col("_without")))
    images = images.withColumn("_two", F.col("_second").isNotNull() & (rank("_second") <= F.col("_n2")))
    first = F.when(F.col("_with._o") < F.col("_without._o"), F.col("_with")).otherwise(F.coalesce("_without", "_with"))
    images = images.withColumns({"_third": F.when(~F.col("_one") & ~F.col("_two"), first), "_so_far": F.count_if(F.col("_one") | F.col("_two")).over(group)})
    three = F.col("_third").isNotNull() & (rank("_third") <= n - F.col("_so_far"))
    pick = F.when(F.col("_one"), F.col("_with")).when(F.col("_two"), F.col("_without")).when(three, F.col("_third"))
    return images.select("_by", "_image", pick.alias("_p")).where("_p IS NOT NULL").select("_by", "_image", "_p._o", "_p._row")


def coverage(rows: DataFrame, by: str, value: str, values: tuple[str, ...]) -> DataFrame:
    """How many rows of each group have each value; zero where none has."""
    return rows.groupBy(by).pivot(value, list(values)).count().na.fill(0)


def family_counts(models: DataFrame, family: str = "family") -> DataFrame:
    """Usable primary models of each family."""
    return models.where("fast_track_primary and status <> 'INCOMPATIBLE'").groupBy(family).agg(F.count("*").alias("models"))


def routed(rows: DataFrame, resolved: Column) -> tuple[DataFrame, DataFrame]:
    """(resolved rows, the rest); an unknown condition isn't resolved."""
    ok = F.coalesce(resolved, F.lit(False))
    return rows.where(ok), rows.where(~ok)


def mapping_report(mapped: DataFrame, by: tuple[str, ...] = ("factor", "mapping_source", "mapping_confidence")) -> DataFrame:
    """Questions and resolved hard negatives by how they were mapped; unmapped ones have a null factor."""
    solved = F.coalesce(F.col("hard_negative_type") != "unresolved", F.lit(False))
    return mapped.groupBy(*by).agg(F.count("*").alias("questions"), F.count_if(solved).alias("resolved"))


def mapping_sample(mapped: DataFrame, key: str, n: int, seed: int = 20260912) -> DataFrame:
    """n mapped questions of each factor for a quality check, in the order of a seeded digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    return first_per_group(mapped.where("factor is not null"), ["factor"], [digest, key], n)
