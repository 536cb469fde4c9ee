"""Preference graphs that a judge answers: only missing edges are asked, answers are kept in a journal, selections follow.

The journal is a Parquet table that grows by whole runs. An edge in it is never asked again, whatever its answer was, but for
edges whose call failed, which have no outcome. Every run reads what it wrote, so a judge is called once for each edge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import pair_outcome
from ..sources.readers import exists
from . import bestofn
from .judging import Judge, ScalarJudge, run_items, run_scores
from .merging import growing

ENDS = ("left_uid", "right_uid")


def missing_edges(pairs: DataFrame, answered: DataFrame | None, keys: tuple[str, ...] = ("pool_id",)) -> DataFrame:
    """Pairs without an outcome so far."""
    on = [*keys, *ENDS]
    return pairs if answered is None else pairs.join(growing(answered.where("outcome is not null").select(*on)), on, "left_anti")


def asked(pairs: DataFrame, make: Callable[[], Judge], keys: tuple[str, ...] = ("pool_id",)) -> DataFrame:
    """The judge's answer to every pair (columns question, left_text, right_text, image_path): outcome, status and message.

    An answer that doesn't parse is an abstention and has an outcome; a failed call has none.
    """
    on = [*keys, *ENDS]
    items = pairs.select(F.to_json(F.struct(*on)).alias("item_id"), "question", F.col("left_text").alias("candidate_a"), F.col("right_text").alias("candidate_b"), "image_path")
    rows = run_items(items, make)
    outcome = F.when(F.col("status").isin("ok", "parse_error"), pair_outcome("parsed_preference"))
    ends = F.from_json("item_id", pairs.select(*on).schema)
    return rows.select(ends.alias("e"), outcome.alias("outcome"), "status", "message").select("e.*", "outcome", "status", "message")


def pairwise_graph(pairs: DataFrame, make: Callable[[], Judge], journal: str, keys: tuple[str, ...] = ("pool_id",)) -> DataFrame:
    """Answers to all pairs: those in the journal, and the missing ones asked and appended to it when this is called, so that the
    result only reads. Runs that share a journal have to come one after the other; at once, each would ask what both miss."""
    spark = pairs.sparkSession
    columns = [*keys, *ENDS, "outcome", "status", "message"]
    before = spark.read.parquet(journal) if exists(spark, journal) else None
    asked(missing_edges(pairs, before, keys), make, keys).select(*columns).write.mode("append").parquet(journal)
    answers = spark.read.parquet(journal)
    # A failed call may have been repeated: of several rows of an edge the one with an outcome counts.
    best = answers.groupBy(*keys, *ENDS).agg(F.min_by(F.struct("outcome", "status", "message"), F.struct(F.col("outcome").isNull(), "status")).alias("r"))
    return pairs.join(growing(best.select(*keys, *ENDS, "r.*")), [*keys, *ENDS])


def run_pools(cands: DataFrame, make: Callable[[], Judge], journal: str, keys: tuple[str, ...] = ("pool_id",), salts: tuple[str, str] = ("orientation", "tie")) -> DataFrame:
    """Winners of the 2-, 4- and 8-subsets of each pool from one graph, status ok; a pool with a failed edge is one failure row.

    cands has keys, uid, text, is_gold, level, question and image_path; question and image_path are those of the pool.
    """
    own = cands.groupBy(*keys).agg(F.first("question").alias("question"), F.first("image_path").alias("image_path"))
    pairs = bestofn.pool_pairs(cands, ("text", "level"), salts[0], keys).join(growing(own), list(keys))
    graph = pairwise_graph(pairs.withColumn("level", F.greatest("left_level", "right_level")), make, journal, keys)
    return _selected(cands, graph, _failures(graph, "outcome", ENDS, keys), keys, salts[1])


def _failures(rows: DataFrame, value: str, order: tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    """One failed call of each pool that has any: the first in order."""
    return rows.where(F.col(value).isNull()).groupBy(*keys).agg(F.min_by(F.struct("status", "message"), F.struct(*order)).alias("f")).select(*keys, "f.*")


def _selected(cands: DataFrame, graph: DataFrame, failed: DataFrame, keys: tuple[str, ...], salt: str) -> DataFrame:
    whole = graph.join(growing(failed.select(*keys)), list(keys), "left_anti")
    chosen = bestofn.selections(cands, whole, keys, salt)
    chosen = chosen.select(*keys, "n", "selected_uid", "gold_uid", "success", "n_pairs", "ties", "semantic_abstentions", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("message"))
    return chosen.unionByName(failed, allowMissingColumns=True)


def candidate_scores(cands: DataFrame, make: Callable[[], ScalarJudge], journal: str, keys: tuple[str, ...] = ("pool_id",)) -> DataFrame:
    """cands with score, status and message: scores in the journal, and missing ones asked when this is called, one call for each
    candidate. A failed call has no score and is asked again by the next run."""
    spark, on = cands.sparkSession, [*keys, "uid"]
    todo = cands.select(*on, "question", F.col("text").alias("candidate"), "image_path").dropDuplicates(on)
    if exists(spark, journal):
        todo = todo.join(growing(spark.read.parquet(journal).where("score IS NOT NULL").select(*on)), on, "left_anti")
    rows = run_scores(todo.select(F.to_json(F.struct(*on)).alias("item_id"), "question", "candidate", "image_path"), make)
    rows = rows.select(F.from_json("item_id", cands.select(*on).schema).alias("e"), "score", "status", "message").select("e.*", "score", "status", "message")
    rows.write.mode("append").parquet(journal)
    best = spark.read.parquet(journal).groupBy(*on).agg(F.min_by(F.struct("score", "status", "message"), F.struct(F.col("score").isNull(), "status")).alias("r"))
    return cands.drop("score", "status", "message").join(growing(best.select(*on, "r.*")), on)


def score_pools(cands: DataFrame, make: Callable[[], ScalarJudge], journal: str, keys: tuple[str, ...] = ("pool_id",), salts: tuple[str, str] = ("orientation", "tie")) -> DataFrame:
    """As run_pools, by a judge that scores candidates: 8 calls for a pool of 8 instead of 28, pairs come from a join."""
    scored = candidate_scores(cands, make, journal, keys)
    failed = _failures(scored, "score", ("uid",), keys)
    graph = bestofn.scalar_graph(scored.join(growing(failed.select(*keys)), list(keys), "left_anti"), salt=salts[0], keys=keys)
    return _selected(cands, graph, failed, keys, salts[1])
