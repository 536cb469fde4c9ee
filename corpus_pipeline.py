"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, personal data is replaced,
sources are put in the order of a mix to target weights, and all of it is packed into sequences along that order.

Every stage takes (spark, docs, sf_dir), works on all rows of docs and returns the columns of docs, under whatever names a
caller has beside those of documents, with their values; the last one returns the packed pieces. A stage's result is written
as Parquet and read again as the next one's docs. A table without rows gives none in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import mixing, ngram_join, packing, pii, toxicity
from assayer.llm.common import documents, every, forget, fresh, stored

TOXIC_FROM = 0.5


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC_FROM. The model learns from labelled rows that aren't held out.

    A null or empty text scores the class prior; a null id stays or goes by its text; repeated rows stay or go together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out())
    score = fresh(docs, "_toxicity")
    return toxicity.score(docs, toxicity.fit(docs, labels), into=score).where(F.col(score) < TOXIC_FROM).select(*every(docs))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Rows that repeat an id count as one document: the one with the least text stays, of equal texts any one. A null id stays,
    however often; a null or empty text is like no other and stays.
    """
    heads = ngram_join.near_groups(docs.select("doc_id", "text")).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(heads, "doc_id", "left_semi")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    once = kept.join(repeated, "doc_id", "left_anti").select(*every(docs))
    row = F.struct(*every(docs))
    many = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.coalesce("text", F.lit(""))).alias("kept")).select("kept.*")
    return once.union(many).union(docs.where("doc_id is null"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data in its text replaced by the kind in angle brackets; n_chars follows. A null text stays null,
    and so does its n_chars; repeated rows are treated alike."""
    return pii.redacted(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*every(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of the slots of a mix in which no source has more than mixing.MAX_SHARE of the characters.

    A source with a larger share goes on after the others have run dry; documents without a slot, those of sources without
    any characters, come last. Null sources are one source; ties are in the order of id and text; repeated rows all stay.
    """
    mix = fresh(docs, "_mix")
    order = (F.col(f"{mix}.slot").asc_nulls_last(), F.col("doc_id"), F.xxhash64("text"))
    return mixing.mixed(docs, into=mix).orderBy(*order).select(*every(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of at most packing.CAPACITY tokens; pieces arrive in the order of docs' files.

    A null or empty text is one piece of length 1; null ids and repeated rows are packed as often as they occur.
    """
    return packing.best_fit_in_order(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("personal_data", personal_data_stage),
    ("source_mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL has neither the model nor the schedule nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. A stage's table goes when the next one's is written."""
    docs, before = documents(spark, sf_dir), None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
