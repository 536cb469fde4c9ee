"""A command line over the operators: each verb reads tables from files, runs one operator and writes the result.

    python -m assayer audit-metrics --judgments j.jsonl --expected manifest.jsonl --out metrics.parquet
    spark-submit -m assayer ...  # or with the cluster's settings

Inputs are JSON lines (.jsonl, or a folder of them), JSON documents (.json), CSV with a header (.csv) or Parquet (anything else);
schemas are declared, not inferred. --out is written the same way, by its ending, beside its place first and put there whole.
An existing output is replaced; one in a folder of official results is refused without --allow-official.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import matching, triplets
from .operators import statistics as S
from .schemas import FACTORS, SCHEMAS
from .sources import readers, writers

#: Names of folders whose contents are results of record.
OFFICIAL = ("official", "results")
MATRIX = "audit_factor string, downstream_factor string, score double"


def read(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, Column]:
    """The table at a path, and what orders its rows as they are written."""
    order = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    if not readers.exists(spark, path):
        raise FileNotFoundError(path)
    if path.endswith(".json"):
        return readers.json_items(spark, path, schema), F.monotonically_increasing_id()
    if path.endswith(".jsonl"):
        return readers.jsonl(spark, path, schema, strict=True), order
    if path.endswith(".csv"):
        return spark.read.schema(schema).option("header", "true").option("mode", "FAILFAST").csv(path), order
    return spark.read.schema(schema).parquet(path), order


def write(df: DataFrame, path: str) -> None:
    form = "csv" if path.endswith(".csv") else "json" if path.endswith((".json", ".jsonl")) else "parquet"
    writers.publish(writers.flat(df) if form == "csv" else df, path, form, **({"header": "true"} if form == "csv" else {}))


def audit_metrics(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Rates by model and factor from judgments and the manifest with the expected preferences."""
    judgments, order = read(spark, args.judgments, SCHEMAS["judgments"])
    expected, expected_order = read(spark, args.expected, SCHEMAS["audit_manifest"])
    gold = triplets.gold_pivot(expected.withColumn("_seq", expected_order), F.col("_seq"))
    return triplets.audit_metrics(triplets.complete(triplets.pivoted(judgments.withColumn("_seq", order), F.col("_seq")), gold))


def static_accuracy(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Accuracy by model and factor from static judgments."""
    return triplets.static_accuracy(read(spark, args.judgments, SCHEMAS["judgments"] + ", expected_preference string, gold_preference string")[0])


def downstream_utility(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Utility by model, factor and pool size from selections."""
    return triplets.utility(read(spark, args.selections, SCHEMAS["selections"])[0])


def matched_pairs(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Pairs of models in accuracy bands, by factor, from a table of metrics."""
    table = read(spark, args.table, SCHEMAS["primary_table"])[0]
    return matching.in_bands(matching.model_pairs(table, deps=tuple(args.deps)), tuple(args.bands))


def incremental(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """By factor: the gain in held-out error, one family left out at a time."""
    return S.incremental_validity(S.leave_one_family_out(read(spark, args.table, SCHEMAS["primary_table"])[0]))


def specificity(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Diagonal against the rest of a factor matrix."""
    return S.specificity(read(spark, args.table, MATRIX)[0], tuple(args.factors))


def bootstrap(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Interval of a mean over families drawn with replacement."""
    table = read(spark, args.table, SCHEMAS["primary_table"])[0].withColumn("statistic", F.lit(args.stat_key))
    return S.cluster_bootstrap(table, ["statistic"], "family", args.stat_key, S.bootstrap_mean, args.n_boot, args.seed)


#: Verb: what it runs and its inputs.
VERBS: dict[str, tuple[Callable[[SparkSession, argparse.Namespace], DataFrame], tuple[str, ...]]] = {
    "audit-metrics": (audit_metrics, ("--judgments", "--expected")),
    "static-A": (static_accuracy, ("--judgments",)),
    "downstream-U": (downstream_utility, ("--selections",)),
    "matched-pairs": (matched_pairs, ("--table",)),
    "incremental": (incremental, ("--table",)),
    "specificity": (specificity, ("--table",)),
    "bootstrap": (bootstrap, ("--table",)),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="assayer", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    verbs = out.add_subparsers(dest="verb", required=True)
    for name, (f, inputs) in VERBS.items():
        p = verbs.add_parser(name, help=f.__doc__)
        for i in (*inputs, "--out"):
            p.add_argument(i, required=True)
        p.add_argument("--allow-official", action="store_true")
        if name == "matched-pairs":
            p.add_argument("--bands", type=float, nargs="+", default=[1.0, 2.0, 3.0])
            p.add_argument("--deps", nargs="+", default=["PFC", "PSC"])
        elif name == "specificity":
            p.add_argument("--factors", nargs="+", default=list(FACTORS))
        elif name == "bootstrap":
            p.add_argument("--stat-key", default="U")
            p.add_argument("--n-boot", type=int, default=200)
            p.add_argument("--seed", type=int, default=20260912)
    return out


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    writers.guard(args.out, OFFICIAL, args.allow_official)
    own = spark or SparkSession.builder.appName(f"assayer {args.verb}").getOrCreate()
    write(VERBS[args.verb][0](own, args), args.out)
    print(f"wrote {args.out}")
    return 0
