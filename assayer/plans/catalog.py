"""The catalogue that queries enter themselves into, by name, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Enter a function under its own name."""

    def enter(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return enter


def r6(c: str | Column) -> Column:
    """Rounded for comparison between engines, whose sums differ in the last bits."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(f"`{n}`").alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]
