"""Judges: the adapter's interface, a deterministic stand-in, and runs that keep failures as rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import even_digest, parse_ab
from .merging import remaining


class Judge(Protocol):
    """One judge model; a worker loads it once and passes rows through it."""

    def load(self) -> None: ...

    def judge(self, question: str, candidate_a: str, candidate_b: str, image_path: str | None) -> str | dict: ...

    def close(self) -> None: ...


class ScalarJudge(Protocol):
    """A judge that scores one candidate at a time; pairs follow from scores."""

    def load(self) -> None: ...

    def score_candidate(self, image_path: str | None, question: str, candidate: str) -> float: ...

    def close(self) -> None: ...


def stand_in(question: str | Column, image_path: str | Column) -> Column:
    """A deterministic preference: the parity of the first eight hex digits of a digest of question and image."""
    text = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    digest = F.sha2(F.concat_ws("|", text(question), text(image_path)), 256)
    return F.when(even_digest(F.left(digest, F.lit(8))), "A").otherwise("B")


def failure(error: BaseException) -> str:
    """Status of a failed call: oom, timeout or error."""
    if isinstance(error, MemoryError) or "oom" in str(error).lower() or "out of memory" in str(error).lower():
        return "oom"
    return "timeout" if isinstance(error, TimeoutError) else "error"


JUDGED = "item_id string, raw_output string, status string, message string"


def _rows(call: Callable[[object, object], tuple], make: Callable[[], object], columns: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Passes each row through one loaded judge; a failed call is a row with its status and message."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = make()
        judge.load()
        try:
            for pdf in batches:
                rows = []
                for r in pdf.itertuples():
                    try:
                        rows.append((r.item_id, call(judge, r), "ok", None))
                    except Exception as error:  # every failure of a judge is data
                        rows.append((r.item_id, None, failure(error), str(error)[:500]))
                yield pd.DataFrame(rows, columns=columns)
        finally:
            judge.close()

    return run


def _answer(judge: Judge, r) -> str:
    answer = judge.judge(r.question, r.candidate_a, r.candidate_b, r.image_path)
    return answer["raw_output"] if isinstance(answer, dict) else str(answer)


def run_items(items: DataFrame, make: Callable[[], Judge], done: DataFrame | None = None) -> DataFrame:
    """Judge each item that isn't done, once. A failure is a row with its status; an answer that doesn't parse is parse_error
    and isn't asked again."""
    todo = items if done is None else remaining(items, done, "item_id")
    out = todo.select("item_id", "question", "candidate_a", "candidate_b", "image_path").mapInPandas(_rows(_answer, make, ["item_id", "raw_output", "status", "message"]), JUDGED)
    out = out.withColumn("parsed_preference", parse_ab("raw_output"))
    return out.withColumn("status", F.when((F.col("status") == "ok") & F.col("parsed_preference").isNull(), "parse_error").otherwise(F.col("status")))


SCORED = "item_id string, score double, status string, message string"


def _score(judge: ScalarJudge, r) -> float:
    score = float(judge.score_candidate(r.image_path, r.question, r.candidate))
    if not math.isfinite(score):
        raise ValueError(f"score {score}")
    return score


def run_scores(items: DataFrame, make: Callable[[], ScalarJudge]) -> DataFrame:
    """The score of each candidate (columns item_id, question, candidate, image_path), one call each. A failure, or a score that
    isn't a finite number, is a row with its status."""
    return items.select("item_id", "question", "candidate", "image_path").mapInPandas(_rows(_score, make, ["item_id", "score", "status", "message"]), SCORED)
