"""Sinks: JSON lines, CSV, write-once and atomic publication, repair. A table is written beside its place and renamed."""

from __future__ import annotations

import json
import tempfile
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .readers import _path, exists, jsonl


def guard(path: str, official: tuple[str, ...], allow: bool = False) -> str:
    """The path, unless it lies in an official folder and that isn't allowed."""
    if not allow and any(part in path.split("/") for part in official):
        raise ValueError(f"refusing to write to an official folder: {path}")
    return path


def guard_synthetic(df: DataFrame, flag: str = "synthetic") -> DataFrame:
    """The same rows; a synthetic one raises when it is written."""
    return df.withColumn(flag, F.when(F.coalesce(F.col(flag), F.lit(False)), F.raise_error(F.lit("a synthetic row in official output")).cast("boolean")).otherwise(F.col(flag)))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir; a local session without one gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="assayer-shared-"))
    return sc.getCheckpointDir()


def put_in_place(spark: SparkSession, beside: str, path: str) -> None:
    """Rename a written table to its path; an older one there is renamed aside first and deleted last, so it is never lost."""
    fs, target = _path(spark, path)
    aside = _path(spark, f"{path}.old-{uuid.uuid4().hex}")[1]
    had = fs.exists(target)
    if had and not fs.rename(target, aside):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(_path(spark, beside)[1], target):
        if had:
            fs.rename(aside, target)
        raise OSError(f"could not publish {path}")
    if had:
        fs.delete(aside, True)


def publish(df: DataFrame, path: str, form: str = "json", **options: str) -> None:
    """Write beside the path and rename: readers see the old table or the new one, never a part, and none for the moment between
    two renames at most. A crash in that moment leaves both tables, the old one under a name that ends in .old-*."""
    spark = df.sparkSession
    beside = f"{path}.writing-{uuid.uuid4().hex}"
    df.write.options(**options).format(form).save(beside)
    put_in_place(spark, beside, path)


def publish_gated(df: DataFrame, path: str, gates: dict[str, tuple[Column, Any]], form: str = "parquet", **options: str) -> dict[str, Any]:
    """Publish df if every gate, an aggregate and the value it has to have, holds; else raise and leave path as it was.

    The aggregates are observed in the pass that writes, so nothing is read twice. Returns what was observed.
    """
    spark = df.sparkSession
    beside = f"{path}.writing-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, *[c.alias(name) for name, (c, _) in gates.items()]).write.options(**options).format(form).save(beside)
    found = seen.get
    if failed := [f"{name}: {found[name]}, not {want}" for name, (_, want) in gates.items() if found[name] != want]:
        fs, place = _path(spark, beside)
        fs.delete(place, True)
        raise ValueError(f"not published, {'; '.join(failed)}")
    put_in_place(spark, beside, path)
    return found


def write_jsonl(df: DataFrame, path: str, ascii_only: bool = False) -> None:
    """JSON lines; ascii_only writes every other character as an escape."""
    if not ascii_only:
        df.write.mode("overwrite").json(path)
        return
    line = F.to_json(F.struct(*df.columns))
    units = F.encode(line, "UTF-16BE")
    escaped = F.array_join(F.transform(F.regexp_extract_all(F.hex(units), F.lit("(.{4})"), F.lit(1)), lambda u: F.when(u < "0080", F.char(F.conv(u, 16, 10).cast("int"))).otherwise(F.concat(F.lit("\\u"), F.lower(u)))), "")
    df.select(F.when(line.rlike(r"^\p{ASCII}*$"), line).otherwise(escaped).alias("value")).write.mode("overwrite").text(path)


def content_hash(df: DataFrame) -> str:
    """A digest of a table's rows in any order: equal tables have equal digests."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    halves = [F.sum(F.conv(F.substring(row, at, 12), 16, 10).cast("decimal(38,0)")) for at in (1, 13, 25, 37, 49)]
    out = df.agg(F.count("*").alias("n"), *[h.alias(f"h{i}") for i, h in enumerate(halves)]).first()
    return "-".join(str(v or 0) for v in out)


def write_once(df: DataFrame, path: str, form: str = "parquet") -> bool:
    """Write a table that never changes: True if written, False if the same is there; other contents raise."""
    spark = df.sparkSession
    if not exists(spark, path):
        publish(df, path, form)
        return True
    if content_hash(spark.read.schema(df.schema).format(form).load(path)) != content_hash(df):
        raise ValueError(f"{path} exists with other contents")
    return False


def text_once(spark: SparkSession, path: str, text: str | bytes) -> bool:
    """Write a small text, or bytes, that never change, such as a receipt; same result as write_once."""
    content = text.encode() if isinstance(text, str) else text
    fs, p = _path(spark, path)
    if fs.exists(p):
        stream = fs.open(p)
        try:
            now = bytes(stream.readAllBytes())
        finally:
            stream.close()
        if now != content:
            raise ValueError(f"{path} exists with other contents")
        return False
    beside = _path(spark, f"{path}.writing-{uuid.uuid4().hex}")[1]
    out = fs.create(beside)
    try:
        out.write(content)
    finally:
        out.close()
    if not fs.rename(beside, p):
        raise OSError(f"could not publish {path}")
    return True


def canonical_json(payload: Any) -> str:
    """JSON with sorted keys and no spaces, for hashing small documents on the driver."""
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def repair_jsonl(spark: SparkSession, path: str, schema: str) -> int:
    """Rewrite a JSON-lines table without the lines that don't parse; how many went."""
    before = spark.read.text(path).where(F.trim("value") != "").count()
    good = jsonl(spark, path, schema)
    beside = f"{path}.repaired-{uuid.uuid4().hex}"
    good.write.json(beside)
    after = jsonl(spark, beside, schema).count()
    put_in_place(spark, beside, path)
    return before - after


def flat(df: DataFrame, fields: list[str] | None = None, array_separator: str | None = None) -> DataFrame:
    """Columns that CSV can hold: nested values as JSON, or arrays of strings joined by a separator."""

    def written(f: T.StructField) -> Column:
        if array_separator is not None and isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            return F.array_join(f.name, array_separator).alias(f.name)
        return F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name)

    chosen = [f for f in df.schema.fields if fields is None or f.name in fields]
    order = fields or [f.name for f in chosen]
    return df.select(*[written(f) for f in chosen]).select(*[c if c in df.columns else F.lit(None).cast("string").alias(c) for c in order])


def write_csv(df: DataFrame, path: str, fields: list[str] | None = None, array_separator: str | None = None) -> None:
    """A CSV with a header; fields that the table lacks are empty, other columns are left out."""
    flat(df, fields, array_separator).write.mode("overwrite").option("header", "true").csv(path)


def report_rows(df: DataFrame, form: str = "markdown", most: int = 200) -> str:
    """A small report table as Markdown or LaTeX text; a table with more rows raises."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("not a report table")
    cells = [["" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in rows]
    if form == "latex":
        return "\n".join(" & ".join(r) + r" \\" for r in [df.columns, *cells])
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *cells])
