"""Scenes and question programs: normalised steps, names and attributes of objects, substitutions, seeded orders."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .expressions import close, col, even_digest, sha

#: Schema of a scene's object and of a program's step; a field that a source lacks is null.
OBJECT = "struct<name: string, attributes: array<string>>"
STEP = "struct<operation: string, func: string, op: string, argument: string, arg: string>"


def _filled(*values: Column) -> Column:
    """The first value that isn't null or blank."""
    return F.coalesce(*[F.when(F.trim(v) != "", v) for v in values], F.lit(""))


def program_steps(steps: str | Column) -> Column:
    """Steps of a program as (op, arg), whatever their fields are called; the operation in lower case without blanks."""
    op = lambda s: F.lower(F.replace(_filled(s["operation"], s["func"], s["op"]), F.lit(" "), F.lit("")))
    return F.transform(F.coalesce(col(steps), F.array().cast(f"array<{STEP}>")), lambda s: F.struct(op(s).alias("op"), F.trim(_filled(s["argument"], s["arg"])).alias("arg")))


def program_ops(steps: str | Column) -> Column:
    return F.transform(program_steps(steps), lambda s: s["op"])


def program_args(steps: str | Column) -> Column:
    """All arguments in lower case, as one text that rules search."""
    return F.lower(F.array_join(F.transform(program_steps(steps), lambda s: s["arg"]), ","))


def scene_objects(by_id: str | Column, listed: str | Column) -> Column:
    """Objects of a scene that has them by id, else as a list."""
    none = F.array().cast(f"array<{OBJECT}>")
    return F.coalesce(F.map_values(col(by_id)), col(listed), none)


def scene_names(objects: Column) -> Column:
    """Distinct names of the objects, in order."""
    return F.array_distinct(F.filter(F.transform(objects, lambda o: F.trim(o["name"])), lambda n: F.coalesce(n, F.lit("")) != ""))


def scene_attributes(objects: Column) -> Column:
    """Distinct attributes of the objects, in order."""
    lists = F.transform(objects, lambda o: F.coalesce(o["attributes"], F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.transform(F.flatten(lists), lambda a: F.trim(a)), lambda a: F.coalesce(a, F.lit("")) != ""))


def scene_attribute(by_id: str | Column, annotated: str | Column, answer: str | Column) -> Column:
    """An attribute other than the answer: of the annotated objects first, then of any; null if the scene has none."""
    scene = col(by_id)
    named = F.filter(F.transform(F.coalesce(col(annotated), F.array().cast("array<string>")), lambda i: F.try_element_at(scene, i)), lambda o: o.isNotNull())
    ordered = scene_attributes(F.concat(named, scene_objects(scene, F.lit(None).cast(f"array<{OBJECT}>"))))
    return F.get(F.filter(ordered, lambda a: F.lower(a) != F.lower(F.trim(col(answer)))), F.lit(0))


def pairwise_order(key: str | Column, gold: str | Column, other: str | Column, salt: str = "pairwise") -> dict[str, Column]:
    """candidate_a, candidate_b and the preferred letter: gold comes first where a salted digest of the key is even."""
    first = even_digest(sha(F.lit(salt), col(key).cast("string")))
    gold, other = col(gold), col(other)
    return {"candidate_a": F.when(first, gold).otherwise(other), "candidate_b": F.when(first, other).otherwise(gold), "expected_preference": F.when(first, "A").otherwise("B")}


def shuffled(values: Column, key: str | Column, salt: str = "shuffle") -> Column:
    """The values in the order of salted digests of key and value."""
    keyed = F.transform(values, lambda v: F.struct(sha(F.lit(salt), col(key).cast("string"), v.cast("string")).alias("h"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda x: x["v"])


def same_magnitude(relevant: str | Column, irrelevant: str | Column, tolerance: float = 0.05) -> Column:
    """Whether two edits change about the same share of pixels; false where one is unknown."""
    return F.coalesce(col(relevant).isNotNull() & close(relevant, irrelevant, tolerance), F.lit(False))


def canonical(c: str | Column) -> Column:
    """JSON of a map with its keys sorted and no spaces, for hashing rows; nulls are written."""
    entries = F.array_sort(F.map_entries(col(c)))
    return F.to_json(F.map_from_entries(entries), {"ignoreNullFields": "false"})


def _quoted(c: Column) -> Column:
    """A JSON string in ASCII: escapes as Python's dumps writes them."""
    short = {"0022": '\\"', "005C": "\\\\", "0008": "\\b", "000C": "\\f", "000A": "\\n", "000D": "\\r", "0009": "\\t"}

    def unit(u: Column) -> Column:
        out = F.when(u == "0022", short["0022"])
        for k, v in list(short.items())[1:]:
            out = out.when(u == k, v)
        return out.when((u >= "0020") & (u <= "007E"), F.char(F.conv(u, 16, 10).cast("int"))).otherwise(F.concat(F.lit("\\u"), F.lower(u)))

    escaped = F.array_join(F.transform(F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit("(.{4})"), F.lit(1)), unit), "")
    return F.concat(F.lit('"'), F.when(c.rlike(r"^[ !#-\[\]-~]*$"), c).otherwise(escaped), F.lit('"'))


def _has(kind: T.DataType, wanted: tuple[type, ...]) -> bool:
    inner = [f.dataType for f in kind.fields] if isinstance(kind, T.StructType) else [kind.elementType] if isinstance(kind, T.ArrayType) else [kind.keyType, kind.valueType] if isinstance(kind, T.MapType) else []
    return isinstance(kind, wanted) or any(_has(k, wanted) for k in inner)


def _dumped(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(_quoted(F.lit(f.name)), F.lit(":"), _dumped(c.getField(f.name), f.dataType)) for f in fields]
        out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.MapType):
        pairs = F.transform(F.array_sort(F.map_keys(c)), lambda k: F.concat(_quoted(k.cast("string")), F.lit(":"), _dumped(F.element_at(c, k), kind.valueType)))
        out = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: _dumped(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        out = c.cast("string")
    else:
        out = _quoted(c.cast("string"))
    return F.when(c.isNull(), F.lit("null")).otherwise(out)


def _sorted_dump(written: pd.Series) -> pd.Series:
    return written.map(lambda s: json.dumps(json.loads(s)[0], sort_keys=True, separators=(",", ":")))


def canonical_json(c: str | Column, kind: T.DataType) -> Column:
    """JSON of a value of any depth with all keys sorted, without spaces and in ASCII, as Python's sorted dump of it.

    kind is the column's type. Built from JVM functions; only values that hold fractions, whose shortest digits the JVM doesn't
    write, go through Python in batches. Dates and other types without JSON of their own are strings, NaN is one too.
    """
    if _has(kind, (T.DoubleType, T.FloatType)):
        return F.pandas_udf(_sorted_dump, T.StringType())(F.to_json(F.array(col(c)), {"ignoreNullFields": "false"}))
    return _dumped(col(c), kind)
