"""Scans: JSON lines and documents, keyed maps, CSV indexes, directories and binary files. Schemas are declared."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import split_json


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines. A missing path is an empty table; bad lines are dropped anywhere, or raise if strict."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def json_items(spark: SparkSession, path: str | list[str], item: str, wrappers: tuple[str, ...] = ("items", "records", "triplets")) -> DataFrame:
    """Rows of JSON documents of any size and layout: a bare list, or a list under one of the wrappers (the first filled one)."""
    found = split_json.pieces(spark, path, list_level=1, map_level=2)
    bare = F.trim("container") == "["
    name = F.regexp_extract("container", r'^\s*[{]?\s*"([^"\\]*)"\s*:\s*\[$', 1)
    rank = F.array_position(F.array(*[F.lit(w) for w in wrappers]), name)
    found = found.withColumn("rank", F.when(bare, 1).otherwise(rank)).where("rank > 0")
    if len(wrappers) > 1:
        first = found.groupBy("file").agg(F.min("rank").alias("rank"))
        found = found.join(first, ["file", "rank"], "left_semi")
    return found.select(F.from_json("piece", item, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def _given_order(spark: SparkSession, paths: list[str], file: Column) -> Column:
    """The place in paths of the one that a file comes from; its own name orders files of one path."""
    rank, file = F.lit(len(paths)), F.regexp_replace(file, "^file:/+", "file:/")
    for i in reversed(range(len(paths))):
        fs, p = _path(spark, paths[i])
        for s in fs.globStatus(p) or []:
            own = re.sub("^file:/+", "file:/", s.getPath().toUri().toString())
            rank = F.when((file == own) | file.startswith(own.rstrip("/") + "/"), i).otherwise(rank)
    return rank


def json_map(spark: SparkSession, path: str | list[str], value: str, key: str = "id") -> DataFrame:
    """JSON objects of any size and layout whose keys are ids: one row for each, the key as a column.

    A key of a later document wins, in the order of path where that is a list, by file name within a path; so does a later entry
    of the same document.
    """
    found = split_json.pieces(spark, path, list_level=0, map_level=1)
    entry = F.from_json(F.concat(F.lit("{"), "piece", F.lit("}")), f"map<string, struct<{T.StructType.fromDDL(value).simpleString()[7:-1]}>>", {"mode": "FAILFAST"})
    paths = path if isinstance(path, list) else [path]
    at = F.struct(_given_order(spark, paths, F.col("file")).alias("path"), "file", "split", "at").alias("_at")
    rows = found.select(at, F.explode(entry).alias(key, "_v"))
    return rows.groupBy(key).agg(F.max_by("_v", "_at").alias("_v")).select(key, "_v.*")


def tree(spark: SparkSession, path: str, names: tuple[str, ...], schema: str) -> DataFrame:
    """Rows of all files below a path whose name, or whose folder's, is one of names, with the file's path."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path).select("*", F.col("_metadata.file_path").alias("file_path"))
    parts = F.split("file_path", "/")
    return rows.where(F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names])))


def tagged_directory(spark: SparkSession, path: str, schema: str, glob: str = "*.json*") -> DataFrame:
    """All files under a directory with the file's name, and test or train by that name."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).json(path).select("*", F.col("_metadata.file_name").alias("file_name"))
    return rows.withColumn("split", F.when(F.lower("file_name").contains("test"), "test").otherwise("train"))


def csv_index(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """A CSV table by key; the last line of a repeated key counts."""
    rows = spark.read.schema(schema).option("header", "true").csv(path)
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rest = [c for c in rows.columns if c not in keys]
    return rows.withColumn("_at", place).groupBy(*keys).agg(F.max_by(F.struct(*rest), "_at").alias("_r")).select(*keys, "_r.*")


def found_files(spark: SparkSession, directory: str, preferences: tuple[str, ...]) -> list[str]:
    """Files of a directory whose names hold the first preference that any name holds, else all, in order."""
    fs, p = _path(spark, directory)
    names = sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isFile()) if fs.exists(p) else []
    for wanted in preferences:
        if hits := [n for n in names if wanted in n.rpartition("/")[2]]:
            return hits
    return names


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, name, length, modificationTime and content of all files under a path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return rows.withColumn("name", F.substring_index("path", "/", -1))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and SHA-256 of every file, in order of path."""
    return files(spark, path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).orderBy("path")


def by_basename(listing: DataFrame) -> DataFrame:
    """Files, or members of archives, by name; a name that occurs twice raises when it is read."""
    one = listing.groupBy("name").agg(F.count("*").alias("_n"), F.first("path").alias("path"))
    return one.select("name", F.when(F.col("_n") == 1, F.col("path")).otherwise(F.raise_error(F.concat(F.lit("ambiguous file name: "), "name")).cast("string")).alias("path"))


def required_files(required: DataFrame, listing: DataFrame) -> DataFrame:
    """A row for each required or present name: missing, unexpected, empty, duplicate or ok, with size and digest."""
    have = listing.select("name", F.lit(True).alias("_have"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    have = have.withColumn("_same", F.count("*").over(Window.partitionBy("sha256")))
    both = required.select("name", F.lit(True).alias("_want")).join(have, "name", "full")
    status = F.when(F.col("_have").isNull(), "missing").when(F.col("_want").isNull(), "unexpected").when(F.col("bytes") == 0, "empty").when(F.col("_same") > 1, "duplicate").otherwise("ok")
    return both.select("name", "bytes", "sha256", status.alias("status"))


def resolved(items: DataFrame, listing: DataFrame, roots: list[str], name: Column) -> DataFrame:
    """items with the path of the first root that has their file; null if none has."""
    rank = reduce(lambda acc, i: acc.when(F.col("path").contains(roots[i]), i), range(len(roots)), F).otherwise(len(roots))
    best = listing.groupBy("name").agg(F.min_by("path", F.struct(rank, "path")).alias("resolved_path"))
    return items.withColumn("_name", name).join(best, F.col("_name") == best["name"], "left").drop("_name", "name")


def raw_filename(image: str | Column) -> Column:
    """vg:12 and 12 both name the file 12.jpg."""
    c = F.regexp_replace(F.col(image) if isinstance(image, str) else image, "^vg:", "")
    return F.when(F.substring_index(c, "/", -1).contains("."), F.substring_index(c, "/", -1)).otherwise(F.concat(c, F.lit(".jpg")))


def latest_file(listing: DataFrame) -> DataFrame:
    """Name of the newest file of each folder, and how many it holds."""
    folder = F.substring_index("path", "/", -2)
    return listing.groupBy(F.substring_index(folder, "/", 1).alias("folder")).agg(F.max_by("name", F.struct("modificationTime", "name")).alias("latest"), F.count("*").alias("files"))


def quiet(listing: DataFrame, seconds: int = 60) -> DataFrame:
    """One row: whether every file is older than so many seconds."""
    return listing.agg((F.max("modificationTime") < F.current_timestamp() - F.make_dt_interval(secs=F.lit(seconds))).alias("ready"))
