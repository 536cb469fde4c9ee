"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text in a group that one Python task holds whole.
GROUP_BYTES = 8 << 20
#: Rows of an Arrow batch that a Python task turns into Python objects at once.
SLICE_ROWS = 512
#: Spark's setting by which a query deletes its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def every(df: DataFrame) -> list[Column]:
    """All columns of df, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def fresh(df: DataFrame, stem: str) -> str:
    """stem, with as many underscores before it as keep every column of df from starting with it; for work columns."""
    while any(c.lower().startswith(stem.lower()) for c in df.columns):
        stem = "_" + stem
    return stem


def with_checkpoints(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names in spark.checkpoint.dir; a local session without one gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="assayer-checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder, without their lineage."""
    with_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same rows from a table written to the shared checkpoint folder; compressed, unlike a checkpoint. The shuffle files
    of the write go when it ends, as the table takes their place; else they stay until the driver collects its garbage."""
    spark = df.sparkSession
    with_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _deleted(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def forget(*frames: DataFrame) -> None:
    """Delete the files behind results of `cut` or `stored` that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        files = df.inputFiles()
        if files:
            _deleted(spark, files[0].rsplit("/", 1)[0])
            continue
        plan = df._jdf.queryExecution().logical()
        if plan.getClass().getSimpleName() == "LogicalRDD" and plan.rdd().getCheckpointFile().isDefined():
            _deleted(spark, plan.rdd().getCheckpointFile().get())


def n_groups(spark: SparkSession, size: int = 0) -> int:
    """Groups for so many bytes of text: one for each shuffle partition at least, of GROUP_BYTES at most where texts are shorter."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // GROUP_BYTES))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long"))).first()[0] or 0


def bytes_list(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of every text; a null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, SLICE_ROWS at a time: what a worker makes of a batch in Python, and sends back, stays small. At the end Arrow
    gives back what it has freed; a worker outlives its task, and the memory is other stages' then."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)
    pa.default_memory_pool().release_unused()


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Hashing of byte strings by polynomials modulo 2**64 with one random 64-bit value for each byte value. The base is odd, so
#: its powers have inverses and any stretch of a prefix sum can be moved to position 0.
SEGMENT = 1 << 20
_RNG = np.random.default_rng(0x5EED)
BYTE_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TABLES: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """BASE**i and its inverse for every position in a segment, made once in each worker."""
    if not _TABLES:
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            out = np.ones(SEGMENT + 1, np.uint64)
            n = 1
            while n < len(out):
                step = np.uint64(pow(base, n, 1 << 64))
                some = min(n, len(out) - n)
                out[n : n + some] = out[:some] * step
                n += some
            _TABLES.append(out)
    return _TABLES


def _prefix_sums(segment: np.ndarray) -> np.ndarray:
    power, _ = _powers()
    out = np.zeros(len(segment) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[segment] * power[: len(segment)], out=out[1:])
    return out


def gram_hashes(data: bytes, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes from every position on."""
    raw = np.frombuffer(data, np.uint8)
    n = max(0, len(raw) - k + 1)
    out = np.empty(n, np.uint64)
    step = SEGMENT - k + 1
    for at in range(0, n, step):
        sums = _prefix_sums(raw[at : at + SEGMENT])
        some = min(step, n - at)
        out[at : at + some] = (sums[k : k + some] - sums[:some]) * _powers()[1][:some]
    return mix64(out)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every run of bytes other than ASCII white space, in order; A-Z count as a-z."""
    raw = np.frombuffer(data.lower(), np.uint8)
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + SEGMENT)
        if end < len(raw):
            gaps = np.flatnonzero(_SPACE[raw[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                gaps = np.flatnonzero(_SPACE[raw[end:]])
                end = end + int(gaps[0]) + 1 if len(gaps) else len(raw)
        part = raw[at:end]
        at = end
        edges = np.diff(np.concatenate(([1], _SPACE[part].view(np.int8), [1])))
        starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        if len(part) <= SEGMENT:
            sums = _prefix_sums(part)
            out.append((sums[ends] - sums[starts]) * _powers()[1][starts])
        else:  # one word longer than a segment
            total = 0
            for i in range(int(starts[0]), int(ends[0]), SEGMENT):
                total = (total * 31 + int(_prefix_sums(part[i : min(i + SEGMENT, int(ends[0]))])[-1])) & ((1 << 64) - 1)
            out.append(np.array([total], np.uint64))
    return mix64(np.concatenate(out)) if out else np.zeros(0, np.uint64)
