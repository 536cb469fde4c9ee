"""JSON documents of any size, cut into their entries in parallel.

A document is read as text between commas, so Spark splits a file wherever it likes and no row is longer than an entry. A split
alone doesn't know whether it starts inside a string, or how deep; but its effect is a function of that: quotes toggle, brackets
outside strings add up. One scan computes the effects of all splits, a running combination of them gives each split's true start,
and a second scan cuts the entries where the depth is right. An entry that crosses splits leaves a part in each; parts are put
together by the running number of the splits that open one.

Both scans have to split files alike. Where they don't, because Spark's default parallelism changed in between, the second one
raises instead of cutting wrong; spark.sql.files.minPartitionNum fixes the splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE, BACKSLASH, COMMA = ord('"'), ord("\\"), ord(",")
BLANKS = b" \t\r\n"


def _marks(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, which of them are quotes that aren't escaped, and +1 or -1 for brackets of either direction."""
    raw = np.frombuffer(data, np.uint8)
    quote = raw == QUOTE
    if BACKSLASH in data:
        # A byte is escaped if the run of backslashes before it is of odd length.
        slash = raw == BACKSLASH
        since = np.arange(len(raw)) - np.maximum.accumulate(np.where(slash, -1, np.arange(len(raw))))
        odd = (since % 2 == 1) & slash
        quote &= ~np.concatenate(([False], odd[:-1]))
    step = np.isin(raw, (ord("{"), ord("["))).astype(np.int8) - np.isin(raw, (ord("}"), ord("]"))).astype(np.int8)
    return raw, quote, step


def _fragments(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    rows = spark.read.option("lineSep", ",").text(paths)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def _by_split(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of rows of one split: its (file, split, ...) and the rows."""
    names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    at = 0
    for i in range(1, len(names) + 1):
        if i == len(names) or names[i] != names[at]:
            yield names[at], batch.slice(at, i - at)
            at = i


def _joined(column: pa.Array) -> bytes:
    """Fragments with the comma after each; after a document's last one it's at depth 0 and means nothing."""
    return b"".join(x + b"," for x in column.cast(pa.binary()).to_pylist())


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each stretch of rows: whether quotes toggle, the change of depth if it starts outside and inside a string, the first byte."""
    for batch in batches:
        out = []
        for n, (name, rows) in enumerate(_by_split(batch)):
            data = _joined(rows.column(2))
            _, quote, step = _marks(data)
            within = np.cumsum(quote) & 1
            out.append((*name, n, int(quote.sum()) & 1, int(step[within == 0].sum()), int(step[within == 1].sum()), data.lstrip(BLANKS)[:1].decode("latin-1")))
        types = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["file", "split", "n", "toggle", "outside", "inside", "first"])


def starts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, split, in_string and depth at its start, and kind, the document's first byte. Unbalanced documents raise."""
    parts = _fragments(spark, paths).mapInArrow(_effects, "file string, split long, n int, toggle int, outside long, inside long, first string")
    # A split comes in as many stretches as batches of rows; they are in order of their ids, as one task reads them.
    order = Window.partitionBy("file").orderBy("split", "at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("at", F.monotonically_increasing_id())
    parts = parts.withColumn("in_string", F.coalesce(F.sum("toggle").over(before), F.lit(0)) % 2)
    parts = parts.withColumn("change", F.when(F.col("in_string") == 1, F.col("inside")).otherwise(F.col("outside")))
    parts = parts.withColumns({"depth": F.coalesce(F.sum("change").over(before), F.lit(0)), "kind": F.first("first").over(order), "ends": F.sum("change").over(Window.partitionBy("file")), "odd": F.sum("toggle").over(Window.partitionBy("file")) % 2})
    broken = (F.col("ends") != 0) | (F.col("odd") != 0)
    kind = F.when(broken, F.raise_error(F.concat(F.lit("not a whole JSON document: "), "file")).cast("string")).otherwise(F.col("kind"))
    return parts.withColumn("kind", kind).groupBy("file", "split").agg(F.min_by(F.struct(F.col("in_string").cast("int").alias("in_string"), F.col("depth"), F.col("kind")), "at").alias("s")).select("file", "split", "s.*")


class Cutter:
    """Cuts one split into pieces at a level: what stands between commas there, or between a comma and a bracket of the level.

    `done` gets (container, piece) for whole pieces. head is what comes before the first cut, for a piece that an earlier split
    opened; tail is what is open at the end. container is the text before the bracket that opened the level, from the comma
    before it on, None if an earlier split has it.
    """

    def __init__(self, level: int, in_string: int, depth: int) -> None:
        self.level, self.in_string, self.depth = level, in_string, depth
        self.open: list[bytes] | None = [] if depth >= level else None
        self.head: bytes | None = None
        self.continues = depth >= level
        self.container: str | None = None
        self.outer: list[bytes] = []
        self.done: list[tuple[str | None, bytes]] = []

    def _close(self, piece: bytes) -> None:
        whole = b"".join([*(self.open or ()), piece])
        if self.continues:
            self.head, self.continues = whole, False
        elif whole.strip(BLANKS):
            self.done.append((self.container, whole))

    def feed(self, data: bytes) -> None:
        raw, quote, step = _marks(data)
        within = (np.cumsum(quote) + self.in_string) & 1
        depth = self.depth + np.cumsum(np.where(within == 0, step, 0))
        plain = (within == 0) & ~quote
        at_level = plain & (raw == COMMA) & (depth == self.level)
        opens = plain & (step == 1) & (depth == self.level)
        closes = plain & (step == -1) & (depth == self.level - 1)
        outer = plain & (raw == COMMA) & (depth == self.level - 1)
        at = 0
        for i in np.flatnonzero(at_level | opens | closes | outer).tolist():
            if opens[i]:
                self.container = b"".join([*self.outer, data[at : i + 1]]).decode("utf-8", "replace")
                self.open, self.outer = [], []
            elif outer[i]:
                self.outer = []
            else:
                self._close(data[at:i])
                self.open = [] if at_level[i] else None
                self.outer = []
            at = i + 1
        if self.open is not None:
            self.open.append(data[at:])
        else:
            self.outer.append(data[at:])
        if len(raw):
            self.in_string, self.depth = int(within[-1]), int(depth[-1])


PIECE = "file string, split long, at long, part int, container string, piece string"


def _pieces(list_level: int, map_level: int):
    """part is null for whole pieces; 0 for what ends, or goes on through, a split, 1 for what it leaves open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cutter, count = None, None, 0

        def rows(last: bool) -> pa.RecordBatch:
            nonlocal count
            out = []
            if cutter is not None:
                for container, piece in cutter.done:
                    out.append((*now, count, None, container, piece.decode("utf-8", "replace")))
                    count += 1
                cutter.done = []
                if last:
                    if cutter.head is not None:
                        out.append((*now, -1, 0, None, cutter.head.decode("utf-8", "replace")))
                    if cutter.open is not None:
                        out.append((*now, count, 0 if cutter.continues else 1, cutter.container, b"".join(cutter.open).decode("utf-8", "replace")))
            types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["file", "split", "at", "part", "container", "piece"])

        for batch in batches:
            for name, own in _by_split(batch):
                if name != now:
                    yield rows(True)
                    now, count = name, 0
                    in_string, depth, kind = (own.column(i)[0].as_py() for i in (3, 4, 5))
                    if in_string is None:
                        raise ValueError(f"{name[0]} was split differently the second time; set spark.sql.files.minPartitionNum")
                    level = list_level if kind == "[" else map_level
                    if not level:
                        raise ValueError(f"not the kind of JSON document that was asked for: {name[0]}")
                    cutter = Cutter(level, in_string, depth)
                cutter.feed(_joined(own.column(2)))
            yield rows(False)
        yield rows(True)

    return run


def pieces(spark: SparkSession, paths: str | list[str], list_level: int = 1, map_level: int = 1) -> DataFrame:
    """file, split, at (which order the pieces of a file), container and piece: the text of every entry at a level, 1 for those
    of the document itself, by the kind of document; 0 refuses that kind."""
    from .writers import shared_folder

    # A row for each split; the driver holds as many to plan the scan.
    known = F.broadcast(starts(spark, paths))
    found = _fragments(spark, paths).join(known, ["file", "split"], "left").select("file", "split", "value", "in_string", "depth", "kind").mapInArrow(_pieces(list_level, map_level), PIECE)
    # A part that a split leaves open begins an entry, parts 0 after it go on with it: two rows for each split at most. They are
    # written apart, so that their windows don't read the documents again.
    order = Window.partitionBy("file").orderBy("split", "at")
    shared_folder(spark)
    parts = found.where("part IS NOT NULL").checkpoint().withColumns({"entry": F.sum(F.when(F.col("part") == 1, 1).otherwise(0)).over(order), "within": F.last("container", True).over(order)})
    whole = parts.groupBy("file", "entry").agg(F.sort_array(F.collect_list(F.struct("split", "at", "piece", "within"))).alias("ps"))
    whole = whole.select("file", F.col("ps")[0]["split"].alias("split"), F.col("ps")[0]["at"].alias("at"), F.col("ps")[0]["within"].alias("container"), F.array_join("ps.piece", "").alias("piece")).where(F.trim(F.regexp_replace("piece", r"[\t\r\n]", " ")) != "")
    # Pieces before a split's first bracket of the level are in the container that was open when it began.
    last = parts.groupBy("file", "split").agg(F.max_by("container", "at").alias("c"))
    inherited = last.select("file", "split", F.last("c", True).over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)).alias("inherited"))
    own = found.where("part IS NULL").join(F.broadcast(inherited), ["file", "split"], "left")
    return own.select("file", "split", "at", F.coalesce("container", "inherited").alias("container"), "piece").union(whole)
