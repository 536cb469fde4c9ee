"""Best-fit packing of token sequences: bounded-space online best-fit over a bitset keyed by free space.

Tokenising is a map over the documents. Each document becomes its ids and one closing id; one longer than a sequence is cut
into full pieces and a rest. Only the pieces' sizes are then dealt out, about PIECES_PER_PACKER pieces by the texts' bytes for
each packer, and every packer holds a fixed number of open sequences. Pieces arrive in a fixed order that does not depend on
their lengths (a hash, or the order of the table) and each is placed when it arrives, for good. Bit f of one integer says
whether some open sequence has f tokens free, so the best fit for n tokens is the lowest set bit at or above n. When no open
sequence fits and the number of open ones is at its bound, the fullest closes.

Ids are those of the tokenizer over the whole text: its splitting never joins what a space or a line feed parts, so each
distinct chunk between them is encoded once and a document's ids are the chunks' ids in a row.

Defined results: a null or empty text is the closing id alone, one piece of length 1. Repeated rows are packed as often as
they occur, a null id is kept, a table without rows gives none, columns other than id and text don't matter, one named
_metadata included. `best_fit_in_order` takes any table, read from files or not.
"""

from __future__ import annotations

import math
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, sliced, stored

CAPACITY = 4096
END_ID = 1
OPEN = 128
PIECES_PER_PACKER = 1 << 17
BYTES_PER_PIECE = 3 * CAPACITY
CACHE_CHUNKS = 300_000
CACHE_MARKS = 10_000
CACHED_LENGTH = 48
LETTERS_AND_MARKS = re.compile(r"([^\W\d_]+)([^\w\s]*)")
#: Its lower case depends on its neighbours in Python, not in the tokenizer.
SIGMA = "\u03a3"
#: Byte-level vocabularies write a byte that has no printable form as the next free character from 256 on.
BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Generations(dict):
    """A cache of bounded size: when the young generation is full it becomes the old one, and keys still in use come back."""

    def __init__(self) -> None:
        super().__init__()
        self.old: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            ids = self.encode(key)
        if len(key) <= CACHED_LENGTH:
            if len(self) >= CACHE_CHUNKS:
                self.old = dict(self)
                self.clear()
            self[key] = ids
        return ids

    def encode(self, key: str) -> bytes:
        raise NotImplementedError


class Words(Generations):
    """Lower-case letters -> ids of the model."""

    def __init__(self, model) -> None:
        super().__init__()
        self.model = model

    def encode(self, key: str) -> bytes:
        if not key.isascii():
            key = key.encode().decode("latin-1").translate(BYTE_CHARS)
        return array("I", [t.id for t in self.model.tokenize(key)]).tobytes()


class Encoder(Generations):
    """Chunk of text -> its ids as little-endian 32-bit integers.

    A chunk of letters with marks after it is two pre-tokens, which go to the model straight away; any other form takes the
    tokenizer's whole way.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.words = Words(self.tokenizer.model)
        self.marks: dict[str, bytes] = {"": b""}

    def encode(self, chunk: str) -> bytes:
        form = LETTERS_AND_MARKS.fullmatch(chunk)
        word = form[1].lower() if form else ""
        if not word.isalpha() or not form[1].isalpha() or SIGMA in chunk or not unicodedata.is_normalized("NFC", chunk):
            return np.asarray(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        marks = self.marks.get(form[2])
        if marks is None:
            marks = np.asarray(self.tokenizer.encode(form[2], add_special_tokens=False).ids, "<u4").tobytes()
            if len(self.marks) < CACHE_MARKS:
                self.marks[form[2]] = marks
        return self.words[word] + marks

    def forget(self) -> None:
        """Empty the caches; a worker outlives its task, and the memory is other stages' then."""
        for cache in (self, self.words):
            cache.clear()
            cache.old = {}

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_cols: tuple[str, ...] = ()) -> DataFrame:
    """A row for each piece of each document, in no order; with_cols, integer columns of docs, stand on each of its pieces."""
    path = path or tokenizer_path()
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in sliced(batches):
            out: list[list] = [[], [], [], [], []]
            rows: list[int] = []
            for n, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                ids = encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
                    rows.append(n)
            arrays = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            more = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[2:]]
            yield pa.RecordBatch.from_arrays([*arrays, *more], names=["doc_id", "piece", "start", "length", "ids_crc32", *with_cols])
        encode.forget()

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).cast("long").alias(c) for c in with_cols])
    return chosen.mapInArrow(run, ", ".join([PIECES, *[f"{c} long" for c in with_cols]]))


class OpenSequences:
    """At most `limit` open sequences; `free` is the bitset, `by_free[f]` holds (number, filled) of those with f tokens free."""

    def __init__(self, capacity: int, limit: int) -> None:
        self.capacity, self.limit = capacity, limit
        self.free, self.count, self.opened = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def take(self, f: int) -> int:
        number = self.by_free[f].pop()
        if not self.by_free[f]:
            self.free &= ~(1 << f)
        self.count -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """The sequence and the offset in it for so many tokens."""
        fitting = self.free >> length
        if fitting:
            f = length + (fitting & -fitting).bit_length() - 1
            number = self.take(f)
        else:
            if self.count >= self.limit:
                self.take((self.free & -self.free).bit_length() - 1)
            f, number = self.capacity, self.opened
            self.opened += 1
        left = f - length
        if left:
            self.by_free[left].append(number)
            self.free |= 1 << left
            self.count += 1
        return number, self.capacity - f


def pack(sized: DataFrame, packers: int, capacity: int = CAPACITY, limit: int = OPEN, length_col: str = "length", packer_col: str | None = None, order: tuple[Column, ...] | None = None) -> DataFrame:
    """sized with sequence_id and offset; rows are dealt evenly over so many packers, or as packer_col says.

    They arrive in the given order; None: that of a hash of all columns, which says nothing of a piece's length.
    """
    names = sized.columns
    at = names.index(length_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, part = OpenSequences(capacity, limit), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.place(n) for n in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part + n for n, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sized.schema.fields) + ", sequence_id long, offset long"
    dealt = sized.repartitionById(packers, F.col(packer_col).cast("int")) if packer_col else sized.repartition(packers)
    return dealt.sortWithinPartitions(*(order or (F.xxhash64(*names),)), *names).mapInArrow(run, schema)


def packers_for(docs: DataFrame, text_col: str = "text", pieces_per_packer: int = PIECES_PER_PACKER) -> int:
    """Packers for all texts, by their number and bytes."""
    about = F.lit(1) + F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)) / BYTES_PER_PIECE
    return max(1, math.ceil((docs.agg(F.sum(about)).first()[0] or 0) / pieces_per_packer))


def best_fit(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, limit: int = OPEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(pieces(docs, path, capacity, id_col=id_col, text_col=text_col), packers_for(docs, text_col), capacity, limit)


def _in_order(docs: DataFrame) -> DataFrame:
    """doc_id and text with _file and _row, which order the rows of docs: its Parquet files by name and their rows, or, where docs
    isn't a table of files, its partitions and their rows, in a table written once so that they can't change."""
    try:
        place = docs.metadataColumn("_metadata")  # the hidden column, whatever columns a caller has
        found = docs.select("doc_id", "text", place["file_path"].alias("_file"), place["row_index"].alias("_row"))
        found.schema
        return found
    except AnalysisException:
        row = F.monotonically_increasing_id()
        return stored(docs.select("doc_id", "text", F.format_string("%010d", F.spark_partition_id()).alias("_file"), (row - F.shiftleft(F.spark_partition_id().cast("long"), 33)).alias("_row")))


def best_fit_in_order(docs: DataFrame, pieces_per_packer: int = PIECES_PER_PACKER) -> DataFrame:
    """As best_fit, for a table whose order counts (see _in_order): every packer takes one stretch of it.

    Pieces arrive in the table's order, so sequence ids rise along it, but for pieces that fill up sequences opened before.
    """
    spark = docs.sparkSession
    ordered = _in_order(docs)
    # The files' names, rows and sizes go to the driver, as Spark's own list of files does.
    about = F.sum(F.lit(1) + F.coalesce(F.octet_length("text"), F.lit(0)) / BYTES_PER_PIECE)
    sizes = sorted((r["f"], r["n"], r["p"]) for r in ordered.groupBy(F.col("_file").alias("f")).agg(F.count("*").alias("n"), about.alias("p")).collect())
    before = [0.0, *accumulate(p for _, _, p in sizes)]
    packers = max(1, math.ceil(before[-1] / pieces_per_packer))
    bases = spark.createDataFrame([(f, i, b / before[-1] * packers, p / n / before[-1] * packers) for i, ((f, n, p), b) in enumerate(zip(sizes, before[:-1], strict=True))], "_file string, _number int, _base double, _step double")
    placed = ordered.join(F.broadcast(bases), "_file")
    packer = F.least(F.floor(F.col("_base") + F.col("_row") * F.col("_step")), F.lit(packers - 1)).cast("int")
    dealt = placed.select("doc_id", "text", packer.alias("_packer"), F.col("_number"), F.col("_row"))
    order = (F.col("_number"), F.col("_row"), F.col("piece"))
    return pack(pieces(dealt, with_cols=("_packer", "_number", "_row")), packers, packer_col="_packer", order=order).drop("_packer", "_number", "_row")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(documents(spark, sf_dir))
