"""ZIP archives by member: no row holds more than one member, however large the archive.

Every member's record begins with the same four bytes, so the archive is read as text between them, by splits like any text; a
row's place is the sum of what comes before it, in its split and in the splits before. The directory at the archive's end, which
the last row ends with, says where records begin, how members are stored and how long they are. A row at such a place that is
long enough is a member. Where the four bytes occur inside a member's data, as in an archive within the archive, its rows are put
together again: only these rows are shuffled.

Stored and deflated members are read, also in 64-bit archives; encrypted members and other methods raise, and so do a wrong
checksum, a directory that isn't where the archive says it is, or a file without one.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Signatures and layouts of the format.
RECORD, ENTRY, END, END_64, LOCATOR_64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
#: Estimated bytes of directory entries up to which they are sent to all executors.
ENTRY_BYTES = 64 << 20
ENTRIES = "file string, place long, member string, method int, stored long, length long, crc long"
MEMBER = "archive string, path string, name string, length long, content binary"


def _rows(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", RECORD.decode("latin-1")).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("data"))


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """_rows with base, the place in the file where the first row of the split starts."""
    sizes = _rows(spark, path).groupBy("file", "split").agg(F.sum(F.octet_length("data") + F.lit(len(RECORD))).alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # A row for each split; the driver holds as many to plan the scan.
    return _rows(spark, path).join(F.broadcast(bases), ["file", "split"], "left")


def _with_places(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """file, size, the place of the record's signature and the bytes after it, for every row in order."""
    now, at = None, 0
    for batch in batches:
        for file, split, size, data, base in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (file, split) != now:
                if base is None:
                    raise ValueError(f"{file} was split differently the second time; set spark.sql.files.minPartitionNum")
                now, at = (file, split), base
            yield file, size, at - len(RECORD), data
            at += len(data) + len(RECORD)


def directory(file: str, size: int, start: int, tail: bytes) -> list[tuple]:
    """Entries of the directory in the archive's last bytes, which start at a place: see ENTRIES."""
    end = tail.rfind(END)
    if end < 0 or len(tail) - end < 22:
        raise ValueError(f"not an archive: {file}")
    n, length, offset = struct.unpack_from("<HII", tail, end + 10)
    locator = end - 20
    if locator >= 0 and tail[locator : locator + 4] == LOCATOR_64:
        at = struct.unpack_from("<Q", tail, locator + 8)[0] - start
        if at < 0 or tail[at : at + 4] != END_64:
            raise ValueError(f"the archive's directory isn't where it says: {file}")
        n, length, offset = struct.unpack_from("<QQQ", tail, at + 32)
    at = offset - start
    out = []
    for _ in range(n):
        if at < 0 or tail[at : at + 4] != ENTRY:
            raise ValueError(f"the archive's directory isn't where it says: {file}")
        flags, method, crc, stored, whole = struct.unpack_from("<HH4xIII", tail, at + 8)
        name_size, extra_size, comment_size = struct.unpack_from("<HHH", tail, at + 28)
        place = struct.unpack_from("<I", tail, at + 42)[0]
        name = tail[at + 46 : at + 46 + name_size].decode("utf-8" if flags & 0x800 else "cp437")
        extra = tail[at + 46 + name_size : at + 46 + name_size + extra_size]
        whole, stored, place = _wide(extra, whole, stored, place)
        if not name.endswith("/"):
            out.append((file, place, name, -1 if flags & 1 else method, stored, whole, crc))
        at += 46 + name_size + extra_size + comment_size
    return out


def _wide(extra: bytes, *values: int) -> tuple[int, ...]:
    """Values of which those that don't fit into 32 bits are in the entry's extra field."""
    at, wide = 0, b""
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            wide = extra[at + 4 : at + 4 + n]
        at += 4 + n
    out, used = [], 0
    for v in values:
        if v == 0xFFFFFFFF and used + 8 <= len(wide):
            v, used = struct.unpack_from("<Q", wide, used)[0], used + 8
        out.append(v)
    return tuple(out)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for file, size, place, data in _with_places(batches):
        start = place + len(RECORD)
        if start + len(data) == size:
            found = directory(file, size, start, data)
            types = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(types)], names=[c.split()[0] for c in ENTRIES.split(", ")])


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for file, _, place, data in _with_places(batches):
        yield pa.RecordBatch.from_pydict({"file": [file], "place": pa.array([place], pa.int64()), "data": pa.array([data], pa.binary())})


def needed(data: bytes, stored: int) -> int:
    """Bytes of a record after its signature up to the end of the member's data; as many as its head has if that is cut."""
    return 26 + sum(struct.unpack_from("<HH", data, 22)) + stored if len(data) >= 26 else 26 + stored


def unpacked(data: bytes, member: str, method: int, stored: int, length: int, crc: int) -> bytes:
    """The member of a record, checked."""
    end = needed(data, stored)
    if len(data) < end:
        raise ValueError(f"the archive's member is cut short: {member}")
    if method not in (0, 8):
        raise ValueError(f"{'encrypted' if method < 0 else f'method {method}'}, can't be read: {member}")
    body = data[end - stored : end]
    body = zlib.decompress(body, -15) if method == 8 else body
    if len(body) != length or zlib.crc32(body) != crc:
        raise ValueError(f"wrong checksum: {member}")
    return body


_MEMBER_TYPES = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, data, member, *rest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            body = unpacked(data, member, *rest)
            row = (file, member, member.rpartition("/")[2], len(body), body)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _MEMBER_TYPES, strict=True)], names=[c.split()[0] for c in MEMBER.split(", ")])


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The directories of all archives (*.zip) under a path: file, place, member, method, stored, length, crc."""
    return _placed(spark, path).mapInArrow(_entries, ENTRIES)


def members(spark: SparkSession, path: str, entry_bytes: int = ENTRY_BYTES) -> DataFrame:
    """archive, path, name, length and content of every member of all archives (*.zip) under a path, folders left out."""
    from .writers import shared_folder

    shared_folder(spark)
    known = entries(spark, path).checkpoint()
    size = known.agg(F.sum(F.octet_length("member") + F.octet_length("file") + F.lit(64))).first()[0] or 0
    located = _placed(spark, path).mapInArrow(_located, "file string, place long, data binary")
    found = located.join(F.broadcast(known) if size <= entry_bytes else known, ["file", "place"], "left")
    # The record's head says how long its name is: two bytes each at 22 and 24, little-endian.
    at = lambda i: F.conv(F.hex(F.substring("data", i, 1)), 16, 10).cast("long")
    head = F.lit(26) + at(23) + 256 * at(24) + at(25) + 256 * at(26)
    whole = F.col("member").isNotNull() & (F.octet_length("data") >= 26) & (F.octet_length("data") >= head + F.col("stored"))
    chosen = ["file", "data", "member", "method", "stored", "length", "crc"]
    out = found.where(F.coalesce(whole, F.lit(False))).select(*chosen).mapInArrow(_unpacked, MEMBER)
    # Rows of members whose data has the signature, with what comes between them.
    order = Window.partitionBy("file").orderBy("place")
    parts = found.where(~F.coalesce(whole, F.lit(False)) & (F.col("place") >= 0)).checkpoint()
    parts = parts.withColumn("entry", F.last(F.when(F.col("member").isNotNull(), F.col("place")), True).over(order)).where("entry IS NOT NULL")
    joined = parts.groupBy("file", "entry").agg(F.sort_array(F.collect_list(F.struct("place", "data"))).alias("ps"), *[F.max(c).alias(c) for c in chosen[2:]])
    data = F.unhex(F.array_join(F.transform("ps", lambda p: F.hex(p["data"])), RECORD.hex())).alias("data")
    return out.union(joined.select("file", data, *chosen[2:]).mapInArrow(_unpacked, MEMBER))
