"""How many documents hold each hash, when hashes are too many to be rows of their own.

Documents are dealt into groups. A group sends the distinct hashes of its documents, sorted and packed, a row for each
bucket of the hash space; a bucket counts over all groups and sends each group the classes of its hashes in the same order.
A hash costs four bytes one way and one byte back, whatever its frequency: a group sends a hash once, so a hash in a third of
all documents is one value in each group. As many buckets as groups: both sides of the exchange grow alike.

Hashes are cut to 32 bits below the bucket's; two hashes that fall together count as one, which can only raise a count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SENT = "g int, bucket int, found binary, counts binary"
CLASSES = "g int, bucket int, classes binary"


def bits(groups: int) -> int:
    """Bits of a hash that choose its bucket."""
    return max(0, (groups - 1).bit_length())


def short(hashes: np.ndarray, groups: int) -> np.ndarray:
    """The bits of a hash that the census sees."""
    return hashes >> np.uint64(32 - bits(groups))


def bucket(hashes: np.ndarray, groups: int) -> np.ndarray:
    """A hash's bucket, from its highest bits."""
    return (hashes >> np.uint64(1) >> np.uint64(63 - bits(groups))).astype(np.int64)


def sent(g: int, values: np.ndarray, counts: np.ndarray, groups: int) -> pa.Table:
    """Rows for a group's distinct short hashes, sorted, with the number of its documents that hold each."""
    which = (values >> np.uint64(32)).astype(np.int64)
    firsts = np.flatnonzero(np.concatenate(([True], np.diff(which) != 0))) if len(which) else which
    low, capped = values.astype(np.uint32), np.minimum(counts, 255).astype(np.uint8)
    # Only buckets that the group has hashes for: its time doesn't depend on how many there are.
    rows = [(g, k, low[i:j].tobytes(), capped[i:j].tobytes()) for k, i, j in zip(which[firsts].tolist(), firsts.tolist(), [*firsts[1:].tolist(), len(which)][: len(firsts)], strict=True)]
    types = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["g", "bucket", "found", "counts"])


def _classified(table: pa.Table) -> pa.Table:
    found = [np.frombuffer(x, np.uint32) for x in table["found"].to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.uint8) for x in table["counts"].to_pylist()])
    every = np.concatenate(found)
    order = np.argsort(every, kind="stable")
    new = np.concatenate(([True], np.diff(every[order]) != 0))
    group = np.cumsum(new) - 1
    total = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(new))
    classes = np.empty(len(every), np.uint8)
    classes[order] = (np.searchsorted(np.int64(1) << np.arange(1, 40), total, side="right") + 1)[group]
    ends = np.cumsum([len(x) for x in found])
    parts = [classes[e - len(x) : e].tobytes() for x, e in zip(found, ends.tolist(), strict=True)]
    return pa.table([table["g"], table["bucket"], pa.array(parts, pa.binary())], names=["g", "bucket", "classes"])


def classes(rows: DataFrame) -> DataFrame:
    """For rows of `sent`: the class of each hash, the number of binary digits of its document count (1: one document)."""
    return rows.groupBy("bucket").applyInArrow(_classified, CLASSES)


def received(buckets: list[int], parts: list[bytes]) -> np.ndarray:
    """A group's classes in the order of its sorted short hashes."""
    return np.concatenate([np.frombuffer(p, np.uint8) for _, p in sorted(zip(buckets, parts, strict=True))]) if parts else np.zeros(0, np.uint8)
