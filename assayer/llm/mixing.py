"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in hash order, fill blocks of a set volume of characters. A source with weight w may start its
j-th block no earlier than its release floor((j - 1) / w) and must have it by its deadline ceil(j / w), in slots of one block.
Earliest deadline first over the released blocks meets every deadline, and after every slot each source is within one block
of its share.

Weights are rounded to multiples of 1 / cycle, so the schedule repeats after so many slots. One cycle is computed from the
weights alone, whatever the size of the data; block number b of a source goes to cycle b div n, position b mod n, where n
is the source's slots in a cycle. The cycle has CYCLE slots, and more where there are many sources: the next power of two from
four slots for each on. Blocks need each document's volume before it in its source, which comes from two levels of sums:
buckets of a source, then documents of a bucket. Neither level holds a whole source in one task.

A document goes whole into the slot of the block in which it begins. Hence after every slot the characters of a source are
within one block and one longest text of its share.

Defined results: a null source is a source of its own; a null or empty text has volume 0 and takes the block at its place;
a null id takes part. Repeated rows each get a place. A source without weight or, for `mixed`, without any characters gets no
slot and isn't admitted; it doesn't count as a source for the cycle either. More than MAX_SOURCES sources with a weight raise
ValueError with their number. A table without rows gives none. All columns of docs pass through under any name; the schedule
is one more column, a struct, and only a column of docs with its very name (parameter into) gives way to it.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, every, fresh

CYCLE = 1 << 14
MAX_SOURCES = 1 << 18
BLOCK_CHARS = 1 << 16
MAX_SHARE = 0.3
SEED = 11


def _refuse(n: int) -> None:
    raise ValueError(f"{n} sources have a weight, more than {MAX_SOURCES}; group them.")


def cycle_for(n_sources: int) -> int:
    """Slots of a cycle for so many sources with a weight."""
    return max(CYCLE, 1 << (4 * n_sources - 1).bit_length()) if n_sources else CYCLE


def slots_of(weights: dict[str | None, float], cycle: int | None = None) -> dict[str | None, int]:
    """Slots of one cycle for each source with a weight: at least one each, the rest by largest remainder."""
    names = sorted((n for n, w in weights.items() if w > 0), key=lambda n: (n is not None, n or ""))
    if len(names) > MAX_SOURCES:
        _refuse(len(names))
    cycle = cycle or cycle_for(len(names))
    if len(names) > cycle:
        raise ValueError(f"{len(names)} sources have a weight; a cycle of {cycle} slots is too short.")
    if not names:
        return {}
    total = math.fsum(weights[n] for n in names)
    exact = {n: weights[n] / total * (cycle - len(names)) for n in names}
    out = {n: 1 + int(exact[n]) for n in names}
    for n in sorted(names, key=lambda n: (int(exact[n]) - exact[n], n is not None, n or ""))[: cycle - sum(out.values())]:
        out[n] += 1
    return out


def one_cycle(slots: dict[str | None, int]) -> dict[str | None, list[int]]:
    """Slot numbers of each source's blocks in one cycle, earliest deadline first among the released."""
    cycle = sum(slots.values())
    names = list(slots)
    waiting = [(0, i, 1) for i in range(len(names))]
    ready: list[tuple[int, int, int]] = []
    out: dict[str | None, list[int]] = {n: [] for n in names}
    heapq.heapify(waiting)
    for slot in range(cycle):
        while waiting and waiting[0][0] <= slot:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j * cycle // slots[names[i]]), i, j))
        _, i, j = heapq.heappop(ready)
        out[names[i]].append(slot)
        if j < slots[names[i]]:
            heapq.heappush(waiting, (j * cycle // slots[names[i]], i, j + 1))
    return out


def volumes(docs: DataFrame, source_col: str = "source", text_col: str = "text") -> dict[str | None, int]:
    """Characters of each source that has any; at most MAX_SOURCES, else it raises."""
    sums = docs.groupBy(F.col(source_col).cast("string").alias("s")).agg(F.sum(F.char_length(text_col)).cast("long").alias("v")).where("v > 0")
    rows = sums.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        _refuse(sums.count())
    return {r["s"]: r["v"] for r in rows}


def capped_weights(sizes: dict[str | None, int], max_share: float = MAX_SHARE) -> tuple[dict[str | None, float], list[str | None]]:
    """Natural shares with none over the cap, and the sources that aren't above it. The cap is max_share, or the equal share of all
    sources with characters where that is more, as otherwise no mix would keep it."""
    sizes = {n: v for n, v in sizes.items() if v > 0}
    if not sizes:
        return {}, []
    cap = max(Fraction(str(max_share)), Fraction(1, len(sizes)))
    over: set = set()
    while True:
        # Exact numbers, as shares that equal the cap aren't over it.
        rest, left = sum(v for n, v in sizes.items() if n not in over), 1 - cap * len(over)
        more = {n for n, v in sizes.items() if n not in over and v * left > cap * rest}
        if not more:
            return {n: float(cap if n in over else v * left / rest) for n, v in sizes.items()}, [n for n in sizes if n not in over]
        over |= more


def mix(docs: DataFrame, weights: dict[str | None, float], until: list[str | None] | None = None, sizes: dict[str | None, int] | None = None, block_chars: int = BLOCK_CHARS, cycle: int | None = None, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", into: str = "mix") -> DataFrame:
    """docs with a struct of block, release, deadline, slot and admitted.

    The stream ends when all sources named in until have run dry (None: all that have a weight); admitted says whether a
    document's slot comes before that end. Texts are only measured and hashed; a caller that drops them later moves none.
    """
    spark = docs.sparkSession
    slots = slots_of(weights, cycle)
    cycle = sum(slots.values()) or 1
    places = one_cycle(slots)
    sizes = sizes if sizes is not None else volumes(docs, source_col, text_col)
    ends = []
    for name in slots if until is None else until:
        if name in slots and name in sizes:
            last, n = max(0, sizes[name] - 1) // block_chars + 1, slots[name]
            ends.append(last // n * cycle + places[name][last % n] + 1)
    horizon = max(ends, default=1 << 62)
    buckets = max(16, math.isqrt(docs.count()))
    w = fresh(docs, "_mix")
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    volume = F.coalesce(F.char_length(text_col), F.lit(0)).cast("long")
    order = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    keys = {f"{w}_source": source, f"{w}_volume": volume, f"{w}_order": order, f"{w}_bucket": F.pmod(F.shiftrightunsigned(order, 20), F.lit(buckets))}
    dealt = docs.withColumns(keys)
    sums = dealt.groupBy(f"{w}_source", f"{w}_bucket").agg(F.sum(f"{w}_volume").alias(f"{w}_sum"))
    earlier = Window.partitionBy(f"{w}_source").orderBy(f"{w}_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(f"{w}_source", f"{w}_bucket", F.coalesce(F.sum(f"{w}_sum").over(earlier), F.lit(0)).alias(f"{w}_base"))
    within = Window.partitionBy(f"{w}_source", f"{w}_bucket").orderBy(f"{w}_order", id_col, f"{w}_volume").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.join(bases, [f"{w}_source", f"{w}_bucket"])
    dealt = dealt.withColumn(f"{w}_block", F.floor((F.col(f"{w}_base") + F.coalesce(F.sum(f"{w}_volume").over(within), F.lit(0))) / block_chars).cast("long"))
    # A row for each source with a weight and a number for each slot of the cycle: 16 MiB at most for MAX_SOURCES.
    table = spark.createDataFrame([("" if n is None else "=" + n, slots[n], places[n]) for n in slots], f"{w}_source string, {w}_n int, {w}_places array<int>")
    dealt = dealt.join(F.broadcast(table), f"{w}_source", "left")
    block, n = F.col(f"{w}_block"), F.col(f"{w}_n")
    place = F.element_at(f"{w}_places", F.pmod(block, n).cast("int") + 1)
    slot = (F.floor(block / n) * cycle + place).cast("long")
    schedule = F.struct(block.alias("block"), F.floor(block * cycle / n).cast("long").alias("release"), F.ceil((block + 1) * cycle / n).cast("long").alias("deadline"), slot.alias("slot"), F.coalesce(slot < horizon, F.lit(False)).alias("admitted"))
    return dealt.select(*[c for c, name in zip(every(docs), docs.columns, strict=True) if name.lower() != into.lower()], schedule.alias(into))


def mixed(docs: DataFrame, max_share: float = MAX_SHARE, into: str = "mix") -> DataFrame:
    """The natural mix, but no source over the cap (see capped_weights); the stream ends when every source that isn't over it has
    run dry. One rule for any number of sources: with three, each gets a third at most."""
    sizes = volumes(docs)
    weights, below = capped_weights(sizes, max_share)
    return mix(docs, weights, below, sizes, into=into)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return mixed(docs).select("doc_id", "source", "mix.*")
