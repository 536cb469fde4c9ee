"""Exact substring deduplication by common-prefix intervals of an enhanced suffix array.

A byte goes when a string of LEAST bytes over it also starts in a document with a smaller id. All such strings, and all
places where they occur, come from maximal repeats, found in these steps.

1. Equal texts become one; later copies go whole.
2. Every window of LEAST bytes has an anchor, its least-hashed run of GRAM bytes, which depends on nothing but the window.
   Windows with the same anchor lie side by side, about fourteen on average. A census of all anchors tells which ones occur
   elsewhere; windows of any other anchor have no second occurrence, and most text ends here.
3. The windows of a shared anchor and nothing else make a context, LEAST to WIDTH bytes. A group of documents sends each
   distinct context once, for the smallest id that has it, to the anchor's bucket. Equal windows meet there, since equal
   windows have equal anchors.
4. A bucket sorts the suffixes of its contexts that hold a whole window (a suffix array), computes common prefixes of
   neighbours, and scans them with a stack for the intervals of the common-prefix tree. An interval whose occurrences are all
   preceded by the same byte is part of a longer repeat one byte to the left and is left out; the others are the maximal
   repeats inside contexts, each with all its occurrences. In an interval every occurrence but those of the smallest id goes.
5. Ranges of windows return to their documents, where they become runs of bytes.

Defined results: a null or empty text has no bytes. A text shorter than LEAST keeps all. Equal rows get equal results: rows
that share an id don't remove from one another. A row with a null id keeps all and removes nothing. Other columns don't
matter; a table without rows gives none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import census
from .common import SEGMENT, bytes_list, documents, gram_hashes, mix64, n_groups, stored, text_bytes

LEAST, GRAM = 50, 24
SPAN = LEAST - GRAM + 1
WIDTH = LEAST + SPAN - 1
PLACE = (1 << 20) - 1
CONTEXT = np.dtype(f"S{WIDTH}")


def anchors(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share an anchor, over texts laid end to end: first window, number of windows, the anchor's hash."""
    firsts, counts, hashes = [], [], []
    n = len(data) - LEAST + 1
    step = min(SEGMENT, PLACE + 1) - LEAST
    for at in range(0, max(0, n), step):
        some = min(step, n - at)
        h = gram_hashes(data[at : at + some + LEAST - 1], GRAM)
        least = (h & ~np.uint64(PLACE)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= SPAN:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < SPAN:
            least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
        place = (least[:some] & np.uint64(PLACE)).astype(np.int64)
        inside = np.ones(some, bool)
        for end in ends[np.searchsorted(ends, at, "right") : np.searchsorted(ends, at + some + LEAST, "right")].tolist():
            inside[max(0, end - LEAST + 1 - at) : max(0, end - at)] = False
        change = np.flatnonzero(np.concatenate(([True], (np.diff(place) != 0) | (np.diff(inside.view(np.int8)) != 0))))
        length = np.diff(np.concatenate((change, [some])))
        keep = inside[change]
        firsts.append(change[keep] + at)
        counts.append(length[keep])
        hashes.append(mix64(h[place[change[keep]]]))  # anchors are least hashes; mixed again they fill the hash space evenly
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(firsts), np.concatenate(counts), np.concatenate(hashes)


def contexts(data: bytes, firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bytes of each run of windows, as fixed-width strings: every byte plus one, then zeros. UTF-8 has no byte 255."""
    raw = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(WIDTH, np.uint8))) + np.uint8(1)
    out = np.empty((len(firsts), WIDTH), np.uint8)
    offsets = np.arange(WIDTH)
    for at in range(0, len(firsts), 1 << 16):
        some = slice(at, at + (1 << 16))
        out[some] = np.where(offsets < (counts[some] + LEAST - 1)[:, None], raw[firsts[some, None] + offsets], 0)
    return out.view(CONTEXT).ravel()


def intervals(common: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(length, first, last) of every interval of the common-prefix tree with at least that length.

    common[i] is the length of the prefix that suffixes i - 1 and i share. The stack holds the open intervals, each longer
    than the one below it; a shorter common prefix closes those that are longer.
    """
    out, stack = [], []
    for i, length in enumerate([*common.tolist()[1:], 0], 1):
        first = i - 1
        while stack and stack[-1][0] > length:
            closed, first = stack.pop()
            out.append((closed, first, i - 1))
        if length >= least and (not stack or stack[-1][0] < length):
            stack.append((length, first))
    return out


def maximal_repeats(ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal repeats among distinct contexts: (repeat number, context, window in it, windows that the repeat covers).

    A row for each occurrence. Suffixes that hold a whole window and whose window occurs twice are sorted, their common
    prefixes are scanned, and intervals without left diversity are left out.
    """
    matrix = ctx.view(np.uint8).reshape(len(ctx), WIDTH)
    sizes = (matrix != 0).sum(1)
    windows = sizes - LEAST + 1
    owner = np.repeat(np.arange(len(ctx)), windows)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    flat = np.concatenate((matrix.ravel(), np.zeros(WIDTH, np.uint8)))
    names = gram_hashes(flat.tobytes(), LEAST)[owner * WIDTH + start]
    order = np.argsort(names, kind="stable")
    same = names[order][1:] == names[order][:-1]
    twice = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(order) else np.zeros(0, bool)
    at = np.sort(order[twice])
    owner, start = owner[at], start[at]
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none, none, none
    suffix = np.empty((len(at), WIDTH), np.uint8)
    offsets = np.arange(WIDTH)
    for a in range(0, len(at), 1 << 16):
        some = slice(a, a + (1 << 16))
        suffix[some] = np.where(offsets < (sizes[owner[some]] - start[some])[:, None], flat[(owner[some] * WIDTH + start[some])[:, None] + offsets], 0)
    order = np.argsort(suffix.view(CONTEXT).ravel(), kind="stable")
    owner, start, suffix = owner[order], start[order], suffix[order]
    common = np.zeros(len(order), np.int64)
    for a in range(1, len(order), 1 << 16):
        x, y = suffix[a - 1 : a - 1 + (1 << 16)], suffix[a : a + (1 << 16)]
        differ = (x[: len(y)] != y) | (y == 0)
        common[a : a + len(y)] = np.where(differ.any(1), differ.argmax(1), WIDTH)
    found = np.asarray(intervals(common), np.int64).reshape(-1, 3)
    left = np.where(start > 0, flat[owner * WIDTH + start - 1].astype(np.int64), -1 - np.arange(len(start)))
    changes = np.concatenate(([0], np.cumsum(np.diff(left) != 0)))
    found = found[changes[found[:, 2]] > changes[found[:, 1]]]
    size = found[:, 2] - found[:, 1] + 1
    number = np.repeat(np.arange(len(found)), size)
    member = np.arange(len(number)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(found[:, 1], size)
    return number, owner[member], start[member], np.repeat(found[:, 0] - LEAST + 1, size)


def ranges(counts: np.ndarray) -> np.ndarray:
    """0 .. count - 1 for each count, end to end."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


class Group:
    """A group's representatives in order of id: their texts end to end."""

    def __init__(self, texts: pa.Table, chosen: pa.Table) -> None:
        names = {(d, s) for d, s in zip(chosen["doc_id"].to_pylist(), chosen["sha"].to_pylist(), strict=True) if s is not None}
        rows = {}
        for doc_id, data in zip(texts["doc_id"].to_pylist(), bytes_list(texts["text"]), strict=True):
            name = (doc_id, hashlib.sha256(data).digest())
            if name in names:
                rows[name] = data
        self.rows = dict(sorted(rows.items()))
        self.number = {name: i for i, name in enumerate(self.rows)}
        self.ids = np.asarray([d for d, _ in self.rows], np.int64)
        self.data = b"".join(self.rows.values())
        self.ends = np.cumsum([len(x) for x in self.rows.values()]).astype(np.int64)
        self.firsts, self.counts, self.hashes = anchors(self.data, self.ends)

    def row(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, "right")

    def start(self, row: np.ndarray) -> np.ndarray:
        return np.concatenate(([0], self.ends))[row]


SENT = "g int, bucket int, ctx binary, ids binary, rows binary, times binary, places binary"
BACK = "g int, rows binary, places binary, windows binary"


def _sent(rows: list[tuple]) -> pa.Table:
    types = (pa.int32(), pa.int32(), *[pa.binary()] * 5)
    names = ["g", "bucket", "ctx", "ids", "rows", "times", "places"]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def shared_contexts(group: Group, classes: np.ndarray, g: int, groups: int) -> pa.Table:
    """A row for each bucket with the group's distinct contexts, and one, bucket -1, with what smaller ids in the group remove."""
    keep = classes > 1
    firsts, counts, hashes = group.firsts[keep], group.counts[keep], group.hashes[keep]
    ctx = contexts(group.data, firsts, counts)
    row = group.row(firsts)
    place = firsts - group.start(row)
    order = np.argsort(ctx, kind="stable")
    new = np.concatenate(([True], ctx[order][1:] != ctx[order][:-1])) if len(order) else np.zeros(0, bool)
    lead = np.flatnonzero(new)
    owner = order[lead][np.cumsum(new) - 1] if len(order) else order
    own = group.ids[row[order]] == group.ids[row[owner]]
    gone = order[~own]
    out = [(g, -1, b"", b"", row[gone].astype(np.int32).tobytes(), counts[gone].astype(np.int32).tobytes(), place[gone].tobytes())]
    order, owner = order[own], owner[own]
    heads = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(order) else order
    times = np.diff(np.concatenate((heads, [len(order)])))
    bucket = census.bucket(hashes[owner[heads]], groups)
    sort = np.argsort(bucket, kind="stable")
    for b in np.unique(bucket).tolist():
        these = sort[np.searchsorted(bucket[sort], b, "left") : np.searchsorted(bucket[sort], b, "right")]
        each = np.repeat(heads[these], times[these]) + ranges(times[these])
        lead = owner[heads[these]]
        # A smallest id may stand for several rows; all its places are listed with the row of each.
        out.append((g, b, ctx[lead].tobytes(), group.ids[row[lead]].tobytes(), row[order[each]].astype(np.int32).tobytes(), times[these].astype(np.int32).tobytes(), place[order[each]].tobytes()))
    return _sent(out)


class Bucket:
    """What a bucket received: contexts with the smallest id of their group, and that id's places."""

    def __init__(self, table: pa.Table) -> None:
        read = lambda c, t: [np.frombuffer(x, t) for x in table[c].to_pylist()]
        ctx = read("ctx", CONTEXT)
        self.ctx, self.ids = np.concatenate(ctx), np.concatenate(read("ids", np.int64))
        self.g = np.repeat(np.asarray(table["g"].to_pylist()), [len(x) for x in ctx])
        self.times = np.concatenate(read("times", np.int32)).astype(np.int64)
        self.rows, self.places = np.concatenate(read("rows", np.int32)), np.concatenate(read("places", np.int64))
        self.first = np.cumsum(self.times) - self.times
        # A context that several groups sent is a leaf of the tree with several occurrences. Its smallest id stands for it in the
        # suffix array; that id may have rows in several groups (its peers), every larger id is a later occurrence.
        order = np.lexsort((self.ids, self.ctx))
        new = np.concatenate(([True], self.ctx[order][1:] != self.ctx[order][:-1]))
        number = np.cumsum(new) - 1
        self.leads = order[new]
        own = self.ids[order] == self.ids[self.leads][number]
        self.later = order[~own]
        self.peers = order[own]
        self.n_peers = np.bincount(number[own], minlength=len(self.leads))
        self.first_peer = np.cumsum(self.n_peers) - self.n_peers

    def windows(self, entry: np.ndarray) -> np.ndarray:
        return (self.ctx[entry].view(np.uint8).reshape(len(entry), WIDTH) != 0).sum(1) - LEAST + 1

    def removed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry, first window, windows) that a smaller id removes."""
        number, context, start, covered = maximal_repeats(self.ctx[self.leads])
        entry = self.leads[context]
        if len(number):
            least = np.minimum.reduceat(self.ids[entry], np.flatnonzero(np.concatenate(([True], np.diff(number) != 0))))
            gone = self.ids[entry] > least[number]
            context, start, covered = context[gone], start[gone], covered[gone]
        times = self.n_peers[context]
        entry = self.peers[np.repeat(self.first_peer[context], times) + ranges(times)]
        start, covered = np.repeat(start, times), np.repeat(covered, times)
        whole = self.windows(self.later)  # a leaf's repeat: all windows of the context
        return np.concatenate((self.later, entry)), np.concatenate((np.zeros(len(self.later), np.int64), start)), np.concatenate((whole, covered))


def _resolved(table: pa.Table) -> pa.Table:
    """Ranges of windows that go, a row for each group."""
    bucket = Bucket(table)
    entry, start, windows = bucket.removed()
    times = bucket.times[entry]
    at = np.repeat(bucket.first[entry], times) + ranges(times)
    g, rows = np.repeat(bucket.g[entry], times), bucket.rows[at]
    places, windows = bucket.places[at] + np.repeat(start, times), np.repeat(windows, times)
    order = np.argsort(g, kind="stable")
    edges = [*np.flatnonzero(np.concatenate(([True], np.diff(g[order]) != 0))).tolist(), len(g)] if len(g) else [0]
    out = [(int(g[order[i]]), rows[order[i:j]].tobytes(), places[order[i:j]].tobytes(), windows[order[i:j]].astype(np.int32).tobytes()) for i, j in zip(edges[:-1], edges[1:], strict=True)]
    types = (pa.int32(), *[pa.binary()] * 3)
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["g", "rows", "places", "windows"])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def runs_of(size: int, places: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """A mask of the bytes that go, from ranges of windows."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, places, 1)
    np.add.at(step, places + windows + LEAST - 1, -1)
    return np.cumsum(step[:-1]) > 0


class Steps:
    """The tables of one run: texts by group, representatives, the census, and contexts by bucket."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str) -> None:
        self.groups = n_groups(docs.sparkSession, text_bytes(docs, text_col))
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        sha = F.unhex(F.sha2("text", 256))
        # By id and text: rows without an id, or of one id, don't all meet in one group.
        deal = F.pmod(F.xxhash64("doc_id", "sha"), F.lit(self.groups)).cast("int").alias("g")
        self.texts = rows.withColumn("sha", sha).select(deal, "doc_id", "text")
        names = rows.where(f"doc_id is not null and octet_length(text) >= {LEAST}").select("doc_id", sha.alias("sha"))
        self.chosen = names.groupBy("sha").agg(F.min("doc_id").alias("doc_id")).select(deal, "doc_id", "sha")
        groups = self.groups

        def send(left: pa.Table, right: pa.Table) -> pa.Table:
            group = Group(left, right)
            values, counts = np.unique(census.short(group.hashes, groups), return_counts=True)
            return census.sent((left if left.num_rows else right)["g"][0].as_py(), values, counts, groups)

        self.known = census.classes(self.texts.groupBy("g").cogroup(self.chosen.groupBy("g")).applyInArrow(send, census.SENT))
        both = self.chosen.unionByName(self.known, allowMissingColumns=True)

        def share(left: pa.Table, right: pa.Table) -> pa.Table:
            group = Group(left, right)
            _, at = np.unique(census.short(group.hashes, groups), return_inverse=True)
            answers = right.filter(pa.compute.is_valid(right["bucket"]))
            classes = census.received(answers["bucket"].to_pylist(), answers["classes"].to_pylist())[at]
            return shared_contexts(group, classes, (left if left.num_rows else right)["g"][0].as_py(), groups)

        self.contexts = stored(self.texts.groupBy("g").cogroup(both.groupBy("g")).applyInArrow(share, SENT))

    def removals(self) -> DataFrame:
        own = self.contexts.where("bucket < 0").select("g", "rows", "places", F.col("times").alias("windows"))
        return self.contexts.where("bucket >= 0").groupBy("bucket").applyInArrow(_resolved, BACK).union(own)


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal repeats inside contexts, one row for each occurrence: bucket, repeat, length, doc_id, start (in bytes).

    Occurrences that a smaller id of the same group already covers by an equal context are left to that context's own row.
    """

    def run(table: pa.Table) -> pa.Table:
        bucket = Bucket(table)
        number, context, start, covered = maximal_repeats(bucket.ctx[bucket.leads])
        entry = bucket.leads[context]
        times = bucket.times[entry]
        at = np.repeat(bucket.first[entry], times) + ranges(times)
        b = table["bucket"][0].as_py()
        return pa.table([pa.array(np.full(len(at), b, np.int32)), pa.array(np.repeat(number, times)), pa.array(np.repeat(covered + LEAST - 1, times)), pa.array(np.repeat(bucket.ids[entry], times)), pa.array(bucket.places[at] + np.repeat(start, times))], names=["bucket", "repeat", "length", "doc_id", "start"])

    return Steps(docs, id_col, text_col).contexts.where("bucket >= 0").groupBy("bucket").applyInArrow(run, "bucket int, repeat long, length long, doc_id long, start long")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept: what is left (parts of characters as U+FFFD)."""
    steps = Steps(docs, id_col, text_col)
    both = steps.chosen.unionByName(steps.removals(), allowMissingColumns=True)
    empty = hashlib.sha256(b"").hexdigest()

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        given = right.filter(pa.compute.is_valid(right["rows"]))
        read = lambda c, t: np.concatenate([np.zeros(0, t), *[np.frombuffer(x, t) for x in given[c].to_pylist()]])
        rows, places, windows = read("rows", np.int32), read("places", np.int64), read("windows", np.int32).astype(np.int64)
        order = np.argsort(rows, kind="stable")
        rows, places, windows = rows[order], places[order], windows[order]
        names = sorted((d, s) for d, s in zip(right["doc_id"].to_pylist(), right["sha"].to_pylist(), strict=True) if s is not None)
        number = {name: i for i, name in enumerate(names)}
        out = []
        for doc_id, data in zip(left["doc_id"].to_pylist(), bytes_list(left["text"]), strict=True):
            kept, removed, spans = data, 0, 0
            if doc_id is not None and len(data) >= LEAST:
                i = number.get((doc_id, hashlib.sha256(data).digest()))
                if i is None:
                    kept, removed, spans = b"", len(data), 1
                else:
                    a, b = np.searchsorted(rows, i, "left"), np.searchsorted(rows, i, "right")
                    if b > a:
                        gone = runs_of(len(data), places[a:b], windows[a:b])
                        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                        removed = len(data) - len(kept)
                        spans = int(gone[0]) + int((np.diff(gone.view(np.int8)) == 1).sum())
            out.append((doc_id, len(data), removed, spans, hashlib.sha256(kept).hexdigest() if kept else empty, kept.decode("utf-8", "replace") if keep_text else None))
        types = (*[pa.int64()] * 4, pa.string(), pa.string())
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return steps.texts.groupBy("g").cogroup(both.groupBy("g")).applyInArrow(finish, RESULT)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir), keep_text=False).drop("kept")


OP5_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
c AS (SELECT doc_id, p, substr(h, 2 * p + 1, 498) AS part FROM (SELECT doc_id, h, unnest(range(0, n - 49, 200)) AS p FROM d WHERE n >= 50)),
w AS (SELECT doc_id, p + i AS i, substr(part, 2 * i + 1, 100) AS s FROM (SELECT doc_id, p, part, unnest(range(least(200, strlen(part) // 2 - 49))) AS i FROM c)),
first AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
gone AS (SELECT w.doc_id, w.i FROM w JOIN first f ON f.s = w.s WHERE f.least < w.doc_id),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM gone),
numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY 1, 2),
gaps AS (SELECT r.doc_id, r.a, r.b, coalesce(lag(r.b) OVER (PARTITION BY r.doc_id ORDER BY r.a), 0) AS before FROM runs r),
kept AS (SELECT g.doc_id, sum(g.b - g.a) AS n_removed, count(*) AS n_spans, string_agg(substr(d.h, 2 * g.before + 1, 2 * (g.a - g.before)), '' ORDER BY g.a) || substr(any_value(d.h), 2 * max(g.b) + 1) AS k FROM gaps g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
