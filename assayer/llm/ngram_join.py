"""N-gram Jaccard join by multiple-global-order filtering, and the groups that its links make.

A document's set is that of its word shingles; two documents link when their sets' Jaccard similarity reaches the threshold.
Under any global order of shingles, two linked sets share one of each one's first n - ceil(t * n) + 1. Two orders are used,
both by the class of a shingle's document count, the rarest first, and within a class by two different permutations of the
hash. Candidates must share a prefix token under the one and under the other before their sets are compared exactly.

1. Equal sets become one class before anything else, so copies cost one row each.
2. A census gives the class of every shingle of every distinct set. A set whose prefix holds no shingle of two documents has
   no partner and is done; that is most sets.
3. The rest are placed: labels spread over shared tokens, sets of a label share a block, and a label with many sets is split
   into blocks of a bounded number of sets. A block compares its sets through an index of prefix tokens, and with the one
   set that gives the label its name, and reports links as a star for each connected part.
4. After the parts are joined up, only tokens that hold more than one part matter. A set outside a token's largest part
   visits the blocks where that token holds other parts, if it would do so under both orders (the order in which parts are
   larger is one for all tokens, so one of two sets visits the other under both). Parts that already hang
   together are never compared again, so a group of near copies costs about one visit for each block, not one for each pair.

The result is exact: every pair that could link is compared or already connected.

Defined results: a null or empty text, or one of white space, has no shingles and links with nothing; fewer words than a
shingle has make one shingle of them all. Rows that share an id are one node. A null id takes no part: its row has the
number of shingles and no component. Repeated rows link, other columns don't matter, a table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import census
from .common import bytes_list, cut, documents, forget, mix64, n_groups, sliced, text_bytes, word_hashes
from .components import components

WORDS, PERCENT = 5, 75
BLOCK_SETS, VISITORS = 256, 2048
#: A part is heavy if it has at least one in so many of all sets; so there are no more heavy parts than this.
HEAVY = 1024
_FACTORS = np.random.default_rng(91).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDER_B = np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(data: bytes, k: int = WORDS) -> np.ndarray:
    """Distinct hashes of the k-word shingles of a text, sorted."""
    words = word_hashes(data)
    if not len(words):
        return words
    if len(words) < k:
        return mix64((words * _FACTORS[32 : 32 + len(words)]).sum(keepdims=True) + np.uint64(len(words)))
    total = words[: len(words) - k + 1] * _FACTORS[0]
    for i in range(1, k):
        total += words[i : len(words) - k + 1 + i] * _FACTORS[i]
    return np.unique(mix64(total))


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed integers."""
    if not len(s):
        return 0, 0
    both = np.array([s.sum(), mix64(s ^ _ORDER_B).sum()], np.uint64).view(np.int64)
    return int(both[0]), int(both[1])


ROWS = "doc_id long, n_shingles long, set_a long, set_b long"


def sets_of(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, size and name of every row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for data in bytes_list(batch.column(1)):
                s = shingles(data, k)
                rows.append((len(s), *set_hash(s)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]], names=["doc_id", "n_shingles", "set_a", "set_b"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ROWS)


def _own_sets(texts: pa.Table, chosen: set[tuple[int, int, int]], k: int) -> dict[int, np.ndarray]:
    """The sets of a group's representatives, by id; sets of rows that share an id are told apart by their names."""
    out: dict[int, np.ndarray] = {}
    ids = {c[0] for c in chosen}
    for doc_id, data in zip(texts["doc_id"].to_pylist(), bytes_list(texts["text"]), strict=True):
        if doc_id in ids:
            s = shingles(data, k)
            name = (doc_id, *set_hash(s))
            if name in chosen:
                chosen.discard(name)
                out[len(out)] = (doc_id, s)
    return out


def _together(own: dict, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Short hashes of all sets in a row, and where each set ends."""
    every = [s for _, s in own.values()]
    return census.short(np.concatenate(every), groups) if every else np.zeros(0, np.uint64), np.cumsum([len(s) for s in every])


def _chosen(table: pa.Table) -> set[tuple[int, int, int]]:
    return {r for r in zip(table["doc_id"].to_pylist(), table["set_a"].to_pylist(), table["set_b"].to_pylist(), strict=True) if r[0] is not None}


SURVIVORS = "node long, size int, shingles binary, first array<long>, second array<long>"


def prefixes(s: np.ndarray, classes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix tokens that other documents have too, under both orders."""
    length = len(s) + (-percent * len(s)) // 100 + 1
    shared = classes > 1
    room = length - int(len(s) - shared.sum())
    if room <= 0:
        return s[:0], s[:0]
    tokens, rank = s[shared], classes[shared]
    first = tokens[np.lexsort((tokens, rank))[:room]]
    second = tokens[np.lexsort((tokens * _ORDER_B, rank))[:room]]
    return first, second


def survivors(docs: DataFrame, reps: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Representatives whose prefixes hold a token of another set, with their sets and such tokens under both orders."""
    groups = n_groups(docs.sparkSession, text_bytes(docs, text_col))
    deal = F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int").alias("g")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null").select(deal, "doc_id", "text")
    chosen = reps.select(deal, "doc_id", "set_a", "set_b")

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        own = _own_sets(left, _chosen(right), k)
        every, _ = _together(own, groups)
        values, counts = np.unique(every, return_counts=True)
        return census.sent((left if left.num_rows else right)["g"][0].as_py(), values, counts, groups)

    known = census.classes(texts.groupBy("g").cogroup(chosen.groupBy("g")).applyInArrow(send, census.SENT))
    both = chosen.unionByName(known, allowMissingColumns=True)

    def keep(left: pa.Table, right: pa.Table) -> pa.Table:
        own = _own_sets(left, _chosen(right), k)
        every, ends = _together(own, groups)
        _, at = np.unique(every, return_inverse=True)
        answers = right.filter(pa.compute.is_valid(right["bucket"]))
        classes = census.received(answers["bucket"].to_pylist(), answers["classes"].to_pylist())[at]
        rows = []
        for (doc_id, s), end in zip(own.values(), ends.tolist(), strict=True):
            first, second = prefixes(s, classes[end - len(s) : end], percent)
            if len(first):
                rows.append((doc_id, len(s), s.tobytes(), first.view(np.int64), second.view(np.int64)))
        types = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["node", "size", "shingles", "first", "second"])

    return texts.groupBy("g").cogroup(both.groupBy("g")).applyInArrow(keep, SURVIVORS)


def placed(kept: DataFrame, tokens: DataFrame, block_sets: int) -> DataFrame:
    """(node, label, block): a heuristic, any placement gives the same result. Labels spread twice over first-order tokens."""
    some = tokens.where("ord = 0").select("token", "node", F.col("node").alias("label"))
    for _ in range(2):
        least = some.groupBy("token").agg(F.min("label").alias("least"))
        lower = some.join(least, "token").groupBy("node").agg(F.min("least").alias("label"))
        some = cut(some.select("token", "node").join(lower, "node")) if _ == 0 else lower
    labels = some.select("node", "label")
    sizes = labels.groupBy("label").agg(F.count("*").alias("members"))
    bins = F.lit(max(1, -(-kept.count() // block_sets)))
    split = F.ceil(F.col("members") / block_sets)
    large = F.concat_ws("/", F.lit("s"), "label", F.pmod(F.xxhash64("node"), split))
    small = F.concat_ws("/", F.lit("b"), F.pmod(F.xxhash64("label"), bins))
    return labels.join(sizes, "label").select("node", "label", F.when(F.col("members") > block_sets, split).otherwise(1).cast("int").alias("parts"), F.when(F.col("members") > block_sets, large).otherwise(small).alias("block"))


class Index:
    """Sets of a block with lists of the members that hold each prefix token, for both orders."""

    def __init__(self, table: pa.Table) -> None:
        self.nodes = table["node"].to_pylist()
        self.sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        self.tokens = [[np.asarray(x, np.int64) for x in table[c].to_pylist()] for c in ("first", "second")]
        self.lists = []
        for held in self.tokens:
            owner = np.repeat(np.arange(len(held)), [len(x) for x in held])
            token = np.concatenate(held) if held else np.zeros(0, np.int64)
            order = np.argsort(token, kind="stable")
            self.lists.append((token[order], owner[order]))

    def candidates(self, tokens: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Members that share a prefix token under the one order and under the other."""
        out = None
        for mine, (token, owner) in zip(tokens, self.lists, strict=True):
            low, high = np.searchsorted(token, mine, "left"), np.searchsorted(token, mine, "right")
            hit = np.zeros(len(self.nodes), bool)
            for a, b in zip(low.tolist(), high.tolist(), strict=True):
                hit[owner[a:b]] = True
            out = hit if out is None else out & hit
        return np.flatnonzero(out)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large) or not len(small):
        return False
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


LINKS = "a long, b long"


def _links(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table([pa.array([p[i] for p in pairs], pa.int64()) for i in range(2)], names=["a", "b"])


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def within(percent: int):
    """Links inside a block, as a star for each connected part."""

    def run(table: pa.Table) -> pa.Table:
        index = Index(table)
        parent = list(range(len(index.nodes)))
        for i in range(len(parent)):
            for j in index.candidates((index.tokens[0][i], index.tokens[1][i])).tolist():
                if j < i and (x := _find(parent, i)) != (y := _find(parent, j)) and linked(index.sets[i], index.sets[j], percent):
                    parent[max(x, y)] = min(x, y)
        return _links([(index.nodes[i], index.nodes[r]) for i in range(len(parent)) if (r := _find(parent, i)) != i])

    return run


def between(percent: int):
    """Links of visitors with a block's members in other parts, one for each part at most."""

    def run(table: pa.Table) -> pa.Table:
        role = np.asarray(table["role"].to_pylist())
        members, visitors = table.filter(pa.array(role == 0)), table.filter(pa.array(role == 1))
        index, parts = Index(members), members["part"].to_pylist()
        pairs = []
        for node, part, data, first, second in zip(*[visitors[c].to_pylist() for c in ("node", "part", "shingles", "first", "second")], strict=True):
            own, done = np.frombuffer(data, np.uint64), {part}
            for j in index.candidates((np.asarray(first, np.int64), np.asarray(second, np.int64))).tolist():
                if parts[j] not in done and linked(own, index.sets[j], percent):
                    done.add(parts[j])
                    pairs.append((node, index.nodes[j]))
        return _links(pairs)

    return run


def links(kept: DataFrame, percent: int = PERCENT, block_sets: int = BLOCK_SETS, visitors: int = VISITORS) -> DataFrame:
    """Links that connect the survivors as all their links would; kept is read several times."""
    tokens = kept.select("node", F.explode("first").alias("token")).select("node", F.lit(0).alias("ord"), "token")
    tokens = cut(tokens.union(kept.select("node", F.explode("second").alias("token")).select("node", F.lit(1), "token")))
    places = cut(placed(kept, tokens, block_sets))
    sets = kept.join(places, "node")
    named = sets.where("node = label and parts > 1")
    copies = named.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("_to", F.concat_ws("/", F.lit("s"), "label", F.col("_part"))).where("_to <> block").withColumn("block", F.col("_to"))
    columns = ["block", "node", "shingles", "first", "second"]
    inside = cut(sets.select(*columns).union(copies.select(*columns)).groupBy("block").applyInArrow(within(percent), LINKS))
    parts = places.select("node", "block").join(components(inside), "node", "left").select("node", "block", F.coalesce("component", "node").alias("part"))
    parts = cut(parts)
    # Any fixed order of the parts gives the same links; heavy ones last saves visits. There are at most HEAVY of those, so they
    # are broadcast, and no part is dealt to a task by its name.
    heavy = parts.groupBy("part").agg(F.count("*").alias("members")).where(F.col("members") * HEAVY >= parts.count())
    held = tokens.join(parts.join(F.broadcast(heavy), "part", "left").withColumn("members", F.coalesce("members", F.lit(0))), "node")
    mixed = held.groupBy("ord", "token").agg(F.min("part").alias("_low"), F.max("part").alias("_high"), F.max(F.struct("members", "part")).alias("_top")).where("_low <> _high").select("ord", "token", F.col("_top.part").alias("top"))
    held = cut(held.join(mixed, ["ord", "token"]))
    targets = held.groupBy("ord", "token", "block").agg(F.min("part").alias("_low"), F.max("part").alias("_high")).withColumnRenamed("block", "to")
    ways = held.where("part <> top").select("ord", "token", "node", "part").join(targets, ["ord", "token"]).where("_low <> part or _high <> part")
    visits = ways.groupBy("node", "part", "to").agg(F.count_distinct("ord").alias("orders")).where("orders = 2").select("node", "part", F.col("to").alias("block"))
    visits = cut(visits)
    shares = visits.groupBy("block").agg(F.ceil(F.count("*") / visitors).cast("int").alias("shares"))
    visiting = kept.join(visits, "node").join(shares, "block").select("block", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("role"), "node", "part", "shingles", "first", "second")
    home = kept.join(parts, "node").join(shares, "block").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    home = home.select("block", "share", F.lit(0).alias("role"), "node", "part", "shingles", "first", "second")
    outside = visiting.union(home).groupBy("block", "share").applyInArrow(between(percent), LINKS)
    out = cut(inside.union(outside))
    forget(tokens, places, inside, parts, held, visits)
    return out


def near_groups(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", block_sets: int = BLOCK_SETS) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest id that links reach, for each row."""
    rows = cut(sets_of(docs, k, id_col, text_col))
    full = rows.where("n_shingles > 0 and doc_id is not null")
    classes = cut(full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("first_id")))  # cut, so that the join below may split a hot set
    kept = cut(survivors(docs, classes.select(F.col("first_id").alias("doc_id"), "set_a", "set_b"), k, percent, id_col, text_col))
    members = cut(rows.join(classes, ["set_a", "set_b"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("first_id")).otherwise(F.col("doc_id")).alias("node")))
    again = members.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    same = members.join(again, "doc_id").select(F.col("node").alias("a"), F.col("a").alias("b"))
    linked_up = links(kept, percent, block_sets)
    found = components(linked_up.union(same))
    forget(rows, classes, kept, linked_up)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node"))
    out = members.join(found, "node", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS node, b AS found FROM edge UNION SELECT r.node, edge.b FROM reach r JOIN edge ON edge.a = r.found)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.found, d.doc_id)) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT node, min(found) AS found FROM reach GROUP BY 1) m ON m.node = d.doc_id
"""
