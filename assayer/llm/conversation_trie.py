"""Prefix tries of conversations: dictionary tries by partition of the first turn, large subtries dealt out by their next turn.

A turn is a digest of its role and text and the bytes of the text; texts go no further. Conversations with equal turns are one
sequence with many members from the start, so copies cost a row each up to that point only. A sequence goes to the partition of
its key, the digest of its first turn. Where a key's sequences have over TURNS turns, the key grows to one turn beyond what they
all share (the common prefix of the least and the largest of them), which always splits them, and so on until no key is that
large or it has one sequence only. A task builds a pointer trie for each of its keys, dictionaries from digest to child, and sums
leaves and savings up from its end, where every child comes before its parent.

The nodes above the keys, from the root on, make the spine. Their figures are sums over the keys' top nodes and go by groups.
The hash of a node's members is taken along the sorted ids in a stream, in chunks of ids joined before they are sent.

Defined results: turns without a number come first; turns that share a number come in the order of their digests. A null role or
text is empty. Rows without a conv_id belong to no conversation. Repeated rows are turns of their own. conv_id is a whole
number. A table without conversations has no node, not even a root. Other columns don't matter. A conversation's turns, 40 bytes
each, have to fit into a task, however many.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, forget
from .sql import CRC_TABLE, crc32_sql

#: Turns of all sequences of a key up to which one task builds its trie.
TURNS = 1 << 17
#: Ids in a chunk of a node's members.
CHUNK = 1 << 12
#: Spine nodes up to which they are sent to all tasks.
SPINE_ROWS = 1 << 17
# Conversations of a family, and the residues of the number of turns that they share, as specified.
FAMILY, RESIDUES = 5, 9
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
EMPTY = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id and turns, in order: structs of digest and bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), digest.alias("digest"), F.octet_length(text).alias("bytes")).alias("t"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.expr("transform(t, x -> named_struct('digest', x.digest, 'bytes', x.bytes))").alias("turns"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Every conversation with the first turns of its family's first one in place of its own first; their number is a hash."""
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % RESIDUES
    firsts = own.where(f"conv_id % {FAMILY} = 0").select(F.col("conv_id").alias("family"), F.slice("turns", 1, RESIDUES - 1).alias("head"))
    both = own.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family"), shared.cast("int").alias("h")).join(firsts, "family", "left")
    head = "CASE WHEN head IS NOT NULL THEN slice(head, 1, h) ELSE slice(turns, 1, 0) END"
    return both.select("conv_id", F.expr(f"concat({head}, slice(turns, h + 1, size(turns)))").alias("turns"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (name, least, n, ids) in order of name and ids: one row for each name, with the hash of all ids."""
    name, least, n, hasher = None, 0, 0, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"name": [x[0] for x in done], "least": [x[1] for x in done], "n": [x[2] for x in done], "ends": [x[3] for x in done]}, pa.schema([("name", pa.string()), ("least", pa.int64()), ("n", pa.int64()), ("ends", pa.string())]))

    for batch in batches:
        done = []
        for key, first, some, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key != name:
                if hasher is not None:
                    done.append((name, least, n, hasher.hexdigest()))
                name, least, n, hasher = key, first, 0, hashlib.sha256()
            else:
                hasher.update(b",")
            hasher.update(ids.encode())
            n += some
        yield row()
    done = [(name, least, n, hasher.hexdigest())] if hasher is not None else []
    yield row()


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """turns, with n members, the least of them, and the hash of all their ids."""
    named = convs.withColumn("name", F.expr("sha2(array_join(transform(turns, x -> hex(x.digest)), ''), 256)"))
    by = F.floor(F.col("conv_id") / CHUNK).alias("chunk")
    chunks = named.groupBy("name", by).agg(F.min("conv_id").alias("least"), F.count("*").alias("n"), F.sort_array(F.collect_list("conv_id")).alias("ids"))
    chunks = chunks.select("name", "least", "n", F.expr("array_join(transform(ids, x -> cast(x AS string)), ',')").alias("ids"))
    members = chunks.repartition("name").sortWithinPartitions("name", "least").mapInArrow(_hashed, "name string, least long, n long, ends string")
    return named.groupBy("name").agg(F.first("turns").alias("turns")).join(members, "name").drop("name")


KEY = "sha2(array_join(transform(slice(turns, 1, k), x -> hex(x.digest)), ''), 256)"


def keyed(seqs: DataFrame, limit: int = TURNS) -> DataFrame:
    """seqs with k, the number of turns in their key, key and on_spine: a sequence that ends above all keys has k turns."""
    now = cut(seqs.withColumns({"k": F.least(F.size("turns"), F.lit(1)), "on_spine": F.size("turns") == 0}).withColumn("key", F.expr(KEY)))
    while True:
        sizes = now.where("NOT on_spine").groupBy("key").agg(F.sum(F.size("turns") - F.col("k")).alias("rest"), F.count("*").alias("n")).where(f"rest > {limit} AND n > 1").select("key")
        large = cut(sizes)
        if large.isEmpty():
            forget(large)
            return now
        digests = F.expr("transform(turns, x -> x.digest)")
        ends = now.where("NOT on_spine").join(large, "key", "left_semi").select("key", digests.alias("d")).groupBy("key").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
        shared = ends.select("key", F.expr("cast(array_position(zip_with(lo, hi, (x, y) -> coalesce(x = y, false)), false) AS int) - 1").alias("shared"))
        moved = now.join(shared, "key", "left")
        ended = F.coalesce((~F.col("on_spine")) & (F.size("turns") == F.col("shared")), F.lit(False))
        moves = (~F.col("on_spine")) & F.col("shared").isNotNull()
        k = F.when(moves, F.least(F.col("shared") + 1, F.size("turns"))).otherwise(F.col("k"))
        after = moved.withColumns({"k": k, "on_spine": F.col("on_spine") | ended}).drop("shared", "key").withColumn("key", F.expr(KEY))
        after = cut(after.select(*now.columns))
        forget(now, large)
        now = after


class Trie:
    """Nodes in the order in which they are made, so parents before their children; node 0 is the key's last turn."""

    def __init__(self, depth: int, size: int) -> None:
        self.children: list[dict[bytes, int]] = [{}]
        self.depth, self.parent, self.size = [depth], [-1], [size]
        self.n, self.least, self.ends = [0], [None], [EMPTY]

    def add(self, digests: list[bytes], sizes: list[int], n: int, least: int, ends: str) -> None:
        at = 0
        self._count(at, n, least)
        for digest, size in zip(digests, sizes, strict=True):
            below = self.children[at].get(digest)
            if below is None:
                below = self.children[at][digest] = len(self.n)
                for column, x in ((self.children, {}), (self.depth, self.depth[at] + 1), (self.parent, at), (self.size, size), (self.n, 0), (self.least, None), (self.ends, EMPTY)):
                    column.append(x)
            at = below
            self._count(at, n, least)
        self.ends[at] = ends

    def _count(self, at: int, n: int, least: int) -> None:
        self.n[at] += n
        self.least[at] = least if self.least[at] is None else min(self.least[at], least)

    def rows(self) -> Iterator[tuple]:
        """Figures of every node, children before parents."""
        leaves = [0 if x else 1 for x in self.children]
        saved = [(n - 1) * size for n, size in zip(self.n, self.size, strict=True)]
        for i in range(len(self.n) - 1, -1, -1):
            p = self.parent[i]
            if p >= 0:
                leaves[p] += leaves[i]
                saved[p] += saved[i]
            yield self.least[i], self.depth[i], self.least[p] if p >= 0 else None, self.n[i], len(self.children[i]), leaves[i], saved[i], self.ends[i]


TOP = ", prefix array<string>, sizes array<long>"
_TYPES = [*[pa.int64()] * 7, pa.string(), pa.list_(pa.string()), pa.list_(pa.int64())]
_NAMES = [x.split(" ")[0] for x in (NODE + TOP).split(", ")]


def prefix_names(digests: list[bytes]) -> list[str]:
    """Names of the nodes along a path, from the root's on."""
    so_far = hashlib.sha256()
    out = [so_far.hexdigest()]
    for d in digests:
        so_far.update(d)
        out.append(so_far.hexdigest())
    return out


def _tries(table: pa.Table) -> pa.Table:
    """The nodes of all keys of a partition. A key's top node carries the names and sizes of the nodes above it; so does a
    sequence that ends on the spine, which is no node of its own (n_children is null) and counts for the last of them."""
    turns = table["turns"].combine_chunks()
    bounds = turns.offsets.to_pylist()
    digests, sizes = turns.values.field("digest").to_pylist(), turns.values.field("bytes").to_pylist()
    tries: dict[str, Trie] = {}
    tops: dict[str, tuple[int, int]] = {}
    out: list[tuple] = []
    for i, (key, k, on_spine, n, least, ends) in enumerate(zip(*[table[c].to_pylist() for c in ("key", "k", "on_spine", "n", "least", "ends")], strict=True)):
        a, b = bounds[i], bounds[i + 1]
        if on_spine:
            out.append((least, k, None, n, None, 0, 0, ends, prefix_names(digests[a:b]), [0, *sizes[a:b]]))
            continue
        if key not in tries:
            tries[key], tops[key] = Trie(k, sizes[a + k - 1]), (a, k)
        tries[key].add(digests[a + k : b], sizes[a + k : b], n, least, ends)
    for key, trie in tries.items():
        a, k = tops[key]
        rows = list(trie.rows())
        out += [(*r, None, None) for r in rows[:-1]]
        out.append((*rows[-1], prefix_names(digests[a : a + k - 1]), [0, *sizes[a : a + k - 1]]))
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(_TYPES)], names=_NAMES)


def prefix_trie(convs: DataFrame, limit: int = TURNS) -> DataFrame:
    """The nodes of the trie of convs (conv_id, turns), a row each; see NODE."""
    spark = convs.sparkSession
    seqs = keyed(distinct_sequences(convs), limit)
    total = seqs.agg(F.sum(F.size("turns"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // limit))
    built = cut(seqs.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInArrow(_tries, NODE + TOP))
    forget(seqs)
    # Spine: what each top node, and each sequence that ends there, adds to every node above it.
    tops = built.where("prefix IS NOT NULL")
    above = tops.select("*", F.posexplode("prefix").alias("j", "id"))
    here = F.col("j") == F.size("prefix") - 1
    ended = F.when(here & F.col("n_children").isNull(), F.col("ends_sha256"))
    spine = above.groupBy("id").agg(
        F.min("conv_id").alias("conv_id"),
        F.first("j").cast("long").alias("depth"),
        F.sum("n_convs").alias("n_convs"),
        F.count_if(here & F.col("n_children").isNotNull()).alias("n_tops"),
        F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved"),
        F.max(ended).alias("ends"),
        F.min(F.slice("prefix", F.lit(1), F.col("j") + 1)).alias("path"),
        F.max(F.element_at("sizes", F.col("j") + 1)).alias("size"),
    )
    spine = cut(spine.withColumns({"own": (F.col("n_convs") - 1) * F.col("size"), "up": F.get("path", F.col("depth").cast("int") - 1)}))
    below = spine.groupBy("up").agg(F.count("*").alias("n_spine")).where("up IS NOT NULL").withColumnRenamed("up", "id")
    sums = spine.select(F.explode("path").alias("id"), "own").groupBy("id").agg(F.sum("own").alias("own_below"))
    figures = spine.drop("own").join(sums, "id").join(below, "id", "left").withColumn("n_children", F.col("n_tops") + F.coalesce("n_spine", F.lit(0)))
    parents = spine.select(F.col("id").alias("up"), F.col("conv_id").alias("parent"))
    if spine.count() <= SPINE_ROWS:
        parents = F.broadcast(parents)
    leaves = F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("n_leaves")).alias("n_leaves")
    of_spine = figures.join(parents, "up", "left").select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", leaves, (F.col("saved") + F.col("own_below")).alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))
    of_tops = tops.where("n_children IS NOT NULL").withColumn("up", F.element_at("prefix", -1)).join(parents, "up", "left").withColumn("parent_conv_id", F.col("parent"))
    names = of_spine.columns
    return built.where("prefix IS NULL").select(*names).union(of_tops.select(*names)).union(of_spine)


OP12_SQL = f"""
WITH {CRC_TABLE},
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n_own FROM t GROUP BY 1),
h AS (SELECT conv_id, n_own, {crc32_sql("CAST(conv_id AS VARCHAR)")} % {RESIDUES} AS h FROM c, crc),
r AS (
  SELECT h.conv_id, t.p, t.role, t.text FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % {FAMILY} AND t.p <= h.h
  UNION ALL SELECT h.conv_id, 100 + t.p, t.role, t.text FROM h JOIN t ON t.conv_id = h.conv_id AND t.p > h.h),
o AS (SELECT conv_id, row_number() OVER w AS depth, list(role || chr(1) || text) OVER w AS path, strlen(text) AS size FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
paths AS (SELECT conv_id, depth, sha256(array_to_string(path, chr(2))) AS id, coalesce(sha256(array_to_string(path[1 : depth - 1], chr(2))), '') AS up, size FROM o),
p0 AS (SELECT conv_id, depth, id, CASE WHEN depth = 1 THEN '' ELSE up END AS up, size FROM paths UNION ALL SELECT conv_id, 0, '', NULL, 0 FROM c),
e AS (SELECT conv_id, max(depth) AS last FROM p0 GROUP BY 1),
n AS (
  SELECT id, p0.depth, any_value(up) AS up, min(p0.conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
    sha256(coalesce(string_agg(CAST(p0.conv_id AS VARCHAR), ',' ORDER BY p0.conv_id) FILTER (WHERE p0.depth = e.last), '')) AS ends_sha256
  FROM p0 JOIN e ON e.conv_id = p0.conv_id GROUP BY 1, 2),
k AS (SELECT up AS id, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY 1),
f AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.id = n.id),
s AS (
  SELECT a.id, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.size) AS saved
  FROM f JOIN p0 a ON a.conv_id = f.conv_id AND a.depth <= f.depth GROUP BY 1)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s ON s.id = f.id LEFT JOIN n u ON u.id = f.up
"""


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
