"""Benchmark decontamination: a hash set of test windows meets every window of the documents, with JVM functions only.

Words are runs of letters, digits and characters beyond ASCII, after A-Z became a-z. WINDOW consecutive words of a benchmark
item are a window; an item with fewer words, but not none, is one window. The windows and the items that hold each make a
set, which is sent to all executors where its size is below SET_BYTES; a larger one meets the documents' windows in a
shuffle. A document's windows are hashed in place and look for the hash; a hit is verified word by word. Only hits and one
row for each document leave the scan, so no text is shuffled and a hot passage costs a row for each place where it occurs.

A window that many items hold carries the array of their ids, once for each document that has the window.

`contaminated` reports documents, `decontaminated` removes what was found: the hit spans, or whole documents.

Defined results: a null or empty text has no words and no hits; a null id is an id like others; rows that repeat a document
are reported as often as they occur. Benchmark rows that share an item_id are one item, each row with its own windows; a null
item_id is written as the empty text. A benchmark without words hits nothing, a table without rows gives none. Other columns
of docs don't matter; `decontaminated` passes them through under any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import each, folded, let, numbered, only, raw, scan, zipped
from .common import cut, documents, every, fresh, text_or_empty

WINDOW = 10
# The characters of words, after A-Z became a-z, as specified.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*+[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++|[\x00-\x7F]++"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Estimated bytes up to which the set of windows, or the table of documents with hits, is sent to all executors.
SET_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def windows_of(length: int, words: str = "words") -> str:
    """Hashes of the windows of so many words, in order."""
    hashes = lambda w: each(f"sequence(1, size({w}) - {length} + 1)", lambda i: f"xxhash64(slice({w}, {i}, {length}))")
    return let(words, lambda w: f"CASE WHEN size({w}) >= {length} THEN {hashes(w)} ELSE cast(array() AS array<bigint>) END")


def window_set(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """window (its words, joined by blanks), length, hash and items, the ids of those that hold it as sorted strings."""
    words = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words_of(text_or_empty(text_col)).alias("words")).where("size(words) > 0")
    length = f"least(size(words), {window})"
    starts = F.explode(F.expr(f"sequence(1, size(words) - {length} + 1)"))
    found = words.withColumn("at", starts).select("item", F.expr(f"slice(words, at, {length})").alias("w"))
    sets = found.groupBy("w").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return sets.select(F.array_join("w", " ").alias("window"), F.size("w").alias("length"), F.xxhash64("w").alias("hash"), "items")


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, set_bytes: int = SET_BYTES) -> DataFrame:
    """doc_id, sha (of the text), n_words, times (equal rows) and, of every occurrence of a window, found: its first word (from
    1), the word after it; and items, a distinct array for each set of items that holds a window of the document."""
    known = cut(window_set(benchmark, window=window))
    # The lengths that occur are at most `window` numbers; the sizes are one row.
    size = known.agg(F.sum(F.octet_length("window") + F.lit(64) + F.expr(f"{folded('items', '0', lambda a, x: f'{a} + octet_length({x}) + 16')}")).alias("n"), F.sort_array(F.collect_set("length")).alias("lengths")).first()
    small = (size["n"] or 0) <= set_bytes
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("sha"), words_of(text).alias("words"))
    # The outer forms, as Spark infers a filter from the others, with the arrays' definitions in it, which means a second evaluation.
    # Length 0 stands for the document itself: one row, whether anything is hit or not.
    parts = [F.struct(F.lit(0).alias("length"), F.array(F.xxhash64("doc_id", "sha")).alias("hashes"))]
    parts += [F.struct(F.lit(n).alias("length"), F.expr(windows_of(n)).alias("hashes")) for n in size["lengths"]]
    scanned = rows.select("doc_id", "sha", "words", F.size("words").cast("long").alias("n_words"), F.array(*parts).alias("parts"))
    scanned = scanned.select("doc_id", "sha", "words", "n_words", F.inline_outer("parts")).select("doc_id", "sha", "words", "n_words", F.col("length").alias("n"), F.posexplode_outer("hashes").alias("at", "h"))
    own = F.array_join(F.expr("slice(words, at + 1, n)"), " ")
    if small:
        met = scanned.join(F.broadcast(known), (F.col("h") == F.col("hash")) & (F.col("n") == F.col("length")) & (own == F.col("window")), "left")
    else:
        met = scanned.withColumn("own", own).drop("words").join(known, (F.col("h") == F.col("hash")) & (F.col("n") == F.col("length")) & (F.col("own") == F.col("window")), "left")
    met = met.where("n = 0 or window is not null")
    found = F.when(F.col("n") > 0, F.struct((F.col("at") + 1).alias("a"), (F.col("at") + 1 + F.col("n")).alias("b")))
    return met.groupBy("doc_id", "sha", "n_words").agg(F.count_if(F.col("n") == 0).alias("times"), F.array_sort(F.collect_set(found)).alias("found"), F.collect_set("items").alias("items"))


def runs(found: str = "found") -> str:
    """Maximal runs of hit words, structs of a and b, from occurrences in order of their first word: a run starts where an
    occurrence begins after the end of all before it, and ends with the largest end before the next start."""

    def body(f: str) -> str:
        starts = let(scan(each(f, lambda x: f"{x}.b"), "0", lambda a, b: f"greatest({a}, {b})"), lambda m: only(zipped(f, m, lambda x, y: f"CASE WHEN {x}.a > {y} THEN named_struct('a', {x}.a, 'm', {y}) END"), lambda x: f"{x} IS NOT NULL"))
        last = f"array_max({each(f, lambda x: f'{x}.b')})"
        return let(starts, lambda s: zipped(each(s, lambda x: f"{x}.a"), f"concat(slice({each(s, lambda x: f'{x}.m')}, 2, size({s})), array({last}))", lambda a, b: f"named_struct('a', {a}, 'b', {b})"))

    return let(found, lambda f: f"CASE WHEN size({f}) > 0 THEN {body(f)} ELSE slice(array(named_struct('a', 0, 'b', 0)), 1, 0) END")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, set_bytes: int = SET_BYTES) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, items (ids as sorted strings) and runs of hit words."""
    found = hits(docs, benchmark, id_col, text_col, window, set_bytes)
    found = found.select("doc_id", "sha", "n_words", "times", F.expr(runs()).alias("runs"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))
    hit = F.expr(folded("runs", "0L", lambda a, x: f"{a} + {x}.b - {x}.a")).alias("n_hit")
    return found.select("doc_id", "sha", "n_words", hit, "items", "runs", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))).alias("_one")).drop("_one")


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, set_bytes: int = SET_BYTES) -> DataFrame:
    """docs without what the benchmark holds: remove = "spans" takes hit words out of the text, with what stands before each in
    its run; "documents" takes out whole documents with any hit."""
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove is spans or documents, not {remove}")
    w = fresh(docs, "_hit")
    found = contaminated(docs, benchmark, id_col, text_col, window, set_bytes).where("n_hit > 0")
    found = cut(found.select(F.col("doc_id").alias(f"{w}_id"), F.col("sha").alias(f"{w}_sha"), F.col("runs").alias(f"{w}_runs")).dropDuplicates([f"{w}_id", f"{w}_sha"]))
    size = found.agg(F.sum(F.lit(100) + 8 * F.size(f"{w}_runs"))).first()[0] or 0
    own = F.col("`" + id_col.replace("`", "``") + "`").eqNullSafe(F.col(f"{w}_id")) & (F.sha2(text_or_empty("`" + text_col.replace("`", "``") + "`"), 256) == F.col(f"{w}_sha"))
    joined = docs.join(F.broadcast(found) if size <= set_bytes else found, own, "left_anti" if remove == "documents" else "left")
    if remove == "documents":
        return joined.select(*every(docs))
    at, text = F.col(f"{w}_runs"), "`" + text_col.replace("`", "``") + "`"

    def kept(p: str, rs: str) -> str:
        after = numbered(rs, lambda r, i: f"array_join(slice({p}, {r}.b, coalesce(get({rs}, {i} + 1).a, size({p}) + 1) - {r}.b), '')")
        return f"concat(array_join(slice({p}, 1, {rs}[0].a - 1), ''), array_join({after}, ''))"

    pieces = f"regexp_extract_all({text}, {raw(PIECE)}, 0)"
    cleaned = F.when(at.isNull(), F.col(text)).otherwise(F.expr(let(pieces, lambda p: kept(p, f"{w}_runs"))))
    return joined.withColumn(text_col, cleaned).select(*every(docs))


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids, (F.col("n_hit") > 0).alias("contaminated"))


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
bn AS (SELECT item, w, least(len(w), {WINDOW}) AS n FROM b WHERE len(w) > 0),
known AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
lengths AS (SELECT DISTINCT n FROM known),
windows AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
hit AS (SELECT r, i, h.n, item FROM windows h JOIN known k ON h.n = k.n AND h.win = k.win),
words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY 1),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
