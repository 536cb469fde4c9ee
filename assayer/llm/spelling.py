"""Spelling variants: Aho-Corasick automata over the halves of all words.

Words are runs of letters, A-Z lower-cased. Two words are near if one insertion, deletion or replacement of a code point makes
one of the other. Such an edit touches one half of a word only; the other half stands in its neighbour untouched, at the start
or at the end. So every word holds two segments, its halves, in automata, and every word is scanned by the automata that its own
possible halves lead to: lengths differ by one at most, so there are two prefixes and two suffixes at most. A hit counts where
the segment's offset is that of its half and the lengths fit; the rest of both words then decides the distance: words with one
segment are looked up by the rest with one code point deleted, which finds a replacement at its place and an insertion or a
deletion at any, so that no list of words with one segment is compared pair by pair.

Segments are dealt into shards by hash; a shard is a task with one automaton. A segment with over SEGMENT_WORDS words, such as a
prefix that a third of all words have, is dealt out again by the halves of what remains of its words, as often as needed: each
time the rest halves. Where less than 4 code points remain there is nothing to deal out, and alphabets bound such groups.

`edited_words` makes the words of the query; `variants` takes any table of distinct words and counts. A word's form is its near
word of largest n (ties: the smallest in code-point order), if that n is at least RATIO times its own; root follows forms to the
last. n grows RATIO-fold each step, so there are few.

Defined results: a null text has no words; a null id counts as the empty text in the hash; rows that repeat a document count as
often as they occur. A table without words gives none. Other columns don't matter.
"""

from __future__ import annotations

import math
from collections import defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, forget, stored
from .sql import CRC_TABLE, crc32_sql

# The characters of words, the share of edited ones, least length, least count and ratio, as specified.
LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EDITED, LEAST_LENGTH, LEAST_COUNT, RATIO = 31, 7, 2, 10
#: Words with one segment in one place beyond which they are dealt out again.
SEGMENT_WORDS = 1 << 16
#: Rows for each shard, about.
SHARD_ROWS = 1 << 17


def edited_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n: runs of letters of all texts, one code point deleted where the hash of id and run says so."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("d"), F.explode_outer(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(LETTERS), F.lit(0))).alias("run")).where(F.char_length("run") >= LEAST_LENGTH)
    h = F.crc32(F.concat(F.col("d"), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    without = F.concat(F.expr("left(run, cast(h % char_length(run) AS int))"), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.col("h") % EDITED == 0, without).otherwise(F.col("run"))
    return found.withColumn("h", h).select(word.alias("word")).where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(f"n >= {LEAST_COUNT}")


def _halves(rest: str, holds: bool) -> str:
    """Structs (side, k) of a text: its halves, or, where it is scanned, all that may be a near one's half."""
    lengths = [f"char_length({rest})"] if holds else [f"char_length({rest}) {d}" for d in ("- 1", "", "+ 1")]
    out = [f"named_struct('side', 'l', 'k', ({n}) div 2), named_struct('side', 'r', 'k', ({n}) - ({n}) div 2)" for n in lengths]
    return f"array_distinct(array({', '.join(out)}))"


def _dealt(rows: DataFrame) -> DataFrame:
    """rows (word, n, holds, parent, rest), once for each segment that they hold or may meet: key, side, and k, its length."""
    both = [rows.where(F.col("holds") == F.lit(h)).withColumn("s", F.explode(F.expr(_halves("rest", h)))) for h in (True, False)]
    segment = F.when(F.col("s.side") == "l", F.expr("left(rest, s.k)")).otherwise(F.expr("right(rest, s.k)"))
    return both[0].union(both[1]).select("word", "n", "holds", "parent", "rest", "s.side", "s.k", F.xxhash64("parent", "s.side", segment).alias("key"))


def _remaining() -> Column:
    """What _dealt leaves of rest when the segment is taken away."""
    return F.when(F.col("side") == "l", F.expr("substring(rest, k + 1)")).otherwise(F.expr("left(rest, char_length(rest) - k)"))


def near(a: str, b: str) -> bool:
    """Whether one insertion, deletion or replacement makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


class Rests:
    """What remains of the words that hold one segment, to be looked up by one edit."""

    def __init__(self) -> None:
        self.whole: dict[str, list[int]] = defaultdict(list)
        self.replaced: dict[tuple[int, str], list[int]] = defaultdict(list)
        self.shorter: dict[str, list[int]] = defaultdict(list)

    def add(self, rest: str, number: int) -> None:
        self.whole[rest].append(number)
        for i in range(len(rest)):
            less = rest[:i] + rest[i + 1 :]
            self.replaced[i, less].append(number)
            if i == 0 or rest[i] != rest[i - 1]:
                self.shorter[less].append(number)

    def found(self, rest: str) -> list[int]:
        """Numbers of rests at a distance of one at most; equal ones may be among them."""
        out = list(self.shorter.get(rest, ()))
        for i in range(len(rest)):
            less = rest[:i] + rest[i + 1 :]
            out += self.replaced.get((i, less), ())
            if i == 0 or rest[i] != rest[i - 1]:
                out += self.whole.get(less, ())
        return out


PAIRS = "word string, near string, near_n long"


def _scanned(table: pa.Table) -> pa.Table:
    """Near pairs of a shard: an automaton holds all segments, every text to be scanned goes through it once."""
    words, counts = [], []
    automaton = ahocorasick.Automaton()
    scans: dict[tuple[int, str], set[str]] = defaultdict(set)
    for word, n, holds, parent, text, side, k in zip(*[table[c].to_pylist() for c in ("word", "n", "holds", "parent", "text", "side", "k")], strict=True):
        text = word if text is None else text
        if not holds:
            scans[parent, text].add(word)
            continue
        segment, rest = (text[:k], text[k:]) if side == "l" else (text[len(text) - k :], text[: len(text) - k])
        entry = automaton.get(segment, None)
        if entry is None:
            automaton.add_word(segment, entry := (k, {}))
        # A half's place: the group that it was dealt from, its side and the length of the whole.
        place = (parent, side, len(text))
        if place not in entry[1]:
            entry[1][place] = Rests()
        entry[1][place].add(rest, len(words))
        words.append(word)
        counts.append(n)
    out: dict[tuple[str, str, int], None] = {}
    if len(automaton):
        automaton.make_automaton()
        for (parent, text), own in scans.items():
            size = len(text)
            for end, (k, places) in automaton.iter(text):
                for side, fits, rest in (("l", end + 1 == k, text[k:]), ("r", end + 1 == size, text[: size - k])):
                    for whole in (size - 1, size, size + 1) if fits else ():
                        rests = places.get((parent, side, whole))
                        if rests is not None:
                            out.update(((w, words[x], counts[x]), None) for x in rests.found(rest) for w in own if near(w, words[x]))
    return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["word", "near", "near_n"])


def near_pairs(words: DataFrame, segment_words: int = SEGMENT_WORDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """word, near and near_n for every ordered pair of near words of a table of distinct words with n; pairs may repeat."""
    spark = words.sparkSession
    rows = words.select("word", "n", F.explode(F.array(F.lit(True), F.lit(False))).alias("holds"), F.lit(0).cast("long").alias("parent"), F.col("word").alias("rest"))
    out = None
    while True:
        dealt = _dealt(rows)
        held = dealt.where("holds AND char_length(rest) - k >= 4").groupBy("key").agg(F.count("*").alias("words"))
        large = cut(held.where(f"words > {segment_words}").select("key"))
        done = large.isEmpty()
        fit = dealt if done else dealt.join(large, "key", "left_anti")
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-3 * rows.count() // shard_rows))
        text = F.when(F.col("parent") != 0, F.col("rest")).alias("text")
        sent = fit.select(F.pmod("key", F.lit(shards)).alias("shard"), "word", F.when(F.col("holds"), F.col("n")).alias("n"), "holds", "parent", text, "side", "k")
        pairs = sent.groupBy("shard").applyInArrow(_scanned, PAIRS)
        out = pairs if out is None else out.union(pairs)
        if done:
            return out
        rows = cut(dealt.join(large, "key", "left_semi").select("word", "n", "holds", F.col("key").alias("parent"), _remaining().alias("rest")))


def with_roots(forms: DataFrame) -> DataFrame:
    """word and root for every word of forms (word, form, n) that has a form: the end of the chain, by doubling the steps."""
    steps = max(1, math.ceil(math.log(max(forms.agg(F.max("n")).first()[0] or 1, 2), RATIO)))
    now = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(max(1, steps.bit_length())):
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = cut(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
        now = after
    return now


def variants(words: DataFrame, segment_words: int = SEGMENT_WORDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """word, n, n_near, form, form_n and root for every word."""
    known = stored(words.select("word", "n"))
    pairs = near_pairs(known, segment_words, shard_rows).repartition("word").groupBy("word", "near").agg(F.first("near_n").alias("near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near"))).alias("best")
    found = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = known.join(found, "word", "left")
    clear = -F.col("best.m") >= RATIO * F.col("n")
    forms = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(clear, F.col("best.near")).alias("form"), F.when(clear, -F.col("best.m")).alias("form_n")))
    forget(known)
    return forms.join(with_roots(forms), "word", "left").withColumn("root", F.coalesce("root", "word"))


OP13_SQL = f"""
WITH {CRC_TABLE},
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS d, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{LETTERS}')) AS run FROM documents),
once AS (SELECT d, run, count(*) AS n FROM runs WHERE length(run) >= {LEAST_LENGTH} GROUP BY 1, 2),
hashed AS (SELECT run, n, {crc32_sql("d || run")} AS h FROM once, crc),
made AS (SELECT CASE WHEN h % {EDITED} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE length(word) >= {LEAST_LENGTH} GROUP BY 1 HAVING sum(n) >= {LEAST_COUNT}),
less AS (SELECT DISTINCT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS v FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n FROM less a JOIN less b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.v, a.word, a.n FROM less a JOIN words b ON a.v = b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.v = b.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM pairs GROUP BY 1),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, (SELECT min(p.near) FROM pairs p WHERE p.word = w.word AND p.n = b.top AND b.top >= {RATIO} * w.n) AS form, CASE WHEN b.top >= {RATIO} * w.n THEN b.top END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (SELECT word AS start, word AS now, 0 AS steps FROM forms UNION ALL SELECT c.start, f.form, c.steps + 1 FROM chain c JOIN forms f ON f.word = c.now WHERE f.form IS NOT NULL),
roots AS (SELECT start, arg_max(now, steps) AS root FROM chain GROUP BY 1)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN roots r ON r.start = f.word
""".replace("WITH crc", "WITH RECURSIVE crc", 1)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = variants(edited_words(documents(spark, sf_dir)))
    return found.select("word", "form", "root", "n", "n_near", "form_n")
