"""Document fingerprints: a Merkle tree over passages, paragraphs and sections, with JVM functions only.

A text is cut into paragraphs at line feeds and each paragraph into passages at sentence ends, forty characters at most; the
cuts keep every character. A passage's digest is the SHA-256 of its text, a paragraph's that of its passages' digests. A
section ends after a paragraph whose digest ends in 0 or 1, or after 32 paragraphs, so sections find their borders again
after an edit. A section's digest covers its paragraphs' digests, the root covers the sections'.

The fingerprint is the tree written out: `root:section/section/..`, a section as `digest=paragraph.paragraph. ..`, a paragraph
as `digest-` and six digits for each passage; the root has 64 digits, sections have 16 and paragraphs 12. Equal texts have
equal fingerprints; texts with different roots differ. Likeness is 2 * common / (sum of both) over distinct passage digits,
and 1 for equal roots. `changed_paragraphs` descends from the root: it opens only sections that the other tree lacks, and
names those of their paragraphs that no section opened in the other tree has. A branch that repeats counts as present if the
other tree has it once.

All of it is nearly linear in the length of a text: every array is bound once (`arrays.let`), and sections carry their
paragraphs' digits with them instead of looking them up.

Defined results: a null text is an empty one, whose fingerprint has a root and no branches; its likeness to any other text
is 0. Repeated rows have equal fingerprints, other columns of `with_edits` don't matter, those of `fingerprinted` pass
through, a table without rows gives none. `successors` orders rows by descending id with null as the least; of rows that
share an id the least text stands for the id. Ids keep their type, numbers or text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import each, let, numbered, only, raw, running, scan, zipped
from .common import cut, documents, n_groups, text_or_empty

PARAGRAPH = r"[^\n]*\n+|[^\n]+"
PASSAGE = r"[^.!?\n]{1,40}[.!?\n]*|[.!?\n]+"
SECTION = r"(?:[0-9a-f]{63}[2-9a-f]-[0-9a-f]* ){0,31}(?:[0-9a-f]{64}-[0-9a-f]* )?"
SECTION_DIGITS, PARAGRAPH_DIGITS, DIGITS = 16, 12, 6


def tree(text: str) -> str:
    """The fingerprint of a text, given and returned as SQL text."""

    def paragraph(p: str) -> str:
        digests = each(f"regexp_extract_all({p}, {raw(PASSAGE)}, 0)", lambda x: f"sha2({x}, 256)")
        return let(digests, lambda ds: f"concat(sha2(array_join({ds}, ''), 256), '-', array_join({each(ds, lambda d: f'left({d}, {DIGITS})')}, ''), ' ')")

    def section(s: str) -> str:
        digest = f"sha2(regexp_replace({s}, '-[0-9a-f]* ', ''), 256)"
        kept = raw(f"([0-9a-f]{{{PARAGRAPH_DIGITS}}})[0-9a-f]{{{64 - PARAGRAPH_DIGITS}}}-([0-9a-f]*) ")
        return f"named_struct('digest', {digest}, 'branches', rtrim('.', regexp_replace({s}, {kept}, '$1-$2.')))"

    def written(sections: str) -> str:
        root = f"sha2(array_join({each(sections, lambda s: f'{s}.digest')}, ''), 256)"
        body = each(sections, lambda s: f"concat(left({s}.digest, {SECTION_DIGITS}), '=', {s}.branches)")
        return f"concat({root}, ':', array_join({body}, '/'))"

    paragraphs = each(f"regexp_extract_all(coalesce({text}, ''), {raw(PARAGRAPH)}, 0)", paragraph)
    joined = f"array_join({paragraphs}, '')"
    return let(each(only(f"regexp_extract_all({joined}, {raw(SECTION)}, 0)", lambda s: f"{s} <> ''"), section), written)


def fingerprinted(df: DataFrame, text: str, into: str) -> DataFrame:
    """df with one more column, the fingerprint of a text column."""
    return df.withColumn(into, F.expr(tree(f"`{text}`")))


def passages(fingerprint: str) -> str:
    """Distinct passage digits of a fingerprint."""
    return f"array_distinct(regexp_extract_all(regexp_replace(substring({fingerprint}, 66), '(?<![0-9a-f])[0-9a-f]++[=-]', ' '), '[0-9a-f]{{{DIGITS}}}', 0))"


def likeness(a: str, b: str) -> Column:
    """Likeness of two fingerprint columns, from 0 to 1."""
    dice = let(passages(a), lambda x: let(passages(b), lambda y: f"2D * size(array_intersect({x}, {y})) / greatest(size({x}) + size({y}), 1)"))
    return F.expr(f"CASE WHEN {a} = {b} THEN 1D ELSE {dice} END")


def absent(items: str, others: str) -> str:
    """Numbers i of those structs (d, i) whose d is not among the others, ascending; by sorting both together."""

    def body(rows: str) -> str:
        last = scan(each(rows, lambda x: f"CASE WHEN {x}.i < 0 THEN {x}.d END"), "cast(null AS string)", lambda a, b: f"coalesce({b}, {a})")
        marked = zipped(rows, last, lambda x, y: f"CASE WHEN {x}.i >= 0 AND NOT {x}.d <=> {y} THEN {x}.i END")
        return f"array_sort({only(marked, lambda i: f'{i} IS NOT NULL')})"

    return let(f"array_sort(concat({each(others, lambda d: f'named_struct({chr(39)}d{chr(39)}, {d}, {chr(39)}i{chr(39)}, -1)')}, {items}))", body)


def _sections(fingerprint: str) -> str:
    return f"CASE WHEN length({fingerprint}) > 65 THEN split(substring({fingerprint}, 66), '/') ELSE cast(array() AS array<string>) END"


def changed_paragraphs(a: str, b: str) -> Column:
    """Positions, from 0, of a's paragraphs in branches that b doesn't have: where an edit lies."""
    digest = lambda s: f"left({s}, {SECTION_DIGITS})"
    entry = lambda d, i: f"named_struct('d', {d}, 'i', {i})"
    opened = lambda s: f"split(substring({s}, {SECTION_DIGITS + 2}), '[.]')"
    own = lambda p: f"left({p}, {PARAGRAPH_DIGITS})"

    def lost(xs: str, ys: str) -> str:
        return absent(numbered(xs, lambda s, i: entry(digest(s), i)), each(ys, digest))

    def descended(xs: str, ys: str) -> str:
        before = running(each(xs, lambda s: f"size({opened(s)})"))
        mine = let(before, lambda at: f"flatten({each(lost(xs, ys), lambda k: numbered(opened(f'{xs}[{k}]'), lambda p, j: entry(own(p), f'{at}[{k}] + {j}')))})")
        others = f"flatten({each(lost(ys, xs), lambda k: each(opened(f'{ys}[{k}]'), own))})"
        return absent(mine, others)

    both = let(_sections(a), lambda xs: let(_sections(b), lambda ys: descended(xs, ys)))
    return F.expr(f"CASE WHEN {a} = {b} THEN cast(array() AS array<int>) ELSE {both} END")


def successors(keys: DataFrame, key: str = "key") -> DataFrame:
    """keys (distinct) with next_key, the next lower one; the lowest is followed by the highest.

    Keys are dealt out by range; within a range the window gives the next one, and between ranges a table with a row for each.
    """
    ranged = cut(keys.repartitionByRange(n_groups(keys.sparkSession), F.desc(key)).withColumn("_range", F.spark_partition_id()))
    tops = ranged.groupBy("_range").agg(F.max(key).alias("_top"))
    between = Window.orderBy("_range")
    tops = tops.select("_range", F.coalesce(F.lead("_top").over(between), F.max("_top").over(Window.partitionBy())).alias("_after"))
    within = Window.partitionBy("_range").orderBy(F.desc(key))
    rows = ranged.withColumn("_next", F.lead(key).over(within)).join(F.broadcast(tops), "_range")
    return rows.select(*keys.columns, F.coalesce("_next", "_after").alias("next_key"))


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text (the last third replaced by the next document's beginning) and likeness."""
    id_type = docs.select(id_col).schema[0].dataType
    key = F.struct(F.col(id_col).isNotNull().alias("known"), F.coalesce(F.col(id_col), F.lit("0").cast(id_type)).alias("id")).alias("key")
    rows = docs.select(key, text_or_empty(text_col).alias("text"))
    third = F.floor(F.char_length("text") / 3).cast("int")
    order = successors(rows.groupBy("key").agg(F.max(third).alias("tail")))
    # The shuffle of all texts by key serves this join and the next; of a repeated key the least text stays, partition by partition.
    named = rows.select(F.col("key").alias("next_key"), "text")
    first = order.join(named, "next_key").groupBy("next_key", "key", "tail").agg(F.min("text").alias("text"))
    following = fingerprinted(first, "text", "next_fingerprint")
    following = following.select("key", F.left("text", F.col("tail")).alias("head"), "next_fingerprint")
    both = rows.join(following, "key").withColumns({"n_chars": F.char_length("text").cast("long"), "tail": third})
    both = both.withColumn("edited", F.concat(F.left("text", (F.col("n_chars") - F.col("tail")).cast("int")), F.left("head", F.col("tail"))))
    both = fingerprinted(fingerprinted(both.drop("head"), "text", "fingerprint"), "edited", "edited_fingerprint")
    both = both.withColumn("edited_sha256", F.sha2("edited", 256)).drop("text", "edited")
    doc_id = F.when(F.col("key.known"), F.col("key.id")).alias("doc_id")
    near = [likeness("fingerprint", other).alias(into) for other, into in (("edited_fingerprint", "near_edited"), ("next_fingerprint", "near_next"))]
    return both.select(doc_id, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near, F.size(changed_paragraphs("fingerprint", "edited_fingerprint")).alias("n_changed"))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(documents(spark, sf_dir))


OP1_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (
  SELECT doc_id, text, CAST(length(text) // 3 AS BIGINT) AS k,
    coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next_text FROM d),
e AS (SELECT *, substr(text, 1, length(text) - k) || substr(next_text, 1, k) AS edited FROM n),
t AS (SELECT doc_id, 0 AS v, text FROM e UNION ALL SELECT doc_id, 1, edited FROM e UNION ALL SELECT doc_id, 2, next_text FROM e),
p AS (SELECT doc_id, v, unnest(regexp_extract_all(text, '[^\n]*\n+|[^\n]+')) AS p, generate_subscripts(regexp_extract_all(text, '[^\n]*\n+|[^\n]+'), 1) AS j FROM t),
q AS (SELECT doc_id, v, j, list_transform(regexp_extract_all(p, '[^.!?\n]{{1,40}}[.!?\n]*|[.!?\n]+'), lambda x: sha256(x)) AS ds FROM p),
r AS (SELECT doc_id, v, j, sha256(array_to_string(ds, '')) || '-' || array_to_string(list_transform(ds, lambda x: left(x, 6)), '') || ' ' AS line FROM q),
joined AS (SELECT t.doc_id, t.v, coalesce(string_agg(line, '' ORDER BY j), '') AS lines FROM t LEFT JOIN r ON t.doc_id = r.doc_id AND t.v = r.v GROUP BY 1, 2),
s AS (SELECT doc_id, v, list_filter(regexp_extract_all(lines, '(?:[0-9a-f]+[2-9a-f]-[0-9a-f]* ){{0,31}}(?:[0-9a-f]+-[0-9a-f]* )?'), lambda x: x <> '') AS ss FROM joined),
written AS (
  SELECT doc_id, v,
    sha256(array_to_string(list_transform(ss, lambda x: sha256(regexp_replace(x, '-[0-9a-f]* ', '', 'g'))), '')) || ':' ||
    array_to_string(list_transform(ss, lambda x: left(sha256(regexp_replace(x, '-[0-9a-f]* ', '', 'g')), 16) || '=' ||
      rtrim(regexp_replace(x, '([0-9a-f]{{12}})[0-9a-f]{{52}}-([0-9a-f]*) ', '\1-\2.', 'g'), '.')), '/') AS f FROM s),
sec AS (SELECT doc_id, v, unnest(string_split(substr(f, 66), '/')) AS x FROM written WHERE length(f) > 65),
lost AS (SELECT a.doc_id, a.v, a.x FROM sec a WHERE a.v < 2 AND NOT EXISTS (SELECT 1 FROM sec b WHERE b.doc_id = a.doc_id AND b.v = 1 - a.v AND left(b.x, 16) = left(a.x, 16))),
par AS (SELECT doc_id, v, left(unnest(string_split(substr(x, 18), '.')), 12) AS y FROM lost),
changed AS (SELECT a.doc_id, CAST(count(*) AS INTEGER) AS n FROM par a WHERE a.v = 0 AND NOT EXISTS (SELECT 1 FROM par b WHERE b.doc_id = a.doc_id AND b.v = 1 AND b.y = a.y) GROUP BY 1),
codes AS (SELECT doc_id, v, f, list_distinct(regexp_extract_all(regexp_replace(substr(f, 66), '[0-9a-f]+[=-]', ' ', 'g'), '[0-9a-f]{{6}}')) AS c FROM written),
pairs AS (SELECT a.doc_id, b.v, CASE WHEN a.f = b.f THEN 1.0::DOUBLE ELSE 2::DOUBLE * len(list_intersect(a.c, b.c)) / greatest(len(a.c) + len(b.c), 1) END AS near FROM codes a JOIN codes b ON a.doc_id = b.doc_id AND a.v = 0)
SELECT e.doc_id, CAST(length(e.text) AS BIGINT) AS n_chars, sha256(e.edited) AS edited_sha256, w0.f AS fingerprint, w1.f AS edited_fingerprint, n1.near AS near_edited, n2.near AS near_next, coalesce(c.n, 0) AS n_changed
FROM e JOIN written w0 ON w0.doc_id = e.doc_id AND w0.v = 0 JOIN written w1 ON w1.doc_id = e.doc_id AND w1.v = 1
JOIN pairs n1 ON n1.doc_id = e.doc_id AND n1.v = 1 JOIN pairs n2 ON n2.doc_id = e.doc_id AND n2.v = 2 LEFT JOIN changed c ON c.doc_id = e.doc_id
"""
