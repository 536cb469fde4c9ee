"""Scalar functions as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_EDGE = r"[^\p{L}\p{N}_]+"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def preference(c: str | Column) -> Column:
    """The value if it is A or B, else null: no parse, which is never the same as wrong."""
    return F.when(col(c).isin("A", "B"), col(c))


def first_filled(*columns: str | Column) -> Column:
    """The first value that is neither null nor empty; synonyms of a field are resolved so."""
    return F.coalesce(*[F.nullif(col(c).cast("string"), F.lit("")) for c in columns])


def parse_ab(raw: str | Column) -> Column:
    """A judge's answer: the letter alone; after "answer", "preference" or "choice" and a colon or dash; at the start, not
    followed by a letter; or the only whole word that is A or B."""
    text = F.trim(col(raw))
    named = F.upper(F.regexp_extract(text, r"(?i)(?:answer|preference|choice)\s*[:\-]\s*([AB])", 1))
    leading = F.regexp_extract(F.replace(text, F.lit(" "), F.lit("")), r"^([AB])(?:[^\p{L}]|$)", 1)
    words = F.filter(F.split(F.upper(text), WORD_EDGE), lambda w: w.isin("A", "B"))
    return F.when(F.coalesce(text, F.lit("")) == "", None).otherwise(
        F.coalesce(F.when(text.isin("A", "B"), text), F.nullif(named, F.lit("")), F.nullif(leading, F.lit("")), F.when(F.size(words) == 1, words[0]))
    )


def sha(*parts: str | Column) -> Column:
    """SHA-256 of the parts joined by a bar, as lower-case hex."""
    return F.sha2(F.concat_ws("|", *[col(p) for p in parts]), 256)


#: Cherokee letters, whose folded form is the upper case.
SMALL = "".join(map(chr, [*range(0xAB70, 0xABC0), *range(0x13F8, 0x13FE)]))
LARGE = "".join(map(chr, [*range(0x13A0, 0x13F0), *range(0x13F0, 0x13F6)]))


def casefold(c: str | Column) -> Column:
    """Case-folded: lower, upper and lower case in turn bring together what differs in case only, such as \u1e9e, \u00df and ss. A
    dotless i stays one and every sigma is the same. Stand-ins for both also keep the optimizer from leaving out a turn."""
    upper = F.upper(F.translate(F.lower(col(c)), "\u0131", "\uf8ff"))
    return F.translate(F.lower(F.translate(upper, "\u03a3", "\uf8fe")), "\uf8fe\uf8ff\u03c2" + SMALL, "\u03c3\u0131\u03c3" + LARGE)


def normal(c: str | Column) -> Column:
    """Trimmed and case-folded."""
    return casefold(F.trim(col(c)))


def candidate_uid(index: str | Column, text: str | Column, *ids: str | Column) -> Column:
    """id:x from the first filled id, else the place and the text."""
    named = first_filled(*ids) if ids else F.lit(None).cast("string")
    return F.coalesce(F.concat(F.lit("id:"), named), F.concat(F.lit("index:"), col(index).cast("string"), F.lit("|text:"), F.coalesce(col(text), F.lit(""))))


def even_digest(digest: Column) -> Column:
    """Whether a hex digest is an even number: its last digit decides."""
    return F.right(digest, F.lit(1)).isin(*"02468ace")


def oriented(pool: str | Column, a: str | Column, b: str | Column, salt: str = "orientation") -> tuple[Column, Column]:
    """(left, right) of an unordered pair, by the parity of a salted digest of the sorted pair."""
    low, high = F.least(col(a), col(b)), F.greatest(col(a), col(b))
    even = even_digest(sha(F.lit(salt), pool, low, high))
    return F.when(even, low).otherwise(high), F.when(even, high).otherwise(low)


def split_bucket(image_id: str | Column, seed: int = 20260912) -> Column:
    """static or downstream, by the first 8 hex digits of a seeded digest modulo 2."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), col(image_id).cast("string")), 256)
    return F.when(F.conv(F.left(digest, F.lit(8)), 16, 10).cast("long") % 2 == 0, "static").otherwise("downstream")


def pair_count(n: str | Column) -> Column:
    """Unordered pairs of n things; a negative n raises."""
    n = col(n).cast("long")
    return F.when(n < 0, F.raise_error(F.lit("n must not be negative"))).otherwise(F.floor(n * (n - 1) / 2))


def pair_outcome(pref: str | Column) -> Column:
    return F.when(col(pref) == "A", "left").when(col(pref) == "B", "right").otherwise("abstain")


def preferred_for(a: str | Column, b: str | Column, answer: str | Column) -> Column:
    """A or B, whichever candidate is the answer; neither raises."""
    return F.when(col(a) == col(answer), "A").when(col(b) == col(answer), "B").otherwise(F.raise_error(F.lit("the answer is neither candidate")).cast("string"))


def whole_number(c: str | Column) -> Column:
    """A non-negative integer written in digits, else null."""
    text = F.trim(col(c).cast("string"))
    return F.when(text.rlike("^[0-9]{1,18}$"), text.cast("long"))


def image_key(path: str | Column) -> dict[str, Column]:
    """source, stem and cleaned relative path of an image."""
    rel = F.regexp_replace(F.replace(col(path), F.lit("\\"), F.lit("/")), r"^[./]+", "")
    low = F.lower(rel)
    stem = F.regexp_replace(F.substring_index(rel, "/", -1), r"(?<=.)\.[^.]*$", "")
    source = F.when(low.contains("vg_100k") | rel.startswith("VG_"), "vg").when(low.contains("train2014") | low.contains("val2014") | low.contains("coco"), "coco").otherwise("other")
    return {"source": source, "stem": stem, "relpath": rel}


def count_hard_negative(gold: str | Column) -> Column:
    return col(gold).cast("long") + 1


def nearby_unused(gold: str | Column, used: str | Column, reach: int = 15) -> Column:
    """The nearest non-negative integer within reach that isn't used, the lower one first."""
    steps = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(reach)), lambda d: F.array(col(gold) - d, col(gold) + d)))
    return F.get(F.filter(steps, lambda v: (v >= 0) & ~F.array_contains(col(used), v)), F.lit(0))


def count_pool(gold: str | Column, size: int = 8) -> Column:
    """gold, gold - 1, gold + 1, gold - 2, ...: non-negative, distinct, so many."""
    steps = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda d: F.array(col(gold).cast("long") - d, col(gold).cast("long") + d)))
    return F.slice(F.array_distinct(F.concat(F.array(col(gold).cast("long")), F.filter(steps, lambda v: v >= 0))), 1, size)


# Program steps and question types that name a factor, and opposite relations.
ATTRIBUTE_OPS = ("sameattr", "differentattr", "filter", "querycolor", "choosecolor", "verifycolor", "querymaterial", "verifymaterial")
ATTRIBUTE_TYPES = ("attrcolor", "attrmaterial", "chooseattr", "verifyattr", "queryattr", "sameattr", "diffattr")
PRESENCE_TYPES = ("exist", "existattr", "existrel", "existattrrel", "logical")
SPATIAL_OPS = ("relate", "verifyrel", "chooserel", "filterrel")
SPATIAL_TYPES = ("rel", "verifyrel", "chooserel", "existrel")
COLORS = ("white", "black", "red", "green", "blue", "yellow", "brown", "gray", "grey", "pink", "orange", "purple")
OPPOSITES = {"left": "right", "right": "left", "to the left of": "to the right of", "to the right of": "to the left of", "left of": "right of", "right of": "left of", "yes": "no", "no": "yes"}


def classified_factor(question: Column, answer: Column, structural: Column, semantic: Column, detailed: Column, ops: Column, args: Column) -> dict[str, Column]:
    """factor, source and confidence of a question from its program, its types or, last, its words. Rules apply in order."""
    q, a = F.lower(question), F.lower(F.trim(answer))
    structural, semantic, detailed = (F.lower(F.coalesce(x, F.lit(""))) for x in (structural, semantic, detailed))
    has = lambda *names: F.arrays_overlap(ops, F.array(*[F.lit(n) for n in names]))
    number, how_many = a.rlike("^[0-9]+$"), q.contains("how many")
    sides = args.contains("left") | args.contains("right")
    counted = has("count") | (detailed == "count")
    attribute = detailed.isin(*ATTRIBUTE_TYPES) | semantic.isin("attr", "attribute") | has(*ATTRIBUTE_OPS)
    attribute_typed = semantic.isin("attr", "attribute") | detailed.isin(*ATTRIBUTE_TYPES)
    exists = has("exist") | detailed.isin(*PRESENCE_TYPES)
    yes_no = a.isin("yes", "no")
    rules = [
        (counted, ("count", F.when(has("count"), "program:count").otherwise("types:count-or-numeric"), "high")),
        (number & semantic.isin("obj", "object", "attr", "global") & how_many & (structural == "query"), ("count", F.lit("types:count-or-numeric"), "medium")),
        (attribute & how_many, ("count", F.lit("count-overrides-attr"), "high")),
        (attribute & ~(sides & semantic.isin("rel", "relation")), ("attribute", F.when(attribute_typed, "types:attr").otherwise("program:attr"), "high")),
        (has(*SPATIAL_OPS) & sides, ("spatial", F.lit("program:relate+left/right"), "high")),
        (detailed.isin(*SPATIAL_TYPES) & sides, ("spatial", F.lit("types:rel+left/right"), "high")),
        (exists & yes_no & sides, ("spatial", F.lit("exist+spatial-rel"), "medium")),
        (exists & yes_no & has("exist"), ("presence", F.lit("program:exist"), "high")),
        (exists & yes_no, ("presence", F.lit("types:exist"), "medium")),
        (number & how_many, ("count", F.lit("keyword"), "low")),
        (q.startswith("is there") | q.startswith("are there"), ("presence", F.lit("keyword"), "low")),
        (q.rlike("left of|right of|to the left|to the right"), ("spatial", F.lit("keyword"), "low")),
        (q.contains("what color") | q.contains("what material"), ("attribute", F.lit("keyword"), "low")),
    ]

    def pick(k: int) -> Column:
        out = F
        for rule, values in rules:
            out = out.when(rule, values[k] if isinstance(values[k], Column) else F.lit(values[k]))
        return out

    return {"factor": pick(0), "mapping_source": pick(1), "mapping_confidence": pick(2)}


def structured_negative(factor: Column, answer: Column, args: Column, scene_attributes: Column) -> dict[str, Column]:
    """hard_negative and its type: one more, the opposite, or another attribute of the scene, else of the palette."""
    a = F.lower(F.trim(answer))
    yes_no = F.when(a == "yes", "no").otherwise("yes")
    inverse = F.element_at(F.create_map(*[F.lit(x) for pair in OPPOSITES.items() for x in pair]), a)
    other = F.get(F.filter(F.coalesce(scene_attributes, F.array().cast("array<string>")), lambda x: F.lower(x) != a), F.lit(0))
    palette = F.when(a.isin(*COLORS), F.get(F.filter(F.array(*[F.lit(c) for c in COLORS]), lambda c: c != a), F.lit(0)))
    number = a.rlike("^[0-9]+$")
    value = (
        F.when((factor == "count") & number, (a.cast("long") + 1).cast("string"))
        .when((factor == "presence") & a.isin("yes", "no"), yes_no)
        .when((factor == "spatial") & inverse.isNotNull(), inverse)
        .when((factor == "spatial") & args.contains("left") & a.isin("yes", "no"), yes_no)
        .when(factor == "attribute", F.coalesce(other, palette))
    )
    kind = (
        F.when((factor == "count") & number, "count_plus_minus_1")
        .when((factor == "presence") & a.isin("yes", "no"), "yes_no_flip")
        .when((factor == "spatial") & inverse.isNotNull(), "spatial_inverse")
        .when((factor == "attribute") & other.isNotNull(), "attribute_scene_substitution")
        .when((factor == "attribute") & palette.isNotNull(), "attribute_palette_substitution")
        .otherwise("unresolved")
    )
    return {"hard_negative": value, "hard_negative_type": kind}


def filled_pool(gold: Column, *sources: Column, size: int = 8) -> Column:
    """Distinct texts, compared without case: gold first, then each source's in order, so many at most."""
    every = F.filter(F.concat(F.array(gold), *sources), lambda x: F.coalesce(F.trim(x), F.lit("")) != "")
    none = F.array().cast("array<string>")
    kept = F.aggregate(every, none, lambda acc, x: F.when(F.exists(acc, lambda y: normal(y) == normal(x)), acc).otherwise(F.array_append(acc, x)))
    return F.slice(kept, 1, size)


def gold_index(texts: Column, gold: Column) -> Column:
    """Place of gold among the texts from 0, without case; 0 if it isn't there."""
    return F.greatest(F.array_position(F.transform(texts, normal), normal(gold)) - 1, F.lit(0)).cast("int")


def alphanumeric_tokens(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(col(text)), F.lit("[a-z0-9]+"), F.lit(0))


def compact(*flags: Column) -> Column:
    return F.array_compact(F.array(*flags))


def pool_flags(gold: Column, texts: Column, index: Column, expected: Column) -> Column:
    """Shortcuts that a candidate pool gives away, in fixed order."""
    low = F.transform(F.filter(texts, lambda t: t.isNotNull()), F.lower)
    filled = F.filter(texts, lambda t: F.coalesce(t, F.lit("")) != "")
    sizes = F.transform(filled, F.char_length)
    marked = F.transform(filled, lambda t: t.rlike("[.!?]$"))
    hits = F.size(F.filter(low, lambda t: t == F.lower(gold)))
    at = F.lower(F.get(texts, index))
    return compact(
        F.when(F.size(low) != F.size(F.array_distinct(low)), "duplicate_candidates"),
        F.when((gold != "") & (hits == 0), "gold_missing_from_pool"),
        F.when(hits > 1, "gold_duplication"),
        F.when(index.isNotNull() & ((index < 0) | (index >= F.size(texts)) | (F.coalesce(at, F.lit("")) != F.lower(gold))), "invalid_gold_index"),
        F.when((expected > 0) & (F.size(filled) != expected), "invalid_candidate_count"),
        F.when((F.size(filled) > 0) & (F.array_max(sizes) - F.array_min(sizes) >= 12), "length_gap"),
        F.when(F.exists(marked, lambda m: m) & F.exists(marked, lambda m: ~m), "punctuation_asymmetry"),
        F.when(F.exists(texts, lambda t: F.coalesce(F.trim(t), F.lit("")) == ""), "empty_candidate"),
    )


def pair_flags(gold: Column, a: Column, b: Column, label: Column) -> Column:
    """Shortcuts that a pair of candidates gives away, in fixed order."""
    ends = lambda x: x.rlike("[.!?]$")
    return compact(
        F.when(F.lower(a) == F.lower(b), "duplicate_candidates"),
        F.when(F.abs(F.char_length(a) - F.char_length(b)) >= 12, "length_gap"),
        F.when(ends(a) != ends(b), "punctuation_asymmetry"),
        F.when(label.isNotNull() & ~label.isin("A", "B"), "invalid_preference_label"),
        F.when((gold != "") & (F.lower(a) == F.lower(gold)) & (F.lower(b) == F.lower(gold)), "gold_duplication"),
    )


def numeric_tail(text: str | Column) -> Column:
    """The last run of digits, null if there is none."""
    return F.nullif(F.regexp_extract(col(text), r"([0-9]+)[^0-9]*$", 1), F.lit(""))


def close(a: str | Column, b: str | Column, tolerance: float = 1e-12) -> Column:
    """Equal within a tolerance; two nulls are equal, one isn't."""
    a, b = col(a), col(b)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= tolerance)


def coco_path(path: str | Column) -> dict[str, Column]:
    """split and file name of a path such as train2014/COCO_train2014_000000000001.jpg; a mismatch raises."""
    p = col(path)
    folder, named = F.regexp_extract(p, "(train2014|val2014)/", 1), F.regexp_extract(p, "COCO_(train2014|val2014)_[0-9]+[.]jpg$", 1)
    return {"split": F.when((folder == named) & (named != ""), named).otherwise(F.raise_error(F.lit("not a consistent path")).cast("string")), "filename": F.substring_index(p, "/", -1)}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def relation_holds(a: Column, b: Column, direction: Column, eps: float = 0.2) -> Column:
    """Whether a lies beyond b along a direction by more than eps."""
    return dot(F.zip_with(a, b, lambda x, y: x.cast("double") - y), direction) > eps


def projected_radius(size: Column, depth: Column) -> Column:
    return F.when(size == "large", 30.0).otherwise(16.0) * (9.0 / F.greatest(F.coalesce(depth, F.lit(10.0)), F.lit(1.0)))


def status_of(flags: Column) -> Column:
    """FAIL, BORDERLINE or PASS by the worst prefix among the flags."""
    return F.when(F.exists(flags, lambda f: f.startswith("FAIL:")), "FAIL").when(F.exists(flags, lambda f: f.startswith("BORDERLINE:")), "BORDERLINE").otherwise("PASS")


def score_outcome(left: Column, right: Column) -> Column:
    """Pairs of a pool: equal scores tie."""
    return F.when(left > right, "left").when(right > left, "right").otherwise("tie")


def margin_preference(margin: Column) -> Column:
    """Audit pairs: a margin of zero is A, unlike in pools."""
    return F.when(margin >= 0, "A").otherwise("B")


def duration(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)


def progress(done: Column, total: Column, seconds: Column) -> dict[str, Column]:
    """percent, rate and eta; null where a denominator is zero."""
    rate = done / F.nullif(seconds, F.lit(0.0))
    return {"percent": 100.0 * done / F.nullif(total, F.lit(0)), "rate": rate, "eta": F.greatest(total - done, F.lit(0)) / F.nullif(rate, F.lit(0.0))}


def elapsed_bound(recorded: Column, summed: Column) -> dict[str, Column]:
    """The larger of recorded seconds and summed latencies, and whether it is only a lower bound."""
    return {"seconds": F.greatest(F.coalesce(recorded, F.lit(0.0)), F.coalesce(summed, F.lit(0.0))), "is_lower_bound": recorded.isNull()}


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def frechet_bounds(ra: Column, ii: Column) -> dict[str, Column]:
    """Least and greatest joint rate that two conditional rates allow."""
    return {"low": F.greatest(F.lit(0.0), ra + ii - 1.0), "high": F.least(ra, ii)}
