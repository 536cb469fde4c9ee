"""Personal data: candidate gradient boosting, with DataFrame and SQL functions only.

Base patterns with exact checks give the base spans. They are then masked, and high-recall generators propose candidates of
other forms in what is left (national telephone and identity numbers, addresses written with "at" and "dot", account numbers,
IPv6 and MAC addresses); candidates of different kinds may overlap. Each candidate has features of its form and its context;
gradient-boosted trees score it. The trees are fitted by Spark ML on TRAINING_ROWS examples that are themselves generated by
SQL from fixed forms, and then written as an array of nodes that SQL walks down, so scoring stays in the projection that
found the candidates. Each
kind has its own threshold, the lowest score at which PRECISION of a calibration part of the examples is right. A candidate
over its threshold is added.

Positions are running sums over the lengths of matches and of the text between them: split and extract by one pattern
alternate. Patterns start at the beginning of a run of their first class or where the last match ended, which is where the
leftmost match is, and use possessive quantifiers, so long runs and texts of many matches cost nearly linear time.

Positions count code points, ends are exclusive. Defined results: a null or empty text has no spans; repeated rows have the
same spans; a table without rows gives none. Other columns, a null id among them, pass through under any name; only a column
with the very name of a result gives way to it.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays
from .arrays import each, let, only, raw, replaced, running
from .common import documents, every, fresh

# Kinds in the order in which spans are written, and their patterns.
LOCAL, OCTET = "A-Za-z0-9._%+-", "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
BASE = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "number": r"(?<![0-9A-Za-z])(?:[(]?[0-9]{2,5}+(?:[ ().\-/]{1,2}+[0-9]{2,6}+){1,5}+|[0-9]{9,12}+)(?![0-9A-Za-z])",
    "handle": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]{{2,64}}+ ?(?:\(at\)|\[at\]|\{{at\}}| at ) ?[A-Za-z0-9-]{{2,63}}+(?: ?(?:\.|\(dot\)|\[dot\]|\{{dot\}}| dot ) ?[A-Za-z]{{2,24}}+)++",
    "account": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}+){2,7}+(?: ?[A-Z0-9]{1,3}+)?+(?![0-9A-Za-z])",
    "address": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}+(?:[:-][0-9A-Fa-f]{1,4}+){5,7}+|(?:[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){0,5}+)?+::(?:[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){0,5}+)?+)(?![0-9A-Za-z:])",
}
KINDS = (*BASE, *GENERATORS)
CUES = {
    "number": r"(?i)\b(?:tel|telephone|phone|fax|mobile|cell|call|text|ring|dial|number|ssn|social|security|passport|id)\b",
    "other": r"(?i)\b(?:mail|email|e-mail|contact|write|reach|iban|bank|account|transfer|host|mac|ip|ipv6|server|device|address)\b",
    "against": r"(?i)[$€£#]\s*$|\b(?:version|order|page|pages|no|isbn|invoice|on|from|ratio|score|item|part|chapter|since|dated|room|row|total|at|met)\b[^A-Za-z0-9]{0,4}$",
}
BEFORE, AFTER = 24, 8
MASK = "char(1)"

TRAINING_ROWS, SEED, ROUNDS, DEPTH, PRECISION = 8000, 23, 12, 4, 0.97

HIT = "struct<kind: string, start: int, end: int, hit: string, before: string, after: string>"
SPAN = "struct<kind: string, start: int, end: int>"


def located(text: str, kind: str, pattern: str) -> str:
    """All leftmost non-overlapping matches with their positions and surroundings, as an array of HIT; text is bound by `let`."""

    def placed(hits: str, gaps: str) -> str:
        sizes = arrays.zipped(f"slice({gaps}, 1, size({hits}))", hits, lambda g, h: f"char_length({g}) + char_length({h})")
        return let(running(sizes), lambda before: arrays.numbered(hits, lambda hit, i: one(hit, f"{gaps}[{i}]", f"{gaps}[{i} + 1]", f"{before}[{i}]")))

    def one(hit: str, gap: str, following: str, before: str) -> str:
        start = f"{before} + char_length({gap})"
        return f"named_struct('kind', '{kind}', 'start', {start}, 'end', {start} + char_length({hit}), 'hit', {hit}, 'before', right({gap}, {BEFORE}), 'after', left({following}, {AFTER}))"

    found = let(f"regexp_extract_all({text}, {raw(pattern)}, 0)", lambda hits: f"CASE WHEN size({hits}) > 0 THEN {let(f'split({text}, {raw(pattern)}, -1)', lambda gaps: placed(hits, gaps))} END")
    return f"coalesce({found}, cast(array() AS array<{HIT}>))"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def luhn(x: str) -> str:
    """Whether the digits of x pass the Luhn check."""

    def weighted(rest: str, i: str) -> str:
        twice = f"(ascii(substring({rest}, {i}, 1)) - 48) * (2 - {i} % 2)"
        return let(twice, lambda t: f"{t} - CASE WHEN {t} > 9 THEN 9 ELSE 0 END")

    total = let(f"reverse({digits(x)})", lambda rest: arrays.folded(f"sequence(1, greatest(length({rest}), 1))", "0", lambda a, i: f"{a} + {weighted(rest, i)}"))
    return f"{total} % 10 = 0"


def valid(kind: str, hit: str) -> str:
    size = f"length({digits(hit)})"
    return {"email": "true", "ip": f"{hit} RLIKE {raw(rf'^{OCTET}(?:[.]{OCTET}){{3}}$')}", "card": f"{size} BETWEEN 16 AND 19 AND {luhn(hit)}", "phone": f"{size} BETWEEN 8 AND 15"}[kind]


def features(hit: str, before: str, after: str) -> dict[str, str]:
    """Numbers about a candidate's form and context, the same for training and for scoring."""
    times = lambda p: f"cast(regexp_count({hit}, {raw(p)}) AS double)"
    size = lambda p: f"cast(length(regexp_extract({hit}, {raw(p)}, 1)) AS double)"
    flag = lambda x, p: f"CASE WHEN {x} RLIKE {raw(p)} THEN 1D ELSE 0D END"
    return {
        "length": f"cast(char_length({hit}) AS double)",
        "digits": times("[0-9]"),
        "groups": times("[0-9]+"),
        "first_run": size("^[^0-9]*([0-9]+)"),
        "second_run": size("^[^0-9]*[0-9]+[^0-9]+([0-9]+)"),
        "last_run": size("([0-9]+)[^0-9]*$"),
        "year": flag(hit, r"(?:^|[^0-9])(?:19|20)[0-9]{2}(?:[^0-9]|$)"),
        "letters": times("[A-Za-z]"),
        "capitals": times("[A-Z]"),
        "words": times("[A-Za-z]+"),
        "spaces": times(" "),
        "dashes": times("-"),
        "dots": times(r"\."),
        "slashes": times("/"),
        "brackets": times(r"[()\[\]{}]"),
        "colons": times(":"),
        "double_colons": times("::"),
        "suffix": flag(hit, r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|it|nl|uk|eu|ch)$"),
        "spelt_dots": times(r"(?i)\bdot\b"),
        "cue_number": flag(before, CUES["number"]),
        "cue_other": flag(before, CUES["other"]),
        "cue_against": flag(before, CUES["against"]),
        "unit_after": flag(after, r"(?i)^\s*(?:%|kg|km|cm|mm|usd|eur|px|ms|pages|people|points|euros|dollars)"),
    }


# Forms of examples. @ is a random digit, A a random capital, h a random hexadecimal digit, w a random word; the
# label says personal or not. The last field says what stands before: a cue, something that speaks against, or anything.
FORMS = (
    ("number", "(@@@) @@@-@@@@", 1, "any"), ("number", "@@@-@@@-@@@@", 1, "any"), ("number", "@@@.@@@.@@@@", 1, "any"), ("number", "@@@ @@@ @@@@", 1, "any"), ("number", "@@@/@@@-@@@@", 1, "any"),
    ("number", "@@@-@@-@@@@", 1, "any"), ("number", "0@@ @@@@ @@@@", 1, "any"), ("number", "0@@@ @@@@@@", 1, "any"), ("number", "0@ @@ @@ @@ @@", 1, "any"), ("number", "0@@/@@@@@@", 1, "cue"), ("number", "0@@@-@@@@@@", 1, "any"),
    ("number", "@@@@@@@@@@", 1, "cue"), ("number", "@@@@@@@@@", 1, "cue"), ("number", "0@@@@@@@@@@", 1, "cue"), ("number", "@@@@@@@@@@@@", 1, "cue"), ("number", "@@@-@@@@", 1, "cue"),
    ("number", "@@@@@@@@@@", 0, "against"), ("number", "@@@@@@@@@", 0, "against"), ("number", "@@@@@@@@@@@@", 0, "against"), ("number", "@@@@@@@@@@", 0, "none"), ("number", "@@@@@@@@@@@@", 0, "none"),
    ("number", "20@@-@@-@@", 0, "any"), ("number", "19@@/@@/@@", 0, "any"), ("number", "@@/@@/20@@", 0, "any"), ("number", "@@.@@.20@@", 0, "any"), ("number", "@@.@@.19@@", 0, "any"), ("number", "@@@ @@@", 0, "any"), ("number", "@@@@-@@@@", 0, "any"),
    ("number", "@@ @@ @@", 0, "any"), ("number", "@@ @@@ @@@", 0, "any"), ("number", "@@@.@@@.@@@.@@@", 0, "any"), ("number", "@@@.@@@.@@@", 0, "any"), ("number", "978-@@-@@@@-@@@", 0, "any"), ("number", "@@@@@ @@@@@ @@@@@", 0, "any"),
    ("number", "@@@@ @@@@ @@@@ @@@@", 0, "any"), ("number", "@@/@@", 0, "any"), ("number", "@@-@@", 0, "any"), ("number", "@@@-@@@", 0, "any"), ("number", "@@.@@", 0, "any"), ("number", "@@@@.@@", 0, "any"), ("number", "@@ @@", 0, "any"), ("number", "20@@ 20@@", 0, "any"),
    ("handle", "w.w (at) w.com", 1, "any"), ("handle", "w [at] w [dot] org", 1, "any"), ("handle", "w@@(at)w(dot)net", 1, "any"), ("handle", "ww at ww dot com", 1, "any"), ("handle", "w_w at w dot de", 1, "any"), ("handle", "w{at}w{dot}fr", 1, "any"), ("handle", "w.w at w.co.uk", 1, "any"), ("handle", "w@@ at w.com", 1, "any"),
    ("handle", "w at w.w", 0, "none"), ("handle", "ww at ww. w", 0, "none"), ("handle", "w at ww.ww", 0, "none"), ("handle", "ww at w dot w", 0, "none"), ("handle", "w at w. The", 0, "none"), ("handle", "w at w. It", 0, "none"), ("handle", "w at w.w", 0, "any"),
    ("account", "AA@@ @@@@ @@@@ @@@@ @@@@ @@", 1, "any"), ("account", "AA@@AAAA@@@@@@@@@@@@@@", 1, "any"), ("account", "AA@@ @@@@ @@@@ @@@", 1, "any"), ("account", "AA@@@@@@@@@@@@@", 1, "any"), ("account", "AA@@ AAAA @@@@ @@@@ @@@@ @@", 1, "any"), ("account", "AA@@ A@@@ @@@@ @@@@ @@@@ @@@@ @@@", 1, "any"), ("account", "AA@@@@@@@@@@@@@@@@@@@@", 1, "any"),
    ("account", "AA@@ AAAA AAAA AAAA", 0, "any"), ("account", "AA@@ AAAA AAAA", 0, "any"), ("account", "AA@@AAAAAAAA", 0, "any"), ("account", "AA@@AAAA@@@@", 0, "any"), ("account", "AA@@ AAAA 20@@", 0, "any"),
    ("address", "2hhh:db8:hhh:hhhh:hhhh:8a2e:hhh:73hh", 1, "any"), ("address", "hh:hh:hh:hh:hh:hh", 1, "any"), ("address", "hh-hh-hh-hh-hh-hh", 1, "any"), ("address", "2001:db8::hhh", 1, "any"), ("address", "fe80::hhh:hhff:fehh:hhhh", 1, "any"), ("address", "2hhh:hhhh:hhhh::h", 1, "any"), ("address", "fd@@:hhhh::hhhh:h", 1, "any"),
    ("address", "@@:@@:@@:@@:@@:@@", 0, "against"), ("address", "@-@-@-@-@-@", 0, "any"), ("address", "::", 0, "any"), ("address", "@::@", 0, "any"), ("address", "@@-@@-@@-@@-@@-@@", 0, "against"), ("address", "a::b", 0, "any"), ("address", "@:@:@:@:@:@", 0, "any"),
)
WORDS = ("anna", "home", "mailer", "office", "river", "stone", "green", "north", "table", "paper", "met", "look", "jones", "mark", "garden")
BEFORE_WORDS = {
    "cue": {"number": ("call me at ", "tel. ", "phone: ", "my number is ", "mobile ", "ssn ", "text ", "fax: ", "passport ", "ring us on "), "other": ("contact ", "iban ", "mail ", "write to ", "bank account ", "device ", "host ", "reach me: ", "my email is ", "server ")},
    "against": ("order ", "version ", "on ", "page ", "$", "invoice no. ", "isbn ", "item ", "since ", "total "),
    "none": ("and then ", "the ", "about ", "", "with ", "they said ", "of ", "it was ", "under ", "then "),
}


def examples(spark: SparkSession, rows: int = TRAINING_ROWS, seed: int = SEED) -> DataFrame:
    """Labelled candidates made from FORMS: kind, hit, before, after, label.

    Where anything may stand before, personal data has a cue in six of ten rows and other data something against in three.
    """
    forms = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(f).alias("form"), F.lit(y).alias("label"), F.lit(c).alias("context")) for k, f, y, c in FORMS])
    draw = lambda *salt: F.xxhash64("id", F.lit(seed), *salt)
    at = lambda name, n: F.pmod(draw(F.lit(name)), F.lit(n)).cast("int") + 1
    df = spark.range(rows).select("id", F.element_at(forms, at("form", len(FORMS))).alias("f")).select("id", "f.*")
    pick = lambda name, xs: F.element_at(F.array(*map(F.lit, xs)), at(name, len(xs)))

    def filled(c: Column, i: Column) -> Column:
        r = draw(F.lit("c"), i)
        return (
            F.when(c == "@", F.pmod(r, F.lit(10)).cast("string"))
            .when(c == "A", F.char(F.pmod(r, F.lit(26)) + 65))
            .when(c == "h", F.lower(F.hex(F.pmod(r, F.lit(16)))))
            .when(c == "w", F.element_at(F.array(*map(F.lit, WORDS)), F.pmod(r, F.lit(len(WORDS))).cast("int") + 1))
            .otherwise(c)
        )

    # Only the letters at, dot, com and the like stay: w, h and A are placeholders, and no form uses them otherwise.
    hit = F.array_join(F.transform(F.split("form", ""), filled), "")
    dice = F.pmod(draw(F.lit("context")), F.lit(10))
    mode = F.when(F.col("context") != "any", F.col("context")).when(F.col("label") == 1, F.when(dice < 6, "cue").otherwise("none")).otherwise(F.when(dice < 3, "against").when(dice < 4, "cue").otherwise("none"))
    cue = F.when(F.col("kind") == "number", pick("b", BEFORE_WORDS["cue"]["number"])).otherwise(pick("b", BEFORE_WORDS["cue"]["other"]))
    before = F.when(mode == "cue", cue).when(mode == "against", pick("b", BEFORE_WORDS["against"])).otherwise(pick("b", BEFORE_WORDS["none"]))
    return df.select("id", "kind", hit.alias("hit"), before.alias("before"), pick("a", (" ", ". ", ", and", " or ")).alias("after"), F.col("label").cast("double").alias("label"))


def nodes_of(lines: list[str]) -> list[tuple[int, float, int, int, float]]:
    """Nodes of one tree of Spark ML's printed form: feature (from 1; 0 in a leaf), threshold, places of both children, value.

    The root comes first, and every node before its children.
    """
    out: list = []

    def read() -> int:
        line, at = lines.pop(0), len(out)
        out.append(None)
        leaf = re.fullmatch(r" *Predict: (\S+)", line)
        if leaf:
            out[at] = (0, 0.0, 0, 0, float(leaf[1]))
        else:
            split = re.fullmatch(r" *If \(feature ([0-9]+) <= (\S+)\)", line)
            left = read()
            lines.pop(0)  # its Else line
            out[at] = (int(split[1]) + 1, float(split[2]), left, read(), 0.0)
        return at + 1

    read()
    return out


class Boosted:
    """Trees with their weights as a table, and a threshold for each generator's kind."""

    def __init__(self, printed: str, weights: list[float], names: list[str], depth: int) -> None:
        self.names, self.depth, self.weights = names, depth, weights
        parts = re.split(r"\n *Tree [0-9]+ \(weight [^)]*\):\n", printed)[1:]
        self.trees = [nodes_of([line for line in p.split("\n") if line.strip()]) for p in parts]
        self.thresholds: dict[str, float] = {}

    def margin(self, values: str) -> str:
        """The trees' weighted sum for an array of feature values; it must be bound by `let`."""
        node = lambda f, t, left, right, v: f"named_struct('f', {f}, 't', {t!r}D, 'l', {left}, 'r', {right}, 'v', {v!r}D)"
        table = "array(" + ", ".join(f"named_struct('w', {float(w)!r}D, 'n', array({', '.join(node(*n) for n in tree)}))" for w, tree in zip(self.weights, self.trees, strict=True)) + ")"

        def step(nodes: str, at: str) -> str:
            own = arrays.name("own")
            down = f"CASE WHEN element_at({values}, greatest({own}.f, 1)) <= {own}.t THEN {own}.l ELSE {own}.r END"
            return f"element_at(transform(array(element_at({nodes}, {at})), {own} -> CASE WHEN {own}.f = 0 THEN {at} ELSE {down} END), 1)"

        def value(tree: str) -> str:
            leaf = arrays.folded(f"sequence(1, {self.depth})", "1", lambda at, _: step(f"{tree}.n", at))
            return f"element_at({tree}.n, {leaf}).v * {tree}.w"

        return arrays.folded(table, "0D", lambda total, tree: f"{total} + {value(tree)}")


_FITTED: dict[tuple[str, int], Boosted] = {}


def fit(spark: SparkSession, rows: int = TRAINING_ROWS) -> Boosted:
    """Boost on four fifths of the examples; calibrate thresholds on the last fifth. The examples are the same every time, so an
    application fits once."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    known = (spark.sparkContext.applicationId, rows)
    if known in _FITTED:
        return _FITTED[known]
    columns = features("hit", "before", "after")
    names = list(columns)
    table = VectorAssembler(inputCols=names, outputCol="features").transform(examples(spark, rows).selectExpr("id", "kind", "label", *[f"{c} AS {n}" for n, c in columns.items()])).coalesce(1)
    model = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.3, seed=SEED, checkpointInterval=-1).fit(table.where("id % 5 <> 0"))
    out = Boosted(model.toDebugString, list(model.treeWeights), names, DEPTH)
    checked = table.where("id % 5 = 0").selectExpr("kind", "label", f"{let(f'array({chr(44).join(names)})', out.margin)} AS margin").collect()
    for kind in GENERATORS:
        ranked = sorted(((r["margin"], r["label"]) for r in checked if r["kind"] == kind), reverse=True)
        right, best = 0.0, math.inf
        for i, (margin, label) in enumerate(ranked, 1):
            right += label
            if right / i >= PRECISION and (i == len(ranked) or ranked[i][0] < margin):
                best = margin
        out.thresholds[kind] = max(best, 0.0)
    _FITTED.clear()
    _FITTED[known] = out
    return out


def _slim(hits: str) -> str:
    return each(hits, lambda x: f"named_struct('kind', {x}.kind, 'start', {x}.start, 'end', {x}.end)")


def _by_start(spans: str) -> str:
    return "array_sort(" + each(spans, lambda x: f"named_struct('start', {x}.start, 'end', {x}.end, 'kind', {x}.kind)") + ")"


def base_spans(text: str) -> str:
    """Matches of the base patterns that pass their checks, as an array of SPAN by kind, then start; text is bound by `let`."""
    # What a pattern cannot do without; most texts lack it, and their scan ends there.
    needs = {"email": f"contains({text}, '@')", "ip": f"{text} RLIKE '[0-9][.][0-9]'", "card": f"{text} RLIKE '[0-9]'", "phone": f"contains({text}, '+')"}
    check = lambda kind: lambda x: valid(kind, f"{x}.hit")
    return "concat(" + ", ".join(f"CASE WHEN {needs[k]} THEN {_slim(only(located(text, k, p), check(k)))} ELSE cast(array() AS array<{SPAN}>) END" for k, p in BASE.items()) + ")"


def added_spans(text: str, model: Boosted) -> str:
    """Candidates that the trees accept in a text without base spans, as an array of SPAN by kind, then start; text is bound by `let`."""
    needs = {"number": raw(r"[0-9][ ().\-/]|[0-9]{9}"), "handle": raw(r"[(\[{ ]at[ )\]}]"), "account": raw("[A-Z]{2}[0-9]{2}"), "address": raw("[0-9A-Fa-f][:-][0-9A-Fa-f]{1,4}[:-]|::")}
    used = [k for k in GENERATORS if math.isfinite(model.thresholds[k])]
    if not used:
        return f"cast(array() AS array<{SPAN}>)"

    def likely(x: str) -> str:
        own = features(f"{x}.hit", f"{x}.before", f"{x}.after").values()
        level = "CASE " + " ".join(f"WHEN {x}.kind = '{k}' THEN {model.thresholds[k]!r}D" for k in used) + " END"
        return f"{let(f'array({chr(44).join(own)})', model.margin)} >= {level}"

    # One filter for all kinds: the trees stand in the plan once.
    proposed = ", ".join(f"CASE WHEN {text} RLIKE {needs[k]} THEN {located(text, k, GENERATORS[k])} ELSE cast(array() AS array<{HIT}>) END" for k in used)
    return _slim(only(f"concat({proposed})", likely))


def personal_spans(docs: DataFrame, model: Boosted | None = None, text_col: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """docs with two arrays of (kind, start, end): base, and spans with the added ones, each ordered by kind, then start."""
    model = model or fit(docs.sparkSession)
    kept = [c for c, name in zip(every(docs), docs.columns, strict=True) if name.lower() not in (base.lower(), spans.lower())]
    own = fresh(docs, "_base")
    text = "coalesce(cast(`" + text_col.replace("`", "``") + "` AS string), '')"
    filler = lambda s, m: f"repeat({MASK}, greatest(0, {s}.end - greatest({s}.start, {m})))"
    added = let(text, lambda t: let(replaced(t, _by_start(own), filler), lambda masked: added_spans(masked, model)))
    df = docs.select("*", F.expr(let(text, base_spans)).alias(own))
    return df.select(*kept, F.col(own).alias(base), F.expr(f"concat({own}, {added})").alias(spans))


def written(spans: str) -> Column:
    return F.expr(f"array_join({each(spans, lambda s: f'concat({s}.kind, {chr(39)}:{chr(39)}, {s}.start, {chr(39)}:{chr(39)}, {s}.end)')}, ',')")


def redacted(docs: DataFrame, model: Boosted | None = None, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; overlapping spans become one, under the kind of the first."""
    work = fresh(docs, "_pii")
    df = personal_spans(docs, model, text_col, f"{work}_base", f"{work}_spans")
    filler = lambda s, m: f"CASE WHEN {s}.start >= {m} THEN concat('<', {s}.kind, '>') ELSE '' END"
    cleaned = F.expr(let("cast(`" + text_col.replace("`", "``") + "` AS string)", lambda t: replaced(t, _by_start(f"{work}_spans"), filler)))
    return df.select(*[cleaned.alias(name) if name == text_col else c for c, name in zip(every(docs), docs.columns, strict=True)])


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = personal_spans(documents(spark, sf_dir).select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return df.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))
