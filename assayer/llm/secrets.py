"""Secret scans: fixed patterns, and sliding-window entropy for each character class over candidate strings.

Three patterns give the base spans. Besides them every long run of key characters is a candidate: a window slides over it,
counts of its characters are updated as one enters and one leaves, and with them the window's Shannon entropy. A window over
the level of its character class makes the candidate a secret unless the allow-list knows its form. Where the candidate as a
whole isn't one, each of its runs between = _ / and - is judged in the same way by its own class, so a key counts behind its
name. What a base span covers isn't reported again; the rest of the candidate is.

Positions count code points, ends are exclusive. Defined results: a null or empty text has no spans; repeated rows have the
same spans; a null id keeps its row, ids keep their type; a table without rows gives none; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

# The three base patterns and their least lengths, as specified.
ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "entropy")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PART = re.compile(r"[A-Za-z0-9+]+")
WINDOW = 20
#: Character classes: name, form of the candidate, least entropy of a window in bits for each character.
CLASSES = (("hex", re.compile(r"[0-9a-fA-F]+"), 3.0), ("base32", re.compile(r"[A-Z2-7]+=*"), 3.5), ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 3.8))
#: A word: one letter case, a capital first, or such words joined as in camelCase, each of three letters at least.
WORD = r"(?:[A-Z]?[a-z]+|[A-Z]+|[a-z]*(?:[A-Z][a-z]{2,})+)"
#: Forms that aren't secrets: words without digits, digits alone, UUIDs, documented sample keys, repeated units, rules.
ALLOWED = (
    re.compile(rf"{WORD}([-_/=+]{WORD})*[-_/=+]*"),
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    re.compile(r".*EXAMPLE.*"),
    re.compile(r"(.{1,8}?)\1+.{0,8}"),
    re.compile(r"[0-9]+([-_/][0-9]+)*"),
)

_OF_HEX = bytes(1 if chr(i) in "0123456789abcdef" else 0 for i in range(256))
_OF_KEY = bytes(1 if re.match(r"[A-Za-z0-9+/_=-]", chr(i)) and i < 128 else 0 for i in range(256))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every base match, in that order."""
    raw, low = text.encode("utf-8", "surrogatepass"), text.lower()
    out = []
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if b"\1" * 16 in raw.translate(_OF_HEX):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def peak_entropy(text: str, window: int = WINDOW) -> float:
    """The largest Shannon entropy of any window, by counts that change by one character in and one out."""
    counts: dict[str, int] = {}
    weighted = best = 0.0
    term = [0.0, *[c * math.log2(c) for c in range(1, window + 1)]]
    for i, new in enumerate(text):
        c = counts.get(new, 0)
        weighted += term[c + 1] - term[c]
        counts[new] = c + 1
        if i >= window:
            old = text[i - window]
            c = counts[old]
            weighted += term[c - 1] - term[c]
            counts[old] = c - 1
        if i >= window - 1:
            best = max(best, math.log2(window) - weighted / window)
    return best


def runs(text: str) -> list[tuple[int, int]]:
    """(start, end) of what may be one key in a candidate: the candidate, and each run between = _ / and -."""
    out = [(0, len(text))]
    parts = [m.span() for m in PART.finditer(text)]
    return out + [x for x in parts if x[1] - x[0] >= WINDOW and x != out[0]]


def secret(text: str) -> bool:
    """Whether the entropy passes the level of the text's class and no allowed form covers it."""
    if any(a.fullmatch(text) for a in ALLOWED):
        return False
    level = next(level for _, form, level in CLASSES if form.fullmatch(text) or form is CLASSES[-1][1])
    return peak_entropy(text) >= level


def entropy_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of candidates that are secrets as a whole, else of their runs that are."""
    if b"\1" * 20 not in text.encode("utf-8", "surrogatepass").translate(_OF_KEY):
        return []
    out = []
    for m in CANDIDATE.finditer(text):
        found = [(a, b) for a, b in runs(m[0]) if secret(m[0][a:b])]
        whole = [x for x in found if x == (0, len(m[0]))]
        out += [(m.start() + a, 3, m.start() + b) for a, b in whole or found]
    return out


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What spans in order of their start cover together, as ranges that don't touch."""
    out: list[tuple[int, int]] = []
    for a, _, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def outside(text: str, span: tuple[int, int, int], covered: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The parts of a span of text outside merged ranges; a part of an allowed form, such as a name before a key, isn't one."""
    start, kind, end = span
    out = []
    i = bisect_right(covered, start, key=lambda x: x[1])
    while start < end:
        a, b = covered[i] if i < len(covered) else (end, end)
        if start < min(a, end):
            out.append((start, kind, min(a, end)))
        start, i = b, i + 1
    return [x for x in out if x == span or not any(a.fullmatch(text[x[0] : x[2]]) for a in ALLOWED)]


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans."""
    base = base_spans(text)
    covered = merged(base)
    more = [part for x in entropy_spans(text) for part in outside(text, x, covered)]
    return base, sorted(base + more)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


COLUMNS = "n_assign long, n_access long, n_hex long, n_entropy long, base string, spans string"


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts by kind, base spans and all spans, each written kind:start:end and comma-joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for value in batch.column(1):
                base, spans = scan(value.as_py() or "")
                kinds = [k for _, k, _ in spans]
                for column, x in zip(out, (*[kinds.count(k) for k in range(4)], written(base), written(spans)), strict=True):
                    column.append(x)
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, t) for x, t in zip(out, types, strict=True)]], names=["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base", "spans"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, {COLUMNS}")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_entropy")


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
