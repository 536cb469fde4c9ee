"""Array and text helpers as SQL expressions, linear or nearly so in the length of their input.

Catalyst may put a column's definition in place of its name, and inside a lambda that means once for every element. `let`
binds a value to a lambda's variable, which is evaluated once. Arguments are SQL text; names of bound variables must differ
along a nesting, so every helper makes its own.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

#: Code points in a chunk of a text, a power of two.
CHUNK_BITS = 8
CHUNK = 1 << CHUNK_BITS
_NAMES = count()


def name(stem: str) -> str:
    """A variable's name that nothing else has."""
    return f"{stem}_{next(_NAMES)}"


def raw(text: str) -> str:
    """A string literal in which backslashes are themselves."""
    return f"r'{text}'"


def let(value: str, body: Callable[[str], str], stem: str = "v") -> str:
    """body of value, which is evaluated once."""
    v = name(stem)
    return f"element_at(transform(array({value}), {v} -> {body(v)}), 1)"


def each(values: str, body: Callable[[str], str]) -> str:
    x = name("x")
    return f"transform({values}, {x} -> {body(x)})"


def numbered(values: str, body: Callable[[str, str], str]) -> str:
    """As each, with the element's number from 0."""
    x, i = name("x"), name("i")
    return f"transform({values}, ({x}, {i}) -> {body(x, i)})"


def only(values: str, body: Callable[[str], str]) -> str:
    x = name("x")
    return f"filter({values}, {x} -> {body(x)})"


def zipped(a: str, b: str, body: Callable[[str, str], str]) -> str:
    x, y = name("x"), name("y")
    return f"zip_with({a}, {b}, ({x}, {y}) -> {body(x, y)})"


def folded(values: str, zero: str, body: Callable[[str, str], str]) -> str:
    acc, x = name("acc"), name("x")
    return f"aggregate({values}, {zero}, ({acc}, {x}) -> {body(acc, x)})"


def scan(values: str, zero: str, combine: Callable[[str, str], str]) -> str:
    """For each element, zero and all elements before it combined; combine is associative, zero changes nothing.

    The array is cut into about as many parts as each is long, so that arrays grown by appending stay short.
    """

    def along(xs: str, start: str) -> str:
        return folded(xs, f"array({start})", lambda acc, x: f"array_append({acc}, {combine(f'element_at({acc}, -1)', x)})")

    def joined(parts: str) -> str:
        totals = each(parts, lambda p: folded(p, zero, combine))
        return let(along(totals, zero), lambda starts: f"flatten({zipped(parts, f'slice({starts}, 1, size({parts}))', lambda p, s: f'slice({along(p, s)}, 1, size({p}))')})")

    def chunked(v: str) -> str:
        return let(f"cast(ceil(sqrt(size({v}))) AS int)", lambda w: let(each(f"sequence(0, (size({v}) - 1) div {w})", lambda k: f"slice({v}, cast({k} AS int) * {w} + 1, {w})"), joined))

    return let(values, lambda v: f"CASE WHEN size({v}) > 0 THEN {chunked(v)} ELSE slice(array({zero}), 1, 0) END")


def running(values: str) -> str:
    """For each element the sum of those before it."""
    return scan(values, "0", lambda a, b: f"{a} + {b}")


def chunks(text: str) -> str:
    """The text in pieces of CHUNK code points; the last one may be shorter."""
    return f"regexp_extract_all({text}, {raw(f'(?s).{{1,{CHUNK}}}')}, 0)"


def between(parts: str, start: str, end: str) -> str:
    """Code points start to end of a text given as chunks; a substring of the text would count from its beginning."""
    whole = f"array_join(slice({parts}, shiftright({start}, {CHUNK_BITS}) + 1, shiftright({end} - 1, {CHUNK_BITS}) - shiftright({start}, {CHUNK_BITS}) + 1), '')"
    return f"CASE WHEN {end} > {start} THEN substring({whole}, ({start} & {CHUNK - 1}) + 1, {end} - {start}) ELSE '' END"


def replaced(text: str, spans: str, filler: Callable[[str, str], str]) -> str:
    """The text with its spans, structs of start, end and more in order of start, replaced by filler(span, end of those before)."""

    def body(parts: str, ss: str) -> str:
        before = scan(each(ss, lambda s: f"{s}.end"), "0", lambda a, b: f"greatest({a}, {b})")
        pieces = let(before, lambda ms: zipped(ss, ms, lambda s, m: f"concat({between(parts, m, f'{s}.start')}, {filler(s, m)})"))
        last = f"array_max({each(ss, lambda s: f'{s}.end')})"
        return f"concat(array_join({pieces}, ''), {let(last, lambda e: between(parts, e, f'char_length({text})'))})"

    return let(spans, lambda ss: f"CASE WHEN size({ss}) > 0 THEN {let(chunks(text), lambda parts: body(parts, ss))} ELSE {text} END")
