"""Pieces of the SQL beside queries, for what DuckDB has no function for."""

from __future__ import annotations

#: A common table: one row with the list of the 256 remainders of CRC-32.
CRC_TABLE = """crc AS (SELECT list(c ORDER BY n) AS crc_t FROM (
  SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS n)))"""


def bytes_sql(text: str) -> str:
    """The UTF-8 bytes of a text, a list of numbers."""
    digit = lambda at: f"strpos('0123456789ABCDEF', substr(hex({text}), {at}, 1)) - 1"
    return f"list_transform(range(1, 2 * strlen({text}), 2), lambda q: ({digit('q')}) * 16 + {digit('q + 1')})"


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8, where crc of CRC_TABLE is among the tables joined."""
    return f"xor(list_reduce(list_prepend(4294967295, {bytes_sql(text)}), lambda c, b: xor(c >> 8, crc_t[(xor(c, b) & 255) + 1])), 4294967295)"
