"""Canonical JSON and prefixed SHA-256 as expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vigilog.functions.fixed_values import HASH_PREFIX


def sha256_text(text: Column) -> Column:
    return F.concat(F.lit(HASH_PREFIX), F.sha2(text, 256))


def lower_escapes(text: Column) -> Column:
    """JSON control escapes with lower-case hex digits (\\u001b, not \\u001B)."""
    for upper in "ABCDEF":
        text = F.regexp_replace(text, rf"(?<!\\)((?:\\\\)*\\u00[01]){upper}", f"$1{upper.lower()}")
    return text


def canonical_json(columns: list[str]) -> Column:
    """Compact JSON of the columns in name order, leaving out nulls."""
    return lower_escapes(F.to_json(F.struct(*sorted(columns))))


def hex_id(text: Column, size: int) -> Column:
    """First `size` bytes of a SHA-256 as hex; never all zero."""
    head = F.substring(F.sha2(text, 256), 1, size * 2)
    return F.when(head.rlike("^0+$"), F.concat(F.substring(head, 1, size * 2 - 1), F.lit("1"))).otherwise(head)


_KEY = r'"(?:[^"\\]|\\.)*+"'


def without_nulls(text: Column) -> Column:
    """Compact JSON without the fields that are null; nulls in arrays stay. A key is met before anything inside it, so strings are safe."""
    for pattern, left in ((_KEY + ":null,", ""), ("," + _KEY + r":null(?=\})", ""), (r"\{" + _KEY + r":null\}", "{}")):
        text = F.regexp_replace(text, pattern, left)
    return text
