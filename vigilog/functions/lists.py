"""Small expression helpers over fixed lists and arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def any_match(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def first_of(*candidates: Column) -> Column:
    return F.coalesce(*candidates)


def one_of(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def lookup(mapping: dict, key: Column) -> Column:
    """Value of a fixed mapping, null for unknown keys."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def matching_names(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """Names of the patterns found in the text, in list order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in patterns]))


def clip(text: Column, limit: int, mark: str = "…") -> Column:
    """Cut at a number of code points and mark the cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def basename(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), path)
