"""Glob and prefix patterns of the expected-behaviour policy, as column patterns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _quoted(pattern: Column) -> Column:
    return F.regexp_replace(pattern, r"([\\^$.+()\[\]{}|])", r"\\$1")


def glob_regex(pattern: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(_quoted(pattern), r"\*", ".*"), r"\?", ".")


def path_regex(pattern: Column) -> Column:
    """Paths: ** crosses directories, * and ? do not."""
    text = F.regexp_replace(_quoted(pattern), r"\*\*", "\u0001")
    text = F.regexp_replace(F.regexp_replace(text, r"\*", "[^/]*"), r"\?", "[^/]")
    return F.regexp_replace(text, "\u0001", ".*")


def has_glob(pattern: Column) -> Column:
    return pattern.contains("*") | pattern.contains("?")


def scalar_matches(value: Column, pattern: Column, any_case: bool = False) -> Column:
    v, p = (F.lower(value), F.lower(pattern)) if any_case else (value, pattern)
    return F.when(has_glob(p), F.rlike(v, F.concat(F.lit("^"), glob_regex(p), F.lit("$")))).otherwise(v == p)


def path_matches(value: Column, pattern: Column) -> Column:
    clean = lambda x: F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("/")), r"^\./", "")
    v, p = clean(value), clean(pattern)
    rooted = p.startswith("/")
    lead = F.when(rooted, "^").otherwise("(?:^|/)")
    plain = (v == p) | (~rooted & v.endswith(F.concat(F.lit("/"), p)))
    return F.when(has_glob(p), F.rlike(v, F.concat(lead, path_regex(p), F.lit("$")))).otherwise(plain)


def command_matches(value: Column, pattern: Column) -> Column:
    v = F.ltrim(value)
    next_char = F.substring(v, F.length(pattern) + 1, F.lit(1))
    plain = v.startswith(pattern) & ((next_char == "") | next_char.rlike(r"\s") | pattern.rlike(r"[;&|]$"))
    return F.when(has_glob(pattern), F.rlike(v, F.concat(F.lit("^"), glob_regex(pattern)))).otherwise(plain)
