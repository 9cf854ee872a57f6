"""Cut shell commands into segments, words and programs with regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_QUOTED = r"'[^']*'|\"[^\"]*\""
_NESTED = r"\((?:[^()]|\([^()]*\))*\)"
SEGMENT = rf"((?:{_QUOTED}|{_NESTED}|(?<!&)&(?!&)|[^;|&\n])++)"
WORD = rf"((?:{_QUOTED}|{_NESTED}|\S)++)"
ASSIGNMENT = r"^[A-Za-z_][A-Za-z0-9_]*="
NOISE_PROGRAMS = ["true", ":", "exit"]
RISKY_SEGMENT = (
    r"^(rm|nc|ncat|netcat|scp|rsync|sftp|ssh|ftp|telnet|curl|wget)\b|\bchmod\b.*(777|a=?\+?rwx|ugo\+rwx)"
    r"|^git\s+push\b.*(--force|-f\b)|^git\s+reset\b.*--hard|^git\s+clean\b.*-[a-z]*f|^(sh|bash|zsh|eval)\b.*-c"
)


def segments(command: Column) -> Column:
    """Top-level steps of a command; separators inside quotes or parentheses do not cut."""
    cut = F.transform(F.regexp_extract_all(command, F.lit(SEGMENT), 1), lambda s: F.trim(s))
    return F.filter(cut, lambda s: s != "")


def words(segment: Column) -> Column:
    return F.regexp_extract_all(segment, F.lit(WORD), 1)


def program_words(segment: Column) -> Column:
    """Words after leading variable assignments."""
    return F.aggregate(
        words(segment), F.expr("array()").cast("array<string>"),
        lambda acc, w: F.when((F.size(acc) == 0) & w.rlike(ASSIGNMENT), acc).otherwise(F.concat(acc, F.array(w))),
    )


def program(segment: Column) -> Column:
    first = F.get(program_words(segment), F.lit(0))
    return F.regexp_replace(F.coalesce(first, F.lit("")), r"^\W+", "")


def steps(command: Column) -> Column:
    """array<struct<program, arguments, danger>> of the steps worth naming."""
    return F.filter(
        F.transform(segments(command), lambda s: F.struct(
            program(s).alias("program"), (F.size(program_words(s)) > 1).alias("arguments"),
            s.rlike(RISKY_SEGMENT).alias("danger"))),
        lambda x: ~x["program"].isin(NOISE_PROGRAMS),
    )


def shell_summary(command: Column) -> Column:
    """One line for a command without its own description."""
    found = steps(command)
    salient = F.coalesce(F.get(F.filter(found, lambda x: x["danger"]), F.lit(0)), F.get(found, F.lit(0)))
    gist = F.concat(F.lit(" `"), salient["program"], F.lit("`"),
                    F.when(salient["arguments"], " with arguments").otherwise(""))
    return (
        F.when(F.size(found) == 0, "Ran a shell command.")
        .when(F.size(found) == 1, F.concat(F.lit("Run"), gist, F.lit(".")))
        .otherwise(F.concat(F.lit("Ran a "), F.size(found).cast("string"), F.lit("-step shell command — run"), gist))
    )
