"""Inverted token index over redacted event text, and searches against it."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, functions as F

from vigilog.functions.wording import action_summary


def _folds() -> dict[str, str]:
    """Lower-case letters that are a letter with marks, by their canonical decomposition."""
    out = {}
    for code in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and chr(code) == chr(code).lower() and parts[0].isalpha() and all(unicodedata.combining(c) for c in parts[1:]):
            out[chr(code)] = parts[0]
    return out


ACCENTED, PLAIN = ("".join(x) for x in zip(*_folds().items()))


def searchable(events: DataFrame) -> DataFrame:
    """Indexable text of each event; a terminal row repeats its Pre and is left out."""
    subject = F.col("d.git.commit.subject")
    summary = action_summary(F.col("action_type"), F.col("target"), F.col("tool_name"), F.col("d.description"))
    some = lambda x: F.nullif(x, F.lit(""))
    kind = (
        F.when(F.col("phase") == "prompt", "prompt").when(F.col("phase") == "reasoning", "reasoning")
        .when(subject.isNotNull(), "commit").otherwise(F.col("action_type"))
    )
    return (
        events.filter(~(F.col("phase").isin("post", "failure") & F.col("tool_use_id").isNotNull()))
        .select("session_id", "seq", "ts", "prompt_id", kind.alias("kind"), F.trim(F.concat_ws(
            " — ", some(F.col("target")), some(summary), some(F.col("d.prompt")), some(F.col("d.reasoning")), some(subject))).alias("text"))
        .filter(F.col("text") != "")
    )


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def tokens(text: Column) -> Column:
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def token_index(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(term, keys, position) rows."""
    return texts.select(*keys, F.posexplode(tokens(F.col("text"))).alias("pos", "term"))


def term_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("uses"))


def search_terms(index: DataFrame, keys: list[str], terms: list[str]) -> DataFrame:
    """Rows holding every term; a trailing * makes a term a prefix."""
    wanted = [t.lower() for t in terms]
    hit = lambda t: F.col("term").startswith(t[:-1]) if t.endswith("*") else F.col("term") == t
    any_term = hit(wanted[0])
    for t in wanted[1:]:
        any_term = any_term | hit(t)
    seen = index.filter(any_term).groupBy(*keys).agg(
        *[F.max(hit(t).cast("int")).alias(f"_{i}") for i, t in enumerate(wanted)])
    for i in range(len(wanted)):
        seen = seen.filter(F.col(f"_{i}") == 1)
    return seen.select(*keys)


def search_phrase(index: DataFrame, keys: list[str], phrase: list[str]) -> DataFrame:
    """Rows where the terms stand next to each other, in order."""
    starts = None
    for i, term in enumerate(phrase):
        here = index.filter(F.col("term") == term.lower()).select(*keys, (F.col("pos") - i).alias("pos"))
        starts = here if starts is None else starts.join(here, [*keys, "pos"], "left_semi")
    return starts.select(*keys).distinct()


def search(index: DataFrame, keys: list[str], text: str) -> DataFrame:
    """All words of the text; quotes or other punctuation make it a phrase. Never fails."""
    words = [w for w in "".join(c if c.isalnum() or c == "*" else " " for c in text).split() if w.strip("*")]
    if not words:
        return index.select(*keys).limit(0)
    plain = all(c.isalnum() or c in " *" for c in text)
    return search_terms(index, keys, words) if plain else search_phrase(index, keys, [w.strip("*") for w in words])


def newest_hits(texts: DataFrame, hits: DataFrame, terms: list[str], limit: int = 200) -> DataFrame:
    """Newest matching events, each with its terms marked."""
    marked = F.regexp_replace("text", "(?i)\\b(" + "|".join(map(re.escape, terms)) + ")\\b", "[$1]")
    return texts.join(hits, ["session_id", "seq"], "left_semi").select(
        "session_id", "seq", "kind", "ts", "prompt_id", marked.alias("snippet")
    ).orderBy(F.desc("ts"), F.desc("seq"), "session_id").limit(limit)


def grouped_hits(hits: DataFrame, top: int = 30, per_session: int = 8) -> DataFrame:
    """At most `per_session` of the `top` newest hits of each session."""
    from pyspark.sql import Window as W

    newest = hits.orderBy(F.desc("ts"), F.desc("seq"), "session_id").limit(top)
    order = W.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("seq"))
    return newest.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_session)
