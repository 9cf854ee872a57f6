"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements
and one failure bit per rule; policies are named, versioned sets of rules that
are applied to the bits afterwards, and ablations are read from the counts of
the few distinct bitmasks, without another pass over any text.

Null and empty texts have no words: all measurements are 0, so they fail
`few_words`. Equal rows get equal ledgers; an empty table gives an empty
ledger. Only the named text column is read, so other columns, whatever their
names, are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from vigilog.llm.common import WORDS, fresh, small_batches

#: The characters that count as symbols, the words of a window.
SYMBOLS = "#*$%&|<>"
WINDOW = 5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_MEASURED = StructType([StructField(m, LongType()) for m in MEASURES])


@dataclass(frozen=True)
class Rule:
    """`fails` gets the measured struct and says whether a document breaks the rule."""

    name: str
    fails: Callable[[Column], Column]


#: The bit of a rule is its place in this list: append only.
RULES = (
    Rule("few_words", lambda m: m["n_words"] < 10),
    Rule("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    Rule("symbols", lambda m: 5 * m["n_symbols"] > m["n_words"]),
    Rule("repeated_lines", lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
    Rule("long_words", lambda m: m["word_chars"] > 40 * m["n_words"]),
)

#: Policies by version; a new version is a new entry.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "web-1": ("few_words", "repeated_windows", "symbols"),
    "web-2": ("few_words", "repeated_windows", "symbols", "repeated_lines", "long_words"),
}
BASE, DEFAULT = "base-1", "web-2"


def repeat_words(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more."""
    grams = list(zip(*(words[k:] for k in range(window))))
    seen = set(grams)
    if len(seen) == len(grams):
        return 0
    first: dict[tuple, int] = {}
    hit = bytearray(len(words))
    for k, gram in enumerate(grams):
        at = first.setdefault(gram, k)
        if at != k:
            hit[k:k + window] = hit[at:at + window] = b"\1" * window
    return sum(hit)


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of MEASURES."""
    if not text:
        return (0,) * len(MEASURES)
    words = WORDS.findall(text)
    lines = [line for line in text.split("\n") if WORDS.search(line)]
    return (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)),
            repeat_words(words))


def _measures(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts], columns=list(MEASURES))


def mask(policy: str) -> int:
    """The bits of the rules that a policy applies."""
    places = {rule.name: k for k, rule in enumerate(RULES)}
    return sum(1 << places[name] for name in POLICIES[policy])


def ledger(docs: DataFrame, text: str = "text", name: str = "ledger") -> tuple[DataFrame, str]:
    """`docs` with one more column: a struct of `fail_bits` and the measurements. Returns its name as well."""
    small_batches(docs.sparkSession)
    raw, name = fresh(docs, "measured"), fresh(docs, name)
    # Non-deterministic for the planner only: the texts must not be measured again for each use of the result.
    by_text = F.pandas_udf(_measures, _MEASURED).asNondeterministic()
    out = docs.withColumn(raw, by_text(F.col(f"`{text}`")))
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(RULES):
        bits = bits + F.when(rule.fails(F.col(raw)), F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
    return out.withColumn(name, F.struct(bits.alias("fail_bits"), f"{raw}.*")).drop(raw), name


def passes(bits: Column, policy: str = DEFAULT) -> Column:
    return bits.bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def filtered(docs: DataFrame, policy: str = DEFAULT, text: str = "text") -> DataFrame:
    """The documents that pass a policy, with their columns as they were."""
    out, name = ledger(docs, text)
    return out.where(passes(F.col(f"{name}.fail_bits"), policy)).drop(name)


def ablation(ledgers: DataFrame, bits: str = "fail_bits", policy: str = DEFAULT) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail nothing else of the policy, and that would be kept without it.

    One aggregation by bitmask, at most two to the number of rules rows, then bit operations on those rows.
    """
    on = mask(policy)
    counts = ledgers.groupBy(F.col(bits).bitwiseAND(F.lit(on).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rows = [(rule.name, 1 << k) for k, rule in enumerate(RULES) if on >> k & 1]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in rows]))
    counts = counts.select("bits", "n", each.alias("r")).select("bits", "n", "r.*")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return counts.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failing"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("failing_alone"),
        F.sum(F.when((F.col("bits") == 0) | (F.col("bits") == F.col("bit")), F.col("n")).otherwise(0)).alias("kept_without"))
