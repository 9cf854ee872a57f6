"""Markdown session reports and case files as ordered line tables.

A report is a table of (session_id, section, line, text). Nothing gathers a
session's lines into one value, so a session of any size can be reported; the
sink writes lines sorted within their session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilog.functions import fixed_values as V
from vigilog.functions.hashing import sha256_text
from vigilog.functions.lists import lookup, one_of
from vigilog.functions.wording import human_duration
from vigilog.operators.sessions import millis

LINE = ["session_id", "section", "line", "text"]


MANIFEST_FAN, MANIFEST_LEVELS = 256, 5

def _lines(df: DataFrame, section: int, line: Column, text: Column) -> DataFrame:
    return df.select("session_id", F.lit(section).alias("section"), line.cast("bigint").alias("line"), text.alias("text"))


def report_lines(cards: DataFrame, counts: DataFrame, findings: DataFrame, actions: DataFrame, dangers: DataFrame) -> DataFrame:
    c, lit = F.col, F.lit
    took = human_duration(millis(c("ended")) - millis(c("started")))
    head = F.array(
        F.concat(lit("# Session report — "), F.coalesce("title", "session_id")),
        F.concat(lit("- **Session:** `"), c("session_id"), lit("`")),
        F.concat(lit("- **Project (cwd):** "), F.coalesce(F.concat(lit("`"), c("cwd"), lit("`")), lit("—"))),
        F.concat(lit("- **When:** "), c("started"), lit(" → "), c("ended"), lit(" ("), took, lit(")")),
        F.concat(lit("- **Events:** "), c("events").cast("string"), lit(" · **Actions:** "), F.coalesce("actions", lit(0)).cast("string")),
        F.concat(lit("## Overall verdict: "), F.upper("verdict"), lit(" (score "), c("score").cast("string"), lit("/100)")))
    opened = cards.join(counts, "session_id", "left").select("session_id", F.posexplode(head).alias("line", "text"))
    top = _lines(opened, 1, c("line"), c("text"))
    chains = _lines(findings, 2, c("consequent_seq"), F.concat(
        lit("- **"), F.upper("severity"), lit(" — "), F.coalesce(lookup(V.COMBO_LABELS, c("combo")), "combo"), lit(":** "), c("display_note"),
        lit(" **Outcome: "), F.upper("outcome"), lit(".** _(seq "), c("antecedent_seq").cast("string"), lit(" → "),
        c("consequent_seq").cast("string"), lit(")_")))
    risky = F.array_intersect("signals", one_of(V.RISK_FLAGS))
    flagged = _lines(actions.filter(F.size(risky) > 0), 3, c("seq"), F.concat(
        lit("### "), F.substring("ts", 12, 8), lit(" · "), c("summary"), lit(" — flags: "), F.array_join(risky, ", ")))
    todo = dangers.groupBy("session_id", "what").agg(F.min("seq").alias("seq"))
    checks = _lines(todo, 4, c("seq"), F.concat(lit("- [ ] "), c("what")))
    return top.unionByName(chains).unionByName(flagged).unionByName(checks)


def case_lines(report: DataFrame, custody: DataFrame, files: DataFrame, commits: DataFrame, divergences: DataFrame,
               checklist: DataFrame) -> DataFrame:
    """Report lines with custody before and provenance, intent and containment after."""
    c, lit = F.col, F.lit
    status = custody.select(F.concat(
        lit("- **Integrity:** "), F.when(c("ok"), "verified").otherwise(F.concat(lit("BROKEN at seq "), c("break_seq").cast("string"),
        lit(" ("), c("break_reason"), lit(")"))), lit(" · head seq "), c("head_seq").cast("string"))).scalar()
    chain = _lines(report.select("session_id").distinct(), 0, lit(0), status)
    changed = _lines(files.filter(c("turn_id").isNull()), 5, c("seq"), F.concat(
        lit("- `"), c("path"), lit("` (+"), c("insertions").cast("string"), lit(" −"), c("deletions").cast("string"), lit(")")))
    made = _lines(commits, 6, c("seq"), F.concat(lit("- `"), F.substring(F.coalesce("sha", lit("")), 1, 7), lit("` "), F.coalesce("subject", lit(""))))
    told = _lines(divergences, 7, F.coalesce("seq", lit(0)), F.concat(
        lit("- **"), c("type"), lit("** — "), c("kind"), lit(" `"), c("value"), lit("`")))
    steps = _lines(checklist, 8, c("order"), F.concat(c("order").cast("string"), lit(". **["), F.upper("severity"), lit("]** "), c("action"),
                                                     lit(" _(seq "), c("seq").cast("string"), lit(")_")))
    return report.unionByName(chain).unionByName(changed).unionByName(made).unionByName(told).unionByName(steps)


def manifests(lines: DataFrame) -> DataFrame:
    """One digest per case file: a hash tree over its sorted lines.

    Lines are hashed together in stretches of their numbers, and the stretches in
    levels of fixed fan-in, so no file is gathered to be hashed, arrival order does
    not matter, and every line counts, equal ones too.
    """
    digest = sha256_text(F.concat_ws("\u0001", F.col("section").cast("string"), F.col("line").cast("string"), "text"))
    tree = lines.select("session_id", "section", F.col("line").cast("bigint").alias("part"), digest.alias("hash"), F.lit(1).alias("lines"))
    for _ in range(MANIFEST_LEVELS):
        tree = tree.groupBy("session_id", "section", F.floor(F.col("part") / MANIFEST_FAN).cast("bigint").alias("up")).agg(
            sha256_text(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "hash"))), lambda x: x["hash"]), "|")).alias("hash"),
            F.sum("lines").alias("lines")).withColumnRenamed("up", "part")
    # What is left of a section is its highest parts: few, as each level divides positions by the fan.
    whole = tree.groupBy("session_id").agg(F.sum("lines").alias("lines"), F.array_sort(F.collect_list(F.struct("section", "part", "hash"))).alias("parts"))
    return whole.select("session_id", "lines", sha256_text(F.concat_ws(
        ":", F.col("lines").cast("string"), F.array_join(F.transform("parts", lambda x: F.concat_ws(".", x["section"].cast("string"), x["part"].cast("string"), x["hash"])), "|"))).alias("manifest"))


def write_reports(lines: DataFrame, folder: str) -> None:
    """Text files with the lines of each session together and in order."""
    ordered = lines.repartitionByRange("session_id", "section", "line").sortWithinPartitions("session_id", "section", "line", "text")
    ordered.select("text").write.mode("overwrite").text(folder)
