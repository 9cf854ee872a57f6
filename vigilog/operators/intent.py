"""Stated narrative of a turn against the risky things it did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilog.functions import fixed_values as V
from vigilog.functions.predicates import is_sensitive_path, looks_like_host

TURN = ["session_id", "prompt_id"]


def observed_entities(facts: DataFrame) -> DataFrame:
    """Sensitive paths, outside hosts, flagged commands and MCP servers of each turn."""
    c = F.col
    binary = F.get(F.split(F.trim("target"), r"\s+"), F.lit(0))
    item = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    found = F.array_compact(F.array(
        F.when(c("sensitive_path").isNotNull(), item("path", c("sensitive_path"))),
        F.when(looks_like_host(c("send.host")), item("host", c("send.host"))),
        F.when(c("shell"), item("command", binary)),
        F.when((c("action_type") == "mcp_call") & c("server").isNotNull(), item("mcp_server", c("server"))),
    ))
    rows = facts.filter(c("prompt_id").isNotNull() & ~c("phase").isin("post", "failure", "reasoning"))
    return rows.select(*TURN, "seq", F.explode(found).alias("e")).select(*TURN, "seq", "e.*")


def narratives(events: DataFrame) -> DataFrame:
    """The last narrative of each turn; a cut one cannot prove absence."""
    return events.filter((F.col("phase") == "reasoning") & F.col("prompt_id").isNotNull() & (F.trim("d.reasoning") != "")).groupBy(
        *TURN).agg(F.max_by("d.reasoning", "seq").alias("text")).withColumn("truncated", F.col("text").endswith(V.ELLIPSIS))


def mentions_path(text: Column, path: Column) -> Column:
    base = F.lower(F.element_at(F.split(path, "/"), -1))
    lower = F.lower(text)
    return lower.contains(F.lower(path)) | ((F.length(base) > 2) & lower.contains(base))


def mentions_word(text: Column, word: Column) -> Column:
    return F.rlike(text, F.concat(F.lit(r"(?i)\b\Q"), word, F.lit(r"\E\b")))


def undisclosed_actions(observed: DataFrame, told: DataFrame) -> DataFrame:
    """Observed entities the turn's narrative never names."""
    once = observed.groupBy(*TURN, "kind", "value").agg(F.min("seq").alias("seq"))
    named = F.when(F.col("kind") == "path", mentions_path(F.col("text"), F.col("value"))).otherwise(
        mentions_word(F.col("text"), F.col("value")))
    return once.join(told, TURN).filter(~named).select(*TURN, "kind", "value", "seq", "truncated")


def stated_entities(told: DataFrame) -> DataFrame:
    """Sensitive paths and hosts named in complete narratives."""
    words = F.transform(
        F.split("text", r"[\s`\"'()\[\]{},;<>]+"), lambda w: F.regexp_replace(w, r"^[.:]+|[.:,]+$", ""))
    rows = told.filter(~F.col("truncated")).select(*TURN, F.explode(F.array_distinct(words)).alias("value")).filter(
        F.col("value") != "")
    path = is_sensitive_path(F.col("value"))
    host = F.col("value").contains(".") & ~F.col("value").contains("/") & looks_like_host(F.col("value"))
    return rows.withColumn("kind", F.when(path, "path").when(host, "host")).filter(F.col("kind").isNotNull())


def unfulfilled_statements(observed: DataFrame, told: DataFrame) -> DataFrame:
    """Stated paths and hosts that no action of the turn touched."""
    acted = observed.select(*TURN).distinct()
    stated = stated_entities(told.join(acted, TURN, "left_semi"))
    done = observed.filter(F.col("kind").isin("path", "host")).select(
        *TURN, "kind", F.col("value").alias("did")).distinct()
    hit = F.when(F.col("kind") == "path", mentions_path(F.col("value"), F.col("did"))).otherwise(
        F.lower("value") == F.lower("did"))
    met = stated.join(done, [*TURN, "kind"]).filter(hit).select(*TURN, "kind", "value").distinct()
    return stated.join(met, [*TURN, "kind", "value"], "left_anti").select(*TURN, "kind", "value")


def divergences(observed: DataFrame, told: DataFrame) -> DataFrame:
    missing = undisclosed_actions(observed, told).select(
        *TURN, F.lit("undisclosed_action").alias("type"), "kind", "value", "seq")
    return missing.unionByName(unfulfilled_statements(observed, told).select(
        *TURN, F.lit("unfulfilled_statement").alias("type"), "kind", "value", F.lit(None).cast("bigint").alias("seq")))


def intent_coverage(observed: DataFrame, told: DataFrame) -> DataFrame:
    turns = observed.select(*TURN).distinct().join(told.select(*TURN, "truncated"), TURN, "left")
    told_any = told.select("session_id").distinct().withColumn("narrated", F.lit(True))
    return turns.groupBy("session_id").agg(
        F.count_if(F.col("truncated").isNotNull()).alias("turns_analyzed"),
        F.count_if(F.col("truncated").isNull()).alias("turns_skipped"),
        F.count_if(F.coalesce("truncated", F.lit(False))).alias("turns_truncated"),
    ).join(told_any, "session_id", "full").select(
        "session_id", *[F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in ("turns_analyzed", "turns_skipped", "turns_truncated")],
        F.coalesce("narrated", F.lit(False)).alias("reasoning_available"))
