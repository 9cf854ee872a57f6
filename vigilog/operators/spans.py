"""Trace spans: session, turn and action levels with deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilog.functions.hashing import hex_id


def nanos(ts: Column) -> Column:
    return F.unix_micros(F.try_to_timestamp(ts)) * 1000


def spans(actions: DataFrame, events: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row per span; turn bounds cover their actions, the session covers all."""
    c, lit = F.col, F.lit
    trace = hex_id(c("session_id"), 16)
    root = hex_id(F.concat("session_id", lit(":session")), 8)
    turn = hex_id(F.concat("session_id", lit(":turn:"), "prompt_id"), 8)
    ends = events.select("session_id", c("seq").alias("post_seq"), c("ts").alias("post_ts"))
    acts = actions.filter((c("type") != "session") & nanos(c("ts")).isNotNull()).join(ends, ["session_id", "post_seq"], "left")
    start = nanos(c("ts"))
    stop = F.when(c("duration_ms") >= 0, start + c("duration_ms") * 1_000_000).otherwise(F.coalesce(nanos(c("post_ts")), start))
    level1 = acts.select(
        "session_id", "prompt_id", trace.alias("trace_id"), hex_id(F.concat("session_id", lit(":act:"), c("seq").cast("string")), 8).alias("span_id"),
        F.when(c("prompt_id").isNotNull(), turn).otherwise(root).alias("parent_id"),
        F.when(c("tool").isNotNull(), F.concat(lit("execute_tool "), c("tool"))).otherwise(c("type")).alias("name"),
        start.alias("start_ns"), F.greatest(start, stop).alias("end_ns"),
        F.when(c("outcome") == "failed", 2).when(c("outcome") == "succeeded", 1).otherwise(0).alias("status"))
    bounds = level1.filter(c("prompt_id").isNotNull()).groupBy("session_id", "prompt_id").agg(
        F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"))
    level2 = bounds.select(
        "session_id", "prompt_id", trace.alias("trace_id"), turn.alias("span_id"), root.alias("parent_id"), lit("turn").alias("name"),
        "start_ns", "end_ns", lit(0).alias("status"))
    span = events.groupBy("session_id").agg(F.min_by("ts", "seq").alias("a"), F.max_by("ts", "seq").alias("z"))
    reach = level1.groupBy("session_id").agg(F.max("end_ns").alias("acts_end"))
    level0 = span.join(reach, "session_id", "left").join(verdicts.select("session_id", "verdict"), "session_id", "left").select(
        "session_id", lit(None).cast("string").alias("prompt_id"), trace.alias("trace_id"), root.alias("span_id"),
        lit(None).cast("string").alias("parent_id"), lit("session").alias("name"), nanos(c("a")).alias("start_ns"),
        F.greatest(nanos(c("a")), nanos(c("z")), F.coalesce("acts_end", lit(0))).alias("end_ns"),
        F.when(c("verdict") == "high", 2).otherwise(1).alias("status"))
    return level0.unionByName(level2).unionByName(level1)


def span_events(actions: DataFrame, findings_on: DataFrame, divergences: DataFrame) -> DataFrame:
    """Flags, findings and divergences as events on their spans, one row each."""
    act = lambda: hex_id(F.concat("session_id", F.lit(":act:"), F.col("seq").cast("string")), 8)
    flags = actions.filter(F.col("type") != "session").select(
        "session_id", act().alias("span_id"), F.lit("finding").alias("event"), F.explode(F.array_union("signals", "notes")).alias("value"))
    found = findings_on.select("session_id", act().alias("span_id"), F.lit("session_finding").alias("event"), F.col("combo").alias("value"))
    told = divergences.select(
        "session_id", hex_id(F.concat("session_id", F.lit(":turn:"), "prompt_id"), 8).alias("span_id"),
        F.lit("intent_divergence").alias("event"), F.concat_ws(":", "type", "kind", "value").alias("value"))
    return flags.unionByName(found).unionByName(told)


def attribute(key: str, value: Column, kind: str) -> Column:
    """One exporter attribute; null when there is no value. 64-bit integers travel as text."""
    return F.when(value.isNotNull(), F.struct(F.lit(key).alias("key"), F.struct(
        (value if kind == "string" else F.lit(None).cast("string")).alias("stringValue"),
        (value.cast("string") if kind == "int" else F.lit(None).cast("string")).alias("intValue")).alias("value")))


def otlp_lines(rows: DataFrame, service: str = "vigilog") -> DataFrame:
    """One exporter JSON document per span, ready for a text sink."""
    attrs = F.array_compact(F.array(
        attribute("session.id", F.col("session_id"), "string"), attribute("prompt_id", F.col("prompt_id"), "string")))
    span = F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_id").alias("parentSpanId"), "name",
        F.lit(1).alias("kind"), F.col("start_ns").cast("string").alias("startTimeUnixNano"),
        F.col("end_ns").cast("string").alias("endTimeUnixNano"), attrs.alias("attributes"), F.struct(F.col("status").alias("code")).alias("status"))
    resource = F.struct(F.array(F.struct(F.lit("service.name").alias("key"), F.struct(F.lit(service).alias("stringValue")).alias("value"))).alias("attributes"))
    scope = F.array(F.struct(F.struct(F.lit(service).alias("name")).alias("scope"), F.array(span).alias("spans")))
    return rows.select("session_id", F.to_json(F.struct(F.array(F.struct(
        resource.alias("resource"), scope.alias("scopeSpans"))).alias("resourceSpans"))).alias("value"))
