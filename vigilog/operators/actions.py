"""Pre/Post pairing, action outcomes, causal findings and event dossiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vigilog.functions import fixed_values as V
from vigilog.functions.lists import one_of
from vigilog.functions.wording import action_summary, note_for_outcome, shell_danger_kinds, summary_for_outcome
from vigilog.operators.ordered import carry_last, previous_row, seq_bucket

KEY = ["session_id", "seq"]
PRE, POSTS = "PreToolUse", ["PostToolUse", "PostToolUseFailure"]


def event_outcome(phase: Column, success: Column) -> Column:
    return (
        F.when(phase == "failure", "failed")
        .when(phase == "post", F.when(success == 0, "failed").otherwise("succeeded"))
        .when(phase == "pre", "attempted")
        .when(success == 0, "failed").when(success == 1, "succeeded").otherwise("unknown")
    )


def tool_outcomes(events: DataFrame) -> DataFrame:
    """Outcome of every tool-use group. Arrival order does not matter."""
    state = event_outcome(F.col("phase"), F.col("success"))
    seen = lambda cond: F.max(cond.cast("int")) == 1
    won, lost, begun = seen(state == "succeeded"), seen(state == "failed"), seen(F.col("phase") == "pre")
    return events.filter(F.col("tool_use_id").isNotNull()).groupBy("session_id", "tool_use_id").agg(
        F.when(won & lost, "unknown").when(lost, "failed").when(won, "succeeded")
        .when(begun, "attempted").otherwise("unknown").alias("outcome")
    )


def with_outcome(events: DataFrame) -> DataFrame:
    own = event_outcome(F.col("phase"), F.col("success"))
    grouped = events.join(
        tool_outcomes(events).withColumnRenamed("outcome", "_group"), ["session_id", "tool_use_id"], "left")
    return grouped.withColumn("outcome", F.coalesce("_group", own)).drop("_group")


def first_terminals(events: DataFrame) -> DataFrame:
    """Earliest Post or Failure after each Pre of the same tool use."""
    calls = events.filter(F.col("tool_use_id").isNotNull() & F.col("phase").isin("pre", "post", "failure"))
    terminal = F.when(F.col("phase") != "pre", F.struct(F.col("seq").alias("post_seq"), F.col("phase").alias("post_phase")))
    # The next terminal is the last one seen when the group is read backwards.
    backwards = calls.select("session_id", "tool_use_id", "seq", "phase", (-F.col("seq")).alias("back"))
    found = carry_last(backwards, ["session_id", "tool_use_id"], "back", terminal, "p", include_current=False)
    return found.filter((F.col("phase") == "pre") & F.col("p").isNotNull()).select(
        "session_id", "tool_use_id", F.col("seq").alias("pre_seq"), "p.*")


def split_flags(risk: DataFrame, fired: DataFrame) -> DataFrame:
    """Visible signals and muted notes of each scored event.

    Annotations become signals where a combo cites the event; risk flags and the
    always-shown annotations are signals everywhere.
    """
    cited = (
        fired.select("session_id", "ruleset", F.explode(F.array("antecedent_seq", "consequent_seq")).alias("seq"))
        .distinct().withColumn("cited", F.lit(True))
    )
    shown = one_of(V.RISK_FLAGS + V.ALWAYS_SHOWN_ANNOTATIONS)
    return risk.join(cited, ["session_id", "ruleset", "seq"], "left").select(
        "session_id", "seq", "ruleset", "score", "flags",
        F.when(F.col("cited"), F.col("flags")).otherwise(F.array_intersect("flags", shown)).alias("signals"),
        F.when(F.col("cited"), F.array_except("flags", F.col("flags")))
        .otherwise(F.array_except("flags", shown)).alias("notes"),
    )


def paired_posts(events: DataFrame) -> DataFrame:
    """Posts whose immediate predecessor in their tool-use group is an open Pre."""
    calls = events.filter(F.col("tool_use_id").isNotNull() & F.col("hook_event").isin(PRE, *POSTS)).select(
        "session_id", "tool_use_id", "seq", "hook_event", "phase", "success", "duration_ms", "redaction_count")
    before = previous_row(calls, ["session_id", "tool_use_id"], "seq", F.struct("seq", "hook_event"), "before")
    return before.filter(F.col("hook_event").isin(POSTS) & (F.col("before.hook_event") == PRE)).select(
        "session_id", F.col("before.seq").alias("pre_seq"), F.col("seq").alias("post_seq"),
        F.col("phase").alias("post_phase"), F.col("success").alias("post_success"),
        F.col("duration_ms").alias("post_duration"), F.col("redaction_count").alias("post_redactions"))


def pair_actions(events: DataFrame, flags: DataFrame) -> DataFrame:
    """One row per action: a Pre with its Post folded in, or a standalone event.

    `flags` is the output of split_flags for one ruleset; it joins on (session_id,
    seq), which is unique. Only the few columns that pairing reads meet by tool use, where
    windows give the call before and after each row and the group's outcome; rows without an
    id have no group. Whole rows are shuffled once, by (session_id, seq), where all that was
    found joins them.
    """
    none = F.expr("array()").cast("array<string>")
    c = F.col
    state = event_outcome(c("phase"), c("success"))
    call = c("hook_event").isin(PRE, *POSTS)
    told = F.when(call, F.struct("seq", "hook_event", "phase", "success", "duration_ms", "redaction_count"))
    group = W.partitionBy("session_id", "tool_use_id")
    # Both look at rows already met, in either direction, so that a long group stays linear.
    forwards, backwards = (group.orderBy(o).rowsBetween(W.unboundedPreceding, -1) for o in ("seq", F.desc("seq")))
    seen = lambda cond: F.max(cond.cast("int")).over(group) == 1
    won, lost, begun = seen(state == "succeeded"), seen(state == "failed"), seen(c("phase") == "pre")
    tied = events.filter(c("tool_use_id").isNotNull()).select(
        *KEY, "tool_use_id", "hook_event", "phase", "success", "duration_ms", "redaction_count").withColumns({
            "_before": F.last(F.when(call, c("hook_event")), True).over(forwards), "_next": F.last(told, True).over(backwards),
            "_group": F.when(won & lost, "unknown").when(lost, "failed").when(won, "succeeded").when(begun, "attempted").otherwise("unknown")})
    folded = c("hook_event").isin(POSTS) & (F.coalesce("_before", F.lit("")) == PRE)
    post = F.when((c("hook_event") == PRE) & c("_next.hook_event").isin(POSTS), c("_next"))
    # A folded Post leaves, and its flags go to the Pre that it follows.
    tied = tied.select(*KEY, "_group", folded.alias("_folded"), post.alias("_post"))
    marks = ["score", "signals", "notes"]
    own = flags.select(*KEY, *marks)
    later = tied.filter(c("_post").isNotNull()).select("session_id", c("_post.seq").alias("_at"), c("seq").alias("_pre")).join(
        own.withColumnRenamed("seq", "_at"), ["session_id", "_at"]).select("session_id", c("_pre").alias("seq"), F.struct(*marks).alias("_marks"))
    joined = events.join(tied, KEY, "left").filter(~F.coalesce("_folded", F.lit(False))).join(own, KEY, "left").join(later, KEY, "left").withColumn(
        "outcome", F.coalesce("_group", state))
    paired = c("_post").isNotNull()
    merged = lambda a, b: F.array_union(F.coalesce(a, none), F.coalesce(b, none))
    opens = (F.col("hook_event") == PRE) & F.col("tool_use_id").isNotNull()
    summary = action_summary(F.col("action_type"), F.col("target"), F.col("tool_name"), F.col("d.description"))
    return joined.select(
        "session_id", "seq", c("_post.seq").alias("post_seq"), "ts", "hook_event", F.col("action_type").alias("type"),
        F.col("tool_name").alias("tool"), "target", "tool_use_id", "prompt_id", "agent_type", "source",
        F.coalesce("_post.phase", "phase").alias("phase"),
        F.when(paired, c("_post.success")).when(opens, None).otherwise(F.col("success")).alias("success"),
        F.when(paired, c("_post.duration_ms")).when(opens, None).otherwise(F.col("duration_ms")).alias("duration_ms"),
        "outcome", summary_for_outcome(summary, F.col("outcome")).alias("summary"),
        (F.col("redaction_count") + F.coalesce("_post.redaction_count", F.lit(0))).alias("redaction_count"),
        F.greatest(F.coalesce("score", F.lit(0)), F.coalesce("_marks.score", F.lit(0))).alias("score"),
        merged(F.col("signals"), c("_marks.signals")).alias("signals"),
        merged(F.col("notes"), c("_marks.notes")).alias("notes"),
    )


def action_counts(events: DataFrame) -> DataFrame:
    """Actions per session: a pair counts once, lifecycle rows not at all."""
    acting = events.filter(F.col("action_type") != "session")
    totals = acting.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    folded = paired_posts(acting).groupBy("session_id").agg(F.count(F.lit(1)).alias("p"))
    return totals.join(folded, "session_id", "left").select(
        "session_id", (F.col("n") - F.coalesce("p", F.lit(0))).alias("actions"))


# ---- findings ---------------------------------------------------------------

def finding_seqs(events: DataFrame, fired: DataFrame) -> DataFrame:
    """Child table: every event that supports a fired combo."""
    name = ["session_id", "ruleset", "combo"]
    cited = fired.select(*name, F.explode(F.array("antecedent_seq", "consequent_seq")).alias("seq"))
    groups = fired.join(
        events.select("session_id", F.col("seq").alias("consequent_seq"), "tool_use_id")
        .filter(F.col("tool_use_id").isNotNull()),
        ["session_id", "consequent_seq"]).select(*name, "tool_use_id")
    terminal = F.col("phase").isin("post", "failure") | ((F.col("phase") != "pre") & F.col("success").isNotNull())
    ends = events.filter(terminal & F.col("tool_use_id").isNotNull()).select("session_id", "tool_use_id", "seq")
    return cited.unionByName(groups.join(ends, ["session_id", "tool_use_id"]).select(*name, "seq")).distinct()


def seq_digest(rows: DataFrame, keys: list[str], width: int = 4096) -> DataFrame:
    """Count, range and list text of the distinct seqs of each key, in one form for all sizes.

    The list is put together from sorted stretches of positions. A key names one finding, so its
    rows are the events of a tool call or of a combo.
    """
    inner = rows.groupBy(*keys, seq_bucket(F.col("seq"), width).alias("_b")).agg(
        F.array_sort(F.collect_set("seq")).alias("_seqs"))
    parts = inner.select(
        *keys, F.size("_seqs").cast("bigint").alias("_n"), F.array_min("_seqs").alias("_lo"),
        F.array_max("_seqs").alias("_hi"), F.struct("_b", F.array_join(F.col("_seqs").cast("array<string>"), ",").alias("t")).alias("_part"))
    return parts.groupBy(*keys).agg(
        F.sum("_n").alias("seq_count"), F.min("_lo").alias("first_seq"), F.max("_hi").alias("last_seq"),
        F.array_sort(F.collect_list("_part")).alias("_parts"),
    ).select(
        *keys, "seq_count", "first_seq", "last_seq",
        F.concat(F.lit("["), F.array_join(F.transform("_parts", lambda p: p["t"]), ","), F.lit("]")).alias("seq_text"),
    )


def findings(events: DataFrame, fired: DataFrame) -> DataFrame:
    """Fired combos with the outcome of their consequent action."""
    consequent = with_outcome(events).select(
        "session_id", F.col("seq").alias("consequent_seq"), "outcome", "target")
    host = F.nullif(F.regexp_extract(F.coalesce("target", F.lit("")), r"(?i)https?://([a-z0-9.-]+)", 1), F.lit(""))
    return fired.join(consequent, ["session_id", "consequent_seq"], "left").select(
        "session_id", "ruleset", "combo", "severity", "antecedent_seq", "consequent_seq", "note", "server",
        F.coalesce("host", host).alias("host"), F.coalesce("outcome", F.lit("unknown")).alias("outcome"), "target",
        note_for_outcome(F.col("note"), F.coalesce("outcome", F.lit("unknown"))).alias("display_note"),
    )


# ---- mutation view and dossier ----------------------------------------------

def mutation_views(events: DataFrame, blobs: DataFrame) -> DataFrame:
    """Recorded mutations with their stored body: available, pruned or skipped."""
    facts = events.filter(F.col("d.mutation").isNotNull()).select(
        "session_id", "seq", "target", F.col("d.mutation").alias("m"))
    bodies = blobs.select("content_hash", "content", "pruned_at")
    stored = F.coalesce(F.col("m.stored"), F.lit(True))
    return facts.withColumn("content_hash", F.col("m.content_hash")).join(bodies, "content_hash", "left").select(
        "session_id", "seq", "target", F.col("m.kind").alias("kind"), F.col("m.bytes").alias("bytes"),
        F.col("m.diffstat").alias("diffstat"), "content_hash", F.coalesce("m.redacted", F.lit(False)).alias("redacted"),
        F.when(~stored, "skipped").when(F.col("content").isNotNull(), "available").otherwise("pruned").alias("status"),
        F.col("m.skip_reason").alias("skip_reason"), F.when(stored, F.col("content")).alias("content"),
        F.when(stored, F.col("pruned_at")).alias("pruned_at"),
    )


def dossiers(events: DataFrame, risk: DataFrame, fired_seqs: DataFrame, views: DataFrame) -> DataFrame:
    """Everything known about each event, for one ruleset."""
    posts = first_terminals(events).select("session_id", F.col("pre_seq").alias("seq"), F.col("post_seq").alias("_post"))
    shown = views.select("session_id", F.col("seq").alias("_mut"), "kind", "status", "content")
    cited = fired_seqs.groupBy("session_id", "seq").agg(F.array_sort(F.collect_set("combo")).alias("findings"))
    return (
        with_outcome(events).join(posts, KEY, "left")
        .withColumn("_mut", F.when(F.col("d.mutation").isNotNull(), F.col("seq")).otherwise(F.col("_post")))
        .join(shown, ["session_id", "_mut"], "left")
        .join(risk.select("session_id", "seq", "score", "flags"), KEY, "left")
        .join(cited, KEY, "left").drop("_mut", "_post")
    )


def danger_notes(risk: DataFrame, events: DataFrame) -> DataFrame:
    """What was risky about each flagged event, and why, as rows."""
    shell = F.create_map(*[F.lit(x) if isinstance(x, str) else F.struct(F.lit(x[0]).alias("what"), F.lit(x[1]).alias("why"))
                           for kv in V.SHELL_DANGER_NOTES.items() for x in kv])
    by_flag = F.array(*[F.struct(F.lit(f).alias("flag"), F.lit(w).alias("what"), F.lit(y).alias("why"))
                        for f, w, y in V.DANGER_NOTES])
    rows = risk.join(events.select("session_id", "seq", "target"), KEY)
    plain = F.transform(F.filter(by_flag, lambda n: F.array_contains("flags", n["flag"])),
                        lambda n: F.struct(n["what"].alias("what"), n["why"].alias("why")))
    risky = F.when(
        F.array_contains("flags", "dangerous-shell"),
        F.transform(shell_danger_kinds(F.col("target")), lambda k: F.element_at(shell, k)),
    ).otherwise(F.expr("array()").cast("array<struct<what:string,why:string>>"))
    return rows.select("session_id", "seq", F.explode(F.concat(risky, plain)).alias("d")).select("session_id", "seq", "d.*")
