"""Turns: which actions belong to which prompt, and what each turn changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilog.functions import fixed_values as V
from vigilog.functions.lists import clip, one_line, one_of
from vigilog.operators.ordered import carry_last

TURN = ["session_id", "turn_id"]
HEADLESS = "#headless"


def assign_turns(actions: DataFrame) -> DataFrame:
    """Give every action the turn it belongs to.

    Prompts and tool steps with a prompt id open (or return to) that turn;
    lifecycle rows return to a turn already open; rows without a prompt id stay
    in the active turn; rows before any turn form a headless one.
    """
    lifecycle = F.col("type") == "session"
    prompt = F.col("phase") == "prompt"
    opens = prompt | ((F.col("phase") != "reasoning") & ~lifecycle & F.col("prompt_id").isNotNull())
    own = F.coalesce("prompt_id", F.when(prompt, F.concat(F.lit("#"), F.col("seq").cast("string"))))
    first_open = (
        actions.filter(opens & F.col("prompt_id").isNotNull()).groupBy("session_id", "prompt_id")
        .agg(F.min("seq").alias("_first_open"))
    )
    rows = actions.join(first_open, ["session_id", "prompt_id"], "left")
    active = F.when(opens, own).when(
        lifecycle & ~prompt & (F.col("phase") != "reasoning") & (F.col("_first_open") < F.col("seq")), F.col("prompt_id"))
    carried = carry_last(rows, ["session_id"], "seq", active, "_active")
    # A lifecycle row of a turn that nothing opened belongs to no turn.
    orphan = lifecycle & ~prompt & (F.col("phase") != "reasoning") & F.col("_first_open").isNull() & F.col("prompt_id").isNotNull()
    return carried.withColumn(
        "turn_id", F.when(orphan, None).otherwise(F.coalesce(own, "_active", F.lit(HEADLESS)))).drop("_active", "_first_open")


def story_rows(actions: DataFrame, events: DataFrame) -> DataFrame:
    """Actions with their turn, role in the story and the facts the story needs.

    Turns are assigned on the few columns they depend on, and facts are sought where there are
    any; whole actions are shuffled once, by (session_id, seq), which is unique.
    """
    own = [F.col("d.prompt").alias("prompt"), F.col("d.reasoning").alias("reasoning"), F.col("d.git").alias("git")]
    facts = events.select("session_id", "seq", *own).filter("prompt IS NOT NULL OR reasoning IS NOT NULL OR git IS NOT NULL")
    changes = events.filter(F.col("d.mutation").isNotNull()).select(
        "session_id", F.col("seq").alias("post_seq"), F.col("d.mutation").alias("mutation"))
    changes = actions.filter(F.col("post_seq").isNotNull()).select("session_id", "seq", "post_seq").join(
        changes, ["session_id", "post_seq"]).select("session_id", "seq", "mutation")
    turn = assign_turns(actions.select("session_id", "seq", "type", "phase", "prompt_id")).filter(F.col("turn_id").isNotNull())
    role = (
        F.when(F.col("phase") == "prompt", "prompt").when(F.col("phase") == "reasoning", "reasoning")
        .when(F.col("type") == "session", "lifecycle")
        .when((F.col("hook_event") == "GitRefTransaction") & F.col("git").isNotNull(), "commit").otherwise("step")
    )
    return (
        actions.join(turn.select("session_id", "seq", "turn_id"), ["session_id", "seq"])
        .join(facts, ["session_id", "seq"], "left").join(changes, ["session_id", "seq"], "left")
        .withColumn("role", role)
        .withColumn("is_subagent", F.coalesce(F.col("agent_type") != "main", F.lit(False)))
        .withColumn("risky", F.arrays_overlap("signals", one_of(V.RISK_FLAGS)))
    )


def turn_files(rows: DataFrame) -> DataFrame:
    """Files changed, per turn and per session (turn_id null), in one pass."""
    files = rows.filter((F.col("role") == "step") & F.col("mutation").isNotNull() & F.col("target").isNotNull()).select(
        "session_id", "turn_id", F.col("target").alias("path"),
        F.coalesce("mutation.diffstat.insertions", F.lit(0)).alias("i"),
        F.coalesce("mutation.diffstat.deletions", F.lit(0)).alias("d"),
        F.coalesce("post_seq", "seq").alias("seq"), (F.col("mutation.stored") == False).alias("skipped"))  # noqa: E712
    return files.groupingSets(
        [[F.col("session_id"), F.col("turn_id"), F.col("path")], [F.col("session_id"), F.col("path")]],
        F.col("session_id"), F.col("turn_id"), F.col("path"),
    ).agg(
        F.sum("i").alias("insertions"), F.sum("d").alias("deletions"), F.max("seq").alias("seq"),
        F.coalesce(F.bool_or("skipped"), F.lit(False)).alias("skipped"))


def turns(rows: DataFrame) -> DataFrame:
    """One row per turn with its metrics and title."""
    c = F.col
    step, commit = c("role") == "step", c("role") == "commit"
    first_text = F.coalesce(F.nullif("summary", F.lit("")), "target", "tool", "type")
    file = F.when(step & c("mutation").isNotNull(), c("target"))
    agg = rows.groupBy(*TURN).agg(
        F.min(F.when(c("role") != "lifecycle", c("seq"))).alias("first_seq"),
        F.min_by("ts", F.when(c("role") != "lifecycle", c("seq"))).alias("started_at"),
        F.max_by("ts", F.when(step | commit | (c("role") == "lifecycle"), c("seq"))).alias("_ended"),
        F.min_by("prompt", F.when(c("prompt").isNotNull(), c("seq"))).alias("prompt"),
        F.max_by("reasoning", F.when(c("reasoning").isNotNull(), c("seq"))).alias("reasoning"),
        F.count_if(step).alias("steps"), F.count_if(commit).alias("commits"),
        F.count_distinct(file).alias("files"), F.count_if(step & c("risky")).alias("flagged"),
        F.coalesce(F.max(F.when(step, c("score"))), F.lit(0)).alias("max_score"),
        F.min_by(first_text, F.when(step, c("seq"))).alias("_first"),
        F.min(F.when(step, c("is_subagent").cast("int"))).alias("_all_sub"),
        F.min_by(F.coalesce("git.commit.subject", "git.commit.sha", "git.ref", F.lit("recorded change")),
                 F.when(commit, c("seq"))).alias("_commit"),
    )
    kept = agg.filter(c("prompt").isNotNull() | c("reasoning").isNotNull() | (c("steps") > 0) | (c("commits") > 0))
    named = lambda text, source: F.struct(
        clip(one_line(text), V.MAX_TURN_TITLE).alias("t"), (F.lit(source) if isinstance(source, str) else source).alias("s"))
    injected = one_line(c("prompt")).rlike(V.INJECTED_BLOCK)
    tag = F.regexp_extract(one_line(c("prompt")), r"^<([a-z-]+)", 1)
    title = F.coalesce(
        F.when(c("prompt").isNotNull() & ~injected, named(c("prompt"), "captured_prompt")),
        F.when(c("reasoning").isNotNull(), named(F.concat(F.lit("Agent response · "), c("reasoning")), "assistant_explanation")),
        F.when(c("_first").isNotNull(), named(
            F.concat(F.when(c("_all_sub") == 1, "Subagent work · ").otherwise("Prompt unavailable · "), c("_first")),
            F.when(c("_all_sub") == 1, "subagent_action").otherwise("recorded_action"))),
        F.when(c("commits") > 0, named(F.concat(F.lit("Commit · "), c("_commit")), "commit")),
        named(F.when(tag == "task-notification", "Background task update").when(tag == "system-reminder", "System reminder")
              .otherwise("Local command"), "recorded_action"),
    )
    return kept.withColumn("_t", title).select(
        *TURN, "first_seq", "started_at", F.coalesce("_ended", "started_at").alias("ended_at"), "prompt", "reasoning",
        "steps", "files", "commits", "flagged", "max_score",
        F.col("_t.t").alias("title"), F.col("_t.s").alias("title_source"))


def turn_flags(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("role") == "step").select(
        *TURN, F.explode(F.array_intersect("signals", one_of(V.RISK_FLAGS))).alias("flag")
    ).groupBy(*TURN, "flag").agg(F.count(F.lit(1)).alias("steps"))


def commits(rows: DataFrame) -> DataFrame:
    g = F.col("git")
    zero = F.lit(0)
    return rows.filter(F.col("role") == "commit").select(
        *TURN, "seq", "ts", g["commit"]["sha"].alias("sha"), g["commit"]["subject"].alias("subject"), g["ref"].alias("ref"),
        g["kind"].alias("kind"), F.coalesce(g["diffstat"]["files"], zero).alias("files"),
        F.coalesce(g["diffstat"]["insertions"], zero).alias("insertions"),
        F.coalesce(g["diffstat"]["deletions"], zero).alias("deletions"),
        F.coalesce(g["is_force"], F.lit(False)).alias("force"))


def session_counts(rows: DataFrame, files: DataFrame, turn_rows: DataFrame) -> DataFrame:
    t = turn_rows.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("turns"), F.sum("steps").alias("steps"), F.sum("commits").alias("commits"))
    f = files.filter(F.col("turn_id").isNull()).groupBy("session_id").agg(F.count(F.lit(1)).alias("files"))
    return t.join(f, "session_id", "left").withColumn("files", F.coalesce("files", F.lit(0).cast("bigint")))


def findings_per_turn(rows: DataFrame, seqs: DataFrame) -> DataFrame:
    """Distinct findings whose supporting events touch a step of the turn."""
    touched = rows.filter(F.col("role") == "step").select(*TURN, F.explode(F.array_compact(F.array("seq", "post_seq"))).alias("seq"))
    return touched.join(seqs, ["session_id", "seq"]).groupBy(*TURN).agg(F.count_distinct("combo").alias("findings"))


def evidence_rows(rows: DataFrame, files: DataFrame, hosts: DataFrame) -> DataFrame:
    """Flagged steps, files, commits and hosts of every turn."""
    c = F.col
    text = lambda x: x.cast("string")
    step = rows.filter((c("role") == "step") & ((c("outcome") == "failed") | (c("score") > 0) | (F.size("signals") > 0))).select(
        *TURN, F.lit("RECORD").alias("kind"), F.concat(F.coalesce("tool", "type"), F.lit(" · "), one_line(c("summary"))).alias("label"),
        F.coalesce("post_seq", "seq").alias("seq"), F.lit(True).alias("danger"))
    file = files.filter(c("turn_id").isNotNull()).select(
        *TURN, F.lit("FILE").alias("kind"), c("path").alias("label"), "seq", F.lit(False).alias("danger"))
    git = commits(rows).select(
        *TURN, F.lit("GIT").alias("kind"), F.coalesce("subject", "kind", F.lit("Git change")).alias("label"), "seq", c("force").alias("danger"))
    owner = rows.filter(c("role") == "step").select(*TURN, F.explode(F.array_compact(F.array("seq", "post_seq"))).alias("seq"))
    host = hosts.join(owner, ["session_id", "seq"]).select(
        *TURN, F.lit("HOST").alias("kind"), c("host").alias("label"), "seq", F.lit(True).alias("danger"))
    return step.unionByName(file).unionByName(git).unionByName(host)


def turn_filter(turn_rows: DataFrame, evidence: DataFrame, per_turn: DataFrame) -> DataFrame:
    """Turns with `is_flagged` and `has_evidence` marks."""
    seen = evidence.select(*TURN).distinct().withColumn("has_evidence", F.lit(True))
    return turn_rows.join(seen, TURN, "left").join(per_turn, TURN, "left").select(
        *TURN, F.coalesce("has_evidence", F.lit(False)).alias("has_evidence"),
        ((F.col("flagged") > 0) | (F.col("max_score") > 0) | (F.coalesce("findings", F.lit(0)) > 0)).alias("is_flagged"))


def subagent_parents(events: DataFrame) -> DataFrame:
    """Subagent events linked to the call that spawned them."""
    parents = events.filter(F.col("phase") == "pre").groupBy("session_id", F.col("tool_use_id").alias("parent")).agg(
        F.min("seq").alias("parent_seq"))
    return events.filter(F.col("d.parent_tool_use_id").isNotNull()).select(
        "session_id", "seq", F.col("d.parent_tool_use_id").alias("parent")).join(parents, ["session_id", "parent"], "left")
