"""Read the driver's tables as agent activity, chains, diffs, turns and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigilog.functions.lists import one_of
from vigilog.operators.ordered import row_index
from vigilog.plans import templates as K

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), index)


def actions_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per `events` row with its session, position and template number."""
    e = table(spark, sf_dir, "events")
    session = F.concat(F.lit("u"), F.col("user_id"), F.lit("-d"),
                       F.floor((F.dayofmonth("ts") - 1) / 3).cast("int"))
    rows = e.select(
        session.alias("session_id"), "event_id", "user_id", "event_type", "value", F.col("ts").alias("at"),
        (F.get_json_object("props", "$.k").cast("int") % 40).alias("k"),
    )
    return row_index(rows, ["session_id"], F.date_trunc("minute", "at"), ["at", "event_id"], "rn")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events: a Pre row per action and, unless it never completed, its terminal row."""
    c, lit = F.col, F.lit
    k, eid = c("k"), c("event_id")
    single = k.isin(K.SINGLE_ROW)
    base = actions_base(spark, sf_dir).withColumn("single", single)
    terminal = F.when(single | (c("event_type") == "signup"), F.array(lit(0))).otherwise(F.array(lit(0), lit(1)))
    rows = base.withColumn("half", F.explode(terminal))
    failed = (c("event_type") == "error") & (c("half") == 1)
    post = c("half") == 1
    single_phase = (
        F.when(k == 16, "post").when(k == 17, "prompt").when(k == 18, "reasoning")
        .when(k == 19, "session_start").when(k == 36, "session_end").when(k == 37, "stop")
    )
    single_hook = (
        F.when(k == 16, "GitRefTransaction").when(k == 17, "UserPromptSubmit").when(k == 18, "ReasoningCapture")
        .when(k == 19, "SessionStart").when(k == 36, "SessionEnd").when(k == 37, "Stop")
    )
    phase = F.when(single, single_phase).otherwise(
        F.when(failed, "failure").when(post, "post").otherwise("pre"))
    hook = F.when(single, single_hook).otherwise(
        F.when(failed, "PostToolUseFailure").when(post, "PostToolUse").otherwise("PreToolUse"))
    subagent = eid % 17 == 0
    insertions, deletions = (F.floor("value") % 40).cast("int"), (eid % 7).cast("int")
    mutated = post & ~failed & k.isin(K.MUTATING)
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else lit(p) for p in parts])
    markers = F.when(post & (k == 10), one_of(["ignore-instructions", "disregard"])).when(
        post & (k == 11), one_of(["ignore-instructions"])).when(post & (k == 38), one_of(["you-are-now"]))
    redaction = (
        F.when(post & (k == 1), F.array(F.struct(lit("path-sensitive-content").alias("type"),
                                                 lit("tool_response.file.content").alias("path"), lit(64).alias("bytes"))))
        .when((k == 14) & (eid % 3 == 0), F.array(F.struct(lit("assigned-secret").alias("type"),
                                                           lit("tool_input.command").alias("path"), lit(12).alias("bytes"))))
    )
    git = F.when(k == 16, F.struct(
        lit("refs/heads/main").alias("ref"), text("old-", eid.cast("string")).alias("old_sha"),
        text("new-", eid.cast("string")).alias("new_sha"),
        F.when(eid % 4 == 0, "force").when(eid % 4 == 1, "reset").otherwise("commit").alias("kind"),
        (eid % 4).isin(0, 1).alias("is_force"), (eid % 4 == 1).alias("is_reset"), lit(False).alias("is_delete"),
        F.struct((eid % 40).cast("int").alias("files"), (eid * 7 % 2000).cast("int").alias("insertions"),
                 (eid * 13 % 900).cast("int").alias("deletions")).alias("diffstat"),
        F.when(eid % 5 != 0, F.struct(
            F.substring(F.sha2(eid.cast("string"), 256), 1, 40).alias("sha"),
            text("fix ", (eid % 50).cast("string")).alias("subject"))).alias("commit"),
    ))
    detail = F.struct(
        redaction.alias("redaction"),
        F.when(markers.isNotNull(), F.struct(markers.alias("injection"))).alias("output_signals"),
        F.when(~single & (eid % 23 == 0), text("Step ", (eid % 9).cast("string"))).alias("description"),
        F.when(k == 17, F.when(eid % 9 == 0, "<system-reminder> keep going").otherwise(
            text("Please review item ", (eid % 100).cast("string"), " in the build"))).alias("prompt"),
        F.when(k == 18, _pick(K.NARRATIVES, (eid % 4).cast("int"))).alias("reasoning"),
        F.when(mutated, F.struct(
            F.when(k.isin(9, 33), "body").otherwise("patch").alias("kind"),
            text("sha256:", F.sha2(text("body-", (eid % 97).cast("string")), 256)).alias("content_hash"),
            (eid % 97 * 10).cast("bigint").alias("bytes"),
            F.struct(lit(1).alias("files"), insertions.alias("insertions"), deletions.alias("deletions")).alias("diffstat"),
            (eid % 11 != 0).alias("stored"), F.when(eid % 11 == 0, "oversize").alias("skip_reason"),
            (eid % 13 == 0).alias("redacted"),
            F.when(k == 13, one_of(["tls-verify-disabled"])).alias("weakens"),
        )).alias("mutation"),
        F.when(k.isin(19, 36), F.struct(
            F.substring(F.sha2(text("base-", c("session_id"), (eid % 3).cast("string")), 256), 1, 40).alias("head_sha"),
            F.when(eid % 4 == 0, lit(None)).when(eid % 2 == 0, "dev").otherwise("main").alias("branch"),
            F.when(eid % 4 == 0, "not-a-repo").alias("reason"))).alias("anchor"),
        git.alias("git"),
    )
    return rows.select(
        "session_id", (2 * c("rn") - 1 + c("half")).cast("bigint").alias("seq"), eid.cast("string").alias("event_id"),
        F.when(~single, text("t", eid.cast("string"))).alias("tool_use_id"),
        F.when(~k.isin(16, 19, 36), text(c("session_id"), "-t", F.floor((c("rn") - 1) / 5).cast("string"))).alias("prompt_id"),
        phase.alias("phase"), hook.alias("hook_event"),
        _pick([t[1] for t in K.TEMPLATES], k).alias("tool_name"),
        _pick([t[0] for t in K.TEMPLATES], k).alias("action_type"),
        _pick([t[2] for t in K.TEMPLATES], k).alias("target"),
        F.when(subagent, text("ag", (c("user_id") % 5).cast("string"))).alias("agent_id"),
        F.when(k == 16, "git").when(k == 18, "recorder").when(c("event_type") == "view", "gemini-cli")
        .when(c("event_type") == "purchase", "codex-cli").otherwise("claude-code").alias("source"),
        F.when(subagent, "explorer").otherwise("main").alias("agent_type"),
        F.when(eid % 10 != 0, text("/repo/p", (c("user_id") % 25).cast("string"))).alias("cwd"),
        F.when(phase == "post", 1).when(phase == "failure", 0).alias("success"),
        F.when(post, F.floor(c("value") * 10).cast("bigint")).alias("duration_ms"),
        F.date_format(c("at"), ISO).alias("ts"),
        F.when(redaction.isNotNull(), 1).otherwise(0).alias("redaction_count"),
        detail.alias("d"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, page and conversation turn as (kind, id, text)."""
    s = lambda *cols: F.concat_ws("-", *[F.col(c).cast("string") for c in cols])
    return (
        table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), s("doc_id").alias("id"), "text")
        .unionByName(table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), s("page_id").alias("id"), F.col("html").alias("text")))
        .unionByName(table(spark, sf_dir, "conversations").select(F.lit("turn").alias("kind"), s("conv_id", "turn").alias("id"), "text"))
    )


CHAIN_COLUMNS = ["seq", "session_id", "event_type"]


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recorded chain over `events`, with some rows altered and some deleted."""
    from vigilog.operators.custody import with_row_hash

    rows = table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("seq"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"),
        "event_type", F.date_format("ts", ISO).alias("ts"))
    hashed = with_row_hash(rows, CHAIN_COLUMNS, "hash")
    before = hashed.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("prev_hash"))
    linked = hashed.join(before, "seq", "left").withColumn("prev_hash", F.coalesce("prev_hash", F.lit("sha256:" + "0" * 64)))
    return linked.filter((F.col("seq") - 1) % 1499 != 1498).withColumn(
        "event_type", F.when(F.col("seq") % 997 == 0, "altered").otherwise(F.col("event_type")))


def commit_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Commits from orders (parent = the customer's previous order) and numstat from lineitem."""
    from pyspark.sql import Window as W

    sha = lambda c: F.substring(F.sha2(c.cast("string"), 256), 1, 40)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    order = W.partitionBy("o_custkey").orderBy("o_orderkey")
    commits = o.withColumn("p", F.lag("o_orderkey").over(order)).select(
        sha(F.col("o_orderkey")).alias("sha"), F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("n"),
        F.when(F.col("p").isNotNull(), F.array(sha(F.col("p")))).otherwise(F.expr("array()").cast("array<string>")).alias("parents"))
    scale = F.when(F.col("l_orderkey") % 50 == 0, 200).otherwise(1)
    stats = table(spark, sf_dir, "lineitem").select(
        sha(F.col("l_orderkey")).alias("sha"), F.concat(F.lit("src/p"), (F.col("l_partkey") % 50).cast("string"), F.lit(".ts")).alias("path"),
        F.when(F.col("l_partkey") % 29 == 0, "-").otherwise((F.col("l_quantity").cast("bigint") * 5).cast("string")).alias("added"),
        (F.col("l_linenumber") * scale).cast("string").alias("removed"))
    return commits, stats


def worktrees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Recorded mutations, end-of-session delta and start baseline, one session per order."""
    path = F.concat(F.lit("src/p"), (F.col("l_partkey") % 50).cast("string"), F.lit(".ts"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey"), path.alias("path")).agg(
        F.min("l_linenumber").alias("n"), F.min(F.col("l_suppkey") % 7).alias("s"), F.min(F.col("l_partkey") % 11).alias("p"),
        F.min(F.col("l_partkey") % 13).alias("b"))
    session = F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))
    body = F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("-", F.col("l_orderkey").cast("string"), "path"), 256))
    disk = F.when(F.col("n") == 3, F.concat(F.lit("sha256:"), F.sha2(F.lit("changed"), 256))).otherwise(body)
    mutations = rows.filter("s <> 0").select(
        session.alias("session_id"), F.concat(F.lit("/repo/"), "path").alias("target"), F.col("n").cast("bigint").alias("seq"),
        F.lit("body").alias("kind"), body.alias("content_hash"), (F.col("n") != 5).alias("stored"), (F.col("n") == 6).alias("redacted"))
    delta = rows.filter("p <> 0").select(session.alias("session_id"), "path", F.lit("M").alias("status"), disk.alias("sha256"))
    base = rows.filter("b = 0").select(session.alias("session_id"), "path", body.alias("sha256"))
    return mutations, delta, base


def recorder_windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Transcript tool uses, recorded uses, and windows in which the recorder was down."""
    e = table(spark, sf_dir, "events")
    uses = e.select(F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("tool_use_id"),
                    F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), F.col("ts").alias("at"))
    captured = e.filter(F.col("event_id") % 17 != 0).select(F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("tool_use_id"))
    day = F.date_trunc("day", "ts")
    gaps = e.filter(F.dayofmonth("ts") % 5 == 0).select(day.alias("from_at")).distinct().withColumn(
        "to_at", F.col("from_at") + F.expr("interval 2 hours"))
    return uses, captured, gaps
