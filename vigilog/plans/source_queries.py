"""Queries over raw lines that Spark derives from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vigilog.sources import files as R
from vigilog.sources import hooks as H
from vigilog.plans import bridges as B
from vigilog.plans.activity_queries import Activity
from vigilog.plans.oracle import CTES
from vigilog.plans.registry import query

NOW = "2024-03-01T00:00:00.000Z"


def _input():
    t, a = F.col("target"), F.col("action_type")
    obj = lambda key: F.to_json(F.struct(t.alias(key)))
    return (
        F.when(t.isNull(), "{}").when(a.startswith("file_"), obj("file_path")).when(a.isin("shell_command", "git_action"), obj("command"))
        .when(a == "web_fetch", F.when(t.startswith("http"), obj("url")).otherwise(obj("query"))).otherwise(t)
    )


def calls(spark, sf_dir) -> DataFrame:
    return Activity(spark, sf_dir).events.filter(~F.col("hook_event").isin("GitRefTransaction", "ReasoningCapture"))


def _line(hook, tool, extra: dict) -> F.Column:
    body = F.to_json(F.struct(hook.alias("hook_event_name"), "session_id", tool.alias("tool_name"), *[v.alias(k) for k, v in extra.items()]))
    return F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(',"tool_input":'), _input(), F.lit("}"))


def hook_lines(spark, sf_dir) -> DataFrame:
    c = F.col
    return calls(spark, sf_dir).select("event_id", _line(c("hook_event"), c("tool_name"), {
        "tool_use_id": c("tool_use_id"), "prompt_id": c("prompt_id"), "agent_id": c("agent_id"), "cwd": c("cwd"), "duration_ms": c("duration_ms"),
        "_captured_at": c("ts"), "prompt": c("d.prompt"), "tool_response": F.when(c("phase") == "post", F.struct(c("target").alias("stdout")))}).alias("value"))


@query("normalised_hooks", "A1 A5 B1 B2 B3 B4 B5 B6 B7 B8 B12 H1", """
    SELECT session_id, coalesce(tool_use_id, '') AS tool_use_id, prompt_id, phase, hook_event, tool_name,
      action_type, target, CASE WHEN agent_id IS NOT NULL THEN 'unknown' ELSE 'main' END AS agent_type, success, duration_ms, ts, cwd
    FROM activity WHERE hook_event NOT IN ('GitRefTransaction', 'ReasoningCapture')""")
def normalised_hooks(spark, sf_dir):
    rows = H.normalise(H.first_vendor(H.good(H.parse(hook_lines(spark, sf_dir)))), NOW)
    return rows.select("session_id", F.coalesce("tool_use_id", F.lit("")).alias("tool_use_id"), "prompt_id", "phase", "hook_event", "tool_name",
                       "action_type", "target", "agent_type", "success", "duration_ms", "ts", "cwd")


@query("output_commitments", "B9 B10 I9", """
    SELECT session_id, tool_use_id, 'sha256:' || sha256(o) AS output_hash, CAST(strlen(o) AS BIGINT) AS output_size_bytes FROM (
      SELECT *, CASE WHEN target IS NULL THEN '{}' ELSE '{"stdout":"' || replace(replace(target, '\\', '\\\\'), '"', '\\"') || '"}' END AS o
      FROM activity WHERE phase = 'post' AND hook_event <> 'GitRefTransaction')""")
def output_commitments(spark, sf_dir):
    rows = H.normalise(H.first_vendor(H.good(H.parse(hook_lines(spark, sf_dir)))), NOW)
    return rows.filter("output_hash IS NOT NULL").select("session_id", "tool_use_id", "output_hash", "output_size_bytes")


@query("ingest_summary", "A1 I30", """
    SELECT result, count(*) AS lines FROM (SELECT CASE WHEN CAST(event_id AS BIGINT) % 19 = 0 THEN NULL WHEN CAST(event_id AS BIGINT) % 13 = 0 THEN 'not-json'
      WHEN CAST(event_id AS BIGINT) % 17 = 0 THEN 'not-an-object' ELSE 'ingested' END AS result FROM activity
      WHERE hook_event NOT IN ('GitRefTransaction', 'ReasoningCapture')) WHERE result IS NOT NULL GROUP BY 1""")
def ingest_summary(spark, sf_dir):
    n = F.col("event_id").cast("bigint")
    damaged = F.when(n % 19 == 0, "  ").when(n % 13 == 0, F.substring("value", 1, 20)).when(
        n % 17 == 0, F.concat(F.lit("["), "value", F.lit("]"))).otherwise(F.col("value"))
    return H.ingest_summary(H.parse(hook_lines(spark, sf_dir).select(damaged.alias("value"))))


_BACK = {"Bash": "run_shell_command", "Read": "read_file", "Write": "write_file", "Edit": "replace", "WebFetch": "web_fetch",
         "WebSearch": "google_web_search", "Grep": "grep_search"}


@query("second_vendor_hooks", "A3", """
    SELECT session_id, seq_, phase, hook_event, tool_name, action_type, target, source FROM (SELECT session_id, event_id AS seq_, phase, hook_event, tool_name,
      action_type, target, 'gemini-cli' AS source FROM activity WHERE hook_event IN ('PreToolUse', 'PostToolUse', 'PostToolUseFailure'))""")
def second_vendor_hooks(spark, sf_dir):
    c = F.col
    from vigilog.functions.lists import lookup
    tool = F.coalesce(lookup(_BACK, c("tool_name")), F.regexp_replace("tool_name", "^mcp__([^_]+)__(.+)$", "mcp_$1_$2"))
    rows = calls(spark, sf_dir).filter(c("tool_use_id").isNotNull())
    hook = F.when(c("phase") == "pre", "BeforeTool").otherwise("AfterTool")
    lines = rows.select(_line(hook, tool, {"timestamp": c("ts"), "agent_id": c("event_id"), "tool_response": F.when(
        c("phase") == "failure", F.struct(F.lit("boom").alias("error")))}).alias("value"))
    out = H.normalise(H.gemini(H.good(H.parse(lines))), NOW)
    return out.select("session_id", c("agent_id").alias("seq_"), "phase", "hook_event", "tool_name", "action_type", "target", "source")


@query("third_vendor_outcomes", "A4", """
    SELECT session_id, event_id AS seq_, CASE WHEN s = 0 THEN 'failure' ELSE 'post' END AS phase, s AS success FROM (SELECT *, CASE CAST(event_id AS BIGINT) % 6
      WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 0 WHEN 4 THEN 0 END AS s FROM activity WHERE hook_event IN ('PostToolUse', 'PostToolUseFailure'))""")
def third_vendor_outcomes(spark, sf_dir):
    c = F.col
    n = c("event_id").cast("bigint") % 6
    response = F.struct(
        F.when(n == 0, True).alias("success"), F.when(n == 1, True).alias("isError"), F.when(n == 2, 0).when(n == 3, 2).alias("exit_code"),
        F.when(n == 4, "Cancelled").alias("status"))
    rows = calls(spark, sf_dir).filter(c("hook_event").isin("PostToolUse", "PostToolUseFailure"))
    lines = rows.select(_line(F.lit("PostToolUse"), F.lit("apply_patch"), {
        "agent_id": c("event_id"), "turn_id": c("prompt_id"), "tool_response": response}).alias("value"))
    out = H.normalise(H.codex(H.good(H.parse(lines))), NOW)
    return out.select("session_id", c("agent_id").alias("seq_"), "phase", "success")


# Some calls lose their Before; seconds run so fast that some Befores expire.
CTES["keyless"] = """
  SELECT *, row_number() OVER (PARTITION BY session_id, tool_name, input ORDER BY seq) AS n FROM (
    SELECT session_id, tool_name, coalesce(target, '') AS input, seq, 700 * seq AS at, phase = 'pre' AS opens FROM activity
    WHERE hook_event IN ('PreToolUse', 'PostToolUse', 'PostToolUseFailure') AND NOT (phase = 'pre' AND seq % 5 = 0))"""


@query("paired_without_ids", "D2", """
    WITH RECURSIVE w AS (
      SELECT DISTINCT session_id, tool_name, input, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS q, CAST(NULL AS BIGINT) AS after_pos, CAST(NULL AS BIGINT) AS before_pos FROM keyless
      UNION ALL
      SELECT session_id, tool_name, input, n, CASE WHEN opens THEN list_append(live, seq) ELSE live[2:] END, CASE WHEN NOT opens THEN seq END, CASE WHEN NOT opens THEN live[1] END
      FROM (SELECT w.session_id, w.tool_name, w.input, e.n, e.opens, e.seq, list_filter(w.q, lambda p: 700 * p >= e.at - 1800) AS live
        FROM w JOIN keyless e ON e.session_id = w.session_id AND e.tool_name = w.tool_name AND e.input = w.input AND e.n = w.n + 1))
    SELECT session_id, after_pos, before_pos FROM w WHERE after_pos IS NOT NULL""")
def paired_without_ids(spark, sf_dir):
    rows = calls(spark, sf_dir).filter(F.col("hook_event").isin("PreToolUse", "PostToolUse", "PostToolUseFailure"))
    e = rows.filter(~((F.col("phase") == "pre") & (F.col("seq") % 5 == 0))).select(
        "session_id", "tool_name", F.coalesce("target", F.lit("")).alias("input"), F.when(F.col("phase") == "pre", "before").otherwise("after").alias("stage"),
        (700 * F.col("seq")).cast("double").alias("at"), F.col("seq").alias("pos"))
    return H.pair_without_ids(e).select("session_id", "after_pos", "before_pos")


@query("ref_lines", "A6", """
    SELECT user_id AS batch, event_id AS pos, 'refs/heads/b' || (event_id % 9) AS ref
    FROM events WHERE event_id % 4 <> 1 AND event_id % 7 <> 3""")
def ref_lines(spark, sf_dir):
    n = F.col("event_id")
    sha = F.substring(F.sha2(n.cast("string"), 256), 1, 40)
    old = F.when(n % 4 == 1, "--output=/etc").otherwise(sha)
    ref = F.when(n % 7 == 3, "refs/stash").otherwise(F.concat(F.lit("refs/heads/b"), (n % 9).cast("string")))
    lines = B.table(spark, sf_dir, "events").select(F.col("user_id").alias("batch"), n.alias("pos"), F.concat_ws(" ", old, sha, ref).alias("value"))
    return R.ref_lines(lines).select("batch", "pos", "ref")


def transcript_lines(spark, sf_dir) -> DataFrame:
    """Conversations as transcript records: a user row opens a prompt, assistants answer and call a tool."""
    c = F.col
    t = B.table(spark, sf_dir, "conversations")
    call = F.concat(F.lit("c"), c("conv_id").cast("string"), F.lit("-"), c("turn").cast("string"))
    block = lambda **f: F.struct(*[v.alias(k) for k, v in f.items()])
    user = F.to_json(F.struct(F.lit("user").alias("type"), F.concat(F.lit("p"), c("turn").cast("string")).alias("promptId"),
                              F.struct(F.array(block(type=F.lit("text"), text=c("text")), block(type=F.lit("tool_result"), text=F.lit(None).cast("string"))).alias("content")).alias("message")))
    agent = F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(
        F.concat(F.lit("m"), (c("turn") % 3).cast("string")).alias("model"), F.struct(F.length("text").alias("input_tokens"), c("turn").alias("output_tokens")).alias("usage"),
        F.array(F.struct(F.lit("text").alias("type"), c("text").alias("text"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name")),
                F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), call.alias("id"), F.lit("Bash").alias("name"))).alias("content")).alias("message")))
    result = F.to_json(F.struct(F.lit("user").alias("type"), F.struct(F.array(F.struct(F.lit("tool_result").alias("type"), call.alias("tool_use_id"))).alias("content")).alias("message")))
    lines = F.when(c("role") == "user", F.array(user)).when(c("role") == "assistant", F.when(
        c("turn") % 4 != 1, F.array(agent, result)).otherwise(F.array(agent))).otherwise(F.array(F.lit("{broken")))
    return t.select(c("conv_id").cast("string").alias("session_id"), c("turn"), F.posexplode(lines).alias("i", "value")).select(
        "session_id", (c("turn") * 2 + c("i")).alias("line"), "value")


CTES["talk"] = """
  SELECT *, last_value(CASE WHEN role = 'user' THEN 'p' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prompt_id
  FROM conversations"""


@query("transcript_turns", "A8 F8 E12 N23", """
    SELECT CAST(conv_id AS VARCHAR) AS session_id, prompt_id, count_if(role = 'assistant') AS assistant_messages,
      CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS input_tokens,
      CAST(sum(CASE WHEN role = 'assistant' THEN turn ELSE 0 END) AS BIGINT) AS output_tokens,
      'm' || (max(CASE WHEN role = 'assistant' THEN turn END) % 3) AS model
    FROM talk WHERE prompt_id IS NOT NULL AND role <> 'system' GROUP BY 1, 2""")
def transcript_turns(spark, sf_dir):
    return R.transcript_turns(R.transcript(transcript_lines(spark, sf_dir))).select(
        "session_id", "prompt_id", "assistant_messages", "input_tokens", "output_tokens", "model")


@query("completed_tool_uses", "N22", """
    SELECT CAST(conv_id AS VARCHAR) AS session_id, 'c' || conv_id || '-' || turn AS tool_use_id FROM conversations WHERE role = 'assistant' AND turn % 4 <> 1""")
def completed_tool_uses(spark, sf_dir):
    return R.completed_tool_uses(R.transcript(transcript_lines(spark, sf_dir))).select("session_id", "tool_use_id")


@query("worktree_delta", "A7", """
    SELECT session_id, path, 'M' AS status, insertions, deletions FROM (SELECT 'o' || l_orderkey AS session_id, 'src/p' || (l_partkey % 50) || '.ts' AS path,
      CAST(max(CASE WHEN l_partkey % 29 = 0 THEN 0 ELSE CAST(l_quantity AS INT) * 5 END) AS INT) AS insertions, CAST(max(l_linenumber) AS INT) AS deletions FROM lineitem GROUP BY 1, 2)
    UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'new/s' || (l_suppkey % 7) || '.md', '?', 0, 0 FROM lineitem WHERE l_suppkey % 3 = 0""")
def worktree_delta(spark, sf_dir):
    c = F.col
    path = F.concat(F.lit("src/p"), (c("l_partkey") % 50).cast("string"), F.lit(".ts"))
    t = B.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), c("l_orderkey").cast("string")).alias("session_id"), path.alias("path"),
        F.when(c("l_partkey") % 29 == 0, "-").otherwise((c("l_quantity").cast("int") * 5).cast("string")).alias("a"), c("l_linenumber").cast("string").alias("r"))
    status = t.select("session_id", F.concat_ws("\t", F.lit("M"), "path").alias("value")).distinct()
    counts = t.select("session_id", F.concat_ws("\t", "a", "r", "path").alias("value"))
    loose = B.table(spark, sf_dir, "lineitem").filter("l_suppkey % 3 = 0").select(
        F.concat(F.lit("o"), c("l_orderkey").cast("string")).alias("session_id"), F.concat(F.lit("new/s"), (c("l_suppkey") % 7).cast("string"), F.lit(".md")).alias("value"))
    return R.worktree_delta(status, counts, loose).select("session_id", "path", "status", "insertions", "deletions")


@query("environment_servers", "A9", """
    SELECT session_id, 'srv' || u || ' (npx)' AS server FROM (SELECT DISTINCT 'u' || user_id AS session_id, user_id % 7 AS u FROM events)""")
def environment_servers(spark, sf_dir):
    u = (F.col("user_id") % 7).cast("string")
    configs = B.table(spark, sf_dir, "events").select("user_id").distinct().select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"),
        F.create_map(F.concat(F.lit("srv"), u), F.lit("/usr/local/bin/npx --token abc")).alias("servers"))
    return R.environment_servers(configs)


@query("process_connections", "A10 D28 F18", """
    WITH RECURSIVE tree(pid) AS (SELECT CAST(0 AS BIGINT) UNION SELECT e.event_id FROM tree t JOIN events e ON e.event_id > 0 AND (e.event_id - 1) // 50 = t.pid)
    SELECT pid, 'h' || (pid % 3) AS endpoint, 'ESTABLISHED' AS state FROM tree WHERE pid % 5 = 0""")
def process_connections(spark, sf_dir):
    e = B.table(spark, sf_dir, "events").select(F.col("event_id").alias("pid"), "ts")
    processes = e.filter("pid > 0").select("pid", F.floor((F.col("pid") - 1) / 50).cast("bigint").alias("ppid"))
    links = e.filter("pid % 5 = 0").select("pid", F.concat(F.lit("h"), (F.col("pid") % 3).cast("string")).alias("endpoint"), F.lit("ESTABLISHED").alias("state"), "ts")
    return R.owned_connections(links, R.process_tree(processes, e.filter("pid = 0"))).select("pid", "endpoint", "state")
