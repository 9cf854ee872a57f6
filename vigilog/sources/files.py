"""Ref lines, worktree listings, transcripts, environments, telemetry, receipts, policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vigilog.functions import fixed_values as V
from vigilog.functions.hashing import sha256_text


def ref_lines(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """`old new ref` lines of a batch (batch, pos, value), cleaned; all of them unless a limit per batch is asked for."""
    from pyspark.sql import Window as W

    parts = F.split(F.trim("value"), r"\s+")
    ref = F.array_join(F.slice(parts, F.lit(3), F.size(parts)), " ")
    rows = lines.withColumn("parts", parts).filter(F.size("parts") >= 3).select(
        "batch", "pos", F.get("parts", F.lit(0)).alias("old_sha"), F.get("parts", F.lit(1)).alias("new_sha"), ref.alias("ref"))
    both_zero = F.col("old_sha").rlike(V.ZERO_OBJECT) & F.col("new_sha").rlike(V.ZERO_OBJECT)
    noise = F.col("ref").rlike("^(AUTO_MERGE|ORIG_HEAD)$") | F.col("ref").startswith("refs/stash") | F.col("ref").startswith("refs/recorder/")
    clean = rows.filter(F.col("old_sha").rlike(V.OBJECT_NAME) & F.col("new_sha").rlike(V.OBJECT_NAME) & ~noise & ~both_zero)
    if limit is None:
        return clean
    # A rank filter keeps at most `limit` rows per batch before the shuffle.
    return clean.withColumn("n", F.row_number().over(W.partitionBy("batch").orderBy("pos"))).filter(F.col("n") <= limit).drop("n")


def worktree_delta(name_status: DataFrame, numstat: DataFrame, untracked: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per changed path from three listings of (session_id, value) lines; a limit per session is marked in `truncated`."""
    from pyspark.sql import Window as W

    cells = F.split("value", "\t")
    last = F.try_element_at(cells, F.lit(-1))
    tracked = name_status.filter(F.trim("value") != "").groupBy("session_id", last.alias("path")).agg(
        F.max(F.substring(F.get(cells, F.lit(0)), 1, 1)).alias("status"))
    number = lambda i: F.coalesce(F.get(cells, F.lit(i)).try_cast("int"), F.lit(0))
    counts = numstat.filter(F.trim("value") != "").groupBy("session_id", last.alias("path")).agg(
        F.max(number(0)).alias("insertions"), F.max(number(1)).alias("deletions"))
    loose = untracked.filter(F.trim("value") != "").select("session_id", F.col("value").alias("path")).distinct().withColumn("_new", F.lit("?"))
    zero = F.lit(0)
    rows = tracked.join(loose, ["session_id", "path"], "full").join(counts, ["session_id", "path"], "left").select(
        "session_id", "path", F.coalesce("status", "_new").alias("status"), F.coalesce("insertions", zero).alias("insertions"),
        F.coalesce("deletions", zero).alias("deletions"))
    if limit is None:
        return rows.withColumn("truncated", F.lit(False))
    sizes = rows.groupBy("session_id").agg((F.count(F.lit(1)) > limit).alias("truncated"))
    order = W.partitionBy("session_id").orderBy(F.col("status") == "?", "path")
    return rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit).drop("n").join(sizes, "session_id")


# ---- transcripts ------------------------------------------------------------

BLOCK = "array<struct<type:string,text:string,thinking:string,id:string,name:string,tool_use_id:string>>"
RECORD = (
    "type string, promptId string, timestamp string, customTitle string, aiTitle string, message struct<model:string,stop_reason:string,"
    f"usage:struct<{','.join(k + ':bigint' for k in V.USAGE_KEYS)}>,content:string>")


def transcript(lines: DataFrame) -> DataFrame:
    """Parsed transcript records of (session_id, line, value); malformed lines are skipped."""
    row = F.from_json("value", RECORD)
    parsed = lines.withColumn("r", row).filter(F.col("r").isNotNull()).select("session_id", "line", "r.*")
    raw = F.col("message.content")
    blocks = F.when(raw.startswith("["), F.from_json(raw, BLOCK)).otherwise(
        F.array(F.from_json(F.to_json(F.struct(F.lit("text").alias("type"), raw.alias("text"))), BLOCK[6:-1])))
    return parsed.withColumn("blocks", blocks)


def with_prompt(records: DataFrame) -> DataFrame:
    """Give assistant records the prompt id of the user record before them."""
    from vigilog.operators.ordered import carry_last

    own = F.when(F.col("type") == "user", F.col("promptId"))
    return carry_last(records, ["session_id"], "line", own, "_p").withColumn("prompt_id", F.coalesce("promptId", "_p")).drop("_p")


def transcript_turns(records: DataFrame) -> DataFrame:
    """Prompt, model, usage and message count of each turn."""
    rows = with_prompt(records).filter(F.col("prompt_id").isNotNull())
    said = F.array_join(F.transform(F.filter("blocks", lambda b: (b["type"] == "text") & (F.trim(b["text"]) != "")), lambda b: F.trim(b["text"])), "\n\n")
    user, agent = F.col("type") == "user", F.col("type") == "assistant"
    usage = [F.coalesce(F.sum(F.when(agent, F.col(f"message.usage.{k}"))), F.lit(0)).alias(k) for k in V.USAGE_KEYS]
    return rows.withColumn("said", said).groupBy("session_id", "prompt_id").agg(
        F.min_by(F.when(user & (F.col("said") != ""), F.col("said")), F.when(user & (F.col("said") != ""), F.col("line"))).alias("prompt"),
        F.max_by("message.model", F.when(agent & F.col("message.model").isNotNull(), F.col("line"))).alias("model"),
        F.max_by("message.stop_reason", F.when(agent & F.col("message.stop_reason").isNotNull(), F.col("line"))).alias("stop_reason"),
        F.count_if(agent).alias("assistant_messages"), *usage)


def completed_tool_uses(records: DataFrame) -> DataFrame:
    """Tool calls of the transcript that have a result; server-side tools do not count."""
    blocks = records.select("session_id", "type", "timestamp", F.explode("blocks").alias("b"))
    uses = blocks.filter((F.col("type") == "assistant") & (F.col("b.type") == "tool_use") & F.col("b.id").isNotNull()).select(
        "session_id", F.col("b.id").alias("tool_use_id"), F.col("b.name").alias("name"), F.col("timestamp").alias("ts"))
    done = blocks.filter((F.col("type") == "user") & (F.col("b.type") == "tool_result")).select("session_id", F.col("b.tool_use_id").alias("tool_use_id")).distinct()
    return uses.dropDuplicates(["session_id", "tool_use_id"]).join(done, ["session_id", "tool_use_id"], "left_semi")


def recover_turns(turns: DataFrame, recovered: DataFrame) -> DataFrame:
    """Fill gaps of recorded turns from the transcript; recorded facts win."""
    found = recovered.select("session_id", F.col("prompt_id").alias("turn_id"), F.col("prompt").alias("_prompt"), "model", "assistant_messages")
    return turns.join(found, ["session_id", "turn_id"], "left").withColumn(
        "recovered", F.col("prompt").isNull() & F.col("_prompt").isNotNull()).withColumn("prompt", F.coalesce("prompt", "_prompt")).drop("_prompt")


def transcript_titles(records: DataFrame) -> DataFrame:
    return records.groupBy("session_id").agg(
        F.max_by("customTitle", F.when(F.col("customTitle").isNotNull(), F.col("line"))).alias("custom_title"),
        F.max_by("aiTitle", F.when(F.col("aiTitle").isNotNull(), F.col("line"))).alias("ai_title"))


# ---- small sources ----------------------------------------------------------

def environment_servers(configs: DataFrame) -> DataFrame:
    """MCP servers of (session_id, servers map<name, command>): name and bare program only."""
    word = lambda command: F.element_at(F.split(F.element_at(F.split(F.trim(command), r"\s+"), 1), r"[/\\]"), -1)
    return configs.select("session_id", F.explode("servers").alias("name", "command")).select(
        "session_id", F.concat("name", F.lit(" ("), word(F.col("command")), F.lit(")")).alias("server"))


def hooks_hash(configs: DataFrame) -> DataFrame:
    return configs.select("session_id", sha256_text(F.col("hooks")).alias("hooks_hash"))


def merged_telemetry(*collectors: DataFrame) -> DataFrame:
    out = collectors[0]
    for df in collectors[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.orderBy("ts")


def process_tree(processes: DataFrame, roots: DataFrame) -> DataFrame:
    """Every process below the roots. A process has one parent, so each round is one join."""
    from vigilog.session import cut_lineage

    links = processes.groupBy("pid").agg(F.min("ppid").alias("ppid"))
    front = seen = cut_lineage(roots.select("pid").distinct())
    while True:
        front = cut_lineage(links.join(front.withColumnRenamed("pid", "ppid"), "ppid").select("pid").join(seen, "pid", "left_anti"))
        if front.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(front))
    return seen


def owned_connections(connections: DataFrame, tree: DataFrame) -> DataFrame:
    """Connections of the process tree, first sight of each endpoint and state."""
    return connections.join(tree, "pid", "left_semi").groupBy("pid", "endpoint", "state").agg(F.min("ts").alias("first_seen"))


RECEIPT = "v int, seq bigint, head_hash string, sig string, pubkey_fp string, signed_at string"


def receipts(lines: DataFrame) -> DataFrame:
    return lines.select(F.from_json("value", RECEIPT).alias("r")).select("r.*").filter((F.col("v") == 1) & F.col("seq").isNotNull())


ENTRY = "struct<id:string,reason:string," + ",".join(f"{s}:array<string>" for s in V.POLICY_SELECTORS) + ">"


def policies(lines: DataFrame) -> DataFrame:
    """Policy documents of (name, value) with `error` set when any rule is broken.

    A document is valid as a whole or not at all.
    """
    p = F.from_json("value", f"version int, expected array<{ENTRY}>")
    keys = F.json_object_keys("value")
    entry_text = F.from_json(F.get_json_object("value", "$.expected"), "array<string>")
    known = F.array(*[F.lit(k) for k in ["id", "reason", *V.POLICY_SELECTORS]])
    rows = lines.select("name", "value", p.alias("p"), keys.alias("keys"), entry_text.alias("texts"))
    e = F.col("p.expected")
    sels = lambda x: F.array(*[x[s] for s in V.POLICY_SELECTORS])
    bad_list = lambda a: a.isNotNull() & ((F.size(a) == 0) | (F.size(a) > V.POLICY_MAX_PATTERNS) | F.exists(
        a, lambda t: t.isNull() | (F.trim(t) == "") | (F.length(t) > V.POLICY_PATTERN_CHARS)))
    bad_entry = lambda x: (
        x["id"].isNull() | ~x["id"].rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,79}$") | (F.coalesce(F.trim(x["reason"]), F.lit("")) == "")
        | (F.length(F.trim(x["reason"])) > V.POLICY_REASON_CHARS)
        | F.exists(sels(x), bad_list) | ~F.exists(sels(x), lambda a: a.isNotNull()))
    error = (
        F.when(F.col("p").isNull() | F.col("keys").isNull(), "invalid JSON")
        .when(F.size(F.array_except("keys", F.array(F.lit("version"), F.lit("expected")))) > 0, "unknown field")
        .when(F.coalesce(F.col("p.version"), F.lit(0)) != 1, "unsupported version").when(e.isNull(), "expected must be an array")
        .when(F.size(e) > V.POLICY_MAX_ENTRIES, "too many entries")
        .when(F.exists("texts", lambda t: F.size(F.array_except(F.json_object_keys(t), known)) > 0), "unknown entry field")
        .when(F.exists(e, bad_entry), "invalid entry")
        .when(F.size(F.array_distinct(F.transform(e, lambda x: x["id"]))) != F.size(e), "duplicate id"))
    return rows.select("name", error.alias("error"), F.when(error.isNull(), e).alias("entries"))


def policy_entries(parsed: DataFrame) -> DataFrame:
    return parsed.filter("error IS NULL").select("name", F.explode("entries").alias("e")).select("name", "e.*")
