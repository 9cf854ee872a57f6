"""Queries over stored tables, recorder rows, receipts, policies, titles and telemetry, each read back from lines or files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from vigilog.operators import gitrefs, reconcile
from vigilog.plans import bridges as B
from vigilog.plans import table_queries  # noqa: F401  defines the token blocks
from vigilog.plans.oracle import CTES
from vigilog.plans.registry import query
from vigilog.plans.source_queries import transcript_lines
from vigilog.session import shared_folder
from vigilog.sources import files as R
from vigilog.sources import hooks as H
from vigilog.sources import tables as T

c = F.col


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def text(*parts) -> F.Column:
    return F.concat(*[p.cast("string") if isinstance(p, F.Column) else F.lit(p) for p in parts])


# ---- receipts and policies --------------------------------------------------

@query("receipt_rows", "A11", """
    SELECT event_id AS seq, 'h' || user_id AS head_hash, 'k' || (event_id % 3) AS pubkey_fp FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0""")
def receipt_rows(spark, sf_dir):
    n = c("event_id")
    body = text('{"v":', F.when(n % 7 == 0, 2).otherwise(1), F.when(n % 13 == 0, "").otherwise(text(',"seq":', n)), ',"head_hash":"h', c("user_id"),
                '","sig":"s","pubkey_fp":"k', n % 3, '","signed_at":"2024-01-01T00:00:00Z"}')
    lines = B.table(spark, sf_dir, "events").select(F.when(n % 11 == 0, F.substring(body, 1, 9)).otherwise(body).alias("value"))
    return R.receipts(lines).select("seq", "head_hash", "pubkey_fp")


# A customer's policy breaks one rule, by its number; every eighth and the rest are valid.
_POLICY_KINDS = {0: "unsupported version", 1: "unknown field", 2: "invalid entry", 3: "duplicate id", 4: "invalid JSON", 5: "unknown entry field"}


@query("policy_documents", "A12", """
    SELECT 'c' || c_custkey AS name, CASE c_custkey % 9 WHEN 0 THEN 'unsupported version' WHEN 1 THEN 'unknown field' WHEN 2 THEN 'invalid entry' WHEN 3 THEN 'duplicate id'
      WHEN 4 THEN 'invalid JSON' WHEN 5 THEN 'unknown entry field' WHEN 6 THEN 'invalid entry' END AS error, CASE WHEN c_custkey % 9 > 6 THEN 2 END AS entries FROM customer""")
def policy_documents(spark, sf_dir):
    k = c("c_custkey") % 9
    entry = lambda name, more: text('{"id":"', name, '","reason":"', F.when(k == 6, F.repeat(F.lit("r"), 1001)).otherwise("known"), '","hosts":["h', c("c_custkey"), '"]', more, "}")
    second = F.when(k == 3, "a").when(k == 2, "not allowed").otherwise("b")
    body = text('{"version":', F.when(k == 0, 2).otherwise(1), F.when(k == 1, ',"note":1').otherwise(""), ',"expected":[', entry(F.lit("a"), F.when(k == 5, ',"z":1').otherwise("")),
                ",", entry(second, ""), "]", F.when(k == 4, "").otherwise("}"))
    lines = B.table(spark, sf_dir, "customer").select(text("c", c("c_custkey")).alias("name"), body.alias("value"))
    return R.policies(lines).select("name", "error", F.when(c("error").isNull(), F.size("entries")).alias("entries"))


# ---- tables -----------------------------------------------------------------

CTES["layer_rows"] = """
  SELECT 'r' || r AS ruleset, 'o' || o_orderkey AS session_id, o_custkey % 3 AS v, o_orderkey AS k FROM orders, (SELECT unnest([1, 2]) AS r)"""


@query("layer_round_trip", "A14 A15", """
    SELECT ruleset, session_id, CASE WHEN ruleset = 'r2' AND k % 10 = 0 THEN 'new' ELSE 'v' || v END AS verdict FROM layer_rows
    WHERE NOT (ruleset = 'r1' AND k % 7 = 0)""")
def layer_round_trip(spark, sf_dir):
    """Write two rulesets, score some sessions again, delete others, read the layer back."""
    at, k = folder(spark, "verdict-layer"), c("o_orderkey")
    rows = B.table(spark, sf_dir, "orders").select(
        F.explode(F.array(F.lit("r1"), F.lit("r2"))).alias("ruleset"), text("o", k).alias("session_id"), text("v", c("o_custkey") % 3).alias("verdict"), k)
    T.upsert_layer(rows.drop("o_orderkey"), at)
    T.upsert_layer(rows.filter((k % 10 == 0) & (c("ruleset") == "r2")).select("ruleset", "session_id", F.lit("new").alias("verdict")), at)
    T.delete_from_layer(rows.filter((k % 7 == 0) & (c("ruleset") == "r1")).select("ruleset", "session_id"), at)
    return spark.read.parquet(at).select("ruleset", "session_id", "verdict")


@query("stored_events", "A13", """
    SELECT strftime(ts, '%Y-%m-%d') AS ingest_date, count(*) AS events, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1""")
def stored_events(spark, sf_dir):
    """Events appended in two batches and read back by ingest date."""
    at = folder(spark, "events")
    rows = B.table(spark, sf_dir, "events").select(text("u", c("user_id")).alias("session_id"), "event_id", F.date_format("ts", B.ISO).alias("captured_at"))
    for part in (0, 1):
        T.append_events(rows.filter(c("event_id") % 2 == part), at)
    return T.read_events(spark, at).groupBy(c("ingest_date").cast("string").alias("ingest_date")).agg(
        F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("stored_bodies", "A13", "SELECT sha256(text) AS content_hash, CAST(strlen(any_value(text)) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def stored_bodies(spark, sf_dir):
    """Each body is stored once by its hash, also when a later batch brings it again."""
    at = folder(spark, "bodies")
    rows = B.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("bigint").alias("bytes"))
    T.append_bodies(rows.filter("doc_id % 2 = 0").drop("doc_id"), at)
    T.append_bodies(rows.drop("doc_id"), at, spark.read.schema("content_hash string, bytes bigint").parquet(at))
    return spark.read.parquet(at)


# ---- recorder rows ----------------------------------------------------------

@query("recorder_downtime", "F12 B16 J8", """
    SELECT strftime(ts - INTERVAL 90 SECOND, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(extract('millisecond' FROM ts) % 1000 AS VARCHAR), 3, '0') || 'Z' AS "from",
      strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(extract('millisecond' FROM ts) % 1000 AS VARCHAR), 3, '0') || 'Z' AS "to", event_id % 200 = 0 AS clean
    FROM events WHERE event_id % 100 <> 50""")
def recorder_downtime(spark, sf_dir):
    """Start rows of the recorder, built as events, and the windows that they tell."""
    n, iso = c("event_id"), lambda t: F.date_format(t, B.ISO)
    fact = F.struct(F.when(n % 100 != 50, iso(c("ts") - F.expr("INTERVAL 90 SECONDS"))).alias("downtime_from"), (n % 200 == 0).alias("clean"))
    facts = B.table(spark, sf_dir, "events").select(F.lit("recorder").alias("session_id"), iso(c("ts")).alias("ts"), fact.alias("fact"))
    rows = H.fact_rows(facts, "DaemonStart", "lifecycle", "daemon")
    parsed = rows.withColumn("d", F.from_json("detail", "daemon struct<downtime_from:string,clean:boolean>"))
    return reconcile.recorder_gaps(parsed)


@query("first_snapshots", "F13 J6", """
    SELECT 'u' || user_id AS session_id, min(event_id) AS seq, arg_min(event_type, event_id) AS kind FROM events GROUP BY 1""")
def first_snapshots(spark, sf_dir):
    """One snapshot per session: the first position wins, whatever arrives later."""
    rows = B.table(spark, sf_dir, "events").select(
        text("u", c("user_id")).alias("session_id"), F.lit("EnvSnapshot").alias("hook_event"), c("event_id").alias("seq"), c("event_type").alias("kind"))
    return H.first_fact(rows, ["session_id"], "EnvSnapshot", "seq").select("session_id", "seq", "kind")


# ---- telemetry, labels, titles ----------------------------------------------

@query("telemetry_union", "A10", """
    SELECT event_id AS pid, 'process' AS kind, 'p' || (event_id % 5) AS name, NULL AS endpoint FROM events
    UNION ALL SELECT event_id, 'connection', NULL, 'h' || (event_id % 3) FROM events WHERE event_id % 5 = 0""")
def telemetry_union(spark, sf_dir):
    e = B.table(spark, sf_dir, "events").select(c("event_id").alias("pid"), "ts")
    started = e.select("pid", "ts", F.lit("process").alias("kind"), text("p", c("pid") % 5).alias("name"))
    opened = e.filter("pid % 5 = 0").select("pid", "ts", F.lit("connection").alias("kind"), text("h", c("pid") % 3).alias("endpoint"))
    return R.merged_telemetry(started, opened).select("pid", "kind", "name", "endpoint")


@query("ref_labels", "I29", """
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'create' ELSE 'commit' END || ' refs/heads/b' || (o_custkey % 4) || ' ' ||
      CASE WHEN o_orderkey % 5 = 0 THEN '∅' ELSE substr(sha256('o' || o_orderkey), 1, 7) END || '→' || substr(sha256('n' || o_orderkey), 1, 7) AS label FROM orders""")
def ref_labels(spark, sf_dir):
    k = c("o_orderkey")
    sha = lambda mark: F.substring(F.sha2(text(mark, k), 256), 1, 40)
    new = k % 5 == 0
    return B.table(spark, sf_dir, "orders").select(k.alias("id"), gitrefs.ref_target(
        F.when(new, "create").otherwise("commit"), text("refs/heads/b", c("o_custkey") % 4), F.when(new, "0" * 40).otherwise(sha("o")), sha("n")).alias("label"))


@query("transcript_titles", "B21", """
    SELECT CAST(conv_id AS VARCHAR) AS session_id, arg_max('custom ' || turn, turn) FILTER (turn % 3 = 0) AS custom_title,
      arg_max('made ' || turn, turn) FILTER (turn % 3 = 1) AS ai_title FROM conversations GROUP BY 1""")
def transcript_titles(spark, sf_dir):
    t = c("turn")
    line = F.when(t % 3 == 0, text('{"type":"custom-title","customTitle":"custom ', t, '"}')).when(t % 3 == 1, text('{"type":"ai-title","aiTitle":"made ', t, '"}')).otherwise("{broken")
    lines = B.table(spark, sf_dir, "conversations").select(c("conv_id").cast("string").alias("session_id"), t.alias("line"), line.alias("value"))
    return R.transcript_titles(R.transcript(lines))


@query("recovered_turns", "N23", """
    SELECT CAST(conv_id AS VARCHAR) AS session_id, prompt_id AS turn_id, CASE WHEN turn % 2 = 0 THEN 'kept' ELSE trim(said) END AS prompt, turn % 2 = 1 AND trim(said) <> '' AS recovered
    FROM (SELECT conv_id, prompt_id, min(turn) AS turn, arg_min(text, turn) FILTER (role = 'user') AS said FROM talk WHERE prompt_id IS NOT NULL AND role <> 'system' GROUP BY 1, 2)""")
def recovered_turns(spark, sf_dir):
    """Recorded turns, half of them without their prompt, filled from the transcript."""
    turns = R.transcript_turns(R.transcript(transcript_lines(spark, sf_dir)))
    number = F.substring("prompt_id", 2, 20).cast("bigint")
    recorded = turns.select("session_id", c("prompt_id").alias("turn_id"), F.when(number % 2 == 0, "kept").alias("prompt"))
    return R.recover_turns(recorded, turns).select("session_id", "turn_id", "prompt", "recovered")


# ---- streams ----------------------------------------------------------------

def streamed(rows: DataFrame, build, name: str) -> DataFrame:
    """What a stream makes of stored rows that arrive in several files, some files at a time."""
    spark = rows.sparkSession
    source, sink, marks = (folder(spark, f"{name}-{x}") for x in ("in", "out", "marks"))
    # Three triggers over about as many files as a shuffle has partitions, six at least.
    files = 3 * max(2, int(spark.conf.get("spark.sql.shuffle.partitions")) // 3)
    rows.repartition(files).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files // 3).parquet(source)
    # State with maps and timers needs the store that keeps them on disk; the session gets its own setting back.
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        build(stream, sink).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.parquet(sink)


@query("live_verdicts", "J1", "SELECT session_id, ruleset, verdict, score, combos, last_scored_seq FROM verdicts")
def live_verdicts(spark, sf_dir):
    """Stored events are scored at once, the others as they arrive, in any order; the last word of both is the batch's verdict."""
    from vigilog.operators import scoring as S
    from vigilog.plans.activity_queries import ALL, Activity
    from vigilog.streaming import scoring as L
    events = Activity(spark, sf_dir).events
    old, new = events.filter(c("ts") < "2024-01-11"), events.filter(c("ts") >= "2024-01-11")
    facts = S.event_facts(old)
    stored_ = S.verdicts(old, S.flag_rows(facts, ALL), S.combos(facts, ALL), ALL).withColumn("version", F.lit(0).cast("bigint"))
    told = streamed(new, lambda s, sink: L.live_verdicts(s, ALL, old).writeStream.format("parquet").option("path", sink), "verdicts")
    last = F.max_by(F.struct("verdict", "score", "combos", "last_scored_seq"), "version").alias("v")
    return stored_.unionByName(told).groupBy("session_id", "ruleset").agg(last).select("session_id", "ruleset", "v.*")


@query("live_token_index", "J5 N5", "SELECT kind, id, pos, term FROM tokens")
def live_token_index(spark, sf_dir):
    """The index built as texts arrive is the index built at once."""
    from vigilog.operators.search import token_index
    texts = B.texts(spark, sf_dir).select("kind", "id", "text")
    return streamed(texts, lambda s, sink: token_index(s, ["kind", "id"]).select("kind", "id", "pos", "term").writeStream.format("parquet").option("path", sink), "index")


@query("live_first_facts", "J6", "SELECT DISTINCT 'u' || user_id AS session_id, event_type FROM events")
def live_first_facts(spark, sf_dir):
    """One fact per session and kind, however often and late it arrives."""
    from vigilog.streaming.live import first_facts
    rows = B.table(spark, sf_dir, "events").select(text("u", c("user_id")).alias("session_id"), "event_type", c("ts").alias("at"))
    return streamed(rows, lambda s, sink: first_facts(s, ["session_id", "event_type"]).select("session_id", "event_type").writeStream.format("parquet").option("path", sink), "facts")


@query("live_boundaries", "J9", "SELECT session_id, seq, 'h' || event_id AS head_hash FROM activity WHERE phase IN ('session_start', 'stop', 'session_end')")
def live_boundaries(spark, sf_dir):
    """The head at every boundary of every session, several in one micro-batch included."""
    from vigilog.plans.activity_queries import Activity
    from vigilog.streaming.live import write_boundaries
    rows = Activity(spark, sf_dir).events.select("session_id", "seq", "phase", text("h", c("event_id")).alias("hash"))
    return streamed(rows, lambda s, sink: s.writeStream.foreachBatch(write_boundaries(sink)), "heads").select("session_id", "seq", "head_hash")
