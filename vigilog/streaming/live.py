"""Streaming forms: live ingest, scoring, correlation, joins, indexing, checkpoints."""

from __future__ import annotations

import json
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from vigilog.functions import fixed_values as V
from vigilog.operators.scoring import event_facts
from vigilog.operators.search import searchable, token_index
from vigilog.sources import hooks


def split_live(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good payloads (an oversize body as a marker event) and rejected lines."""
    parsed = hooks.parse(lines)
    return hooks.good(parsed), parsed.filter("reject IS NOT NULL").select("value", "reject")


def write_live(lines: DataFrame, ingest_time: str | None, events_folder: str, rejects_folder: str, checkpoint: str, vendor=hooks.first_vendor):
    """Write normalised events of one vendor and rejects; a bad line never fails the stream.

    Each micro-batch has a folder of its own, by its number, and a retried one
    replaces it. The ingest time is that of the micro-batch unless one is given.
    """
    def batch(df: DataFrame, epoch: int) -> None:
        now = ingest_time or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.000Z")
        lines = df.persist()
        rows, bad = split_live(lines)
        hooks.normalise(vendor(rows), now).write.mode("overwrite").parquet(f"{events_folder}/epoch={epoch}")
        bad.write.mode("overwrite").parquet(f"{rejects_folder}/epoch={epoch}")
        lines.unpersist()

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


# ---- incremental scoring ----------------------------------------------------

FIRED = "session_id string, combo string, severity string, antecedent_seq bigint, consequent_seq bigint"


def _fire(state: dict, row) -> list[tuple]:
    """Fold one event's facts into a session's state; return the combos it fires."""
    seq, out = int(row.seq), []

    def fire(combo: str, severity: str, ante: int) -> None:
        if combo not in state["fired"]:
            state["fired"].append(combo)
            out.append((combo, severity, ante, seq))

    if row.secret_touch and state["touch"] is None:
        state["touch"] = seq
    touch, arm = state["touch"], state["arm"]
    if row.via is not None:
        if row.secret is not None:
            fire("exfil-chain", "high", touch if touch is not None and touch < seq else seq)
        elif touch is not None and 0 < seq - touch <= V.COMBO_WINDOW and row.via in V.PUSH_SENDS:
            fire("exfil-chain", "medium", touch)
    if row.arms:
        state["arm"] = seq
    elif arm is not None and 0 < seq - arm <= V.COMBO_WINDOW:
        if row.strong_auth_path:
            fire("injected-tamper", "medium" if row.test_path else "high", arm)
        for seen, combo in ((row.weak, "injected-tamper"), (row.via is not None, "injected-exfil"),
                            (row.shell, "injected-rce"), (row.ci_path, "injected-ci-write")):
            if seen:
                fire(combo, "high", arm)
    if row.server is not None:
        first = state["servers"].setdefault(row.server, seq)
        if first < seq and row.outbound_path is not None and row.outbound_path in state["reads"]:
            fire("tool-poisoning", "high", first)
    if row.tamper:
        fire("anti-forensics", "high", seq)
    if row.sensitive_path is not None and row.sensitive_path not in state["reads"]:
        state["reads"].append(row.sensitive_path)
    return out


def _advance(key, batches, state):
    now = json.loads(state.get[0]) if state.exists else {
        "touch": None, "arm": None, "fired": [], "servers": {}, "reads": [], "last": 0}
    # A trigger's rows come in any order and in several Arrow batches: they are put in order as a whole.
    for pdf in [pd.concat(list(batches), ignore_index=True)]:
        out = []
        for row in pdf.sort_values("seq").astype(object).where(pdf.notna(), None).itertuples(index=False):
            if row.seq > now["last"]:  # events already folded do not count twice
                out += [(key[0], *f) for f in _fire(now, row)]
                now["last"] = int(row.seq)
        yield pd.DataFrame(out, columns=["session_id", "combo", "severity", "antecedent_seq", "consequent_seq"])
    state.update((json.dumps(now),))


def live_combos(events: DataFrame, recorder: str = "recorder") -> DataFrame:
    """Combos of the current ruleset as they fire.

    Predicates are a stateless projection; only rows that can matter to a combo
    reach the per-session state, which holds a few numbers and names. Late
    events are settled by batch rescoring, the source of truth.
    """
    c = F.col
    facts = event_facts(events, recorder).select(
        "session_id", "seq", "secret_touch", "arms", "strong_auth_path", "test_path", "shell", "ci_path", "tamper", "server",
        "outbound_path", "sensitive_path", c("send.via").alias("via"), c("send.secret").alias("secret"), c("weakens").isNotNull().alias("weak"))
    matters = c("secret_touch") | c("arms") | c("strong_auth_path") | c("shell") | c("ci_path") | c("tamper") | c("weak") | c("via").isNotNull() | c("server").isNotNull()
    return facts.filter(matters).groupBy("session_id").applyInPandasWithState(_advance, FIRED, "state string", "append", "NoTimeout")


# ---- correlation without ids ------------------------------------------------

MATCHED = "session_id string, tool_name string, input string, after_pos bigint, before_pos bigint"


def _match(key, batches, state):
    pending = json.loads(state.get[0]) if state.exists else []
    for pdf in [pd.concat(list(batches), ignore_index=True)]:
        out = []
        for row in pdf.sort_values("pos").itertuples(index=False):
            pending = [p for p in pending if p[1] >= row.at - V.PENDING_TTL_SECONDS]
            if row.stage == "before":
                pending.append([int(row.pos), float(row.at)])
            else:
                out.append((*key, int(row.pos), pending.pop(0)[0] if pending else None))
        frame = pd.DataFrame(out, columns=["session_id", "tool_name", "input", "after_pos", "before_pos"])
        yield frame.astype({"before_pos": "Int64"})
    state.update((json.dumps(pending),))


def live_pairs(calls: DataFrame) -> DataFrame:
    """First pending Before answers each After; old ones expire, none is invented."""
    return calls.groupBy("session_id", "tool_name", "input").applyInPandasWithState(_match, MATCHED, "state string", "append", "NoTimeout")


# ---- joins, dedupe, index, checkpoints --------------------------------------

def live_outcomes(pre: DataFrame, terminal: DataFrame, lateness: str = "30 minutes") -> DataFrame:
    """Calls with their terminal row in whatever order they arrive; unanswered ones after the wait."""
    a = pre.withWatermark("at", lateness).select("session_id", "tool_use_id", "at").alias("a")
    b = terminal.withWatermark("at", lateness).select("session_id", "tool_use_id", F.col("at").alias("done_at"), "phase").alias("b")
    near = F.expr(f"a.session_id = b.session_id AND a.tool_use_id = b.tool_use_id AND b.done_at BETWEEN a.at - INTERVAL {lateness} AND a.at + INTERVAL {lateness}")
    return a.join(b, near, "left_outer").select("a.session_id", "a.tool_use_id", "a.at", "b.done_at", "b.phase")


def live_attribution(updates: DataFrame, events: DataFrame, seconds: int = V.CORRELATION_SECONDS) -> DataFrame:
    """Ref updates with the session events of the same repository just before them."""
    u = updates.withWatermark("at", "1 minute").alias("u")
    e = events.withWatermark("at", "1 minute").alias("e")
    near = F.expr(f"u.repo = e.repo AND e.at <= u.at AND e.at > u.at - INTERVAL {seconds} SECONDS")
    return u.join(e, near, "inner").select("u.id", F.col("u.at").alias("at"), "e.session_id")


def first_facts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key for good: without a watermark no key is forgotten and no late row is dropped; the state grows with the keys."""
    return rows.dropDuplicates(keys)


def live_index(events: DataFrame, folder: str, checkpoint: str, every: str = "3 seconds"):
    """Append-only token index; the stream's checkpoint is its high-water mark."""
    rows = token_index(searchable(events), ["session_id", "seq"])
    return rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(processingTime=every)


def write_boundaries(folder: str):
    """A micro-batch writer of the head at every session boundary; a retried micro-batch replaces its folder."""
    def batch(df: DataFrame, epoch: int) -> None:
        edge = df.filter(F.col("phase").isin(V.BOUNDARY_PHASES))
        edge.select("session_id", "seq", F.col("hash").alias("head_hash")).write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    return batch


def boundary_heads(events: DataFrame, folder: str, checkpoint: str):
    """Record the head of a session at every one of its boundaries."""
    return events.writeStream.foreachBatch(write_boundaries(folder)).option("checkpointLocation", checkpoint)


def hourly(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    return events.withWatermark("at", lateness).groupBy(F.window("at", "1 hour"), "phase").agg(F.count(F.lit(1)).alias("events"))


def inactivity_sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Sessions by silence, for sources that carry no session id."""
    return events.withWatermark("at", lateness).groupBy(F.session_window("at", gap), "source").agg(F.count(F.lit(1)).alias("events"))
