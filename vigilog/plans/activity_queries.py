"""Queries over agent activity: scoring, actions, sessions, fleet and stories."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilog.functions import fixed_values as V
from vigilog.functions import predicates as P
from vigilog.functions import wording as X
from vigilog.functions.lists import basename, matching_names
from vigilog.operators import actions as A
from vigilog.operators import scoring as S
from vigilog.operators import sessions as N
from vigilog.operators import story as T
from vigilog.plans import bridges as B
from vigilog.plans.oracle import SHELL, in_list, like, plausible_host, text_list, text_literal
from vigilog.plans.registry import query
from vigilog.session import stored

CURRENT = ["r4"]
ALL = V.RULESETS


class Activity:
    """Derived layers of one activity data set, shared by all queries over it.

    Each layer is stored once in the shared folder and read back, as a pipeline
    would keep it: events, facts, flags, risk, combos, actions.
    """

    _shared: dict = {}

    def __new__(cls, spark: SparkSession, sf_dir: str, rulesets: list[str] = CURRENT):
        key = (spark.sparkContext.applicationId, sf_dir, tuple(rulesets))
        if key not in cls._shared:
            made = super().__new__(cls)
            made.spark, made.sf_dir, made.rulesets = spark, sf_dir, list(rulesets)
            cls._shared[key] = made
        return cls._shared[key]

    @classmethod
    def forget(cls) -> None:
        """Drop the shared layers, so that the next query starts cold."""
        cls._shared.clear()

    @property
    def _current(self) -> Activity:
        return Activity(self.spark, self.sf_dir)

    @cached_property
    def events(self) -> DataFrame:
        return stored(B.activity(self.spark, self.sf_dir), "events") if self.rulesets == CURRENT else self._current.events

    @cached_property
    def facts(self) -> DataFrame:
        return stored(S.event_facts(self.events), "facts") if self.rulesets == CURRENT else self._current.facts

    @cached_property
    def flags(self) -> DataFrame:
        return stored(S.flag_rows(self.facts, self.rulesets), "flags")

    @cached_property
    def risk(self) -> DataFrame:
        return stored(S.event_risk(self.flags), "risk")

    @cached_property
    def combos(self) -> DataFrame:
        return stored(S.combos(self.facts, self.rulesets), "combos")

    @cached_property
    def verdicts(self) -> DataFrame:
        return S.verdicts(self.events, self.flags, self.combos, self.rulesets)

    @cached_property
    def split(self) -> DataFrame:
        return A.split_flags(self.risk, self.combos)

    @cached_property
    def actions(self) -> DataFrame:
        return stored(A.pair_actions(self.events, self.split), "actions")

    @cached_property
    def finding_seqs(self) -> DataFrame:
        return stored(A.finding_seqs(self.events, self.combos), "finding_seqs")

    @cached_property
    def findings(self) -> DataFrame:
        return stored(A.findings(self.events, self.combos), "findings")

    @cached_property
    def cards(self) -> DataFrame:
        return stored(N.cards(self.events, self.actions, S.newest_verdicts(self.verdicts), self.combos), "cards")

    @cached_property
    def story(self) -> DataFrame:
        return stored(T.story_rows(self.actions, self.events), "story")


def joined(column: str) -> F.Column:
    return F.array_join(column, ",")


# ---- scoring ----------------------------------------------------------------

@query("sessions_by_verdict", "E3 G1 F1 F4 F6",
       "SELECT session_id, verdict, score, combos FROM verdicts WHERE ruleset = 'r4'")
def sessions_by_verdict(spark, sf_dir):
    a = Activity(spark, sf_dir)
    rank = F.expr("CASE verdict WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END")
    return a.verdicts.select("session_id", "verdict", "score", "combos").orderBy(rank, "session_id")


@query("event_flags", "C1 C2 C4 C5 C6 C7 C8 C9 C10 C12 C14 C15 C17 K1", """
    SELECT session_id, seq, flag, score, path, host, via, secret, server, patterns, kind FROM flags WHERE ruleset = 'r4'""")
def event_flags(spark, sf_dir):
    return Activity(spark, sf_dir).flags.drop("ruleset")


@query("event_flags_first_ruleset", "C3", "SELECT session_id, seq, flag, score FROM flags WHERE ruleset = 'r1'")
def event_flags_first_ruleset(spark, sf_dir):
    return Activity(spark, sf_dir, ["r1"]).flags.select("session_id", "seq", "flag", "score")


@query("external_sends", "C9 C10 I20", """
    SELECT session_id, seq, via, send_host AS host, send_secret AS secret FROM facts WHERE via IS NOT NULL""")
def external_sends(spark, sf_dir):
    return Activity(spark, sf_dir).facts.filter("send IS NOT NULL").select("session_id", "seq", "send.*")


@query("armed_injections", "C16 H4", "SELECT session_id, seq, array_to_string(markers, ',') AS markers FROM facts WHERE arms")
def armed_injections(spark, sf_dir):
    return Activity(spark, sf_dir).facts.filter("arms").select("session_id", "seq", joined("markers").alias("markers"))


@query("event_risk", "E4", f"""
    SELECT session_id, seq, max(score) AS score,
      array_to_string(list_filter({text_list(V.FLAG_ORDER)}, lambda x: list_contains(list(flag), x)), ',') AS flags
    FROM flags WHERE ruleset = 'r4' GROUP BY 1, 2""")
def event_risk(spark, sf_dir):
    return Activity(spark, sf_dir).risk.select("session_id", "seq", "score", joined("flags").alias("flags"))


@query("fired_combos", "F2 F3 F4 F5 F6 F9 F14 D22", """
    SELECT session_id, ruleset, combo, severity, antecedent_seq, consequent_seq, note,
      nullif(server_, '') AS server, nullif(host_, '') AS host FROM combos""")
def fired_combos(spark, sf_dir):
    return Activity(spark, sf_dir, ALL).combos


@query("rescore_all_rulesets", "N20 E3", "SELECT session_id, ruleset, verdict, score, combos, last_scored_seq FROM verdicts")
def rescore_all_rulesets(spark, sf_dir):
    return Activity(spark, sf_dir, ALL).verdicts


_LIMITS = ",".join(f"{n}={v}" for n, v in S.LIMITS)


@query("rules_fingerprints", "I15 C23", f"""
    SELECT ruleset, fingerprint, count(*) AS sessions FROM verdicts JOIN (
      SELECT ruleset, 'sha256:' || sha256('rules-v1|' || ruleset || '|' || array_to_string(list_sort(list(line)), ',') || '|{_LIMITS}') AS fingerprint FROM (
        SELECT ruleset, 'score|' || rule_key || '|' || flag || '|' || score AS line FROM rules
        UNION ALL SELECT ruleset, 'combo|' || variant || '|' || combo || '|' || severity FROM combo_rules) GROUP BY 1) USING (ruleset) GROUP BY 1, 2""")
def rules_fingerprints(spark, sf_dir):
    """How many sessions have been scored by each ruleset as it stands."""
    return Activity(spark, sf_dir, ALL).verdicts.join(F.broadcast(S.fingerprints(spark, ALL)), "ruleset").groupBy("ruleset", "fingerprint").agg(F.count(F.lit(1)).alias("sessions"))


@query("rule_counts", "E2", "SELECT session_id, flag, count(*) AS events FROM flags WHERE ruleset = 'r4' GROUP BY 1, 2")
def rule_counts(spark, sf_dir):
    return S.rule_counts(Activity(spark, sf_dir).flags).drop("ruleset")


@query("verdict_spread", "E29", """
    SELECT coalesce(ruleset, 'all') AS ruleset, coalesce(verdict, 'all') AS verdict, count(*) AS sessions
    FROM verdicts GROUP BY CUBE (ruleset, verdict)""")
def verdict_spread(spark, sf_dir):
    return N.verdict_spread(Activity(spark, sf_dir, ALL).verdicts)


# A stored layer as it was left behind: sessions on an odd user are only scored
# by older rulesets, and every third session was scored before its last event.
_STORED = """(SELECT session_id, ruleset, verdict, score, combos,
    CASE WHEN length(session_id) % 3 = 0 THEN last_scored_seq - 1 ELSE last_scored_seq END AS last_scored_seq
    FROM verdicts WHERE ruleset <> 'r4' OR CAST(regexp_extract(session_id, '^u(\\d+)', 1) AS INT) % 2 = 0)"""


def stored_layer(verdicts: DataFrame) -> DataFrame:
    user = F.regexp_extract("session_id", r"^u(\d+)", 1).cast("int")
    return verdicts.filter((F.col("ruleset") != "r4") | (user % 2 == 0)).withColumn(
        "last_scored_seq", F.when(F.length("session_id") % 3 == 0, F.col("last_scored_seq") - 1).otherwise(F.col("last_scored_seq")))


@query("newest_verdicts", "D24", f"""
    SELECT session_id, arg_max(ruleset, CAST(ruleset[2:] AS INT)) AS ruleset, arg_max(verdict, CAST(ruleset[2:] AS INT)) AS verdict,
      arg_max(score, CAST(ruleset[2:] AS INT)) AS score FROM {_STORED} GROUP BY 1""")
def newest_verdicts(spark, sf_dir):
    return S.newest_verdicts(stored_layer(Activity(spark, sf_dir, ALL).verdicts)).drop("combos")


@query("sessions_to_score", "D23 J11", f"""
    SELECT session_id, max_seq, last_scored_seq FROM (SELECT session_id, max(seq) AS max_seq FROM activity GROUP BY 1)
    LEFT JOIN (SELECT * FROM {_STORED} WHERE ruleset = 'r4') USING (session_id)
    WHERE last_scored_seq IS NULL OR last_scored_seq < max_seq""")
def sessions_to_score(spark, sf_dir):
    a = Activity(spark, sf_dir, ALL)
    return S.sessions_to_score(a.events, stored_layer(a.verdicts), "r4")


@query("rescore_audit", "D29", f"""
    SELECT session_id, ruleset, CASE WHEN s.verdict IS NULL THEN 'not-yet-scored'
      WHEN s.score + (CASE WHEN length(session_id) % 7 = 0 THEN 1 ELSE 0 END) = v.score THEN 'match' ELSE 'mismatch' END AS status
    FROM verdicts v LEFT JOIN {_STORED} s USING (session_id, ruleset)""")
def rescore_audit(spark, sf_dir):
    a = Activity(spark, sf_dir, ALL)
    drifted = stored_layer(a.verdicts).withColumn(
        "score", (F.col("score") + F.when(F.length("session_id") % 7 == 0, 1).otherwise(0)).cast("int"))
    return S.rescore_audit(drifted, a.verdicts)


# ---- actions ----------------------------------------------------------------

from vigilog.plans.oracle import CTES  # noqa: E402

CTES["outcomes"] = """
  SELECT a.*, CASE WHEN g.outcome IS NOT NULL THEN g.outcome ELSE own END AS outcome FROM (
    SELECT *, CASE WHEN phase = 'failure' THEN 'failed' WHEN phase = 'post' THEN 'succeeded' WHEN phase = 'pre' THEN 'attempted'
      WHEN success = 0 THEN 'failed' WHEN success = 1 THEN 'succeeded' ELSE 'unknown' END AS own FROM facts) a
  LEFT JOIN (SELECT session_id, tool_use_id, CASE WHEN bool_or(phase = 'post') AND bool_or(phase = 'failure') THEN 'unknown'
      WHEN bool_or(phase = 'failure') THEN 'failed' WHEN bool_or(phase = 'post') THEN 'succeeded' ELSE 'attempted' END AS outcome
    FROM activity WHERE tool_use_id IS NOT NULL GROUP BY 1, 2) g USING (session_id, tool_use_id)"""
CTES["risk"] = f"""
  SELECT session_id, seq, max(score) AS score, max(host) AS send_host, max(via) AS send_via,
    max(CASE WHEN flag = 'secret-touch' THEN path END) AS touch_path,
    list_filter({text_list(V.FLAG_ORDER)}, lambda x: list_contains(list(flag), x)) AS flags
  FROM flags WHERE ruleset = 'r4' GROUP BY 1, 2"""
CTES["cited"] = """
  SELECT DISTINCT session_id, seq FROM (SELECT session_id, antecedent_seq AS seq FROM combos WHERE ruleset = 'r4'
    UNION ALL SELECT session_id, consequent_seq FROM combos WHERE ruleset = 'r4')"""
_SHOWN = text_list(V.RISK_FLAGS + V.ALWAYS_SHOWN_ANNOTATIONS)
CTES["split"] = f"""
  SELECT r.session_id, r.seq, score, CASE WHEN c.seq IS NOT NULL THEN flags ELSE list_filter(flags, lambda f: list_contains({_SHOWN}, f)) END AS signals,
    CASE WHEN c.seq IS NOT NULL THEN [] ELSE list_filter(flags, lambda f: NOT list_contains({_SHOWN}, f)) END AS notes
  FROM risk r LEFT JOIN cited c USING (session_id, seq)"""
_SEGMENTS = r"(?:''[^'']*''|\"[^\"]*\"|\([^()]*\)|[^;|&\n''\"()])+".replace('\\"', '"')
CTES["summaries"] = f"""
  SELECT session_id, seq, CASE WHEN action_type = 'session' THEN 'A session lifecycle event (start/stop).'
    WHEN description IS NOT NULL THEN description
    WHEN {SHELL} THEN CASE WHEN len(progs) = 1 THEN 'Run `' || progs[1].p || '`' || CASE WHEN progs[1].a THEN ' with arguments' ELSE '' END || '.'
      ELSE 'Ran a ' || len(progs) || '-step shell command — run `' || coalesce(list_filter(progs, lambda x: x.d)[1].p, progs[1].p) || '`' ||
        CASE WHEN coalesce(list_filter(progs, lambda x: x.d)[1].a, progs[1].a) THEN ' with arguments' ELSE '' END END
    WHEN action_type = 'file_read' THEN 'Read the file `' || coalesce(target, '') || '`.'
    WHEN action_type = 'file_write' THEN 'Wrote (created or replaced) the file `' || target || '`.'
    WHEN action_type = 'file_edit' THEN 'Edited the file `' || target || '`.'
    WHEN action_type = 'web_fetch' THEN 'Fetched the web page `' || coalesce(nullif(regexp_extract(target, '(?i)https?://([a-z0-9.\\-]+)', 1), ''), target) || '`.'
    WHEN action_type = 'mcp_call' THEN 'Called `' || string_split(tool_name, '__')[3] || '` on the MCP server `' || string_split(tool_name, '__')[2] || '`.'
    WHEN action_type = 'task_control' THEN 'Managed a sub-agent or task.' ELSE tool_name || ' action.' END AS summary
  FROM (SELECT *, list_transform(list_filter(list_transform(regexp_extract_all(target, '{_SEGMENTS}'), lambda s: trim(s)), lambda s: s <> ''),
      lambda s: {{'p': string_split(s, ' ')[1], 'a': contains(s, ' '),
                  'd': regexp_matches(s, '^(rm|nc|scp|curl|wget)\\b|chmod.*777|^git\\s+push\\b.*--force|^git\\s+reset\\b.*--hard')}}) AS progs
    FROM activity)"""
CTES["actions"] = """
  SELECT o.session_id, o.seq, p.seq AS post_seq, o.ts, o.hook_event, o.action_type AS type, o.tool_name AS tool, o.target, o.tool_use_id,
    o.prompt_id, o.agent_type, o.source, o.k, coalesce(p.phase, o.phase) AS phase, o.commit_sha, o.commit_subject, o.git_kind, o.git_force,
    o.git_files, o.git_ins, o.git_del, o.prompt, o.reasoning, p.mutated, p.mut_ins, p.mut_del, p.mut_stored,
    CASE WHEN p.seq IS NOT NULL THEN p.success WHEN o.hook_event = 'PreToolUse' THEN NULL ELSE o.success END AS success,
    p.duration_ms AS duration_ms, o.outcome,
    CASE o.outcome WHEN 'succeeded' THEN m.summary WHEN 'failed' THEN regexp_replace(m.summary, '\\.$', '') || ' — the tool reported failure.'
      WHEN 'attempted' THEN regexp_replace(m.summary, '\\.$', '') || ' — completion was not recorded.'
      ELSE regexp_replace(m.summary, '\\.$', '') || ' — outcome unknown.' END AS summary,
    o.redaction_count + coalesce(p.redaction_count, 0) AS redaction_count,
    greatest(coalesce(s1.score, 0), coalesce(s2.score, 0)) AS score,
    list_distinct(list_concat(coalesce(s1.signals, []), coalesce(s2.signals, []))) AS signals,
    list_distinct(list_concat(coalesce(s1.notes, []), coalesce(s2.notes, []))) AS notes
  FROM (SELECT * FROM outcomes WHERE hook_event NOT LIKE 'PostToolUse%') o
  LEFT JOIN (SELECT * FROM activity WHERE hook_event LIKE 'PostToolUse%') p ON o.session_id = p.session_id AND o.tool_use_id = p.tool_use_id
  LEFT JOIN summaries m ON m.session_id = o.session_id AND m.seq = o.seq
  LEFT JOIN split s1 ON s1.session_id = o.session_id AND s1.seq = o.seq
  LEFT JOIN split s2 ON s2.session_id = o.session_id AND s2.seq = p.seq"""


@query("split_flags", "C18", """
    SELECT session_id, seq, array_to_string(list_sort(signals), ',') AS signals, array_to_string(list_sort(notes), ',') AS notes FROM split""")
def split_flags(spark, sf_dir):
    return Activity(spark, sf_dir).split.select(
        "session_id", "seq", joined(F.array_sort("signals")).alias("signals"), joined(F.array_sort("notes")).alias("notes"))


@query("paired_actions", "D1 D4 H7 E9 B23 B24", """
    SELECT session_id, seq, post_seq, type, phase, success, duration_ms, outcome, summary, redaction_count, score,
      array_to_string(list_sort(signals), ',') AS signals, array_to_string(list_sort(notes), ',') AS notes FROM actions""")
def paired_actions(spark, sf_dir):
    return Activity(spark, sf_dir).actions.select(
        "session_id", "seq", "post_seq", "type", "phase", "success", "duration_ms", "outcome", "summary", "redaction_count",
        "score", joined(F.array_sort("signals")).alias("signals"), joined(F.array_sort("notes")).alias("notes"))


@query("first_terminals", "D3", """
    SELECT p.session_id, p.tool_use_id, p.seq AS pre_seq, min(q.seq) AS post_seq, arg_min(q.phase, q.seq) AS post_phase
    FROM activity p JOIN activity q ON p.session_id = q.session_id AND p.tool_use_id = q.tool_use_id AND q.seq > p.seq
    WHERE p.phase = 'pre' AND q.phase IN ('post', 'failure') GROUP BY 1, 2, 3""")
def first_terminals(spark, sf_dir):
    return A.first_terminals(Activity(spark, sf_dir).events)


@query("action_counts", "E16", """
    SELECT session_id, count(*) AS actions FROM activity WHERE action_type <> 'session' AND hook_event NOT LIKE 'PostToolUse%' GROUP BY 1""")
def action_counts(spark, sf_dir):
    return A.action_counts(Activity(spark, sf_dir).events)


CTES["finding_seqs"] = """
  SELECT DISTINCT session_id, combo, seq FROM (
    SELECT session_id, combo, antecedent_seq AS seq FROM combos WHERE ruleset = 'r4'
    UNION ALL SELECT session_id, combo, consequent_seq FROM combos WHERE ruleset = 'r4'
    UNION ALL SELECT c.session_id, combo, t.seq FROM combos c JOIN activity a ON a.session_id = c.session_id AND a.seq = c.consequent_seq
      JOIN activity t ON t.session_id = a.session_id AND t.tool_use_id = a.tool_use_id
    WHERE ruleset = 'r4' AND t.phase IN ('post', 'failure'))"""
CTES["findings"] = """
  SELECT c.session_id, combo, severity, antecedent_seq, consequent_seq, note, nullif(server_, '') AS server,
    coalesce(nullif(host_, ''), nullif(regexp_extract(coalesce(o.target, ''), '(?i)https?://([a-z0-9.-]+)', 1), '')) AS host, o.outcome, o.target
  FROM combos c JOIN outcomes o ON o.session_id = c.session_id AND o.seq = c.consequent_seq WHERE ruleset = 'r4'"""


@query("findings", "D5 B24", """
    SELECT session_id, combo, severity, host, outcome,
      CASE WHEN outcome = 'succeeded' THEN note || '. The tool reported success; there is no packet-level delivery confirmation.'
      ELSE replace(replace(replace(note, 'sent to', 'was submitted for transfer to'), 'shipped sensitive file', 'attempted to send sensitive file'),
        'external send', 'external-send attempt') || CASE outcome
        WHEN 'failed' THEN '. The recorded tool result was failure; no successful completion was observed.'
        WHEN 'attempted' THEN '. The attempt was observed but no completion event.'
        ELSE '. The action outcome could not be determined from the recorded events.' END END AS display_note FROM findings""")
def findings(spark, sf_dir):
    return Activity(spark, sf_dir).findings.select("session_id", "combo", "severity", "host", "outcome", "display_note")


@query("finding_events", "D5", "SELECT session_id, combo, seq FROM finding_seqs")
def finding_events(spark, sf_dir):
    return Activity(spark, sf_dir).finding_seqs.drop("ruleset")


@query("danger_notes", "B25", f"""
    SELECT session_id, seq, d.what FROM risk JOIN (SELECT session_id, seq, target FROM activity) USING (session_id, seq),
      unnest(list_concat(
        list_transform(CASE WHEN list_contains(flags, 'dangerous-shell') THEN list_filter([
          CASE WHEN {like('target', '(?i)[|] *(sh|bash)')} THEN {text_literal(V.SHELL_DANGER_NOTES['pipe'][0])} END,
          CASE WHEN {like('target', 'rm -rf')} THEN {text_literal(V.SHELL_DANGER_NOTES['rm'][0])} END,
          CASE WHEN {like('target', 'chmod 777')} THEN {text_literal(V.SHELL_DANGER_NOTES['chmod'][0])} END], lambda x: x IS NOT NULL) ELSE [] END, lambda x: x),
        list_transform(list_filter([{', '.join("{'f': " + text_literal(f) + ", 'w': " + text_literal(w) + "}" for f, w, _ in V.DANGER_NOTES)}],
          lambda n: list_contains(flags, n.f)), lambda n: n.w))) AS d(what)""")
def danger_notes(spark, sf_dir):
    a = Activity(spark, sf_dir)
    return A.danger_notes(a.risk, a.events).select("session_id", "seq", "what")


# ---- sessions and fleet -----------------------------------------------------

CTES["summary"] = f"""
  SELECT session_id, count(*) AS events, min(ts) AS started, max(ts) AS ended, count_if(phase = 'failure') AS failures,
    count_if(phase NOT IN {in_list(V.LIFECYCLE_PHASES)}) AS activity FROM activity GROUP BY 1"""
_RISKY = f"len(list_intersect(signals, {text_list(V.RISK_FLAGS)})) > 0"
CTES["titles"] = """
  SELECT session_id, CASE WHEN arg_min(prompt, seq) LIKE '<%' THEN NULL ELSE arg_min(prompt, seq) END AS title
  FROM activity WHERE prompt IS NOT NULL GROUP BY 1"""
CTES["cards"] = f"""
  SELECT session_id, events, started, ended, failures, verdict, score, coalesce(flagged, 0) AS flagged, coalesce(findings, 0) AS findings,
    coalesce(flagged, 0) + coalesce(findings, 0) AS review_count, cwd, title
  FROM summary JOIN (SELECT * FROM verdicts WHERE ruleset = 'r4') USING (session_id)
  LEFT JOIN (SELECT session_id, count_if({_RISKY}) AS flagged FROM actions GROUP BY 1) USING (session_id)
  LEFT JOIN (SELECT session_id, count(*) AS findings FROM findings GROUP BY 1) USING (session_id)
  LEFT JOIN (SELECT session_id, arg_min(cwd, seq) AS cwd FROM activity WHERE cwd IS NOT NULL GROUP BY 1) USING (session_id)
  LEFT JOIN titles USING (session_id) WHERE activity > 0"""


@query("session_summary", "E1 C21", "SELECT * FROM summary")
def session_summary(spark, sf_dir):
    return N.session_summary(Activity(spark, sf_dir).events)


@query("active_sessions", "C21", "SELECT session_id, events FROM summary WHERE activity > 0 AND session_id NOT LIKE 'bb:%'")
def active_sessions(spark, sf_dir):
    return N.active_sessions(N.session_summary(Activity(spark, sf_dir).events)).select("session_id", "events")


@query("density_histogram", "E5", """
    SELECT session_id, array_to_string(list_transform(range(18), lambda i: coalesce(m[CAST(i AS INT)], 0)), ',') AS density FROM (
      SELECT session_id, map_from_entries(list((slot, n))) AS m FROM (
        SELECT session_id, CAST(least(17, greatest(0, floor((epoch_ms(CAST(ts AS TIMESTAMP)) - epoch_ms(CAST(started AS TIMESTAMP)))
          / greatest(1, epoch_ms(CAST(ended AS TIMESTAMP)) - epoch_ms(CAST(started AS TIMESTAMP))) * 18))) AS INT) AS slot, count(*) AS n
        FROM activity JOIN summary USING (session_id) GROUP BY 1, 2) GROUP BY 1)""")
def density_histogram(spark, sf_dir):
    e = Activity(spark, sf_dir).events
    return N.density(e, N.session_summary(e)).select(
        "session_id", F.array_join(F.col("density").cast("array<string>"), ",").alias("density"))


@query("session_cards", "E28 F15 B21 D24", "SELECT * FROM cards")
def session_cards(spark, sf_dir):
    return Activity(spark, sf_dir).cards.drop("ruleset")


@query("default_report_session", "G2", f"""
    SELECT session_id, verdict, ended FROM cards ORDER BY CASE verdict WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, ended DESC, session_id LIMIT 1""")
def default_report_session(spark, sf_dir):
    return N.default_report_session(Activity(spark, sf_dir).cards).select("session_id", "verdict", "ended")


@query("risk_sorted_sessions", "G6", "SELECT session_id, score, flagged, ended FROM cards ORDER BY score DESC, flagged DESC, ended DESC, session_id")
def risk_sorted_sessions(spark, sf_dir):
    return N.by_score(Activity(spark, sf_dir).cards).select("session_id", "score", "flagged", "ended")


@query("sidebar_sessions", "G7", """
    SELECT * FROM (SELECT session_id, 'review' AS "group" FROM cards WHERE review_count > 0 ORDER BY ended DESC, session_id LIMIT 8)
    UNION ALL SELECT * FROM (SELECT session_id, 'recent' FROM cards WHERE review_count = 0 ORDER BY ended DESC, session_id LIMIT 7)""")
def sidebar_sessions(spark, sf_dir):
    return N.sidebar(Activity(spark, sf_dir).cards).select("session_id", "group")


@query("session_name_search", "G10", """
    SELECT session_id, rank FROM (SELECT session_id, CASE WHEN t = 'p7' THEN 100 WHEN starts_with(t, 'p7') THEN 80 WHEN contains(t, 'p7') THEN 60
      WHEN starts_with(p, 'p7') THEN 45 WHEN contains(p, 'p7') THEN 35 WHEN contains(session_id, 'p7') THEN 20 ELSE 0 END AS rank
      FROM (SELECT session_id, lower(coalesce(title, session_id)) AS t, coalesce(regexp_extract(cwd, '[^/]+$'), '') AS p FROM cards)) WHERE rank > 0""")
def session_name_search(spark, sf_dir):
    return N.match_sessions(Activity(spark, sf_dir).cards, "p7").select("session_id", "rank")


@query("verdict_mix", "E6", "SELECT verdict, count(*) AS sessions FROM cards GROUP BY 1")
def verdict_mix(spark, sf_dir):
    return N.verdict_mix(Activity(spark, sf_dir).cards)


CTES["flag_counts"] = f"""
  SELECT session_id, flag, count(*) AS actions FROM (SELECT session_id, unnest(list_intersect(signals, {text_list(V.RISK_FLAGS)})) AS flag FROM actions) GROUP BY 1, 2"""


@query("fleet_totals", "E6", """
    SELECT count(*) AS sessions, count_if(verdict IN ('high', 'medium')) AS flagged,
      count_if(session_id IN (SELECT session_id FROM flag_counts WHERE flag = 'recorder-tamper')) AS anti_forensics FROM cards""")
def fleet_totals(spark, sf_dir):
    a = Activity(spark, sf_dir)
    return N.fleet_totals(a.cards, N.flag_action_counts(a.actions))


@query("fleet_rule_totals", "E7 E9", "SELECT flag, CAST(sum(actions) AS BIGINT) AS actions FROM flag_counts GROUP BY 1")
def fleet_rule_totals(spark, sf_dir):
    return N.rule_totals(N.flag_action_counts(Activity(spark, sf_dir).actions))


@query("outside_hosts", "E8 C19", f"""
    SELECT send_host AS host, min(ts) AS first_seen FROM risk JOIN (SELECT session_id, seq, ts FROM activity) USING (session_id, seq)
    WHERE send_host IS NOT NULL AND {plausible_host('send_host')} GROUP BY 1""")
def outside_hosts(spark, sf_dir):
    a = Activity(spark, sf_dir)
    return N.outside_hosts(a.risk, a.events)


@query("sensitive_path_counts", "E23", "SELECT touch_path AS path, count(*) AS touches FROM risk WHERE touch_path IS NOT NULL GROUP BY 1")
def sensitive_path_counts(spark, sf_dir):
    return N.path_counts(Activity(spark, sf_dir).risk)


@query("top_sensitive_paths", "G3", """
    SELECT touch_path AS path, count(*) AS touches FROM risk WHERE touch_path IS NOT NULL GROUP BY 1 ORDER BY touches DESC, path LIMIT 20""")
def top_sensitive_paths(spark, sf_dir):
    return N.top_sensitive_paths(Activity(spark, sf_dir).risk)


@query("project_counts", "E22", "SELECT cwd, count(*) AS sessions FROM cards WHERE cwd IS NOT NULL GROUP BY 1")
def project_counts(spark, sf_dir):
    return N.project_counts(Activity(spark, sf_dir).cards)


@query("top_projects", "G3", "SELECT cwd, count(*) AS sessions FROM cards WHERE cwd IS NOT NULL GROUP BY 1 ORDER BY sessions DESC, cwd LIMIT 20")
def top_projects(spark, sf_dir):
    return N.top_projects(Activity(spark, sf_dir).cards)


@query("dashboard_tiles", "E21", """
    SELECT count(*) AS sessions, count_if(review_count > 0) AS need_review, count(DISTINCT regexp_extract(cwd, '[^/]+$')) AS projects,
      (SELECT count(*) FROM activity) AS events FROM cards""")
def dashboard_tiles(spark, sf_dir):
    a = Activity(spark, sf_dir)
    return N.tiles(a.cards, a.events)


@query("redaction_audit", "E15", """
    SELECT coalesce(session_id, 'all') AS session_id, coalesce(redaction_type, 'all') AS type, count(*) AS hits, CAST(sum(redaction_bytes) AS BIGINT) AS bytes
    FROM activity WHERE redaction_type IS NOT NULL GROUP BY ROLLUP (session_id, redaction_type)""")
def redaction_audit(spark, sf_dir):
    return N.redaction_audit(Activity(spark, sf_dir).events)


@query("hourly_event_counts", "J13", "SELECT ts[1:13] AS hour, phase, count(*) AS events FROM activity GROUP BY 1, 2")
def hourly_event_counts(spark, sf_dir):
    return N.hourly_counts(Activity(spark, sf_dir).events)


@query("event_listing", "B18", """
    SELECT session_id, seq, lpad(CAST(seq AS VARCHAR), 6, ' ') || ' ' || rpad(phase, 13, ' ') || ' ' || rpad(coalesce(tool_name, '-'), 12, ' ') || ' ' ||
      CASE WHEN success = 0 THEN 'FAIL' ELSE '    ' END || ' ' || coalesce(target, '') AS line FROM activity""")
def event_listing(spark, sf_dir):
    return N.listing(Activity(spark, sf_dir).events)


@query("session_agents", "E24", "SELECT DISTINCT session_id, agent_id FROM activity WHERE agent_id IS NOT NULL")
def session_agents(spark, sf_dir):
    return N.session_agents(Activity(spark, sf_dir).events)


@query("last_revisions", "F16 B17", """
    SELECT session_id, arg_max(anchor_sha, seq) AS "commit", nullif(arg_max(coalesce(anchor_branch, ''), seq), '') AS branch
    FROM activity WHERE anchor_sha IS NOT NULL GROUP BY 1""")
def last_revisions(spark, sf_dir):
    return N.last_anchor(Activity(spark, sf_dir).events)


@query("lifecycle_boundaries", "C25", "SELECT session_id, seq, phase FROM activity WHERE phase IN ('session_start', 'session_end', 'stop')")
def lifecycle_boundaries(spark, sf_dir):
    return Activity(spark, sf_dir).events.filter(F.col("phase").isin(V.BOUNDARY_PHASES)).select("session_id", "seq", "phase")


@query("light_events", "B14", "SELECT session_id, seq, event_id, phase, tool_name, target, ts FROM activity")
def light_events(spark, sf_dir):
    return Activity(spark, sf_dir).events.select("session_id", "seq", "event_id", "phase", "tool_name", "target", "ts")


@query("subagent_parents", "D27 B13", """
    WITH RECURSIVE linked AS (SELECT session_id, seq, 't' || (CAST(event_id AS BIGINT) - user_id % 3) AS parent FROM activity WHERE agent_id IS NOT NULL),
      calls AS (SELECT session_id, tool_use_id AS parent, min(seq) AS parent_seq FROM activity WHERE phase = 'pre' AND tool_use_id IS NOT NULL GROUP BY 1, 2)
    SELECT session_id, parent, seq, parent_seq FROM linked LEFT JOIN calls USING (session_id, parent)""")
def subagent_parents(spark, sf_dir):
    """Each event of a subagent with the call that started it, where that call is in the session."""
    e = Activity(spark, sf_dir).events
    user = F.regexp_extract("session_id", r"^u(\d+)", 1).cast("bigint")
    parent = F.when(F.col("agent_id").isNotNull(), F.concat(F.lit("t"), (F.col("event_id").cast("bigint") - user % 3).cast("string")))
    return T.subagent_parents(e.withColumn("d", F.col("d").withField("parent_tool_use_id", parent)))
