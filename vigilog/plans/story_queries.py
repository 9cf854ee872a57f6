"""Queries over turns, intent, event search, blast radius, traces, reviews and spans."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from vigilog.functions import fixed_values as V
from vigilog.functions.lists import basename
from vigilog.operators import actions as A
from vigilog.operators import blast as L
from vigilog.operators import custody as C
from vigilog.operators import graph as G
from vigilog.operators import intent as I
from vigilog.operators import replay as Y
from vigilog.operators import report as M
from vigilog.operators import review as W
from vigilog.operators import scoring as S
from vigilog.operators import search as Q
from vigilog.operators import sessions as N
from vigilog.operators import spans as O
from vigilog.operators import story as T
from vigilog.plans import bridges as B
from vigilog.plans.activity_queries import Activity, joined
from vigilog.plans.oracle import CTES, SHELL, in_list, like, plausible_host, sensitive, text_list, text_literal
from vigilog.plans.registry import query
from vigilog.session import stored


class Story:
    """Story tables over the shared activity tables."""

    _shared: dict = {}

    def __new__(cls, spark, sf_dir):
        a = Activity(spark, sf_dir)
        if cls._shared.get("activity") is not a:
            made = super().__new__(cls)
            made.a = a
            cls._shared = {"activity": a, "story": made}
        return cls._shared["story"]

    @cached_property
    def rows(self) -> DataFrame:
        return self.a.story

    @cached_property
    def turns(self) -> DataFrame:
        return stored(T.turns(self.rows), "turns")

    @cached_property
    def files(self) -> DataFrame:
        return stored(T.turn_files(self.rows), "files")

    @cached_property
    def commits(self) -> DataFrame:
        return T.commits(self.rows)

    @cached_property
    def trace(self) -> tuple[DataFrame, DataFrame]:
        nodes, edges = G.trace(self.rows, self.turns, self.files, self.commits, self.a.findings)
        return stored(nodes, "nodes"), stored(edges, "edges")

    @cached_property
    def observed(self) -> DataFrame:
        return I.observed_entities(self.a.facts)

    @cached_property
    def told(self) -> DataFrame:
        return I.narratives(self.a.events)

    @cached_property
    def hosts(self) -> DataFrame:
        return L.hosts(self.a.risk, self.a.findings)

    @cached_property
    def checklist(self) -> DataFrame:
        a = self.a
        return L.checklist(L.files(a.events), L.secrets(a.facts), self.hosts, L.commits(a.events), a.findings)

    @cached_property
    def review(self) -> tuple[DataFrame, DataFrame]:
        a = self.a
        items, entities = W.review_findings(a.events, a.flags, a.risk, a.findings, a.finding_seqs)
        return stored(items, "items"), stored(entities, "entities")


# ---- turns ------------------------------------------------------------------

CTES["story"] = """
  SELECT *, CASE WHEN phase = 'prompt' THEN 'prompt' WHEN phase = 'reasoning' THEN 'reasoning' WHEN type = 'session' THEN 'lifecycle'
      WHEN hook_event = 'GitRefTransaction' THEN 'commit' ELSE 'step' END AS role, agent_type <> 'main' AS is_subagent
  FROM (SELECT *, coalesce(prompt_id, active, '#headless') AS turn_id,
      type = 'session' AND phase NOT IN ('prompt', 'reasoning') AND first_open IS NULL AND prompt_id IS NOT NULL AS orphan
    FROM (SELECT *, last_value(opened IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS active
      FROM (SELECT a.*, first_open, CASE WHEN phase = 'prompt' OR (phase <> 'reasoning' AND type <> 'session' AND prompt_id IS NOT NULL) THEN prompt_id
          WHEN type = 'session' AND phase NOT IN ('prompt', 'reasoning') AND first_open < seq THEN prompt_id END AS opened
        FROM actions a LEFT JOIN (SELECT session_id, prompt_id, min(seq) AS first_open FROM actions
          WHERE prompt_id IS NOT NULL AND (phase = 'prompt' OR (phase <> 'reasoning' AND type <> 'session')) GROUP BY 1, 2) USING (session_id, prompt_id))))
  WHERE NOT orphan"""
_RISKY = f"len(list_intersect(signals, {text_list(V.RISK_FLAGS)})) > 0"
_CLIP = "CASE WHEN length({0}) > 180 THEN {0}[1:180] || '…' ELSE {0} END"
CTES["turns"] = f"""
  SELECT session_id, turn_id, first_seq, started_at, coalesce(ended, started_at) AS ended_at, prompt, reasoning, steps, files, commits, flagged, max_score,
    CASE WHEN prompt NOT LIKE '<%' THEN prompt WHEN reasoning IS NOT NULL THEN {_CLIP.format("('Agent response · ' || reasoning)")}
      WHEN first_text IS NOT NULL THEN {_CLIP.format("(CASE WHEN all_sub THEN 'Subagent work · ' ELSE 'Prompt unavailable · ' END || first_text)")}
      WHEN commits > 0 THEN 'Commit · ' || commit_text ELSE 'System reminder' END AS title,
    CASE WHEN prompt NOT LIKE '<%' THEN 'captured_prompt' WHEN reasoning IS NOT NULL THEN 'assistant_explanation'
      WHEN first_text IS NOT NULL THEN CASE WHEN all_sub THEN 'subagent_action' ELSE 'recorded_action' END
      WHEN commits > 0 THEN 'commit' ELSE 'recorded_action' END AS title_source
  FROM (SELECT session_id, turn_id, min(seq) FILTER (role <> 'lifecycle') AS first_seq, arg_min(ts, seq) FILTER (role <> 'lifecycle') AS started_at,
      arg_max(ts, seq) FILTER (role IN ('step', 'commit', 'lifecycle')) AS ended, arg_min(prompt, seq) FILTER (prompt IS NOT NULL) AS prompt,
      arg_max(reasoning, seq) FILTER (reasoning IS NOT NULL) AS reasoning, count(*) FILTER (role = 'step') AS steps, count(*) FILTER (role = 'commit') AS commits,
      count(DISTINCT CASE WHEN mutated THEN target END) AS files, count(*) FILTER (role = 'step' AND {_RISKY}) AS flagged,
      coalesce(max(score) FILTER (role = 'step'), 0) AS max_score, arg_min(summary, seq) FILTER (role = 'step') AS first_text,
      bool_and(is_subagent) FILTER (role = 'step') AS all_sub,
      arg_min(coalesce(commit_subject, 'refs/heads/main'), seq) FILTER (role = 'commit') AS commit_text
    FROM story GROUP BY 1, 2) WHERE prompt IS NOT NULL OR reasoning IS NOT NULL OR steps > 0 OR commits > 0"""


@query("turn_assignment", "F7 J7", "SELECT session_id, seq, turn_id, role FROM story")
def turn_assignment(spark, sf_dir):
    return Story(spark, sf_dir).rows.select("session_id", "seq", "turn_id", "role")


@query("turns", "L1 L2 E11 B22 C20", "SELECT * FROM turns")
def turns(spark, sf_dir):
    return Story(spark, sf_dir).turns


@query("turn_flags", "E11", f"""
    SELECT session_id, turn_id, flag, count(*) AS steps FROM (SELECT session_id, turn_id, unnest(list_intersect(signals, {text_list(V.RISK_FLAGS)})) AS flag
      FROM story WHERE role = 'step') GROUP BY 1, 2, 3""")
def turn_flags(spark, sf_dir):
    return T.turn_flags(Story(spark, sf_dir).rows)


CTES["turn_files"] = """
  SELECT session_id, turn_id, target AS path, CAST(sum(mut_ins) AS BIGINT) AS insertions, CAST(sum(mut_del) AS BIGINT) AS deletions,
    max(post_seq) AS seq, bool_or(NOT mut_stored) AS skipped
  FROM story WHERE mutated AND role = 'step' GROUP BY GROUPING SETS ((session_id, turn_id, target), (session_id, target))"""


@query("file_changes", "E10", "SELECT * FROM turn_files")
def file_changes(spark, sf_dir):
    return Story(spark, sf_dir).files


CTES["story_commits"] = """
  SELECT session_id, turn_id, seq, commit_sha AS sha, commit_subject AS subject, git_kind AS kind, git_files AS files, git_ins AS insertions,
    git_del AS deletions, git_force AS force FROM story WHERE role = 'commit'"""


@query("turn_commits", "L2", "SELECT session_id, turn_id, seq, sha, subject, kind, force FROM story_commits")
def turn_commits(spark, sf_dir):
    return Story(spark, sf_dir).commits.select("session_id", "turn_id", "seq", "sha", "subject", "kind", "force")


CTES["per_turn"] = """
  SELECT s.session_id, s.turn_id, count(DISTINCT combo) AS findings FROM story s JOIN finding_seqs f ON f.session_id = s.session_id
    AND (f.seq = s.seq OR f.seq = s.post_seq) WHERE role = 'step' GROUP BY 1, 2"""


@query("findings_per_turn", "L17", "SELECT * FROM per_turn")
def findings_per_turn(spark, sf_dir):
    s = Story(spark, sf_dir)
    return T.findings_per_turn(s.rows, s.a.finding_seqs)


CTES["blast_hosts"] = """
  SELECT session_id, h.host, via, seq, f.outcome IS NOT NULL AS correlated, coalesce(f.outcome, 'unknown') AS outcome
  FROM (SELECT session_id, send_host AS host, arg_min(send_via, seq) AS via, min(seq) AS seq FROM risk WHERE send_host IS NOT NULL GROUP BY 1, 2) h
  LEFT JOIN (SELECT session_id, host, arg_max(outcome, (consequent_seq, combo)) AS outcome FROM findings WHERE host IS NOT NULL GROUP BY 1, 2) f USING (session_id, host)"""
CTES["evidence"] = """
  SELECT session_id, turn_id, 'RECORD' AS kind, coalesce(tool, type) || ' · ' || summary AS label, coalesce(post_seq, seq) AS seq, true AS danger
    FROM story WHERE role = 'step' AND (outcome = 'failed' OR score > 0 OR len(signals) > 0)
  UNION ALL SELECT session_id, turn_id, 'FILE', path, seq, false FROM turn_files WHERE turn_id IS NOT NULL
  UNION ALL SELECT session_id, turn_id, 'GIT', coalesce(subject, kind), seq, force FROM story_commits
  UNION ALL SELECT h.session_id, s.turn_id, 'HOST', h.host, h.seq, true FROM blast_hosts h JOIN story s ON s.session_id = h.session_id
    AND (s.seq = h.seq OR s.post_seq = h.seq) WHERE role = 'step'"""


def evidence_rows(s: Story) -> DataFrame:
    return T.evidence_rows(s.rows, s.files, s.hosts)


@query("evidence_rows", "L14", "SELECT session_id, turn_id, kind, label, seq, danger FROM evidence")
def evidence(spark, sf_dir):
    return evidence_rows(Story(spark, sf_dir))


@query("turn_filters", "C22", """
    SELECT t.session_id, t.turn_id, EXISTS (SELECT 1 FROM evidence e WHERE e.session_id = t.session_id AND e.turn_id = t.turn_id) AS has_evidence,
      flagged > 0 OR max_score > 0 OR coalesce(p.findings, 0) > 0 AS is_flagged
    FROM turns t LEFT JOIN per_turn p ON p.session_id = t.session_id AND p.turn_id = t.turn_id""")
def turn_filters(spark, sf_dir):
    s = Story(spark, sf_dir)
    return T.turn_filter(s.turns, evidence_rows(s), T.findings_per_turn(s.rows, s.a.finding_seqs))


@query("session_sentences", "N21", """
    SELECT c.session_id, CASE WHEN outcomes <> '' THEN 'The agent ' || outcomes || ' in ' || project || '.'
        ELSE 'The session completed in ' || project || ' without a stored file or commit outcome.' END
      || CASE WHEN review <> '' THEN ' ' || review || ' require review.' ELSE ' No elevated-risk finding or action was detected.' END AS sentence
    FROM (SELECT session_id, coalesce(regexp_extract(cwd, '[^/]+$'), 'no project') AS project,
        concat_ws(' and ', CASE WHEN files > 0 THEN 'changed ' || files || ' file' || CASE WHEN files = 1 THEN '' ELSE 's' END END,
          CASE WHEN commits > 0 THEN 'recorded ' || commits || ' commit' || CASE WHEN commits = 1 THEN '' ELSE 's' END END) AS outcomes,
        concat_ws(' and ', CASE WHEN findings > 0 THEN findings || ' session finding' || CASE WHEN findings = 1 THEN '' ELSE 's' END END,
          CASE WHEN flagged > 0 THEN flagged || ' individually flagged action' || CASE WHEN flagged = 1 THEN '' ELSE 's' END END) AS review
      FROM cards JOIN (SELECT session_id, CAST(sum(commits) AS BIGINT) AS commits FROM turns GROUP BY 1) USING (session_id)
      LEFT JOIN (SELECT session_id, count(*) AS files FROM turn_files WHERE turn_id IS NULL GROUP BY 1) USING (session_id)) c""")
def session_sentences(spark, sf_dir):
    s = Story(spark, sf_dir)
    counts = T.session_counts(s.rows, s.files, s.turns)
    project = F.coalesce(basename(F.col("cwd")), F.lit("no project"))
    return s.a.cards.join(counts, "session_id").select("session_id", N.summary_sentence(
        F.col("files"), F.col("commits"), project, F.col("findings"), F.col("flagged")).alias("sentence"))


# ---- intent -----------------------------------------------------------------

CTES["observed"] = f"""
  SELECT session_id, prompt_id, seq, e.kind, e.value FROM (SELECT session_id, prompt_id, seq, unnest(list_filter([
      CASE WHEN sensitive_path IS NOT NULL THEN {{'kind': 'path', 'value': sensitive_path}} END,
      CASE WHEN {plausible_host('send_host')} THEN {{'kind': 'host', 'value': send_host}} END,
      CASE WHEN shell THEN {{'kind': 'command', 'value': string_split(target, ' ')[1]}} END,
      CASE WHEN server IS NOT NULL THEN {{'kind': 'mcp_server', 'value': server}} END], lambda x: x IS NOT NULL)) AS e
    FROM facts WHERE prompt_id IS NOT NULL AND phase NOT IN ('post', 'failure', 'reasoning'))"""
CTES["told"] = """
  SELECT session_id, prompt_id, arg_max(reasoning, seq) AS text, arg_max(reasoning, seq) LIKE '%…' AS truncated FROM activity
  WHERE phase = 'reasoning' AND prompt_id IS NOT NULL GROUP BY 1, 2"""
_PATH_NAMED = ("(contains(lower({t}), lower({p})) OR (length(list_extract(string_split({p}, '/'), -1)) > 2 AND "
               "contains(lower({t}), lower(list_extract(string_split({p}, '/'), -1)))))")
CTES["undisclosed"] = f"""
  SELECT session_id, prompt_id, kind, value, min(seq) AS seq FROM observed JOIN told USING (session_id, prompt_id)
  WHERE NOT CASE WHEN kind = 'path' THEN {_PATH_NAMED.format(t='text', p='value')}
    ELSE regexp_matches(text, '(?i)\\b' || regexp_escape(value) || '\\b') END GROUP BY 1, 2, 3, 4"""
CTES["stated"] = f"""
  SELECT session_id, prompt_id, value, CASE WHEN {sensitive('value')} THEN 'path' ELSE 'host' END AS kind FROM (
    SELECT DISTINCT session_id, prompt_id, regexp_replace(w, '^[.:]+|[.:,]+$', '', 'g') AS value FROM (
      SELECT session_id, prompt_id, unnest(regexp_split_to_array(text, '[\\s`"''()\\[\\]{{}},;<>]+')) AS w FROM told WHERE NOT truncated))
  WHERE value <> '' AND ({sensitive('value')} OR (contains(value, '.') AND NOT contains(value, '/') AND {plausible_host('value')}))"""
CTES["unfulfilled"] = f"""
  SELECT session_id, prompt_id, kind, value FROM stated s WHERE EXISTS (SELECT 1 FROM observed o WHERE o.session_id = s.session_id AND o.prompt_id = s.prompt_id)
    AND NOT EXISTS (SELECT 1 FROM observed o WHERE o.session_id = s.session_id AND o.prompt_id = s.prompt_id AND o.kind = s.kind
      AND CASE WHEN s.kind = 'path' THEN {_PATH_NAMED.format(t='s.value', p='o.value')} ELSE lower(o.value) = lower(s.value) END)"""


@query("observed_entities", "N14", "SELECT session_id, prompt_id, seq, kind, value FROM observed")
def observed_entities(spark, sf_dir):
    return Story(spark, sf_dir).observed


@query("undisclosed_actions", "D20", "SELECT session_id, prompt_id, kind, value, seq FROM undisclosed")
def undisclosed_actions(spark, sf_dir):
    s = Story(spark, sf_dir)
    return I.undisclosed_actions(s.observed, s.told).drop("truncated")


@query("unfulfilled_statements", "D21 H3", "SELECT session_id, prompt_id, kind, value FROM unfulfilled")
def unfulfilled_statements(spark, sf_dir):
    s = Story(spark, sf_dir)
    return I.unfulfilled_statements(s.observed, s.told)


@query("intent_divergence", "N13", """
    SELECT session_id, prompt_id, 'undisclosed_action' AS type, kind, value, seq FROM undisclosed
    UNION ALL SELECT session_id, prompt_id, 'unfulfilled_statement', kind, value, NULL FROM unfulfilled""")
def intent_divergence(spark, sf_dir):
    s = Story(spark, sf_dir)
    return I.divergences(s.observed, s.told)


@query("intent_coverage", "E27", """
    SELECT session_id, coalesce(a, 0) AS turns_analyzed, coalesce(k, 0) AS turns_skipped, coalesce(t, 0) AS turns_truncated, n IS NOT NULL AS reasoning_available
    FROM (SELECT session_id, count_if(truncated IS NOT NULL) AS a, count_if(truncated IS NULL) AS k, count_if(coalesce(truncated, false)) AS t
      FROM (SELECT DISTINCT session_id, prompt_id FROM observed) LEFT JOIN told USING (session_id, prompt_id) GROUP BY 1)
    FULL JOIN (SELECT DISTINCT session_id, true AS n FROM told) USING (session_id)""")
def intent_coverage(spark, sf_dir):
    s = Story(spark, sf_dir)
    return I.intent_coverage(s.observed, s.told)


# ---- event search -----------------------------------------------------------

CTES["searchable"] = f"""
  SELECT a.session_id, a.seq, ts, prompt_id, CASE WHEN phase IN ('prompt', 'reasoning') THEN phase WHEN commit_subject IS NOT NULL THEN 'commit' ELSE action_type END AS kind,
    concat_ws(' — ', target, summary, prompt, reasoning, commit_subject) AS text
  FROM activity a JOIN summaries s ON s.session_id = a.session_id AND s.seq = a.seq WHERE NOT (phase IN ('post', 'failure') AND tool_use_id IS NOT NULL)"""
_WORDS = f"list_filter(regexp_split_to_array(translate(lower(text), '{Q.ACCENTED}', '{Q.PLAIN}'), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


@query("searchable_events", "N1", "SELECT session_id, seq, kind, text FROM searchable")
def searchable_events(spark, sf_dir):
    return Q.searchable(Story(spark, sf_dir).a.events).select("session_id", "seq", "kind", "text")


CTES["hits"] = f"""
  SELECT session_id, seq, kind, ts, prompt_id, regexp_replace(text, '(?i)\\b(curl|evil)\\b', '[\\1]', 'g') AS snippet FROM searchable
  WHERE list_contains({_WORDS}, 'curl') AND list_contains({_WORDS}, 'evil') ORDER BY ts DESC, seq DESC, session_id LIMIT 200"""


def search_hits(spark, sf_dir):
    rows = Q.searchable(Story(spark, sf_dir).a.events)
    found = Q.search(Q.token_index(rows, ["session_id", "seq"]), ["session_id", "seq"], "curl evil")
    return Q.newest_hits(rows, found, ["curl", "evil"])


@query("event_search", "N3 G8 D18 I26", "SELECT session_id, seq, kind, ts, prompt_id, snippet FROM hits")
def event_search(spark, sf_dir):
    return search_hits(spark, sf_dir)


@query("grouped_search", "G9", """
    SELECT session_id, seq, CAST(row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, seq DESC) AS INT) AS rank
    FROM (SELECT * FROM hits ORDER BY ts DESC, seq DESC, session_id LIMIT 30) QUALIFY rank <= 8""")
def grouped_search(spark, sf_dir):
    return Q.grouped_hits(search_hits(spark, sf_dir)).select("session_id", "seq", "rank")


# ---- blast radius -----------------------------------------------------------

CTES["blast_files"] = f"""
  SELECT session_id, target AS path, CAST(sum(mut_ins) AS BIGINT) AS insertions, CAST(sum(mut_del) AS BIGINT) AS deletions, min(seq) AS seq,
    {like('target', V.AUTH_SEGMENT)} AS auth FROM activity WHERE mutated GROUP BY 1, 2, 6"""
CTES["blast_secrets"] = "SELECT session_id, sensitive_path AS path, min(seq) AS seq FROM facts WHERE sensitive_path IS NOT NULL GROUP BY 1, 2"
CTES["blast_commits"] = """
  SELECT session_id, coalesce(commit_sha, 'new-' || event_id) AS sha, CASE WHEN commit_sha IS NOT NULL THEN commit_subject ELSE '(force update)' END AS subject, seq,
    CASE WHEN commit_sha IS NOT NULL THEN git_force ELSE true END AS force FROM activity WHERE k = 16 AND (commit_sha IS NOT NULL OR git_force)"""
_SENT = "session_id IN (SELECT session_id FROM findings WHERE outcome = 'succeeded' AND combo IN ('exfil-chain', 'injected-exfil', 'tool-poisoning'))"
CTES["checklist"] = f"""
  SELECT session_id, 'rotate-secret' AS kind, CASE WHEN {_SENT} THEN 'high' ELSE 'medium' END AS severity,
    CASE WHEN {_SENT} THEN 'Rotate the credential that may have been exposed via ' || path ELSE 'Review whether ' || path || ' was exposed; rotate its credentials if confirmed' END AS action, seq FROM blast_secrets
  UNION ALL SELECT session_id, 'revert-commit', CASE WHEN force THEN 'high' ELSE 'medium' END,
    CASE WHEN force THEN 'Investigate/undo' ELSE 'Review' END || ' commit ' || sha[1:10] || coalesce(' — ' || subject, ''), seq FROM blast_commits
  UNION ALL SELECT session_id, 'inspect-host', CASE WHEN outcome = 'succeeded' THEN 'high' ELSE 'medium' END, 'Inspect the ' || CASE outcome
      WHEN 'succeeded' THEN 'tool-reported outbound transfer' WHEN 'failed' THEN 'failed outbound-transfer attempt' WHEN 'attempted' THEN 'outbound-transfer attempt'
      ELSE 'outbound action with unknown outcome' END || ' to ' || host || coalesce(' (via ' || via || ')', '') || CASE WHEN correlated THEN ' — correlated session finding' ELSE '' END, seq FROM blast_hosts
  UNION ALL SELECT session_id, 'review-file', 'medium', 'Review the auth-path change to ' || path || ' (+' || insertions || ' −' || deletions || ')', seq FROM blast_files WHERE auth"""


@query("blast_files", "E13", "SELECT * FROM blast_files")
def blast_files(spark, sf_dir):
    return L.files(Story(spark, sf_dir).a.events)


@query("blast_secrets", "E13", "SELECT * FROM blast_secrets")
def blast_secrets(spark, sf_dir):
    return L.secrets(Story(spark, sf_dir).a.facts)


@query("blast_hosts", "E13 D25", "SELECT * FROM blast_hosts")
def blast_hosts(spark, sf_dir):
    return Story(spark, sf_dir).hosts


@query("blast_commits", "E13", "SELECT * FROM blast_commits")
def blast_commits(spark, sf_dir):
    return L.commits(Story(spark, sf_dir).a.events)


@query("containment_checklist", "L13 F17 I28", """
    SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, seq, kind, action) AS "order" FROM checklist""")
def containment_checklist(spark, sf_dir):
    return L.numbered(Story(spark, sf_dir).checklist)


@query("secret_kinds", "E14", "SELECT DISTINCT session_id, redaction_type AS kind FROM activity WHERE redaction_type IS NOT NULL")
def secret_kinds(spark, sf_dir):
    return L.secret_kinds(Story(spark, sf_dir).a.events)


@query("egress_hosts", "E14", f"""
    SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY cited IS NULL, coalesce(cited, seq), host) AS INT) AS rank, host FROM (
      SELECT session_id, host, min(seq) AS seq, min(cited) AS cited FROM (
        SELECT session_id, send_host AS host, seq, NULL AS cited FROM risk WHERE send_host IS NOT NULL
        UNION ALL SELECT session_id, host, NULL, consequent_seq FROM findings WHERE host IS NOT NULL) GROUP BY 1, 2)
    WHERE {plausible_host('host')}""")
def egress_hosts(spark, sf_dir):
    s = Story(spark, sf_dir)
    return L.egress_hosts(s.a.risk, s.a.findings)


# ---- trace ------------------------------------------------------------------

CTES["actors"] = """
  SELECT s.*, 's:' || s.seq AS step, EXISTS (SELECT 1 FROM findings f WHERE f.session_id = s.session_id AND f.consequent_seq IN (s.seq, s.post_seq)) AS is_effect FROM story s
  WHERE role = 'step' AND (len(signals) > 0 OR (is_subagent AND tool = 'Task')
    OR EXISTS (SELECT 1 FROM cited c WHERE c.session_id = s.session_id AND c.seq IN (s.seq, s.post_seq)))"""
CTES["made"] = """
  SELECT f.*, coalesce(a.step, 'p:' || f.turn_id) AS parent, CASE WHEN len(parts) >= 2 THEN parts[-2] || '/' ELSE './' END AS dir,
    count(*) OVER (PARTITION BY f.session_id, coalesce(a.step, 'p:' || f.turn_id), CASE WHEN len(parts) >= 2 THEN parts[-2] || '/' ELSE './' END) AS n
  FROM (SELECT *, list_filter(string_split(path, '/'), lambda p: p <> '') AS parts FROM turn_files WHERE turn_id IS NOT NULL) f
  LEFT JOIN actors a ON a.session_id = f.session_id AND f.seq IN (a.seq, a.post_seq)"""
CTES["placed"] = """
  SELECT f.*, a.turn_id AS aturn, a.seq AS astep, c.turn_id AS cturn, c.seq AS cstep FROM findings f
  LEFT JOIN (SELECT * FROM story WHERE role = 'step') a ON a.session_id = f.session_id AND f.antecedent_seq IN (a.seq, a.post_seq)
  LEFT JOIN (SELECT * FROM story WHERE role = 'step') c ON c.session_id = f.session_id AND f.consequent_seq IN (c.seq, c.post_seq)
  WHERE a.turn_id IS NOT NULL OR c.turn_id IS NOT NULL"""
CTES["nodes"] = """
  SELECT session_id, 'p:' || turn_id AS id, 'prompt' AS kind, title AS label, first_seq AS seq, flagged > 0 AS risk FROM turns
  UNION ALL SELECT session_id, step, 'step', coalesce(tool, type) || coalesce(' · ' || coalesce(nullif(regexp_extract(target, '([^/]+)/*$', 1), ''), target), ''), coalesce(post_seq, seq), len(signals) > 0 FROM actors
  UNION ALL SELECT session_id, 'f:' || parent || ':' || path, 'file', parts[-1], seq, false FROM made WHERE n < 3
  UNION ALL SELECT DISTINCT session_id, 'd:' || parent || ':' || dir, 'dir', n || ' files in ' || dir, NULL, false FROM made WHERE n >= 3
  UNION ALL SELECT session_id, 'c:' || seq, 'commit', coalesce(sha[1:7] || ' ' || subject, 'commit'), seq, false FROM story_commits
  UNION ALL SELECT session_id, 'F:' || combo, 'finding', CASE WHEN combo = 'exfil-chain' THEN 'exfil chain' WHEN combo LIKE 'injected%' THEN 'injected instruction'
    WHEN server IS NOT NULL THEN 'tool poisoning' ELSE replace(combo, '-', ' ') END, consequent_seq, true FROM placed
  UNION ALL SELECT session_id, 'h:' || combo, 'host', host, NULL, true FROM placed WHERE host IS NOT NULL
  UNION ALL SELECT session_id, 'm:' || combo, 'host', server, NULL, true FROM placed WHERE server IS NOT NULL"""
_WENT = "CASE WHEN outcome = 'succeeded' THEN 'sent' ELSE 'targeted' END"
CTES["edges"] = f"""
  SELECT session_id, 'p:' || turn_id AS src, step AS dst, 'caused' AS rel FROM actors WHERE NOT is_effect
  UNION ALL SELECT session_id, parent, 'f:' || parent || ':' || path, 'wrote' FROM made WHERE n < 3
  UNION ALL SELECT DISTINCT session_id, parent, 'd:' || parent || ':' || dir, 'wrote' FROM made WHERE n >= 3
  UNION ALL SELECT c.session_id, coalesce((SELECT arg_max(a.step, a.seq) FROM actors a WHERE a.session_id = c.session_id AND a.turn_id = c.turn_id AND a.seq < c.seq), 'p:' || c.turn_id), 'c:' || c.seq, 'committed' FROM story_commits c
  UNION ALL SELECT session_id, coalesce('s:' || astep, 'p:' || coalesce(aturn, cturn)), 'F:' || combo, 'flagged' FROM placed
  UNION ALL SELECT session_id, 'F:' || combo, 's:' || cstep, 'flagged' FROM placed WHERE cstep IS NOT NULL
  UNION ALL SELECT session_id, coalesce('s:' || cstep, 'F:' || combo), 'h:' || combo, {_WENT} FROM placed WHERE host IS NOT NULL
  UNION ALL SELECT session_id, 'F:' || combo, 'm:' || combo, {_WENT} FROM placed WHERE server IS NOT NULL"""


@query("trace_nodes", "L3 L5 I21 I25", "SELECT session_id, id, kind, label, seq, risk FROM nodes")
def trace_nodes(spark, sf_dir):
    return Story(spark, sf_dir).trace[0].drop("sub")


@query("trace_edges", "L4 D26", "SELECT session_id, src, dst, rel FROM edges")
def trace_edges(spark, sf_dir):
    return Story(spark, sf_dir).trace[1]


CTES["options"] = """
  SELECT n.session_id, id, n.kind, CASE WHEN n.kind = 'finding' THEN CASE f.severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END ELSE 9 END AS rank, n.seq,
    coalesce(t.files + 2 * t.commits + 3 * t.flagged, 0) AS worth
  FROM nodes n LEFT JOIN findings f ON f.session_id = n.session_id AND n.id = 'F:' || f.combo LEFT JOIN turns t ON t.session_id = n.session_id AND n.id = 'p:' || t.turn_id
  WHERE n.kind IN ('finding', 'prompt')"""
CTES["roots"] = "SELECT session_id, arg_min(id, (rank, -worth, coalesce(seq, 0), id)) AS id FROM options GROUP BY 1"


@query("root_options", "L8", "SELECT session_id, id, kind, CAST(rank AS INT) AS rank, seq FROM options")
def root_options(spark, sf_dir):
    s = Story(spark, sf_dir)
    return G.root_options(s.trace[0], s.a.findings).drop("label")


@query("default_roots", "L7", "SELECT * FROM roots")
def default_roots(spark, sf_dir):
    s = Story(spark, sf_dir)
    return G.default_roots(s.trace[0], s.a.findings, s.turns)


@query("trace_neighbourhood", "L6 H6", """
    SELECT DISTINCT session_id, id FROM (SELECT * FROM roots
      UNION ALL SELECT e.session_id, e.src FROM edges e JOIN roots r ON r.session_id = e.session_id AND r.id = e.dst
      UNION ALL SELECT e.session_id, e.dst FROM edges e JOIN roots r ON r.session_id = e.session_id AND r.id = e.src
      UNION ALL SELECT e.session_id, e.src FROM edges e JOIN edges m ON m.session_id = e.session_id AND e.dst = m.src JOIN roots r ON r.session_id = m.session_id AND r.id = m.dst
      UNION ALL SELECT e.session_id, e.dst FROM edges e JOIN edges m ON m.session_id = e.session_id AND e.src = m.dst JOIN roots r ON r.session_id = m.session_id AND r.id = m.src)""")
def trace_neighbourhood(spark, sf_dir):
    s = Story(spark, sf_dir)
    return G.neighbourhood(s.trace[1], default_roots(spark, sf_dir))


@query("tainted_nodes", "L9", """
    WITH RECURSIVE up(session_id, id) AS (SELECT session_id, id FROM nodes WHERE risk UNION SELECT e.session_id, e.src FROM up u JOIN edges e ON e.session_id = u.session_id AND e.dst = u.id),
      down(session_id, id) AS (SELECT session_id, id FROM nodes WHERE risk UNION SELECT e.session_id, e.dst FROM down u JOIN edges e ON e.session_id = u.session_id AND e.src = u.id)
    SELECT * FROM up UNION SELECT * FROM down""")
def tainted_nodes(spark, sf_dir):
    return G.tainted(*Story(spark, sf_dir).trace)


@query("trace_layers", "L10", """
    WITH RECURSIVE reach(session_id, src, dst) AS (
        SELECT session_id, src, dst FROM edges UNION SELECT r.session_id, r.src, e.dst FROM reach r JOIN edges e ON e.session_id = r.session_id AND e.src = r.dst),
      stuck AS (SELECT session_id, src AS id FROM reach WHERE src = dst
        UNION SELECT r.session_id, r.dst FROM reach r JOIN (SELECT session_id, src FROM reach WHERE src = dst) k ON k.session_id = r.session_id AND k.src = r.src),
      free AS (SELECT DISTINCT session_id, id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM stuck s WHERE s.session_id = n.session_id AND s.id = n.id)),
      depth(session_id, id, layer) AS (SELECT session_id, id, 0 FROM free
        UNION SELECT e.session_id, e.dst, d.layer + 1 FROM depth d JOIN edges e ON e.session_id = d.session_id AND e.src = d.id
          JOIN free f ON f.session_id = e.session_id AND f.id = e.dst),
      deepest AS (SELECT session_id, id, max(layer) AS layer FROM depth GROUP BY 1, 2)
    SELECT session_id, id, layer FROM deepest
    UNION ALL SELECT n.session_id, n.id, CAST(coalesce(max(d.layer) + 1, 0) AS INTEGER) FROM (SELECT DISTINCT session_id, id FROM nodes) n
      JOIN stuck s ON s.session_id = n.session_id AND s.id = n.id
      LEFT JOIN edges e ON e.session_id = n.session_id AND e.dst = n.id LEFT JOIN deepest d ON d.session_id = e.session_id AND d.id = e.src GROUP BY 1, 2""")
def trace_layers(spark, sf_dir):
    return G.layers(*Story(spark, sf_dir).trace)


# ---- spans ------------------------------------------------------------------

_HEX = "sha256({})[1:{}]"
CTES["act_spans"] = f"""
  SELECT session_id, prompt_id, {_HEX.format('session_id', 32)} AS trace_id, {_HEX.format("session_id || ':act:' || seq", 16)} AS span_id,
    CASE WHEN prompt_id IS NOT NULL THEN {_HEX.format("session_id || ':turn:' || prompt_id", 16)} ELSE {_HEX.format("session_id || ':session'", 16)} END AS parent_id,
    CASE WHEN tool IS NOT NULL THEN 'execute_tool ' || tool ELSE type END AS name, epoch_us(CAST(ts AS TIMESTAMP)) * 1000 AS start_ns,
    epoch_us(CAST(ts AS TIMESTAMP)) * 1000 + coalesce(duration_ms, 0) * 1000000 AS end_ns, CASE outcome WHEN 'failed' THEN 2 WHEN 'succeeded' THEN 1 ELSE 0 END AS status
  FROM actions WHERE type <> 'session'"""


@query("spans", "L11 I16 I17", f"""
    SELECT session_id, prompt_id, trace_id, span_id, parent_id, name, start_ns, end_ns, status FROM act_spans
    UNION ALL SELECT session_id, prompt_id, {_HEX.format('session_id', 32)}, {_HEX.format("session_id || ':turn:' || prompt_id", 16)}, {_HEX.format("session_id || ':session'", 16)},
      'turn', min(start_ns), max(end_ns), 0 FROM act_spans WHERE prompt_id IS NOT NULL GROUP BY 1, 2
    UNION ALL SELECT session_id, NULL, {_HEX.format('session_id', 32)}, {_HEX.format("session_id || ':session'", 16)}, NULL, 'session', a,
      greatest(a, z, coalesce(e, 0)), CASE WHEN verdict = 'high' THEN 2 ELSE 1 END
      FROM (SELECT session_id, epoch_us(CAST(arg_min(ts, seq) AS TIMESTAMP)) * 1000 AS a, epoch_us(CAST(arg_max(ts, seq) AS TIMESTAMP)) * 1000 AS z FROM activity GROUP BY 1)
      LEFT JOIN (SELECT session_id, max(end_ns) AS e FROM act_spans GROUP BY 1) USING (session_id) JOIN (SELECT * FROM verdicts WHERE ruleset = 'r4') USING (session_id)""")
def spans(spark, sf_dir):
    a = Activity(spark, sf_dir)
    return O.spans(a.actions, a.events, a.verdicts)


def span_events(spark, sf_dir):
    s = Story(spark, sf_dir)
    on = s.a.actions.select("session_id", "seq", F.explode(F.array_compact(F.array("seq", "post_seq"))).alias("at")).join(
        s.a.finding_seqs.withColumnRenamed("seq", "at"), ["session_id", "at"]).select("session_id", "seq", "combo").distinct()
    return O.span_events(s.a.actions, on, I.divergences(s.observed, s.told))


@query("span_events", "L12")
def span_event_rows(spark, sf_dir):
    return span_events(spark, sf_dir)


@query("otlp_lines", "A16 I31")
def otlp_lines(spark, sf_dir):
    return O.otlp_lines(spans(spark, sf_dir))


# ---- review -----------------------------------------------------------------

CTES["items"] = f"""
  SELECT session_id, 'combo' AS kind, combo AS id, combo AS item, severity, CASE WHEN severity = 'high' THEN 80 ELSE 50 END AS score, outcome, target, '' AS rule_ids,
    (SELECT list_sort(list(seq)) FROM finding_seqs q WHERE q.session_id = f.session_id AND q.combo = f.combo) AS seqs FROM findings f
  UNION ALL SELECT session_id, 'action', 'action-risk', item, CASE WHEN score >= 80 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END, score, outcome, target,
    array_to_string(list_sort(list_distinct(flatten(rules))), ','), seqs
  FROM (SELECT o.session_id, coalesce('tool:' || o.tool_use_id, 'seq:' || o.seq) AS item, max(CASE WHEN len(rf) > 0 AND score > 0 THEN score END) AS score,
      arg_min(outcome, (phase <> 'pre', o.seq)) AS outcome, arg_min(target, (phase <> 'pre', o.seq)) AS target,
      list(CASE WHEN len(rf) > 0 AND score > 0 THEN rf ELSE [] END) AS rules, list_sort(list(o.seq)) AS seqs
    FROM outcomes o LEFT JOIN (SELECT *, list_intersect(flags, {text_list(V.RISK_FLAGS)}) AS rf FROM risk) r ON r.session_id = o.session_id AND r.seq = o.seq
    GROUP BY 1, 2) WHERE score IS NOT NULL"""
CTES["keyed"] = """
  SELECT *, 'sha256:' || sha256('review-finding-v1' || chr(10) || '{"id":"' || id || '","kind":"' || kind || '","related_seqs":[' || array_to_string(seqs, ',') ||
    '],"ruleset_version":"r4","session_id":"' || session_id || '"}') AS key FROM items"""


@query("review_findings", "N15 N16 H2 I13 I23 I27 G4", """
    SELECT session_id, kind, id, item, severity, score, outcome, target, rule_ids, key, seqs[1] AS first_seq, len(seqs) AS seq_count FROM keyed""")
def review_findings(spark, sf_dir):
    return W.in_review_order(Story(spark, sf_dir).review[0].select(
        "session_id", "kind", "id", "item", "severity", "score", "outcome", "target", "rule_ids", "key", "first_seq", "seq_count"))


@query("finding_entities", "I24")
def finding_entities(spark, sf_dir):
    return Story(spark, sf_dir).review[1]


@query("finding_counts", "E18", """
    SELECT session_id, count_if(severity = 'high') AS high, count_if(severity = 'medium') AS medium, count_if(severity = 'low') AS low,
      count_if(outcome = 'attempted') AS attempted, count_if(outcome = 'succeeded') AS succeeded, count_if(outcome = 'failed') AS failed, count_if(outcome = 'unknown') AS unknown
    FROM items GROUP BY 1""")
def finding_counts(spark, sf_dir):
    return W.severity_outcome_counts(Story(spark, sf_dir).review[0])


# (id, finding_ids, rule_ids, hosts, paths, command_prefixes, mcp_servers)
POLICY = [
    ("docs-api", None, None, ["*.Example.com"], None, None, None),
    ("known-push", None, ["destructive-git"], None, None, ["git push"], None),
    ("tests-only", None, ["auth-edit"], None, ["tests/**"], None, None),
    ("srv-tool", ["tool-*", "injected-*"], None, None, None, None, ["EVIL"]),
]


def policy(spark) -> DataFrame:
    lists = "array<string>"
    rows = ", ".join("(" + ", ".join(
        [f"'{p[0]}'", "'known'"] + [("array(" + ", ".join(f"'{x}'" for x in v) + ")") if v else f"CAST(NULL AS {lists})" for v in p[1:]]) + ")" for p in POLICY)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(id, reason, {', '.join(V.POLICY_SELECTORS)})")


CTES["evidence_of"] = """
  SELECT DISTINCT i.session_id, i.item, i.kind, f.host, f.server FROM items i, unnest(i.seqs) AS u(seq)
  JOIN flags f ON f.session_id = i.session_id AND f.seq = u.seq AND f.ruleset = 'r4' WHERE i.kind = 'action'"""
CTES["targets_of"] = """
  SELECT DISTINCT i.session_id, i.item, i.kind, a.target, a.action_type, CASE WHEN starts_with(a.tool_name, 'mcp__') THEN string_split(a.tool_name, '__')[2] END AS server
  FROM items i, unnest(i.seqs) AS u(seq) JOIN activity a ON a.session_id = i.session_id AND a.seq = u.seq"""
_T = "EXISTS (SELECT 1 FROM targets_of t WHERE t.session_id = i.session_id AND t.item = i.item AND t.kind = i.kind AND {})"
_EV = "EXISTS (SELECT 1 FROM evidence_of t WHERE t.session_id = i.session_id AND t.item = i.item AND t.kind = i.kind AND {})"
_OWN = "EXISTS (SELECT 1 FROM findings f WHERE i.kind = 'combo' AND f.session_id = i.session_id AND f.combo = i.id AND regexp_matches(lower(f.host), '^.*[.]example[.]com$'))"
CTES["expected"] = f"""
  SELECT session_id, kind, item, 'docs-api' AS entry FROM items i WHERE {_OWN} OR {_EV.format("regexp_matches(lower(t.host), '^.*[.]example[.]com$')")}
    OR {_T.format("regexp_matches(t.target, '(?i)https?://[a-z0-9.-]*[.]example[.]com([/:?].*|$|[^a-z0-9.-].*)')")}
  UNION ALL SELECT session_id, kind, item, 'known-push' FROM items i WHERE list_contains(string_split(rule_ids, ','), 'destructive-git')
    AND {_T.format(SHELL.replace('action_type', 't.action_type') + " AND (t.target = 'git push' OR t.target LIKE 'git push %')")}
  UNION ALL SELECT session_id, kind, item, 'tests-only' FROM items i WHERE list_contains(string_split(rule_ids, ','), 'auth-edit')
    AND {_T.format("t.action_type LIKE 'file_%' AND regexp_matches(t.target, '(^|/)tests/.*$')")}
  UNION ALL SELECT session_id, kind, item, 'srv-tool' FROM items i WHERE (id LIKE 'tool-%' OR id LIKE 'injected-%') AND {_T.format("lower(t.server) = 'evil' AND t.action_type = 'mcp_call'")}"""


@query("expected_findings", "D16 I22", "SELECT session_id, kind, item, entry FROM expected")
def expected_findings(spark, sf_dir):
    s = Story(spark, sf_dir)
    return W.expected_matches(*s.review, policy(spark)).select("session_id", "kind", "item", "entry")


@query("labelled_findings", "N17", """
    SELECT session_id, kind, item, expected_by, expected_by IS NOT NULL AS expected FROM items LEFT JOIN (
      SELECT session_id, kind, item, array_to_string(list_sort(list(entry)), ',') AS expected_by FROM expected GROUP BY 1, 2, 3) USING (session_id, kind, item)""")
def labelled_findings(spark, sf_dir):
    s = Story(spark, sf_dir)
    matches = W.expected_matches(*s.review, policy(spark))
    return W.with_expected(s.review[0], matches).select("session_id", "kind", "item", "expected_by", "expected")


# A policy per customer: an entry per order, its patterns from the order's lines in whatever order they come.
_LINES = "list_sort(list({} || l_linenumber) FILTER (l_linenumber % 2 = {}))"
CTES["policy_entries"] = f"""
  SELECT o_custkey AS policy_id, 'e' || o_orderkey AS id, {_LINES.format("'h' || l_suppkey || '.example.com/'", 0)} AS hosts, {_LINES.format("'src/p' || l_partkey || '/'", 1)} AS paths
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2"""


def customer_policies(spark, sf_dir) -> DataFrame:
    c, text = F.col, lambda *p: F.concat(*[x.cast("string") if isinstance(x, F.Column) else F.lit(x) for x in p])
    lines = B.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    rows = B.table(spark, sf_dir, "orders").join(lines, c("o_orderkey") == c("l_orderkey"))
    some = lambda cond, value: F.nullif(F.collect_list(F.when(cond, value)), F.array().cast("array<string>"))
    entries = rows.groupBy(c("o_custkey").alias("policy_id"), text("e", c("o_orderkey")).alias("id")).agg(
        some(c("l_linenumber") % 2 == 0, text("h", c("l_suppkey"), ".example.com/", c("l_linenumber"))).alias("hosts"),
        some(c("l_linenumber") % 2 == 1, text("src/p", c("l_partkey"), "/", c("l_linenumber"))).alias("paths"))
    return entries.withColumns({"reason": F.lit("usual work"), **{n: F.lit(None).cast("array<string>") for n in V.POLICY_SELECTORS if n not in ("hosts", "paths")}})


@query("policy_hashes", "I14", f"""
    SELECT policy_id, 'sha256:' || sha256({text_literal(W.POLICY_DOMAIN)} || '{{"expected":[' || string_agg(e, ',' ORDER BY id) || '],"version":1}}') AS policy_hash FROM (
      SELECT policy_id, id, '{{' || coalesce('"hosts":' || CAST(to_json(hosts) AS VARCHAR) || ',', '') || '"id":"' || id || '"' ||
        coalesce(',"paths":' || CAST(to_json(paths) AS VARCHAR), '') || ',"reason":"usual work"}}' AS e FROM policy_entries) GROUP BY 1""")
def policy_hashes(spark, sf_dir):
    return W.policy_hashes(customer_policies(spark, sf_dir), "policy_id")


# Decisions: two of three findings were decided, some before the session's last event or under another policy.
def reviews(items: DataFrame, heads: DataFrame) -> DataFrame:
    n = F.conv(F.substring("key", 8, 4), 16, 10).cast("int")
    first = items.join(heads, "session_id").filter(n % 3 != 0).select(
        "session_id", "key", F.concat(F.lit("a"), n.cast("string")).alias("review_id"), F.lit("2024-02-01").alias("created_at"),
        F.get(F.array(F.lit("acknowledged"), F.lit("expected"), F.lit("false_positive"), F.lit("unreviewed")), n % 4).alias("disposition"),
        F.when(n % 5 == 0, F.col("head_seq") - 1).otherwise(F.col("head_seq")).alias("reviewed_seq"), F.col("head_hash").alias("reviewed_hash"),
        F.when(n % 7 == 0, "sha256:old").alias("policy_hash"))
    again = first.filter(F.conv(F.substring("key", 8, 4), 16, 10).cast("int") % 11 == 0).withColumns({
        "review_id": F.concat(F.lit("b"), "review_id"), "created_at": F.lit("2024-03-01"), "disposition": F.lit("acknowledged")})
    return first.unionByName(again)


def heads_of(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id").agg(F.max("seq").alias("head_seq")).withColumn("head_hash", F.concat(F.lit("h-"), "session_id"))


_N = "CAST('0x' || key[8:11] AS INT)"
CTES["decided"] = f"""
  SELECT session_id, kind, item, severity, outcome, n % 3 <> 0 AND (n % 5 = 0 OR n % 7 = 0) AS stale,
    CASE WHEN n % 3 <> 0 AND NOT (n % 5 = 0 OR n % 7 = 0) THEN CASE WHEN n % 11 = 0 THEN 'acknowledged' ELSE ['acknowledged', 'expected', 'false_positive', 'unreviewed'][n % 4 + 1] END
      ELSE 'unreviewed' END AS disposition
  FROM (SELECT *, {_N} AS n FROM keyed)"""


def decided(spark, sf_dir) -> DataFrame:
    s = Story(spark, sf_dir)
    heads = heads_of(s.a.events)
    return W.with_decisions(s.review[0], reviews(s.review[0], heads), heads, F.lit(None).cast("string"))


@query("review_decisions", "D19 F10 N18", "SELECT session_id, kind, item, stale, disposition FROM decided")
def review_decisions(spark, sf_dir):
    return decided(spark, sf_dir).select("session_id", "kind", "item", "stale", "disposition")


CTES["review_counts"] = """
  SELECT session_id, count(*) AS total, count_if(disposition = 'unreviewed') AS unresolved, count_if(stale) AS stale, count_if(disposition = 'acknowledged') AS acknowledged,
    count_if(disposition = 'expected') AS expected, count_if(disposition = 'false_positive') AS false_positive, count_if(disposition = 'unreviewed' AND severity = 'high') AS open_high,
    count_if(disposition = 'unreviewed' AND severity = 'medium') AS open_medium, count_if(disposition = 'unreviewed' AND severity = 'low') AS open_low,
    CASE WHEN count_if(disposition = 'unreviewed') > 0 THEN 'needs_review' ELSE 'reviewed' END AS status FROM decided GROUP BY 1"""


@query("review_counts", "E19", "SELECT * FROM review_counts")
def review_counts(spark, sf_dir):
    return W.review_counts(decided(spark, sf_dir))


@query("guarded_decisions", "N19 N18", """
    SELECT review_id, session_id, refusal, CASE WHEN refusal IS NULL THEN 'token=[REDACTED:assigned-secret] seen' || CASE WHEN n % 2 = 0 THEN repeat('x', 963) ELSE '' END END AS note,
      CASE WHEN refusal IS NULL THEN head_seq END AS reviewed_seq, CASE WHEN refusal IS NULL AND m = 1 THEN 'p1' END AS policy_hash
    FROM (SELECT *, CASE WHEN n % 4 = 3 THEN 'invalid' WHEN n % 3 = 2 THEN 'not-current' WHEN m = 2 THEN 'invalid-policy' END AS refusal FROM (
      SELECT 'r' || key AS review_id, session_id, CAST('0x' || key[8:11] AS INT) AS n, head_seq, length(session_id) % 3 AS m
      FROM keyed JOIN (SELECT session_id, max(seq) AS head_seq FROM activity GROUP BY 1) USING (session_id)))""")
def guarded_decisions(spark, sf_dir):
    """Decisions on all findings, some of a wrong kind, some on findings that are gone, some under an invalid policy."""
    s, c = Story(spark, sf_dir), F.col
    items, heads = s.review[0], heads_of(s.a.events)
    n = F.conv(F.substring("key", 8, 4), 16, 10).cast("int")
    note = F.concat(F.lit("  token=abcdef"), n.cast("string"), F.lit(" seen"), F.when(n % 2 == 0, F.repeat(F.lit("x"), 2000)).otherwise(""), F.lit("  "))
    sent = items.select(F.concat(F.lit("r"), "key").alias("review_id"), "session_id", F.when(n % 3 == 2, F.concat(F.lit("gone-"), "key")).otherwise(c("key")).alias("key"),
                        F.when(n % 4 == 3, "maybe").otherwise("expected").alias("disposition"), note.alias("note"), F.lit("2024-02-01").alias("created_at"))
    m = F.length("session_id") % 3
    policies = heads.filter(m != 0).select("session_id", F.when(m == 1, "p1").alias("policy_hash"), F.when(m == 2, "bad pattern").alias("error"))
    return W.accept_reviews(sent, items, heads, policies).select("review_id", "session_id", "refusal", "note", "reviewed_seq", "policy_hash")


@query("severity_gate", "C24", "SELECT session_id FROM review_counts WHERE open_high + open_medium > 0")
def severity_gate(spark, sf_dir):
    return W.gate(W.review_counts(decided(spark, sf_dir)), "medium").select("session_id")


CTES["inbox"] = """
  SELECT r.session_id, unresolved, c.score, c.ended, coalesce(regexp_extract(cwd, '[^/]+$'), 'No project') AS project, v.branch, v.commit FROM review_counts r
  JOIN cards c USING (session_id) LEFT JOIN (SELECT session_id, arg_max(anchor_sha, seq) AS "commit", nullif(arg_max(coalesce(anchor_branch, ''), seq), '') AS branch
    FROM activity WHERE anchor_sha IS NOT NULL GROUP BY 1) v USING (session_id) WHERE unresolved > 0"""


def inbox(spark, sf_dir):
    a = Activity(spark, sf_dir)
    return W.inbox(W.review_counts(decided(spark, sf_dir)), a.cards, N.last_anchor(a.events))


@query("review_inbox", "G5 N18", "SELECT session_id, unresolved, score, ended, project FROM inbox")
def review_inbox(spark, sf_dir):
    return inbox(spark, sf_dir).select("session_id", "unresolved", "score", "ended", "project")


@query("inbox_groups", "E20", """
    SELECT project, coalesce(branch, 'detached') AS branch, coalesce("commit", 'no-commit') AS "commit", count(*) AS sessions, CAST(sum(unresolved) AS BIGINT) AS open FROM inbox GROUP BY 1, 2, 3""")
def inbox_groups(spark, sf_dir):
    return W.inbox_groups(inbox(spark, sf_dir))


@query("attestation_aggregates", "A19", """
    SELECT session_id, first_seq, last_seq, event_count, agent_sources, verdict, score, total, unresolved FROM
      (SELECT session_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS event_count,
        coalesce(array_to_string(list_sort(list(DISTINCT source) FILTER (source NOT IN ('git', 'recorder'))), ','), '') AS agent_sources FROM activity GROUP BY 1)
    JOIN (SELECT * FROM verdicts WHERE ruleset = 'r4') USING (session_id) LEFT JOIN review_counts USING (session_id)""")
def attestation_aggregates(spark, sf_dir):
    s = Story(spark, sf_dir)
    identity = s.a.events.groupBy("session_id").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("event_count"))
    return W.attestations(identity, W.agent_sources(s.a.events), s.a.verdicts.select("session_id", "verdict", "score"),
                          W.severity_outcome_counts(s.review[0]), W.review_counts(decided(spark, sf_dir))).select(
        "session_id", "first_seq", "last_seq", "event_count", "agent_sources", "verdict", "score", "total", "unresolved")


@query("attestation_check", "D30", """
    SELECT session_id, CASE WHEN session_id LIKE '%d9' THEN 'range-mismatch' ELSE 'ok' END AS status FROM summary""")
def attestation_check(spark, sf_dir):
    e = Activity(spark, sf_dir).events
    now = e.groupBy("session_id").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("event_count"),
                                     F.max_by("event_id", "seq").alias("last_hash"))
    claims = now.withColumn("event_count", F.col("event_count") + F.when(F.col("session_id").endswith("d9"), 1).otherwise(0))
    return W.check_attestations(claims, now).select("session_id", "status")


# ---- reports ----------------------------------------------------------------

def report(spark, sf_dir) -> DataFrame:
    a = Activity(spark, sf_dir)
    return M.report_lines(a.cards, A.action_counts(a.events), a.findings, a.actions, A.danger_notes(a.risk, a.events))


@query("report_lines", "A17 I18 G2")
def report_lines(spark, sf_dir):
    return report(spark, sf_dir)


def case_file(spark, sf_dir) -> DataFrame:
    from vigilog.plans.table_queries import marks, recomputed
    from vigilog.plans import bridges as B
    s = Story(spark, sf_dir)
    rows = B.chain(spark, sf_dir)
    status = C.custody_status(rows, C.chain_breaks(rows, recomputed()), marks(spark, sf_dir))
    return M.case_lines(report(spark, sf_dir), status, s.files, s.commits, I.divergences(s.observed, s.told), L.numbered(s.checklist))


@query("case_file_manifests", "A18")
def case_file_manifests(spark, sf_dir):
    return M.manifests(case_file(spark, sf_dir))


# ---- bodies -----------------------------------------------------------------

CTES["blobs"] = """
  SELECT content_hash, min(ts) AS created_at, 'body of ' || content_hash AS content, CAST(length('body of ' || content_hash) AS BIGINT) AS bytes FROM activity WHERE mutated AND mut_stored GROUP BY 1"""
_CUTOFF = "2024-01-28T00:00:00.000Z"


def blobs(events: DataFrame) -> DataFrame:
    h = F.col("d.mutation.content_hash")
    body = F.concat(F.lit("body of "), "content_hash")
    return events.filter(h.isNotNull() & F.col("d.mutation.stored")).groupBy(h.alias("content_hash")).agg(F.min("ts").alias("created_at")).select(
        "content_hash", "created_at", body.alias("content"), F.length(body).cast("bigint").alias("bytes"), F.lit(None).cast("string").alias("pruned_at"))


@query("mutation_views", "D17 B20", f"""
    SELECT session_id, seq, mut_kind AS kind, CASE WHEN NOT mut_stored THEN 'skipped' WHEN b.content IS NOT NULL AND live THEN 'available' ELSE 'pruned' END AS status, mut_skip AS skip_reason
    FROM activity a LEFT JOIN (SELECT b.*, content_hash IN (SELECT content_hash FROM activity WHERE mutated AND ts >= '{_CUTOFF}') AS live FROM blobs b) b USING (content_hash) WHERE mutated""")
def mutation_views(spark, sf_dir):
    e = Activity(spark, sf_dir).events
    return A.mutation_views(e, C.prune_blobs(blobs(e), e, _CUTOFF, "2024-03-01")).select("session_id", "seq", "kind", "status", "skip_reason")


@query("pruned_blobs", "H5 M9", f"""
    SELECT content_hash, bytes, content_hash NOT IN (SELECT content_hash FROM activity WHERE mutated AND ts >= '{_CUTOFF}') AS pruned_now FROM blobs""")
def pruned_blobs(spark, sf_dir):
    e = Activity(spark, sf_dir).events
    return C.prune_blobs(blobs(e), e, _CUTOFF, "2024-03-01").select("content_hash", "bytes", "pruned_now")


@query("blob_stats", "E26", f"""
    SELECT count(*) AS blobs, count_if(NOT p) AS live, count_if(p) AS pruned, coalesce(CAST(sum(CASE WHEN p THEN bytes END) AS BIGINT), 0) AS bytes_freed
    FROM (SELECT *, content_hash NOT IN (SELECT content_hash FROM activity WHERE mutated AND ts >= '{_CUTOFF}') AS p FROM blobs)""")
def blob_stats(spark, sf_dir):
    e = Activity(spark, sf_dir).events
    return C.blob_stats(C.prune_blobs(blobs(e), e, _CUTOFF, "2024-03-01"))


@query("file_history", "N6", "SELECT session_id, target AS path, seq, mut_kind AS kind, content_hash, mut_redacted AS redacted FROM activity WHERE mutated")
def file_history(spark, sf_dir):
    e = Activity(spark, sf_dir).events
    return Y.file_history(A.mutation_views(e, blobs(e))).select("session_id", "path", "seq", "kind", "content_hash", "redacted")


@query("reconstructed_files", "N7 K3")
def reconstructed_files(spark, sf_dir):
    e = Activity(spark, sf_dir).events
    return Y.reconstruct(Y.file_history(A.mutation_views(e, blobs(e)))).drop("content")


@query("command_profile", "N9")
def command_profile(spark, sf_dir):
    return Y.command_profile(Activity(spark, sf_dir).events)


@query("event_dossiers", "B19")
def event_dossiers(spark, sf_dir):
    a = Activity(spark, sf_dir)
    return A.dossiers(a.events, a.risk, a.finding_seqs, A.mutation_views(a.events, blobs(a.events))).select(
        "session_id", "seq", "outcome", "score", joined("flags").alias("flags"), joined("findings").alias("findings"), "kind", "status")
