"""Reference answers in plain SQL, for checking the Spark queries with DuckDB.

`CTES` holds named building blocks with their dependencies; `sql(body)` prefixes a
query with the blocks it names. Nothing here runs in the engine itself.
"""

from __future__ import annotations

import re

from vigilog.functions import fixed_values as V
from vigilog.plans import templates as K


def text_literal(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def text_list(values: list) -> str:
    return "[" + ", ".join(text_literal(v) for v in values) + "]"


def in_list(values: list) -> str:
    return "(" + ", ".join(text_literal(v) for v in values) + ")"


def like(column: str, pattern: str) -> str:
    """RE2 match; the patterns used here need no lookaround."""
    return f"regexp_matches({column}, {text_literal(pattern)})"


def any_like(column: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(like(column, p) for p in patterns) + ")"


def sensitive(path: str) -> str:
    base = f"list_extract(string_split({path}, '/'), -1)"
    return (f"(CASE WHEN {like(base, V.TEMPLATE_SUFFIX)} THEN false ELSE "
            f"({like(path, V.SENSITIVE_SEGMENT)} OR {any_like(base, V.SENSITIVE_BASENAMES)}) END)")


def first_sensitive(command: str) -> str:
    return (f"list_filter(list_transform(regexp_split_to_array({command}, {text_literal(V.COMMAND_SEPARATORS)}), "
            f"lambda t: regexp_replace(t, '^@', '')), lambda t: t <> '' AND {sensitive('t')})[1]")


def local_host(host: str) -> str:
    return like(f"regexp_replace(lower({host}), '^\\[|\\]$', '', 'g')", V.LOCAL_HOST)


def plausible_host(host: str) -> str:
    tld = f"lower(list_extract(string_split({host}, '.'), -1))"
    v4 = like(host, r"^\d{1,3}(\.\d{1,3}){3}$")
    v6 = like(host, "(?i)^[0-9a-f:]+$")
    return (f"({v4} OR (contains({host}, ':') AND {v6}) OR (contains({host}, '.') AND "
            f"{like(tld, '^[a-z]{2,}$')} AND {tld} NOT IN {in_list(V.NOT_A_TLD)}))")


def strip_port(host: str) -> str:
    return f"regexp_replace({host}, ':\\d+$', '')"


def strip_user(host: str) -> str:
    return f"list_extract(string_split({host}, '@'), -1)"


def catastrophic(token: str) -> str:
    t = f"regexp_replace({token}, '^[''\"]|[''\"]$', '', 'g')"
    parts = f"list_filter(string_split(regexp_replace(regexp_replace({t}, '/+$', ''), '/\\*$', ''), '/'), lambda p: p <> '')"
    child = f"regexp_replace(regexp_extract({t}, {text_literal(V.HOME_ROOT)}, 3), '/+$', '')"
    return f"""(CASE WHEN {t} = '' THEN false WHEN {like(t, V.BARE_ROOT)} THEN true
      WHEN regexp_replace(regexp_replace({t}, '^\\./', ''), '/+$', '') IN {in_list(V.VCS_DIRECTORIES)} THEN true
      WHEN {like(t, V.HOME_ROOT)} THEN {child} = '' OR string_split({child}, '/')[1] IN {in_list(V.SENSITIVE_HOME_CHILDREN)}
      WHEN starts_with({t}, '/') THEN CASE WHEN {like(t, V.SCRATCH_ROOT)} THEN false WHEN len({parts}) <= 1 THEN true
        WHEN lower(array_to_string({parts}[1:2], '/')) IN {in_list(V.CATASTROPHIC_PREFIXES)} THEN true
        ELSE len({parts}) <= 2 AND lower({parts}[1]) IN {in_list(V.SYSTEM_ROOTS)} END
      ELSE false END)"""


SHELL = "action_type IN ('shell_command', 'git_action')"
CHANGE = "action_type IN ('file_write', 'file_edit')"
BARE = f"regexp_replace(target, {text_literal(V.QUOTED)}, ' ', 'g')"
OUTSIDE_URLS = (f"list_filter(list_transform(regexp_extract_all(target, {text_literal(V.URL_HOST)}, 1), "
                f"lambda h: {strip_port(strip_user('h'))}), lambda h: h <> '' AND NOT {local_host('h')})")
OUTSIDE_DOMAINS = (f"list_filter(regexp_extract_all(target, {text_literal(V.BARE_DOMAIN)}, 1), "
                   f"lambda h: NOT {local_host('h')} AND NOT {like('h', V.FILE_EXTENSION)})")
STATE = (r"(/\.recorder(/|$)|\$\{?RECORDER_HOME\}?|\brecorder\.db\b|\bsigning\.(key|head)\b)")
TAMPER = [STATE, r"\brecorder\s+(stop|uninit|prune)\b", r"\b(pkill|killall|kill)\b[^\n|&;]*\brecorder\b",
          r"\blaunchctl\s+(unload|bootout|remove|disable)\b[^\n]*\bcom\.recorder",
          r"\bsqlite3\b[^\n]*\brecorder\.db\b", V.GIT_HOOK_ATTACK]

CTES: dict[str, str] = {}

CTES["base"] = f"""
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY tm, event_id) AS rn FROM (
    SELECT 'u' || user_id || '-d' || ((day(ts) - 1) // 3) AS session_id, event_id, user_id, event_type, value,
           ts AS tm, CAST(json_extract(props, '$.k') AS INT) % 40 AS k
    FROM events)"""

CTES["activity"] = f"""
  SELECT *, CASE WHEN redaction_type IS NOT NULL THEN 1 ELSE 0 END AS redaction_count,
         CASE WHEN phase = 'post' THEN 1 WHEN phase = 'failure' THEN 0 END AS success
  FROM (
  SELECT b.session_id, CAST(2 * rn - 1 + half AS BIGINT) AS seq, CAST(event_id AS VARCHAR) AS event_id, k, rn, user_id,
    event_type, CASE WHEN NOT single THEN 't' || event_id END AS tool_use_id,
    CASE WHEN k NOT IN (16, 19, 36) THEN b.session_id || '-t' || ((rn - 1) // 5) END AS prompt_id,
    CASE WHEN k = 16 THEN 'post' WHEN k = 17 THEN 'prompt' WHEN k = 18 THEN 'reasoning' WHEN k = 19 THEN 'session_start'
         WHEN k = 36 THEN 'session_end' WHEN k = 37 THEN 'stop'
         WHEN half = 1 AND event_type = 'error' THEN 'failure' WHEN half = 1 THEN 'post' ELSE 'pre' END AS phase,
    CASE WHEN k = 16 THEN 'GitRefTransaction' WHEN k = 17 THEN 'UserPromptSubmit' WHEN k = 18 THEN 'ReasoningCapture'
         WHEN k = 19 THEN 'SessionStart' WHEN k = 36 THEN 'SessionEnd' WHEN k = 37 THEN 'Stop'
         WHEN half = 1 AND event_type = 'error' THEN 'PostToolUseFailure' WHEN half = 1 THEN 'PostToolUse'
         ELSE 'PreToolUse' END AS hook_event,
    {text_list([t[1] for t in K.TEMPLATES])}[k + 1] AS tool_name,
    {text_list([t[0] for t in K.TEMPLATES])}[k + 1] AS action_type,
    {text_list([t[2] for t in K.TEMPLATES])}[k + 1] AS target,
    CASE WHEN event_id % 17 = 0 THEN 'ag' || (user_id % 5) END AS agent_id,
    CASE WHEN k = 16 THEN 'git' WHEN k = 18 THEN 'recorder' WHEN event_type = 'view' THEN 'gemini-cli'
         WHEN event_type = 'purchase' THEN 'codex-cli' ELSE 'claude-code' END AS source,
    CASE WHEN event_id % 17 = 0 THEN 'explorer' ELSE 'main' END AS agent_type,
    CASE WHEN event_id % 10 <> 0 THEN '/repo/p' || (user_id % 25) END AS cwd,
    CASE WHEN half = 1 THEN CAST(floor(value * 10) AS BIGINT) END AS duration_ms,
    strftime(tm, '%Y-%m-%dT%H:%M:%S.%gZ') AS ts,
    CASE WHEN half = 1 AND k = 10 THEN ['ignore-instructions', 'disregard'] WHEN half = 1 AND k = 11 THEN ['ignore-instructions']
         WHEN half = 1 AND k = 38 THEN ['you-are-now'] END AS markers,
    CASE WHEN half = 1 AND k = 1 THEN 'path-sensitive-content' WHEN k = 14 AND event_id % 3 = 0 THEN 'assigned-secret' END AS redaction_type,
    CASE WHEN half = 1 AND k = 1 THEN 64 WHEN k = 14 AND event_id % 3 = 0 THEN 12 END AS redaction_bytes,
    CASE WHEN NOT single AND event_id % 23 = 0 THEN 'Step ' || (event_id % 9) END AS description,
    CASE WHEN k = 17 THEN CASE WHEN event_id % 9 = 0 THEN '<system-reminder> keep going'
         ELSE 'Please review item ' || (event_id % 100) || ' in the build' END END AS prompt,
    CASE WHEN k = 18 THEN {text_list(K.NARRATIVES)}[event_id % 4 + 1] END AS reasoning,
    mutated, CASE WHEN mutated THEN CASE WHEN k IN (9, 33) THEN 'body' ELSE 'patch' END END AS mut_kind,
    CASE WHEN mutated THEN 'sha256:' || sha256('body-' || (event_id % 97)) END AS content_hash,
    CASE WHEN mutated THEN event_id % 97 * 10 END AS mut_bytes,
    CASE WHEN mutated THEN CAST(floor(value) AS BIGINT) % 40 END AS mut_ins, CASE WHEN mutated THEN event_id % 7 END AS mut_del,
    CASE WHEN mutated THEN event_id % 11 <> 0 END AS mut_stored,
    CASE WHEN mutated AND event_id % 11 = 0 THEN 'oversize' END AS mut_skip,
    CASE WHEN mutated THEN event_id % 13 = 0 END AS mut_redacted,
    CASE WHEN mutated AND k = 13 THEN ['tls-verify-disabled'] END AS weakens,
    CASE WHEN k IN (19, 36) THEN sha256('base-' || b.session_id || (event_id % 3))[1:40] END AS anchor_sha,
    CASE WHEN k IN (19, 36) AND event_id % 4 <> 0 THEN CASE WHEN event_id % 2 = 0 THEN 'dev' ELSE 'main' END END AS anchor_branch,
    CASE WHEN k IN (19, 36) AND event_id % 4 = 0 THEN 'not-a-repo' END AS anchor_reason,
    CASE WHEN k = 16 THEN CASE event_id % 4 WHEN 0 THEN 'force' WHEN 1 THEN 'reset' ELSE 'commit' END END AS git_kind,
    CASE WHEN k = 16 THEN event_id % 4 IN (0, 1) END AS git_force, CASE WHEN k = 16 THEN event_id % 4 = 1 END AS git_reset,
    CASE WHEN k = 16 THEN event_id % 40 END AS git_files, CASE WHEN k = 16 THEN event_id * 7 % 2000 END AS git_ins,
    CASE WHEN k = 16 THEN event_id * 13 % 900 END AS git_del,
    CASE WHEN k = 16 AND event_id % 5 <> 0 THEN sha256(CAST(event_id AS VARCHAR))[1:40] END AS commit_sha,
    CASE WHEN k = 16 AND event_id % 5 <> 0 THEN 'fix ' || (event_id % 50) END AS commit_subject
  FROM (SELECT b.*, h.half, k IN (16, 17, 18, 19, 36, 37) AS single,
               h.half = 1 AND event_type <> 'error' AND k IN (7, 8, 9, 13, 33, 34) AS mutated
        FROM base b CROSS JOIN (VALUES (0), (1)) h(half)
        WHERE h.half = 0 OR NOT (k IN (16, 17, 18, 19, 36, 37) OR event_type = 'signup')) b)"""

CTES["facts"] = f"""
  SELECT a.*, redaction_count > 0 OR sensitive_path IS NOT NULL AS secret_touch,
    CASE WHEN redaction_count > 0 THEN NULL ELSE sensitive_path END AS touch_path,
    CASE WHEN via IN {in_list(['curl-data', 'pipe-file', 'script'])} THEN host
         WHEN via = 'query-payload' THEN query_host WHEN via = 'netcat' THEN nc_host
         WHEN via = 'scp' THEN scp_host WHEN via = 'mcp-url' THEN mcp_host END AS send_host,
    CASE WHEN via IS NOT NULL AND {SHELL} THEN sensitive_path END AS send_secret
  FROM (SELECT a.*,
    CASE WHEN {SHELL} THEN
      CASE WHEN {like('target', V.CURL_OR_WGET)} AND {like('target', V.DATA_FLAG)} AND host IS NOT NULL THEN 'curl-data'
           WHEN {like('target', V.PIPE_TO_CURL)} AND host IS NOT NULL THEN 'pipe-file'
           WHEN {like('target', V.SCRIPT_NETWORK)} AND host IS NOT NULL THEN 'script'
           WHEN query_host IS NOT NULL THEN 'query-payload' WHEN nc_host IS NOT NULL THEN 'netcat'
           WHEN scp_host IS NOT NULL THEN 'scp' END
      WHEN action_type = 'web_fetch' AND query_host IS NOT NULL THEN 'query-payload'
      WHEN action_type = 'mcp_call' AND mcp_host IS NOT NULL THEN 'mcp-url' END AS via
  FROM (SELECT a.*,
    CASE WHEN action_type LIKE 'file_%' THEN CASE WHEN {sensitive('target')} THEN target END
         WHEN {SHELL} THEN {first_sensitive('target')} END AS sensitive_path,
    {OUTSIDE_URLS} AS url_hosts,
    coalesce({OUTSIDE_URLS}[1], {OUTSIDE_DOMAINS}[1]) AS host,
    list_filter(list_zip(regexp_extract_all(target, {text_literal(V.URL_WITH_PATH)}, 1), regexp_extract_all(target, {text_literal(V.URL_WITH_PATH)}, 2)),
      lambda x: NOT {local_host('x[1]')} AND contains(x[2], '?') AND length(x[2]) - instr(x[2], '?') >= 40)[1][1] AS query_host,
    CASE WHEN {SHELL} AND regexp_extract(target, {text_literal(V.NETCAT)}, 1) <> '' AND NOT {local_host(f"regexp_extract(target, {text_literal(V.NETCAT)}, 1)")}
      THEN regexp_extract(target, {text_literal(V.NETCAT)}, 1) END AS nc_host,
    CASE WHEN {SHELL} AND regexp_extract(target, {text_literal(V.REMOTE_COPY)}, 1) <> '' THEN regexp_extract(target, {text_literal(V.REMOTE_COPY)}, 1) END AS scp_host,
    CASE WHEN action_type = 'mcp_call' AND len({OUTSIDE_URLS}) > 0 THEN {OUTSIDE_URLS}[1] END AS mcp_host,
    CASE WHEN starts_with(tool_name, 'mcp__') THEN string_split(tool_name, '__')[2] END AS server,
    CASE WHEN action_type = 'mcp_call' THEN {first_sensitive('target')} END AS outbound_path,
    phase = 'failure' AS failed,
    coalesce({SHELL} AND ({any_like(BARE, V.PIPE_TO_SHELL)} OR {like(BARE, V.CHMOD_OPEN)} OR
      ({like(f"regexp_extract({BARE}, '\\brm\\b[^|&;\\n]*')", V.RM_RECURSIVE)} AND {like(f"regexp_extract({BARE}, '\\brm\\b[^|&;\\n]*')", V.RM_FORCE)})), false) AS shell_any_rm,
    coalesce({SHELL} AND ({any_like(BARE, V.PIPE_TO_SHELL)} OR {like(BARE, V.CHMOD_OPEN)} OR
      ({like(BARE, r'\brm\b')} AND {like(f"regexp_extract({BARE}, '\\brm\\b[^|&;\\n]*')", V.RM_RECURSIVE)} AND {like(f"regexp_extract({BARE}, '\\brm\\b[^|&;\\n]*')", V.RM_FORCE)}
       AND len(list_filter(regexp_split_to_array(regexp_extract(target, '\\brm\\b([^|&;\\n]*)', 1), '\\s+'),
               lambda w: w <> '' AND NOT starts_with(w, '-') AND {catastrophic('w')})) > 0)), false) AS shell,
    coalesce({CHANGE} AND {like('target', V.AUTH_SEGMENT)}, false) AS auth_path,
    coalesce({CHANGE} AND {like('target', V.AUTH_SEGMENT_STRONG)}, false) AS strong_auth_path,
    coalesce({CHANGE} AND {like('target', V.CI_BUILD_PATH)}, false) AS ci_path,
    coalesce({like('target', V.TEST_PATH)}, false) AS test_path,
    coalesce(git_force OR git_reset, false) OR coalesce({SHELL} AND {any_like('target', V.GIT_DESTRUCTIVE)}, false) AS git_destructive,
    CASE WHEN git_del >= 500 AND git_del > 3 * git_ins THEN 'bulk-delete'
         WHEN git_files >= 25 OR git_ins + git_del >= 1500 THEN 'mass' END AS mass_kind,
    coalesce(CASE WHEN {CHANGE} THEN {like('target', STATE)} OR {like('target', V.AGENT_HOOK_SETTINGS)}
         WHEN {SHELL} THEN {any_like('target', TAMPER)} END, false) AS tamper,
    coalesce(CASE WHEN action_type = 'web_fetch' THEN len(list_intersect(markers, {text_list(V.STRONG_MARKERS + V.CORROBORATING_MARKERS)})) >= 2
         WHEN action_type = 'mcp_call' THEN len(list_intersect(markers, {text_list(V.STRONG_MARKERS)})) >= 1
           OR len(list_intersect(markers, {text_list(V.STRONG_MARKERS + V.CORROBORATING_MARKERS)})) >= 2 END, false) AS arms
  FROM activity a) a) a"""

CTES["servers"] = "SELECT session_id, server, min(seq) AS seq FROM facts WHERE server IS NOT NULL GROUP BY ALL"

CTES["rules"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{r}', '{k}', '{f}', {s})" for r, k, f, s in V.RULE_SCORES) + ") t(ruleset, rule_key, flag, score)"

CTES["combo_rules"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{r}', '{v}', '{c}', '{s}')" for r, v, c, s in V.COMBO_RULES) + ") t(ruleset, variant, combo, severity)"

_NO = "NULL AS path, NULL AS host, NULL AS via, NULL AS secret, NULL AS server, NULL AS patterns, NULL AS kind"
_HITS = [
    ("failed", "'failed'", _NO),
    ("secret_touch", "'secret-touch'", _NO.replace("NULL AS path", "touch_path AS path")),
    ("shell_any_rm", "'dangerous-shell-any-rm'", _NO),
    ("shell", "'dangerous-shell'", _NO),
    ("auth_path", "CASE WHEN test_path THEN 'auth-edit-test' ELSE 'auth-edit' END", _NO.replace("NULL AS path", "target AS path")),
    ("git_destructive", "'destructive-git'", _NO),
    ("mass_kind IS NOT NULL", "CASE WHEN mass_kind = 'bulk-delete' THEN 'mass-diff-bulk' ELSE 'mass-diff' END", _NO.replace("NULL AS kind", "mass_kind AS kind")),
    ("via IS NOT NULL", "'external-send'", "NULL AS path, send_host AS host, via, send_secret AS secret, NULL AS server, NULL AS patterns, NULL AS kind"),
    ("markers IS NOT NULL", "'injection-output'", _NO.replace("NULL AS patterns", "array_to_string(markers, ',') AS patterns")),
    ("tamper", "'recorder-tamper'", _NO.replace("NULL AS path", "target AS path")),
    ("weakens IS NOT NULL", "'auth-weaken'", _NO.replace("NULL AS path", "target AS path").replace("NULL AS patterns", "array_to_string(weakens, ',') AS patterns")),
]
CTES["flags"] = "SELECT session_id, seq, ruleset, flag, score, path, host, via, secret, server, patterns, kind FROM (\n  " + "\n  UNION ALL ".join(
    f"SELECT session_id, seq, {key} AS rule_key, {cols} FROM facts WHERE {cond}" for cond, key, cols in _HITS
) + """
  UNION ALL SELECT session_id, seq, 'new-mcp-server', NULL, NULL, NULL, NULL, server, NULL, NULL FROM servers
  ) h JOIN rules USING (rule_key)"""

CTES["touches"] = "SELECT session_id, min(seq) AS first_touch FROM facts WHERE secret_touch GROUP BY 1"

CTES["armed"] = """
  SELECT f.*, arm_seq, last_value(CASE WHEN arms THEN array_to_string(markers, ', ') END IGNORE NULLS) OVER w AS arm_markers,
         last_value(CASE WHEN arms THEN action_type END IGNORE NULLS) OVER w AS arm_channel
  FROM (SELECT *, last_value(CASE WHEN arms THEN seq END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS arm_seq FROM facts) f
  WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""

_ARMED = "FROM armed WHERE arm_seq < seq AND seq - arm_seq <= 20 AND "
_NOTE = "'injection-shaped ' || arm_channel || ' output (' || arm_markers || ') then ' || "
CTES["combos"] = f"""
  SELECT session_id, ruleset, combo, arg_min(severity, o) AS severity, arg_min(antecedent_seq, o) AS antecedent_seq,
         arg_min(consequent_seq, o) AS consequent_seq, arg_min(note, o) AS note, arg_min(coalesce(server, ''), o) AS server_,
         arg_min(coalesce(host, ''), o) AS host_
  FROM (SELECT *, consequent_seq * 10 + prio AS o FROM (
    SELECT f.session_id, CASE WHEN send_secret IS NOT NULL THEN 'exfil-linked' ELSE 'exfil-temporal' END AS variant, 0 AS prio,
      CASE WHEN first_touch < seq THEN first_touch ELSE seq END AS antecedent_seq, seq AS consequent_seq,
      CASE WHEN send_secret IS NOT NULL THEN 'sensitive file ' || send_secret || ' sent to ' || send_host
           ELSE 'secret-touch then external send to ' || send_host || ' (temporal, unverified)' END AS note,
      NULL AS server, NULL AS host
    FROM facts f LEFT JOIN touches USING (session_id)
    WHERE via IS NOT NULL AND (send_secret IS NOT NULL OR (first_touch < seq AND seq - first_touch <= 20 AND via IN {in_list(V.PUSH_SENDS)}))
    UNION ALL SELECT session_id, CASE WHEN test_path THEN 'tamper-test-path' ELSE 'tamper-path' END, 0, arm_seq, seq, {_NOTE} 'auth edit ' || target, NULL, NULL {_ARMED} strong_auth_path
    UNION ALL SELECT session_id, 'tamper-weaken', 1, arm_seq, seq, {_NOTE} 'auth weakened in ' || target || ' (' || array_to_string(weakens, ', ') || ')', NULL, NULL {_ARMED} weakens IS NOT NULL
    UNION ALL SELECT session_id, 'injected-exfil', 0, arm_seq, seq, {_NOTE} 'external send (' || via || ') to ' || send_host, NULL, NULL {_ARMED} via IS NOT NULL
    UNION ALL SELECT session_id, 'injected-rce', 0, arm_seq, seq, {_NOTE} 'dangerous shell command', NULL, NULL {_ARMED} shell
    UNION ALL SELECT session_id, 'injected-ci-write', 0, arm_seq, seq, {_NOTE} 'CI/build-config write ' || target, NULL, NULL {_ARMED} ci_path
    UNION ALL SELECT c.session_id, 'tool-poisoning', 0, s.seq, c.seq, 'new MCP server "' || c.server || '" shipped sensitive file ' || outbound_path || coalesce(' to ' || send_host, ''), c.server, send_host
      FROM facts c JOIN servers s ON s.session_id = c.session_id AND s.server = c.server AND s.seq < c.seq
      WHERE outbound_path IS NOT NULL AND EXISTS (SELECT 1 FROM facts r WHERE r.session_id = c.session_id AND r.sensitive_path = c.outbound_path AND r.seq < c.seq)
    UNION ALL SELECT session_id, 'anti-forensics', 0, seq, seq, 'the agent attacked the recorder: ' || target, NULL, NULL FROM facts WHERE tamper
  )) JOIN combo_rules USING (variant) GROUP BY 1, 2, 3"""

CTES["verdicts"] = """
  SELECT session_id, ruleset, CASE WHEN coalesce(any_high, 0) = 1 OR s >= 80 THEN 'high' WHEN n > 0 OR m >= 50 THEN 'medium'
         WHEN m > 0 THEN 'low' ELSE 'none' END AS verdict, CAST(s AS INT) AS score, CAST(n AS INT) AS combos, last_scored_seq
  FROM (SELECT session_id, ruleset, last_scored_seq, any_high, coalesce(max_score, 0) AS m, coalesce(n, 0) AS n,
               least(100, coalesce(max_score, 0) + 40 * coalesce(n, 0)) AS s
    FROM (SELECT session_id, max(seq) AS last_scored_seq FROM activity GROUP BY 1)
    CROSS JOIN (SELECT DISTINCT ruleset FROM rules)
    LEFT JOIN (SELECT session_id, ruleset, max(score) AS max_score FROM flags GROUP BY ALL) USING (session_id, ruleset)
    LEFT JOIN (SELECT session_id, ruleset, count(*) AS n, max(CASE WHEN severity = 'high' THEN 1 ELSE 0 END) AS any_high
               FROM combos GROUP BY ALL) USING (session_id, ruleset))"""


def _needed(text: str, known: dict[str, str], order: list[str]) -> None:
    for name in known:
        if name not in order and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text, re.IGNORECASE):
            _needed(known[name], known, order)
            if name not in order:
                order.append(name)


def _big_counts(text: str) -> str:
    """count_if is wider than a bigint in this dialect; cast every use."""
    out, at = "", 0
    for found in re.finditer(r"count_if\(", text):
        if found.start() < at:
            continue
        depth, end = 1, found.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        out += text[at:found.start()] + f"CAST({text[found.start():end]} AS BIGINT)"
        at = end
    return out + text[at:]


def sql(body: str, blocks: dict[str, str] | None = None) -> str:
    """A runnable query: the named blocks `body` reads (of those given, else the common ones), then `body`."""
    known, order = CTES | (blocks or {}), []
    _needed(body, known, order)
    if not order:
        return _big_counts(body.strip())
    blocks = ",\n".join(f"{n} AS MATERIALIZED ({known[n]})" for n in order)
    body = body.strip()
    if body.startswith("WITH RECURSIVE"):
        return _big_counts(f"WITH RECURSIVE {blocks},\n{body[len('WITH RECURSIVE'):]}")
    return _big_counts(f"WITH {blocks}\n{body}")
