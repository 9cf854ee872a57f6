"""Plain-English text derived from event columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vigilog.functions import fixed_values as V
from vigilog.functions.lists import any_match, clip, lookup
from vigilog.functions.shell import shell_summary


def url_host(text: Column) -> Column:
    """Host of the first URL in the text, else the first dotted name."""
    url = F.regexp_extract(text, r"(?i)https?://([a-z0-9.\-]+)", 1)
    dotted = F.regexp_extract(text, r"(?i)\b([a-z0-9-]+(?:\.[a-z0-9-]+)+)", 1)
    return F.nullif(F.when(url != "", url).otherwise(dotted), F.lit(""))


def action_summary(action: Column, target: Column, tool: Column, description: Column) -> Column:
    text = F.coalesce(target, F.lit(""))
    parts = F.split(F.coalesce(tool, F.lit("")), "__")
    call = F.nullif(F.array_join(F.slice(parts, F.lit(3), F.size(parts)), "__"), F.lit(""))
    code = lambda x: F.concat(F.lit("`"), clip(x, 90), F.lit("`"))
    made = (
        F.when(action.isin("shell_command", "git_action"), shell_summary(text))
        .when(action == "file_read", F.concat(F.lit("Read the file "), code(text), F.lit(".")))
        .when(action == "file_write", F.concat(F.lit("Wrote (created or replaced) the file "), code(text), F.lit(".")))
        .when(action == "file_edit", F.concat(F.lit("Edited the file "), code(text), F.lit(".")))
        .when(action == "web_fetch", F.concat(
            F.lit("Fetched the web page "), code(F.coalesce(url_host(text), text)), F.lit(".")))
        .when(action == "mcp_call", F.concat(
            F.lit("Called `"), F.coalesce(call, F.lit("a tool")), F.lit("` on the MCP server `"),
            F.coalesce(F.get(parts, F.lit(1)), F.lit("unknown")), F.lit("`.")))
        .when(action == "task_control", F.lit("Managed a sub-agent or task."))
        .otherwise(F.concat(F.coalesce(tool, action), F.lit(" action.")))
    )
    said = F.nullif(F.trim(description), F.lit(""))
    return F.when(action == "session", F.lit("A session lifecycle event (start/stop).")).otherwise(F.coalesce(said, made))


def summary_for_outcome(summary: Column, outcome: Column) -> Column:
    base = F.regexp_replace(summary, r"\.$", "")
    return (
        F.when(outcome == "failed", F.concat(base, F.lit(" — the tool reported failure.")))
        .when(outcome == "attempted", F.concat(base, F.lit(" — completion was not recorded.")))
        .when(outcome == "unknown", F.concat(base, F.lit(" — outcome unknown.")))
        .otherwise(summary)
    )


def as_attempt(note: Column) -> Column:
    note = F.regexp_replace(note, r"(?i)\bsent to\b", "was submitted for transfer to")
    note = F.regexp_replace(note, r"(?i)\bshipped sensitive file\b", "attempted to send sensitive file")
    return F.regexp_replace(note, r"(?i)\bexternal send\b", "external-send attempt")


def note_for_outcome(note: Column, outcome: Column) -> Column:
    ending = (
        F.when(outcome == "failed", ". The recorded tool result was failure; no successful completion was observed.")
        .when(outcome == "attempted", ". The attempt was observed but no completion event.")
        .otherwise(". The action outcome could not be determined from the recorded events.")
    )
    success = F.lit(". The tool reported success; there is no packet-level delivery confirmation.")
    return F.when(outcome == "succeeded", F.concat(note, success)).otherwise(F.concat(as_attempt(note), ending))


def human_duration(milliseconds: Column) -> Column:
    """1h 4m, 12s, 0s; rounded to seconds, zero units left out."""
    seconds = F.round(milliseconds / 1000).cast("bigint")
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    unit = lambda n, u: F.when(n > 0, F.concat(n.cast("string"), F.lit(u)))
    text = F.concat_ws(" ", unit(h, "h"), unit(m, "m"), unit(s, "s"))
    return F.when(F.coalesce(milliseconds, F.lit(0)) <= 0, "0s").otherwise(
        F.when(text == "", "0s").otherwise(text))


def retention_millis(spec: Column) -> Column:
    """Milliseconds of a retention text such as 30d, 12h or 45m; null when malformed."""
    unit = lookup({"d": 86_400_000, "h": 3_600_000, "m": 60_000}, F.lower(F.regexp_extract(spec, r"(?i)^(\d+)([dhm])$", 2)))
    return F.regexp_extract(spec, r"(?i)^(\d+)([dhm])$", 1).try_cast("bigint") * unit


def plural(count: Column, noun: str) -> Column:
    return F.concat(count.cast("string"), F.lit(f" {noun}"), F.when(count == 1, "").otherwise("s"))


def title_case(identifier: Column) -> Column:
    words = F.filter(F.split(identifier, "[-_]"), lambda w: w != "")
    return F.array_join(F.transform(
        words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2_000_000_000))), " ")


def markdown_cell(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"([\\|])", r"\\$1"), r"[\r\n]+", " ")


def churn_label(insertions: Column, deletions: Column, skipped: Column) -> Column:
    parts = F.concat_ws(
        " ", F.when(insertions > 0, F.concat(F.lit("+"), insertions.cast("string"))),
        F.when(deletions > 0, F.concat(F.lit("-"), deletions.cast("string"))))
    return F.when(parts != "", parts).when(skipped, "skipped")


def short_object(sha: Column) -> Column:
    return F.when(sha.rlike(V.ZERO_OBJECT), "∅").otherwise(F.substring(sha, 1, 7))


def shell_danger_kinds(command: Column) -> Column:
    """Which shell dangers a flagged command shows: pipe, rm, chmod."""
    piped = r"(?i)\b(curl|wget)\b[^|]*\|\s*(?:sudo\s+)?(sh|bash|zsh|python3?|node|nodejs|perl|ruby|eval)\b"
    pipe = any_match(command, [piped, r"(?i)\bbase64\s+-d[^|]*\|\s*(sh|bash|node|python)"])
    local = F.coalesce(url_host(F.regexp_extract(command, rf"({piped})", 1)).rlike(V.LOCAL_HOST_PREFIX), F.lit(False))
    rm = F.regexp_extract(command, r"(\brm\b[^|;&\n]*)", 1)
    return F.array_compact(F.array(
        F.when(pipe, F.when(local, "pipe-local").otherwise("pipe")),
        F.when(rm.rlike(V.RM_RECURSIVE) & rm.rlike(V.RM_FORCE), "rm"),
        F.when(command.rlike(V.CHMOD_OPEN), "chmod"),
    ))
