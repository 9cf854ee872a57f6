"""Per-event rule predicates as Catalyst expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vigilog.functions import fixed_values as V
from vigilog.functions.lists import any_match, first_of, one_of


#: Something that every text with a sensitive path in it has, wherever the path starts and ends; cheap to look for.
_SENSITIVE_TRACE = "|".join(f"(?:{p.removeprefix('^').removeprefix('.*').removesuffix('$')})" for p in V.SENSITIVE_BASENAMES) + r"|\.(?:aws|ssh|gnupg)"


def is_sensitive_path(path: Column) -> Column:
    base = F.element_at(F.split(path, "/"), -1)
    named = any_match(base, V.SENSITIVE_BASENAMES)
    return F.when(base.rlike(V.TEMPLATE_SUFFIX), False).otherwise(path.rlike(V.SENSITIVE_SEGMENT) | named)


def first_sensitive_token(command: Column) -> Column:
    """First token of a command that names a sensitive file, else null."""
    tokens = F.transform(F.split(command, V.COMMAND_SEPARATORS), lambda t: F.regexp_replace(t, "^@", ""))
    return F.when(command.rlike(_SENSITIVE_TRACE), F.get(F.filter(tokens, lambda t: (t != "") & is_sensitive_path(t)), F.lit(0)))


def is_shell(action: Column) -> Column:
    return action.isin("shell_command", "git_action")


def is_file_change(action: Column) -> Column:
    return action.isin("file_write", "file_edit")


def sensitive_path_touched(action: Column, target: Column) -> Column:
    """The sensitive local file an event reads or writes, from the event itself."""
    return F.when(
        action.isin("file_read", "file_write", "file_edit"),
        F.when(target.rlike(_SENSITIVE_TRACE) & is_sensitive_path(target), target),
    ).when(is_shell(action), first_sensitive_token(target))


# ---- shell ------------------------------------------------------------------

def without_quotes(command: Column) -> Column:
    return F.regexp_replace(command, V.QUOTED, " ")


def _pipes_or_chmod(unquoted: Column) -> Column:
    return any_match(unquoted, V.PIPE_TO_SHELL) | unquoted.rlike(V.CHMOD_OPEN)


def dangerous_shell_any_rm(command: Column) -> Column:
    """First ruleset: any recursive and forced rm counts, whatever it removes."""
    bare = without_quotes(command)
    rm_span = F.regexp_extract(bare, r"(\brm\b[^|&;\n]*)", 1)
    return _pipes_or_chmod(bare) | (command.contains("rm") & rm_span.rlike(V.RM_RECURSIVE) & rm_span.rlike(V.RM_FORCE))


def is_catastrophic_rm_target(token: Column) -> Column:
    target = F.regexp_replace(token, r"^['\"]|['\"]$", "")
    relative = F.regexp_replace(F.regexp_replace(target, r"^\./", ""), r"/+$", "")
    home_child = F.regexp_replace(F.regexp_extract(target, V.HOME_ROOT, 3), r"/+$", "")
    trimmed = F.regexp_replace(F.regexp_replace(target, r"/+$", ""), r"/\*$", "")
    parts = F.filter(F.split(trimmed, "/"), lambda p: p != "")
    top_two = F.lower(F.array_join(F.slice(parts, 1, 2), "/"))
    absolute = (
        F.when(target.rlike(V.SCRATCH_ROOT), False)
        .when(F.size(parts) <= 1, True)
        .when(top_two.isin(V.CATASTROPHIC_PREFIXES), True)
        .otherwise((F.size(parts) <= 2) & F.lower(F.get(parts, F.lit(0))).isin(V.SYSTEM_ROOTS))
    )
    return (
        F.when(target == "", False)
        .when(target.rlike(V.BARE_ROOT), True)
        .when(relative.isin(V.VCS_DIRECTORIES), True)
        .when(
            target.rlike(V.HOME_ROOT),
            (home_child == "") | F.element_at(F.split(home_child, "/"), 1).isin(V.SENSITIVE_HOME_CHILDREN),
        )
        .when(target.startswith("/"), absolute)
        .otherwise(False)
    )


def rm_is_catastrophic(command: Column) -> Column:
    """Recursive, forced rm of a root, home, system or version-control directory.

    A separator or an `rm` inside quotes is data, so the command is cut at
    unquoted separators only; targets are read from the uncut text, so a quoted
    real target still counts. The first unquoted `rm` of a segment covers every
    later one, because flags and targets after it are a superset.
    """
    segments = F.regexp_extract_all(command, F.lit(r"((?:'[^']*'|\"[^\"]*\"|[^|&;\n])++)"), 1)

    def dangerous(segment: Column) -> Column:
        tail = F.regexp_extract(segment, r"^(?>'[^']*'|\"[^\"]*\"|(?!\brm\b)[\s\S])*+\brm\b([\s\S]*)$", 1)
        flags = F.concat(F.lit("rm"), without_quotes(tail))
        # The `rm` itself is no target of its own: it names no root, home or system path.
        words = F.filter(
            F.split(F.concat(F.lit("rm"), tail), r"\s+"),
            lambda w: (w != "") & ~w.startswith("-"),
        )
        return flags.rlike(V.RM_RECURSIVE) & flags.rlike(V.RM_FORCE) & F.exists(words, is_catastrophic_rm_target)

    return F.exists(segments, dangerous)


def dangerous_shell(command: Column) -> Column:
    return _pipes_or_chmod(without_quotes(command)) | F.when(command.contains("rm"), rm_is_catastrophic(command)).otherwise(False)


def destructive_git_command(command: Column) -> Column:
    return any_match(command, V.GIT_DESTRUCTIVE)


# ---- recorder tampering -----------------------------------------------------

def recorder_tamper(action: Column, target: Column, recorder: str = "recorder") -> Column:
    """Writes or commands aimed at the recorder's own state, hooks or process.

    `recorder` is the recorder's command name; its state directory, database,
    signing files, home variable and launch label all derive from it.
    """
    upper = recorder.upper()
    state = (
        rf"(/\.{recorder}(/|$)|\$\{{?{upper}_HOME\}}?|\b{recorder}\.db\b|\bsigning\.(key|head)\b)"
    )
    process = [
        rf"\b{recorder}\s+(stop|uninit|prune)\b",
        rf"\b(pkill|killall|kill)\b[^\n|&;]*\b{recorder}\b",
        rf"\blaunchctl\s+(unload|bootout|remove|disable)\b[^\n]*\bcom\.{recorder}",
        rf"\bsqlite3\b[^\n]*\b{recorder}\.db\b",
        V.GIT_HOOK_ATTACK,
    ]
    return (
        F.when(is_file_change(action), target.rlike(state) | target.rlike(V.AGENT_HOOK_SETTINGS))
        .when(is_shell(action), any_match(target, [state] + process))
        .otherwise(False)
    )


# ---- network ----------------------------------------------------------------

def is_local_host(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^\[|\]$", "").rlike(V.LOCAL_HOST)


def looks_like_host(host: Column) -> Column:
    """Plausible host: an address, or a dotted name whose last label can be a TLD."""
    tld = F.lower(F.element_at(F.split(host, r"\."), -1))
    return (
        host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
        | (host.contains(":") & host.rlike(r"(?i)^[0-9a-f:]+$"))
        | (host.contains(".") & tld.rlike(r"^[a-z]{2,}$") & ~tld.isin(V.NOT_A_TLD))
    )


def _strip_port(host: Column) -> Column:
    return F.regexp_replace(host, r":\d+$", "")


def _strip_user(host: Column) -> Column:
    return F.element_at(F.split(host, "@"), -1)


def external_hosts(text: Column) -> Column:
    """Non-local hosts named by URLs in the text, then bare domains that are not files."""
    urls = F.transform(
        F.regexp_extract_all(text, F.lit(V.URL_HOST), 1), lambda h: _strip_port(_strip_user(h))
    )
    domains = F.regexp_extract_all(text, F.lit(V.BARE_DOMAIN), 1)
    return F.concat(
        F.filter(urls, lambda h: (h != "") & ~is_local_host(h)),
        F.filter(domains, lambda h: ~is_local_host(h) & ~h.rlike(V.FILE_EXTENSION)),
    )


def needs_host(command: Column) -> Column:
    """Whether a shell command is of a form that `external_send` judges by the command's first outside host."""
    return (command.rlike(V.CURL_OR_WGET) & command.rlike(V.DATA_FLAG)) | command.rlike(V.PIPE_TO_CURL) | command.rlike(V.SCRIPT_NETWORK)


def _query_payload_host(text: Column, pattern: str, drop_user: bool) -> Column:
    """Host of the first URL with a long query string to a non-local host."""
    hosts = F.regexp_extract_all(text, F.lit(pattern), 1)
    paths = F.regexp_extract_all(text, F.lit(pattern), 2)
    pairs = F.zip_with(
        hosts, paths,
        lambda h, p: F.struct(
            _strip_port(_strip_user(h) if drop_user else h).alias("host"),
            F.when(p.contains("?"), F.length(p) - F.instr(p, "?")).otherwise(0).alias("query"),
        ),
    )
    hit = F.filter(
        pairs,
        lambda x: (x["host"] != "") & ~is_local_host(x["host"]) & (x["query"] >= V.QUERY_PAYLOAD_MIN),
    )
    return F.when(text.contains("?"), F.get(hit, F.lit(0))["host"])


def external_send(action: Column, target: Column, host: Column | None = None, secret: Column | None = None) -> Column:
    """struct(via, host, secret) of an outbound data-bearing send, else null.

    Shell forms are tried in fixed order and the first with a non-local host wins.
    A caller that already holds the command's first outside host and sensitive
    file passes them in, so that they are computed once per row.
    """
    secret = first_sensitive_token(target) if secret is None else secret
    host = F.get(external_hosts(target), F.lit(0)) if host is None else host

    def sent(via: str, host: Column, secret: Column = F.lit(None).cast("string")) -> Column:
        return F.struct(F.lit(via).alias("via"), host.alias("host"), secret.alias("secret"))

    def named(pattern: str) -> Column:
        found = F.regexp_extract(target, pattern, 1)
        return F.when((found != "") & ~is_local_host(found), found)

    shell_query = _query_payload_host(target, V.URL_WITH_PATH, True)
    netcat, copied = named(V.NETCAT), named(V.REMOTE_COPY)
    shell = first_of(
        F.when(target.rlike(V.CURL_OR_WGET) & target.rlike(V.DATA_FLAG) & host.isNotNull(), sent("curl-data", host, secret)),
        F.when(target.rlike(V.PIPE_TO_CURL) & host.isNotNull(), sent("pipe-file", host, secret)),
        F.when(target.rlike(V.SCRIPT_NETWORK) & host.isNotNull(), sent("script", host, secret)),
        F.when(shell_query.isNotNull(), sent("query-payload", shell_query, secret)),
        F.when(netcat.isNotNull(), sent("netcat", netcat, secret)),
        F.when(copied.isNotNull(), sent("scp", copied, secret)),
    )
    web_query = _query_payload_host(target, r"(?i)https?://([^/\s\"']+)(/[^\s\"']*)?", False)
    mcp_host = _strip_port(F.regexp_extract(target, r"(?i)https?://([^/\s\"']+)", 1))
    return (
        F.when(is_shell(action), shell)
        .when((action == "web_fetch") & web_query.isNotNull(), sent("query-payload", web_query))
        .when((action == "mcp_call") & (mcp_host != "") & ~is_local_host(mcp_host), sent("mcp-url", mcp_host))
    )


# ---- MCP and injection arming -----------------------------------------------

def mcp_server(tool: Column) -> Column:
    name = F.get(F.split(tool, "__"), F.lit(1))
    return F.when(tool.startswith("mcp__") & (name != ""), name)


def arms_injection(action: Column, markers: Column) -> Column:
    """Whether injection markers on an untrusted channel arm the injected combos."""
    strong = F.size(F.array_intersect(markers, one_of(V.STRONG_MARKERS)))
    weak = F.size(F.array_intersect(markers, one_of(V.CORROBORATING_MARKERS)))
    return F.coalesce(
        F.when(action == "web_fetch", strong + weak >= 2)
        .when(action == "mcp_call", (strong >= 1) | (strong + weak >= 2))
        .otherwise(False),
        F.lit(False),
    )


# ---- diffs ------------------------------------------------------------------

def mass_diff_kind(files: Column, insertions: Column, deletions: Column) -> Column:
    return F.when(
        (deletions >= V.BULK_DELETE_MIN) & (deletions > V.BULK_DELETE_RATIO * insertions), "bulk-delete"
    ).when((files >= V.MASS_FILES_MIN) | (insertions + deletions >= V.MASS_LINES_MIN), "mass")


def severity_of(score: Column) -> Column:
    return F.when(score >= V.HIGH_SCORE, "high").when(score >= V.MEDIUM_SCORE, "medium").otherwise("low")
