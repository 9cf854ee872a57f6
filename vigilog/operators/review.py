"""Review findings, expected-behaviour policy, decisions and their staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilog.functions import fixed_values as V
from vigilog.functions import globs as G
from vigilog.functions import predicates as P
from vigilog.functions.hashing import canonical_json, sha256_text
from vigilog.functions.lists import basename, lookup, one_of
from vigilog.functions.redaction import redact_text
from vigilog.functions.wording import title_case
from vigilog.operators.actions import seq_digest, with_outcome

DOMAIN = "review-finding-v1\n"
POLICY_DOMAIN = "baseline-policy-v1\n"
LISTS = ["hosts", "paths", "commands", "mcp_servers"]
FINDING = ["session_id", "ruleset", "kind", "id", "item"]


def finding_key(seq_text: Column) -> Column:
    """Stable key from session, ruleset, kind, id and the sorted distinct positions."""
    def value(name: str) -> Column:
        wrapped = F.to_json(F.struct(F.col(name).alias("x")))  # {"x":"..."}
        return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)

    return sha256_text(F.concat(
        F.lit(DOMAIN + '{"id":'), value("id"), F.lit(',"kind":'), value("kind"), F.lit(',"related_seqs":'), seq_text,
        F.lit(',"ruleset_version":'), value("ruleset"), F.lit(',"session_id":'), value("session_id"), F.lit("}")))


# ---- entities ---------------------------------------------------------------

def event_entities(events: DataFrame) -> DataFrame:
    """Hosts, paths, commands and servers each event names, as (seq, list, value) rows."""
    c = F.col
    target = F.trim("target")
    urls = F.when(target.contains("://"), F.regexp_extract_all(target, F.lit(r"(?i)(https?://[^\s\"'<>]+)"), 1))
    hosts = F.transform(urls, lambda u: F.try_parse_url(F.regexp_replace(u, r"[),.;]+$", ""), F.lit("HOST")))
    shell = P.is_shell(c("action_type"))
    file_path = F.when(c("action_type").isin("file_read", "file_write", "file_edit") & (target != ""), F.coalesce(
        P.first_sensitive_token(target), F.when(~target.rlike(r"\s"), target)))
    item = lambda name, value: F.struct(F.lit(name).alias("list"), value.alias("value"))
    found = F.concat(
        F.transform(F.coalesce(hosts, F.expr("array()").cast("array<string>")), lambda h: item("hosts", h)),
        F.array(
            item("commands", F.when(shell & (target != ""), target)),
            item("paths", F.when(shell, P.first_sensitive_token(target)).otherwise(file_path)),
            item("mcp_servers", F.when(c("action_type") == "mcp_call", P.mcp_server(c("tool_name"))))))
    return events.select("session_id", "seq", F.explode(found).alias("e")).select("session_id", "seq", "e.*").filter(
        F.col("value").isNotNull())


def evidence_entities(flags: DataFrame) -> DataFrame:
    path = lambda name: F.when(F.trim(name) != "", F.coalesce(
        P.first_sensitive_token(F.trim(name)), F.when(~F.trim(name).rlike(r"\s"), F.trim(name))))
    item = lambda name, value: F.struct(F.lit(name).alias("list"), value.alias("value"))
    # Tamper evidence names a command, not a path.
    found = F.array(
        item("hosts", F.col("host")), item("mcp_servers", F.col("server")),
        item("paths", F.when(F.col("flag") != "recorder-tamper", path("path"))), item("paths", path("secret")))
    return flags.select("session_id", "seq", F.explode(found).alias("e")).select("session_id", "seq", "e.*").filter(
        F.col("value").isNotNull()).distinct()


# ---- findings ---------------------------------------------------------------

def combo_items(findings: DataFrame, seqs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fired combos as review items, and their supporting positions."""
    rows = findings.select(
        "session_id", "ruleset", F.lit("combo").alias("kind"), F.col("combo").alias("id"), F.col("combo").alias("item"),
        title_case(F.col("combo")).alias("title"), F.col("display_note").alias("note"), "severity",
        F.when(F.col("severity") == "high", 80).otherwise(50).alias("score"), "outcome", "target", F.lit("").alias("rule_ids"))
    return rows, seqs.select("session_id", "ruleset", F.lit("combo").alias("kind"), F.col("combo").alias("id"),
                             F.col("combo").alias("item"), "seq")


def action_items(events: DataFrame, risk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Actions with a scoring risk flag, one item per tool use."""
    item = F.coalesce(F.concat(F.lit("tool:"), "tool_use_id"), F.concat(F.lit("seq:"), F.col("seq").cast("string")))
    keyed = with_outcome(events).withColumn("item", item)
    risky = F.array_intersect("flags", one_of(V.RISK_FLAGS))
    hits = risk.filter((F.size(risky) > 0) & (F.col("score") > 0)).join(
        keyed.select("session_id", "seq", "item"), ["session_id", "seq"])
    grouped = hits.select("session_id", "ruleset", "item", "score", F.explode(risky).alias("flag")).groupBy(
        "session_id", "ruleset", "item").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("flag")).alias("rules"))
    members = keyed.join(grouped.select("session_id", "ruleset", "item"), ["session_id", "item"])
    first = members.groupBy("session_id", "ruleset", "item").agg(
        F.min("seq").alias("earliest"), F.min_by(F.struct("outcome", "target"), F.struct(F.col("phase") != "pre", F.col("seq"))).alias("r"))
    rows = grouped.join(first, ["session_id", "ruleset", "item"]).select(
        "session_id", "ruleset", F.lit("action").alias("kind"), F.lit("action-risk").alias("id"), "item",
        F.when(F.size("rules") == 1, title_case(F.get("rules", F.lit(0)))).otherwise("Flagged action").alias("title"),
        F.concat(F.lit("Action "), F.col("earliest").cast("string"), F.lit(" matched "), F.array_join("rules", ", ")).alias("note"),
        P.severity_of(F.col("score")).alias("severity"), "score", F.col("r.outcome").alias("outcome"), F.col("r.target").alias("target"),
        F.array_join("rules", ",").alias("rule_ids"))
    return rows, members.select("session_id", "ruleset", F.lit("action").alias("kind"), F.lit("action-risk").alias("id"), "item", "seq")


def review_findings(events: DataFrame, flags: DataFrame, risk: DataFrame, findings: DataFrame, seqs: DataFrame
                    ) -> tuple[DataFrame, DataFrame]:
    """All review items with keys, and their entities as child rows."""
    combos, combo_seqs = combo_items(findings, seqs)
    actions, action_seqs = action_items(events, risk)
    support = combo_seqs.unionByName(action_seqs)
    digest = seq_digest(support, FINDING).select(*FINDING, "first_seq", "last_seq", "seq_count", "seq_text")
    items = combos.unionByName(actions).join(digest, FINDING).withColumn("key", finding_key(F.col("seq_text"))).drop("seq_text")
    named = event_entities(events).unionByName(evidence_entities(flags)).distinct()
    own_host = findings.filter(F.col("host").isNotNull()).select(
        "session_id", "ruleset", F.lit("combo").alias("kind"), F.col("combo").alias("id"), F.col("combo").alias("item"),
        F.lit("hosts").alias("list"), F.col("host").alias("value"))
    # Evidence counts for actions; combos use what their events name.
    by_event = combo_seqs.join(event_entities(events.join(combo_seqs.select("session_id", "seq").distinct(), ["session_id", "seq"], "left_semi")), ["session_id", "seq"]).unionByName(
        action_seqs.join(named, ["session_id", "seq"])).select(*FINDING, "list", "value")
    return items.dropDuplicates(["session_id", "key"]), by_event.unionByName(own_host).distinct()


def in_review_order(items: DataFrame) -> DataFrame:
    return items.orderBy("session_id", lookup(V.SEVERITY_RANK, F.col("severity")), "first_seq", "kind", "id", "key")


# ---- policy -----------------------------------------------------------------

def policy_hash(policy: DataFrame) -> Column:
    """Hash of a valid policy, whatever the order of its entries and patterns.

    A policy is bounded by its own format (128 entries of 64 patterns), so the
    one-row array below has a fixed size limit.
    """
    return _entries(policy).agg(_hash_of_entries()).scalar()


def _entries(policies: DataFrame, *keys: str) -> DataFrame:
    entry = F.to_json(F.struct(*sorted(["id", "reason", *V.POLICY_SELECTORS])))
    return policies.select(*keys, "id", "reason", *[F.array_sort(F.col(s)).alias(s) for s in V.POLICY_SELECTORS]).select(*keys, "id", entry.alias("e"))


def _hash_of_entries() -> Column:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "e"))), lambda x: x["e"]), ",")
    return sha256_text(F.concat(F.lit(POLICY_DOMAIN + '{"expected":['), text, F.lit('],"version":1}')))


def policy_hashes(policies: DataFrame, *keys: str) -> DataFrame:
    """One hash per policy of a table of entries; each policy is bounded by its own format."""
    return _entries(policies, *keys).groupBy(*keys).agg(_hash_of_entries().alias("policy_hash"))


def _pattern_test(match, value: Column):
    return lambda pattern: match(value, pattern)


def expected_matches(items: DataFrame, entities: DataFrame, policy: DataFrame) -> DataFrame:
    """(finding, policy entry) pairs where every populated selector has a match.

    The policy's size is limited by its format; it reaches the rows as one
    bounded array from a scalar subquery, not as a join.
    """
    patterns = policy.select("id", *[F.coalesce(F.col(s), F.expr("array()").cast("array<string>")).alias(s) for s in V.POLICY_SELECTORS])
    entries = patterns.agg(F.collect_list(F.struct("id", *V.POLICY_SELECTORS))).scalar()
    match = {"hosts": lambda v, p: G.scalar_matches(v, p, True), "paths": G.path_matches, "commands": G.command_matches,
             "mcp_servers": lambda v, p: G.scalar_matches(v, p, True)}
    selector = {"hosts": "hosts", "paths": "paths", "commands": "command_prefixes", "mcp_servers": "mcp_servers"}
    # Entries whose selector of this list matches the value, per entity row.
    hit = entities.withColumn("_entries", entries).select(*FINDING, "list", F.explode("_entries").alias("e"), "value")
    ok = F.lit(False)
    for name in LISTS:
        fits = _pattern_test(match[name], F.col("value"))
        ok = ok | ((F.col("list") == name) & F.exists(F.col(f"e.{selector[name]}"), fits))
    matched = hit.filter(ok).groupBy(*FINDING, F.col("e.id").alias("entry")).agg(F.count_distinct("list").alias("met"))
    own = items.withColumn("e", F.explode(entries)).filter(
        (F.size("e.finding_ids") == 0) | F.exists("e.finding_ids", lambda p: G.scalar_matches(F.col("id"), p)))
    own = own.filter((F.size("e.rule_ids") == 0) | F.exists(
        F.split("rule_ids", ","), lambda r: F.exists(F.col("e.rule_ids"), lambda p: G.scalar_matches(r, p))))
    needed = sum([F.when(F.size(f"e.{selector[n]}") > 0, 1).otherwise(0) for n in LISTS], F.lit(0))
    return own.select(*FINDING, F.col("e.id").alias("entry"), needed.alias("needed")).join(
        matched, [*FINDING, "entry"], "left").filter(F.coalesce("met", F.lit(0)) == F.col("needed")).select(*FINDING, "entry")


def with_expected(items: DataFrame, matches: DataFrame) -> DataFrame:
    """Label findings; none is ever removed."""
    marks = matches.groupBy(*FINDING).agg(F.array_join(F.array_sort(F.collect_set("entry")), ",").alias("expected_by"))
    return items.join(marks, FINDING, "left").withColumn("expected", F.col("expected_by").isNotNull())


# ---- decisions --------------------------------------------------------------

def latest_reviews(reviews: DataFrame) -> DataFrame:
    """The last decision on each finding; later ids win at the same time."""
    return reviews.groupBy("session_id", "key").agg(F.max_by(
        F.struct("disposition", "reviewed_seq", "reviewed_hash", "policy_hash"), F.struct("created_at", "review_id")).alias("r")
    ).select("session_id", "key", F.col("r.disposition").alias("decided"), "r.reviewed_seq", "r.reviewed_hash",
             F.col("r.policy_hash").alias("reviewed_policy"), F.lit(True).alias("decided_any"))


def with_decisions(items: DataFrame, reviews: DataFrame, heads: DataFrame, policy: Column, policy_error: bool = False) -> DataFrame:
    """Current disposition of each finding; a decision lapses when evidence or policy moved."""
    joined = items.join(latest_reviews(reviews), ["session_id", "key"], "left").join(heads, "session_id", "left").withColumn("_policy", policy)
    fresh = (
        F.col("reviewed_seq").eqNullSafe(F.col("head_seq")) & F.col("reviewed_hash").eqNullSafe(F.col("head_hash"))
        & F.col("reviewed_policy").eqNullSafe(F.col("_policy"))
    )
    decided = F.coalesce("decided_any", F.lit(False))
    stale = decided & (F.lit(True) if policy_error else ~fresh)
    return joined.withColumn("stale", stale).withColumn(
        "disposition", F.when(decided & ~F.col("stale"), F.col("decided")).otherwise("unreviewed")).drop(
        "decided", "decided_any", "reviewed_seq", "reviewed_hash", "reviewed_policy", "_policy", "head_seq", "head_hash")


def review_counts(decided: DataFrame) -> DataFrame:
    open_ = F.col("disposition") == "unreviewed"
    counts = decided.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(open_).alias("unresolved"), F.count_if("stale").alias("stale"),
        *[F.count_if(F.col("disposition") == d).alias(d) for d in ("acknowledged", "expected", "false_positive")],
        *[F.count_if(open_ & (F.col("severity") == s)).alias(f"open_{s}") for s in ("high", "medium", "low")])
    return counts.withColumn("status", F.when(F.col("total") == 0, "clear").when(F.col("unresolved") > 0, "needs_review").otherwise("reviewed"))


def severity_outcome_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("session_id").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")],
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("attempted", "succeeded", "failed", "unknown")])


def gate(counts: DataFrame, level: str) -> DataFrame:
    """Sessions with unresolved findings at or above a severity."""
    names = ["high", "medium", "low"]
    total = sum([F.col(f"open_{s}") for s in names[: names.index(level) + 1]], F.lit(0))
    return counts.filter(total > 0)


def inbox(counts: DataFrame, cards: DataFrame, revisions: DataFrame) -> DataFrame:
    """Sessions with open findings, worst and newest first."""
    return counts.filter("unresolved > 0").join(cards.select("session_id", "score", "ended", "cwd"), "session_id").join(
        revisions, "session_id", "left").withColumn("project", F.coalesce(basename(F.col("cwd")), F.lit("No project"))).orderBy(
        F.desc("score"), F.desc("ended"), "session_id")


def inbox_groups(box: DataFrame) -> DataFrame:
    return box.groupBy("project", F.coalesce("branch", F.lit("detached")).alias("branch"), F.coalesce("commit", F.lit("no-commit")).alias("commit")).agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("unresolved").alias("open"))


def accept_reviews(submitted: DataFrame, items: DataFrame, heads: DataFrame, policies: DataFrame | None = None) -> DataFrame:
    """Submitted decisions (review_id, session_id, key, disposition, note, created_at) with a `refusal`, null for those to append.

    A decision needs a known disposition, a finding that is current, and a policy of its session that is not invalid
    (`policies`: session_id, policy_hash, error). Notes are trimmed, redacted whole and then cut to a length; an accepted one is tied to the head it saw.
    """
    rows = submitted.join(items.select("session_id", "key", F.lit(True).alias("_current")), ["session_id", "key"], "left").join(heads, "session_id", "left")
    none = F.lit(None).cast("string")
    rows = rows.join(policies.select("session_id", "policy_hash", F.col("error").alias("_error")), "session_id", "left") if policies is not None else rows.withColumns(
        {"policy_hash": none, "_error": none})
    refusal = (F.when(F.col("session_id").isNull() | F.col("key").isNull() | ~F.coalesce(F.col("disposition").isin(V.DISPOSITIONS), F.lit(False)), "invalid")
               .when(F.col("_current").isNull(), "not-current").when(F.col("_error").isNotNull(), "invalid-policy"))
    fine = F.col("refusal").isNull()
    # A refused decision tells no note, so only the others' notes are redacted.
    rows = rows.withColumn("refusal", refusal).withColumn("_note", F.when(fine, F.nullif(F.trim("note"), F.lit(""))))
    rows = redact_text(rows, "_note", "_clean", "_hits", "note")
    return rows.select("review_id", "session_id", "key", "disposition", "created_at", "refusal", F.when(fine, F.substring("_clean", 1, V.MAX_NOTE)).alias("note"),
                       *[F.when(fine, F.col(a)).alias(b) for a, b in (("head_seq", "reviewed_seq"), ("head_hash", "reviewed_hash"), ("policy_hash", "policy_hash"))])


def attestations(identity: DataFrame, sources: DataFrame, verdicts: DataFrame, findings: DataFrame, counts: DataFrame) -> DataFrame:
    """Closed list of aggregates per session; no raw evidence."""
    return identity.join(sources, "session_id", "left").join(verdicts, "session_id", "left").join(
        findings, "session_id", "left").join(counts, "session_id", "left")


def agent_sources(events: DataFrame) -> DataFrame:
    """Which agents produced a session; at most three fixed names."""
    known = ["claude-code", "codex-cli", "gemini-cli"]
    return events.groupBy("session_id").agg(F.concat_ws(",", *[
        F.max(F.when(F.col("source") == s, F.lit(s))) for s in known]).alias("agent_sources"))


def check_attestations(claims: DataFrame, identity: DataFrame) -> DataFrame:
    """Whether range, count and head of each session are what a claim says."""
    now = identity.select("session_id", *[F.col(n).alias(f"now_{n}") for n in ("first_seq", "last_seq", "event_count", "last_hash")])
    same = F.lit(True)
    for n in ("first_seq", "last_seq", "event_count", "last_hash"):
        same = same & F.col(n).eqNullSafe(F.col(f"now_{n}"))
    return claims.join(now, "session_id", "left").withColumn(
        "status", F.when(F.col("now_last_seq").isNull(), "session-missing").when(same, "ok").otherwise("range-mismatch"))
