"""Event facts, versioned flags, temporal combos and session verdicts.

Rules are data: predicates are computed once per event, and a small fixed score
table decides which of them count, and for how much, under each ruleset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigilog.functions import fixed_values as V
from vigilog.functions import predicates as P
from vigilog.functions.hashing import sha256_text
from vigilog.functions.lists import one_of
from vigilog.operators.ordered import nearest_before

KEY = ["session_id", "seq"]
#: Thresholds that decide verdicts besides the two tables.
LIMITS = [("bulk_delete_min", V.BULK_DELETE_MIN), ("bulk_delete_ratio", V.BULK_DELETE_RATIO), ("combo_weight", V.COMBO_WEIGHT), ("combo_window", V.COMBO_WINDOW),
          ("high_score", V.HIGH_SCORE), ("mass_files_min", V.MASS_FILES_MIN), ("mass_lines_min", V.MASS_LINES_MIN), ("medium_score", V.MEDIUM_SCORE),
          ("weakening_scanner", V.WEAKENING_SCANNER)]


def _fixed_table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A constant table as a literal VALUES list, so its size is known to the planner."""
    values = ", ".join("(" + ", ".join(repr(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def rule_scores(spark: SparkSession, rulesets: list[str] | None = None) -> DataFrame:
    """Fixed score table (ruleset, rule_key, flag, score); about fifty rows."""
    rows = [r for r in V.RULE_SCORES if rulesets is None or r[0] in rulesets]
    return _fixed_table(spark, rows, "ruleset, rule_key, flag, score")


def combo_rules(spark: SparkSession, rulesets: list[str] | None = None) -> DataFrame:
    rows = [r for r in V.COMBO_RULES if rulesets is None or r[0] in rulesets]
    return _fixed_table(spark, rows, "ruleset, variant, combo, severity")


def check_rulesets(rulesets: list[str]) -> list[str]:
    unknown = [r for r in rulesets if r not in V.RULESETS]
    if unknown:
        raise ValueError(f"unknown ruleset: {', '.join(unknown)}")
    return list(rulesets)


def fingerprints(spark: SparkSession, rulesets: list[str]) -> DataFrame:
    """One hash per ruleset over all that decides its verdicts: scores, combos with their severities, and thresholds; whatever the order of the tables."""
    rules = rule_scores(spark, check_rulesets(rulesets)).select("ruleset", F.concat_ws("|", F.lit("score"), "rule_key", "flag", F.col("score").cast("string")).alias("line"))
    chains = combo_rules(spark, rulesets).select("ruleset", F.concat_ws("|", F.lit("combo"), "variant", "combo", "severity").alias("line"))
    limits = F.lit(",".join(f"{n}={v}" for n, v in LIMITS))
    return rules.unionByName(chains).groupBy("ruleset").agg(
        sha256_text(F.concat(F.lit("rules-v1|"), "ruleset", F.lit("|"), F.array_join(F.array_sort(F.collect_list("line")), ","), F.lit("|"), limits)).alias("fingerprint"))


def ruleset_number(ruleset: Column) -> Column:
    """Numeric version, so that r10 is newer than r2."""
    return F.coalesce(F.regexp_extract(ruleset, r"^r(\d+)$", 1).try_cast("int"), F.lit(0))


def event_facts(events: DataFrame, recorder: str = "recorder") -> DataFrame:
    """Rule predicates of every event, computed in one projection without a shuffle."""
    action, target, tool = F.col("action_type"), F.col("target"), F.col("tool_name")
    text = F.coalesce(target, F.lit(""))
    shell, change = P.is_shell(action) & (text != ""), P.is_file_change(action) & (text != "")
    # Values that several predicates need get columns of their own first.
    events = events.withColumns({
        "_touched": P.sensitive_path_touched(action, target),
        "_host": F.when(P.is_shell(action) & P.needs_host(text), F.get(P.external_hosts(text), F.lit(0))),
    })
    touched = F.col("_touched")
    git, markers, weakens = F.col("d.git"), F.col("d.output_signals.injection"), F.col("d.mutation.weakens")
    no = F.lit(False)
    return events.select(
        "session_id", "seq", "ts", "phase", "action_type", "tool_name", "tool_use_id", "prompt_id", "target",
        (F.col("phase") == "failure").alias("failed"),
        ((F.col("redaction_count") > 0) | touched.isNotNull()).alias("secret_touch"),
        F.when(F.col("redaction_count") > 0, None).otherwise(touched).alias("touch_path"),
        touched.alias("sensitive_path"),
        F.when(shell, P.dangerous_shell_any_rm(text)).otherwise(no).alias("shell_any_rm"),
        F.when(shell, P.dangerous_shell(text)).otherwise(no).alias("shell"),
        (change & text.rlike(V.AUTH_SEGMENT)).alias("auth_path"),
        (change & text.rlike(V.AUTH_SEGMENT_STRONG)).alias("strong_auth_path"),
        (change & text.rlike(V.CI_BUILD_PATH)).alias("ci_path"),
        text.rlike(V.TEST_PATH).alias("test_path"),
        (
            F.coalesce(git["is_force"] | git["is_reset"] | git["is_delete"], no)
            | F.when(shell, P.destructive_git_command(text)).otherwise(no)
        ).alias("git_destructive"),
        P.mass_diff_kind(
            git["diffstat"]["files"], git["diffstat"]["insertions"], git["diffstat"]["deletions"]
        ).alias("mass_kind"),
        P.mcp_server(tool).alias("server"),
        F.when(action == "mcp_call", P.first_sensitive_token(text)).alias("outbound_path"),
        P.external_send(action, text, F.col("_host"), touched).alias("send"),
        F.when(F.size(markers) > 0, markers).alias("markers"),
        P.arms_injection(action, markers).alias("arms"),
        P.recorder_tamper(action, text, recorder).alias("tamper"),
        F.when(change & (F.size(weakens) > 0), weakens).alias("weakens"),
    )


def first_servers(facts: DataFrame) -> DataFrame:
    """First event of every MCP server in a session (map-side combined)."""
    return (
        facts.filter(F.col("server").isNotNull())
        .groupBy("session_id", "server")
        .agg(F.min("seq").alias("seq"))
    )


EVIDENCE = "path string, host string, via string, secret string, server string, patterns string, kind string"


def flag_rows(facts: DataFrame, rulesets: list[str]) -> DataFrame:
    """One row per (ruleset, event, flag) with its score and evidence."""
    null = F.lit(None).cast("string")

    def hit(key: str | Column, **evidence: Column) -> Column:
        names = ["path", "host", "via", "secret", "server", "patterns", "kind"]
        return F.struct(
            (F.lit(key) if isinstance(key, str) else key).alias("rule_key"),
            *[evidence.get(n, null).alias(n) for n in names],
        )

    c = F.col
    hits = F.array_compact(F.array(
        F.when(c("failed"), hit("failed")),
        F.when(c("secret_touch"), hit("secret-touch", path=c("touch_path"))),
        F.when(c("shell_any_rm"), hit("dangerous-shell-any-rm")),
        F.when(c("shell"), hit("dangerous-shell")),
        F.when(c("auth_path"), hit(F.when(c("test_path"), "auth-edit-test").otherwise("auth-edit"), path=c("target"))),
        F.when(c("git_destructive"), hit("destructive-git")),
        F.when(c("mass_kind").isNotNull(), hit(
            F.when(c("mass_kind") == "bulk-delete", "mass-diff-bulk").otherwise("mass-diff"), kind=c("mass_kind"))),
        F.when(c("send").isNotNull(), hit(
            "external-send", host=c("send.host"), via=c("send.via"), secret=c("send.secret"))),
        F.when(c("markers").isNotNull(), hit("injection-output", patterns=F.array_join("markers", ","))),
        F.when(c("tamper"), hit("recorder-tamper", path=c("target"))),
        F.when(c("weakens").isNotNull(), hit(
            "auth-weaken", path=c("target"), patterns=F.array_join("weakens", ","))),
    ))
    own = facts.select("session_id", "seq", F.explode(hits).alias("h")).select("session_id", "seq", "h.*")
    servers = first_servers(facts).select(
        "session_id", "seq", F.lit("new-mcp-server").alias("rule_key"),
        *[null.alias(n) for n in ("path", "host", "via", "secret")],
        "server", null.alias("patterns"), null.alias("kind"),
    )
    scores = rule_scores(facts.sparkSession, check_rulesets(rulesets))
    return (
        own.unionByName(servers)
        .join(F.broadcast(scores), "rule_key")
        .select("session_id", "seq", "ruleset", "flag", "score", "path", "host", "via", "secret",
                "server", "patterns", "kind")
    )


def event_risk(flags: DataFrame) -> DataFrame:
    """One row per (event, ruleset): top score and flags in rule order."""
    order = one_of(V.FLAG_ORDER)
    return flags.groupBy("session_id", "seq", "ruleset").agg(
        F.max("score").alias("score"),
        F.array_intersect(order, F.collect_set("flag")).alias("flags"),
        F.max(F.when(F.col("flag") == "external-send", F.col("host"))).alias("send_host"),
        F.max(F.when(F.col("flag") == "external-send", F.col("via"))).alias("send_via"),
        F.max(F.when(F.col("flag") == "secret-touch", F.col("path"))).alias("touch_path"),
    )


# ---- combos -----------------------------------------------------------------

def _candidate(variant: str, prio: int, ante: Column, note: Column, server: Column | None = None,
               host: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        F.lit(variant).alias("variant"), F.lit(prio).alias("prio"), ante.cast("bigint").alias("antecedent_seq"),
        F.col("seq").alias("consequent_seq"), note.alias("note"),
        (null if server is None else server).alias("server"), (null if host is None else host).alias("host"),
    )


def _exfil_candidates(facts: DataFrame) -> DataFrame:
    sends = facts.filter(F.col("send").isNotNull()).select("session_id", "seq", "send")
    first_touch = (
        facts.filter("secret_touch").groupBy("session_id").agg(F.min("seq").alias("first_touch"))
    )
    # A send that carries a sensitive file: only the first one per session matters.
    linked = (
        sends.filter(F.col("send.secret").isNotNull())
        .groupBy("session_id")
        .agg(F.min_by(F.struct("seq", "send"), "seq").alias("s"))
        .select("session_id", "s.seq", "s.send")
        .join(first_touch, "session_id", "left")
        .select("session_id", _candidate(
            "exfil-linked", 0,
            F.when(F.col("first_touch") < F.col("seq"), F.col("first_touch")).otherwise(F.col("seq")),
            F.concat(F.lit("sensitive file "), F.col("send.secret"), F.lit(" sent to "), F.col("send.host")),
        ).alias("c"))
    )
    # A push to an outside host soon after the first touch: temporal only.
    pushes = sends.filter(F.col("send.secret").isNull() & F.col("send.via").isin(V.PUSH_SENDS))
    touches = first_touch.withColumnRenamed("first_touch", "seq")
    temporal = nearest_before(pushes, touches, ["session_id"], "seq", V.COMBO_WINDOW, [], "touch").select(
        "session_id", _candidate(
            "exfil-temporal", 1, F.col("touch.seq"),
            F.concat(F.lit("secret-touch then external send to "), F.col("send.host"),
                     F.lit(" (temporal, unverified)")),
        ).alias("c"))
    return linked.unionByName(temporal)


def _injected_candidates(facts: DataFrame) -> DataFrame:
    c = F.col
    arms = facts.filter("arms").select("session_id", "seq", "markers", "action_type")
    # A row that itself arms replaces the antecedent, so it never fires.
    acts = facts.filter(~c("arms")).filter(
        c("strong_auth_path") | c("weakens").isNotNull() | c("send").isNotNull() | c("shell") | c("ci_path")
    )
    armed = nearest_before(acts, arms, ["session_id"], "seq", V.COMBO_WINDOW, ["markers", "action_type"], "arm")

    def fired(variant: str, prio: int, what: Column) -> Column:
        note = F.concat(F.lit("injection-shaped "), c("arm.action_type"), F.lit(" output ("),
                        F.array_join("arm.markers", ", "), F.lit(") then "), what)
        return _candidate(variant, prio, c("arm.seq"), note)

    both = F.array_compact(F.array(
        F.when(c("strong_auth_path") & ~c("test_path"), fired(
            "tamper-path", 0, F.concat(F.lit("auth edit "), c("target")))),
        F.when(c("strong_auth_path") & c("test_path"), fired(
            "tamper-test-path", 0, F.concat(F.lit("auth edit "), c("target")))),
        F.when(c("weakens").isNotNull(), fired(
            "tamper-weaken", 1, F.concat(F.lit("auth weakened in "), c("target"), F.lit(" ("),
                                         F.array_join("weakens", ", "), F.lit(")")))),
        F.when(c("send").isNotNull(), fired(
            "injected-exfil", 0, F.concat(F.lit("external send ("), c("send.via"), F.lit(") to "), c("send.host")))),
        F.when(c("shell"), fired("injected-rce", 0, F.lit("dangerous shell command"))),
        F.when(c("ci_path"), fired(
            "injected-ci-write", 0, F.concat(F.lit("CI/build-config write "), c("target")))),
    ))
    return armed.select("session_id", F.explode(both).alias("c"))


def poisoning_links(facts: DataFrame) -> DataFrame:
    """MCP calls that ship a file read earlier, by a server first seen earlier."""
    reads = (
        facts.filter(F.col("sensitive_path").isNotNull())
        .groupBy("session_id", F.col("sensitive_path").alias("outbound_path"))
        .agg(F.min("seq").alias("read_seq"))
    )
    servers = first_servers(facts).withColumnRenamed("seq", "first_seq")
    calls = facts.filter(F.col("outbound_path").isNotNull() & F.col("server").isNotNull()).select(
        "session_id", "seq", "server", "outbound_path", F.col("send.host").alias("host"))
    return (
        calls.join(reads, ["session_id", "outbound_path"])
        .join(servers, ["session_id", "server"])
        .filter((F.col("read_seq") < F.col("seq")) & (F.col("first_seq") < F.col("seq")))
    )


def combos(facts: DataFrame, rulesets: list[str]) -> DataFrame:
    """Fired combos, each at most once per (session, ruleset), earliest first."""
    c = F.col
    poisoned = poisoning_links(facts).select("session_id", _candidate(
        "tool-poisoning", 0, c("first_seq"),
        F.concat(F.lit('new MCP server "'), c("server"), F.lit('" shipped sensitive file '), c("outbound_path"),
                 F.when(c("host").isNotNull(), F.concat(F.lit(" to "), c("host"))).otherwise("")),
        c("server"), c("host"),
    ).alias("c"))
    tampered = facts.filter("tamper").select("session_id", _candidate(
        "anti-forensics", 0, c("seq"), F.concat(F.lit("the agent attacked the recorder: "), c("target"))).alias("c"))
    candidates = (
        _exfil_candidates(facts).unionByName(_injected_candidates(facts))
        .unionByName(poisoned).unionByName(tampered).select("session_id", "c.*")
    )
    rules = combo_rules(facts.sparkSession, check_rulesets(rulesets))
    return (
        candidates.join(F.broadcast(rules), "variant")
        .groupBy("session_id", "ruleset", "combo")
        .agg(F.min_by(
            F.struct("severity", "antecedent_seq", "consequent_seq", "note", "server", "host"),
            F.struct("consequent_seq", "prio"),
        ).alias("f"))
        .select("session_id", "ruleset", "combo", "f.*")
    )


# ---- verdicts ---------------------------------------------------------------

def rule_counts(flags: DataFrame) -> DataFrame:
    return flags.groupBy("session_id", "ruleset", "flag").agg(F.count(F.lit(1)).alias("events"))


def verdicts(events: DataFrame, flags: DataFrame, fired: DataFrame, rulesets: list[str]) -> DataFrame:
    """One verdict per (session, ruleset). All sides are already one row per session."""
    sessions = (
        events.groupBy("session_id").agg(F.max("seq").alias("last_scored_seq"))
        .withColumn("ruleset", F.explode(one_of(check_rulesets(rulesets))))
    )
    scored = flags.groupBy("session_id", "ruleset").agg(F.max("score").alias("max_score"))
    chains = fired.groupBy("session_id", "ruleset").agg(
        F.count(F.lit(1)).alias("combos"), F.max((F.col("severity") == "high").cast("int")).alias("any_high"))
    key = ["session_id", "ruleset"]
    base = F.coalesce("max_score", F.lit(0))
    count = F.coalesce("combos", F.lit(0))
    score = F.least(F.lit(100), base + V.COMBO_WEIGHT * count)
    return (
        sessions.join(scored, key, "left").join(chains, key, "left")
        .select(
            *key,
            F.when((F.coalesce("any_high", F.lit(0)) == 1) | (score >= V.HIGH_SCORE), "high")
            .when((count > 0) | (base >= V.MEDIUM_SCORE), "medium")
            .when(base > 0, "low").otherwise("none").alias("verdict"),
            score.cast("int").alias("score"), count.cast("int").alias("combos"), "last_scored_seq",
        )
    )


def newest_verdicts(scored: DataFrame) -> DataFrame:
    """The highest ruleset available per session; versions compare as numbers."""
    return scored.groupBy("session_id").agg(
        F.max_by(F.struct("ruleset", "verdict", "score", "combos"), ruleset_number(F.col("ruleset"))).alias("v")
    ).select("session_id", "v.*")


def sessions_to_score(events: DataFrame, stored: DataFrame, ruleset: str) -> DataFrame:
    """Sessions with no stored verdict for a ruleset, or with events after it."""
    heads = events.groupBy("session_id").agg(F.max("seq").alias("max_seq"))
    done = stored.filter(F.col("ruleset") == ruleset).select("session_id", "last_scored_seq")
    return heads.join(done, "session_id", "left").filter(
        F.col("last_scored_seq").isNull() | (F.col("last_scored_seq") < F.col("max_seq")))


def rescore_audit(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Full outer comparison of two verdict layers: match, mismatch or one side missing."""
    key = ["session_id", "ruleset"]
    left = stored.select(*key, F.struct("verdict", "score", "combos").alias("old"))
    right = recomputed.select(*key, F.struct("verdict", "score", "combos").alias("new"))
    return left.join(right, key, "full").select(
        *key,
        F.when(F.col("old").isNull(), "not-yet-scored").when(F.col("new").isNull(), "orphaned")
        .when(F.col("old") == F.col("new"), "match").otherwise("mismatch").alias("status"),
    )
