"""Session summaries, cards, fleet aggregates, dashboards and orderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilog.functions import fixed_values as V
from vigilog.functions.lists import basename, clip, lookup, one_line, one_of
from vigilog.functions.predicates import looks_like_host
from vigilog.functions.wording import plural


def session_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("events"), F.min("ts").alias("started"), F.max("ts").alias("ended"),
        F.count_if(F.col("phase") == "failure").alias("failures"),
        F.count_if(~F.col("phase").isin(V.LIFECYCLE_PHASES)).alias("activity"))


def active_sessions(summary: DataFrame) -> DataFrame:
    """Sessions that did something, without the recorder's own reserved ones."""
    return summary.filter((F.col("activity") > 0) & ~F.col("session_id").startswith("bb:"))


def millis(ts: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(ts))


def density(events: DataFrame, summary: DataFrame, buckets: int = V.DENSITY_BUCKETS) -> DataFrame:
    """Event counts over equal slices of each session's own span, as one array."""
    spans = summary.select(
        "session_id", millis(F.col("started")).alias("a"),
        F.greatest(F.lit(1), millis(F.col("ended")) - millis(F.col("started"))).alias("span"))
    # Events of one session at the same instant meet before the join.
    points = events.groupBy("session_id", "ts").agg(F.count(F.lit(1)).alias("n"))
    slot = F.least(F.lit(buckets - 1), F.greatest(
        F.lit(0), F.floor((millis(F.col("ts")) - F.col("a")) / F.col("span") * buckets).cast("int")))
    filled = (
        points.join(spans, "session_id").groupBy("session_id", slot.alias("slot")).agg(F.sum("n").alias("n"))
        .groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("m"))
    )
    return filled.select("session_id", F.transform(
        F.sequence(F.lit(0), F.lit(buckets - 1)),
        lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("bigint"))).alias("density"))


def first_value(events: DataFrame, value: Column, name: str) -> DataFrame:
    """First non-null value of each session, by position."""
    return events.filter(value.isNotNull()).groupBy("session_id").agg(F.min_by(value, F.col("seq")).alias(name))


def last_anchor(events: DataFrame) -> DataFrame:
    """Last captured revision of each session; the session end wins over its start."""
    return events.filter(F.col("d.anchor").isNotNull()).groupBy("session_id").agg(
        F.max_by(F.col("d.anchor"), F.col("seq")).alias("a")
    ).select("session_id", F.col("a.head_sha").alias("commit"), F.col("a.branch").alias("branch"))


def session_titles(events: DataFrame, transcript_titles: DataFrame | None = None) -> DataFrame:
    """Custom title, else generated title, else the first real prompt, cut to size."""
    prompts = events.filter((F.col("phase") == "prompt") & F.col("d.prompt").isNotNull()).groupBy("session_id").agg(
        F.min_by(F.col("d.prompt"), F.col("seq")).alias("p"))
    line = one_line(F.col("p"))
    named = prompts.select("session_id", F.when(
        (line != "") & ~line.rlike(V.INJECTED_TITLE), clip(line, V.MAX_TITLE)).alias("prompt_title"))
    if transcript_titles is None:
        return named.select("session_id", F.col("prompt_title").alias("title"))
    return named.join(transcript_titles, "session_id", "full").select(
        "session_id", F.coalesce("custom_title", "ai_title", "prompt_title").alias("title"))


def flagged_actions(actions: DataFrame) -> DataFrame:
    """Actions per session that carry a risk flag (a pair counts once)."""
    return actions.groupBy("session_id").agg(
        F.count_if(F.arrays_overlap("signals", one_of(V.RISK_FLAGS))).alias("flagged"))


def flag_action_counts(actions: DataFrame) -> DataFrame:
    return actions.select(
        "session_id", F.explode(F.array_intersect("signals", one_of(V.RISK_FLAGS))).alias("flag")
    ).groupBy("session_id", "flag").agg(F.count(F.lit(1)).alias("actions"))


def cards(events: DataFrame, actions: DataFrame, newest: DataFrame, fired: DataFrame,
          titles: DataFrame | None = None) -> DataFrame:
    """One card per active session; every joined side is one row per session."""
    summary = session_summary(events)
    found = fired.groupBy("session_id").agg(F.count(F.lit(1)).alias("findings"))
    zero = F.lit(0).cast("bigint")
    return (
        summary.filter("activity > 0").drop("activity")
        .join(newest, "session_id", "left").drop("combos")
        .join(flagged_actions(actions), "session_id", "left")
        .join(found, "session_id", "left")
        .join(first_value(events, F.col("cwd"), "cwd"), "session_id", "left")
        .join(session_titles(events, titles), "session_id", "left")
        .withColumn("verdict", F.coalesce("verdict", F.lit("unscored")))
        .withColumn("score", F.coalesce("score", F.lit(0)))
        .withColumn("flagged", F.coalesce("flagged", zero)).withColumn("findings", F.coalesce("findings", zero))
        .withColumn("review_count", F.col("flagged") + F.col("findings"))
    )


def by_risk(cards: DataFrame) -> DataFrame:
    return cards.orderBy(lookup(V.VERDICT_RANK, F.col("verdict")), F.desc("ended"), "session_id")


def by_score(cards: DataFrame) -> DataFrame:
    return cards.orderBy(F.desc("score"), F.desc("flagged"), F.desc("ended"), "session_id")


def by_recency(cards: DataFrame) -> DataFrame:
    return cards.orderBy(F.desc("ended"), "session_id")


def default_report_session(cards: DataFrame) -> DataFrame:
    return by_risk(cards).limit(1)


def sidebar(cards: DataFrame, review: int = 8, recent: int = 7) -> DataFrame:
    """Newest sessions that need review, then the newest of the others."""
    top = lambda df, name, n: by_recency(df).limit(n).withColumn("group", F.lit(name))
    return top(cards.filter("review_count > 0"), "review", review).unionByName(
        top(cards.filter("review_count = 0"), "recent", recent))


def match_sessions(cards: DataFrame, query: str) -> DataFrame:
    """Sessions whose title, project or id match a text, best match first."""
    q = query.strip().lower()
    title, project = F.lower(F.coalesce("title", "session_id")), F.lower(F.coalesce(basename(F.col("cwd")), F.lit("")))
    rank = (
        F.when(title == q, 100).when(title.startswith(q), 80).when(title.contains(q), 60)
        .when(project.startswith(q), 45).when(project.contains(q), 35)
        .when(F.lower("session_id").contains(q), 20).otherwise(0)
    )
    return cards.withColumn("rank", rank).filter("rank > 0").orderBy(F.desc("rank"), F.desc("ended"), "session_id")


# ---- fleet ------------------------------------------------------------------

def verdict_mix(cards: DataFrame) -> DataFrame:
    return cards.groupBy("verdict").agg(F.count(F.lit(1)).alias("sessions"))


def fleet_totals(cards: DataFrame, flag_counts: DataFrame) -> DataFrame:
    tampered = flag_counts.filter(F.col("flag") == "recorder-tamper").select("session_id", F.lit(1).alias("t"))
    return cards.join(tampered, "session_id", "left").agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("verdict").isin("high", "medium")).alias("flagged"),
        F.count("t").alias("anti_forensics"))


def rule_totals(flag_counts: DataFrame) -> DataFrame:
    return flag_counts.groupBy("flag").agg(F.sum("actions").alias("actions"))


def outside_hosts(risk: DataFrame, events: DataFrame) -> DataFrame:
    """Plausible outside hosts with the time of their first send."""
    first = risk.filter(F.col("send_host").isNotNull() & looks_like_host(F.col("send_host"))).join(
        events.select("session_id", "seq", "ts"), ["session_id", "seq"])
    return first.groupBy(F.col("send_host").alias("host")).agg(F.min("ts").alias("first_seen"))


def top_sensitive_paths(risk: DataFrame, limit: int = 20) -> DataFrame:
    return path_counts(risk).orderBy(F.desc("touches"), "path").limit(limit)


def path_counts(risk: DataFrame) -> DataFrame:
    return risk.filter(F.col("touch_path").isNotNull()).groupBy(F.col("touch_path").alias("path")).agg(
        F.count(F.lit(1)).alias("touches"))


def project_counts(cards: DataFrame) -> DataFrame:
    return cards.filter(F.col("cwd").isNotNull()).groupBy("cwd").agg(F.count(F.lit(1)).alias("sessions"))


def top_projects(cards: DataFrame, limit: int = 20) -> DataFrame:
    return project_counts(cards).orderBy(F.desc("sessions"), "cwd").limit(limit)


def tiles(cards: DataFrame, events: DataFrame) -> DataFrame:
    total = events.agg(F.count(F.lit(1)).alias("n")).scalar()
    return cards.agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("review_count") > 0).alias("need_review"),
        F.count_distinct(basename(F.col("cwd"))).alias("projects")).withColumn("events", total)


def verdict_spread(scored: DataFrame) -> DataFrame:
    """Sessions by ruleset and verdict, with subtotals."""
    return scored.cube("ruleset", "verdict").agg(F.count(F.lit(1)).alias("sessions")).select(
        F.coalesce("ruleset", F.lit("all")).alias("ruleset"), F.coalesce("verdict", F.lit("all")).alias("verdict"), "sessions")


def redaction_audit(events: DataFrame) -> DataFrame:
    """Redaction hits per session and type, with per-session and grand totals."""
    hits = events.select("session_id", F.explode("d.redaction").alias("r")).select("session_id", "r.type", "r.bytes")
    return hits.rollup("session_id", "type").agg(
        F.count(F.lit(1)).alias("hits"), F.sum("bytes").alias("bytes")).select(
        F.coalesce("session_id", F.lit("all")).alias("session_id"), F.coalesce("type", F.lit("all")).alias("type"), "hits", "bytes")


def hourly_counts(events: DataFrame) -> DataFrame:
    hour = F.substring("ts", 1, 13)
    return events.groupBy(hour.alias("hour"), "phase").agg(F.count(F.lit(1)).alias("events"))


def listing(events: DataFrame) -> DataFrame:
    """Padded event listing with a marker on failures."""
    return events.select(
        "session_id", "seq",
        F.concat_ws(" ", F.lpad(F.col("seq").cast("string"), 6, " "), F.rpad("phase", 13, " "),
                    F.rpad(F.coalesce("tool_name", F.lit("-")), 12, " "),
                    F.when(F.col("success") == 0, "FAIL").otherwise("    "),
                    F.coalesce("target", F.lit(""))).alias("line"))


def identities(events: DataFrame) -> DataFrame:
    """Range, head and owning agent of each session."""
    return events.groupBy("session_id").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max_by("hash", "seq").alias("head_hash"),
        F.min_by("agent_type", "seq").alias("agent_type"), F.count_distinct("agent_id").alias("agent_ids"))


def session_agents(events: DataFrame) -> DataFrame:
    """Distinct agent ids of each session, one row each."""
    return events.filter(F.col("agent_id").isNotNull()).select("session_id", "agent_id").distinct()


def check_identities(claims: DataFrame, events: DataFrame) -> DataFrame:
    """Whether the event a claim ends at still exists, unchanged, in that session."""
    heads = events.select(F.col("seq").alias("last_seq"), F.col("hash").alias("_hash"), F.col("session_id").alias("_session"))
    return claims.join(heads, "last_seq", "left").withColumn(
        "reason",
        F.when(F.col("_hash").isNull(), "range-missing").when(F.col("_hash") != F.col("head_hash"), "range-hash-mismatch")
        .when(F.col("_session") != F.col("session_id"), "range-session-mismatch")).drop("_hash", "_session")


def summary_sentence(files: Column, commits: Column, project: Column, findings: Column, flagged: Column) -> Column:
    outcomes = F.concat_ws(
        " and ", F.when(files > 0, F.concat(F.lit("changed "), plural(files, "file"))),
        F.when(commits > 0, F.concat(F.lit("recorded "), plural(commits, "commit"))))
    opening = F.when(outcomes != "", F.concat(F.lit("The agent "), outcomes, F.lit(" in "), project, F.lit("."))).otherwise(
        F.concat(F.lit("The session completed in "), project, F.lit(" without a stored file or commit outcome.")))
    review = F.concat_ws(
        " and ", F.when(findings > 0, plural(findings, "session finding")),
        F.when(flagged > 0, plural(flagged, "individually flagged action")))
    closing = F.when(review != "", F.concat(F.lit(" "), review, F.lit(" require review."))).otherwise(
        " No elevated-risk finding or action was detected.")
    return F.concat(opening, closing)
