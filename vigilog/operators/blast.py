"""Blast radius: files, secrets, hosts and commits of a session, and what to do first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from vigilog.functions import fixed_values as V
from vigilog.functions.lists import lookup
from vigilog.functions.predicates import looks_like_host


def files(events: DataFrame) -> DataFrame:
    m = F.col("d.mutation")
    changed = events.filter(m.isNotNull() & F.col("target").isNotNull() & F.col("action_type").isin("file_write", "file_edit"))
    zero = F.lit(0)
    return changed.groupBy("session_id", F.col("target").alias("path")).agg(
        F.sum(F.coalesce(m["diffstat"]["insertions"], zero)).alias("insertions"),
        F.sum(F.coalesce(m["diffstat"]["deletions"], zero)).alias("deletions"), F.min("seq").alias("seq"),
    ).withColumn("auth", F.col("path").rlike(V.AUTH_SEGMENT))


def secrets(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("sensitive_path").isNotNull()).groupBy(
        "session_id", F.col("sensitive_path").alias("path")).agg(F.min("seq").alias("seq"))


def hosts(risk: DataFrame, findings: DataFrame) -> DataFrame:
    """Outside hosts with the first send to each and the outcome of its finding."""
    first = risk.filter(F.col("send_host").isNotNull()).groupBy("session_id", F.col("send_host").alias("host")).agg(
        F.min_by("send_via", "seq").alias("via"), F.min("seq").alias("seq"))
    # The combo that fired last stands for a host that several combos cite.
    by_host = findings.filter(F.col("host").isNotNull()).groupBy("session_id", "host").agg(F.max_by("outcome", F.struct("consequent_seq", "combo")).alias("found"))
    return first.join(by_host, ["session_id", "host"], "left").select(
        "session_id", "host", "via", "seq", F.col("found").isNotNull().alias("correlated"),
        F.coalesce("found", F.lit("unknown")).alias("outcome"))


def commits(events: DataFrame) -> DataFrame:
    g = F.col("d.git")
    force = F.coalesce(g["is_force"], F.lit(False))
    named, gone = g["commit"]["sha"].isNotNull(), F.coalesce(g["is_delete"], F.lit(False))
    return events.filter(named | force | gone).select(
        "session_id", F.coalesce(g["commit"]["sha"], g["new_sha"], F.lit("(ref)")).alias("sha"),
        F.when(named, g["commit"]["subject"]).when(gone, "(branch delete)").otherwise("(force update)").alias("subject"),
        "seq", (F.when(named, force).otherwise(True)).alias("force"))


def checklist(file_rows: DataFrame, secret_rows: DataFrame, host_rows: DataFrame, commit_rows: DataFrame,
              findings: DataFrame) -> DataFrame:
    """Ordered containment steps per session, most severe first."""
    lit = F.lit
    sent = findings.filter((F.col("outcome") == "succeeded") & F.col("combo").isin("exfil-chain", "injected-exfil", "tool-poisoning")).select(
        "session_id").distinct().withColumn("_sent", lit(True))
    exposed = F.coalesce("_sent", lit(False))
    rotate = secret_rows.join(sent, "session_id", "left").select(
        "session_id", lit("rotate-secret").alias("kind"), F.when(exposed, "high").otherwise("medium").alias("severity"),
        F.when(exposed, F.concat(lit("Rotate the credential that may have been exposed via "), F.col("path"))).otherwise(
            F.concat(lit("Review whether "), F.col("path"), lit(" was exposed; rotate its credentials if confirmed"))).alias("action"), "seq")
    revert = commit_rows.select(
        "session_id", lit("revert-commit").alias("kind"), F.when(F.col("force"), "high").otherwise("medium").alias("severity"),
        F.concat(F.when(F.col("force"), "Investigate/undo").otherwise("Review"), lit(" commit "), F.substring("sha", 1, 10),
                 F.when(F.col("subject").isNotNull(), F.concat(lit(" — "), F.col("subject"))).otherwise("")).alias("action"), "seq")
    what = (
        F.when(F.col("outcome") == "succeeded", "tool-reported outbound transfer").when(F.col("outcome") == "failed", "failed outbound-transfer attempt")
        .when(F.col("outcome") == "attempted", "outbound-transfer attempt").otherwise("outbound action with unknown outcome")
    )
    inspect = host_rows.select(
        "session_id", lit("inspect-host").alias("kind"), F.when(F.col("outcome") == "succeeded", "high").otherwise("medium").alias("severity"),
        F.concat(lit("Inspect the "), what, lit(" to "), F.col("host"),
                 F.when(F.col("via").isNotNull(), F.concat(lit(" (via "), F.col("via"), lit(")"))).otherwise(""),
                 F.when(F.col("correlated"), " — correlated session finding").otherwise("")).alias("action"), "seq")
    review = file_rows.filter("auth").select(
        "session_id", lit("review-file").alias("kind"), lit("medium").alias("severity"),
        F.concat(lit("Review the auth-path change to "), F.col("path"), lit(" (+"), F.col("insertions").cast("string"), lit(" −"),
                 F.col("deletions").cast("string"), lit(")")).alias("action"), "seq")
    return rotate.unionByName(revert).unionByName(inspect).unionByName(review)


def numbered(steps: DataFrame) -> DataFrame:
    """Order number of each step; positions are counted per severity, then offset."""
    from vigilog.operators.ordered import row_index, seq_bucket

    rank = lookup(V.SEVERITY_RANK, F.col("severity"))
    # Severity and position bucket together never decrease along the order.
    bucket = rank.cast("bigint") * F.lit(1 << 40) + seq_bucket(F.col("seq"))
    return row_index(steps.withColumn("_rank", rank), ["session_id"], bucket, ["_rank", "seq", "kind", "action"], "order").drop("_rank")


def secret_kinds(events: DataFrame) -> DataFrame:
    return events.select("session_id", F.explode("d.redaction.type").alias("kind")).distinct()


def egress_hosts(risk: DataFrame, findings: DataFrame, limit: int | None = None) -> DataFrame:
    """Plausible outside hosts per session, finding hosts first; all of them unless a limit is asked for."""
    sent = risk.filter(F.col("send_host").isNotNull()).groupBy("session_id", F.col("send_host").alias("host")).agg(F.min("seq").alias("seq"))
    named = findings.filter(F.col("host").isNotNull()).groupBy("session_id", "host").agg(F.min("consequent_seq").alias("_cited"))
    hosts = sent.join(named, ["session_id", "host"], "full").filter(looks_like_host(F.col("host")))
    order = W.partitionBy("session_id").orderBy(F.col("_cited").isNull(), F.coalesce("_cited", "seq"), "host")
    # With a limit, the rank filter lets Spark keep only that many rows per session before the shuffle.
    ranked = hosts.withColumn("rank", F.row_number().over(order))
    return (ranked if limit is None else ranked.filter(F.col("rank") <= limit)).select("session_id", "rank", "host")
