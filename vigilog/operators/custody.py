"""Hash chains: building, verifying and reconciling them without a global sort."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from vigilog.functions.hashing import canonical_json, sha256_text
from vigilog.functions import fixed_values as V

SEGMENT = 256
LEVELS = 4


def with_row_hash(rows: DataFrame, columns: list[str], name: str = "row_hash") -> DataFrame:
    """Hash of the canonical form of all listed columns; null columns do not count."""
    return rows.withColumn(name, sha256_text(canonical_json(columns)))


def segment_of(seq: Column) -> Column:
    return F.floor((seq - 1) / SEGMENT).cast("bigint")


def build_chain(events: DataFrame, content: Column, heads: DataFrame | None = None) -> DataFrame:
    """Chain every session in fixed segments of its positions.

    Inside a segment each row hashes its content and the hash before it; a
    segment starts from a hash of its own name. Segments are independent, so a
    session of any size is chained in parallel, and a task streams over sorted rows and
    holds one hash. session_heads ties the segments of a session together.
    `heads` (session_id, last_seq, last_hash) are the ends of what is chained already: rows that go
    on in an open segment start from its last hash, so a chain extended batch by batch is the chain built at once.
    """
    rows = events.select("session_id", "seq", segment_of(F.col("seq")).alias("segment"), content.alias("content"))
    start = sha256_text(F.concat_ws("|", F.lit("segment"), "session_id", F.col("segment").cast("string")))
    if heads is not None:
        rows = rows.join(heads.select("session_id", "last_seq", "last_hash"), "session_id", "left")
        start = F.when(segment_of(F.col("last_seq")) == F.col("segment"), F.col("last_hash")).otherwise(start)
    rows = rows.select("session_id", "segment", "seq", start.alias("start"), "content")

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, prev = None, ""
        for batch in batches:
            before, after = [], []
            for session, segment, first, text in zip(batch["session_id"], batch["segment"], batch["start"], batch["content"]):
                if (session, segment) != now:
                    now, prev = (session, segment), first
                before.append(prev)
                prev = V.HASH_PREFIX + hashlib.sha256(f"{prev}|{text}".encode("utf-8", "surrogatepass")).hexdigest()
                after.append(prev)
            yield batch[["session_id", "segment", "seq"]].assign(prev_hash=before, hash=after)

    dealt = rows.repartition("session_id", "segment").sortWithinPartitions("session_id", "segment", "seq")
    return dealt.mapInPandas(link, "session_id string, segment bigint, seq bigint, prev_hash string, hash string")


def session_heads(chain: DataFrame) -> DataFrame:
    """One head per session: segment heads hashed together in a tree of fixed fan-in."""
    heads = chain.groupBy("session_id", F.col("segment").alias("part")).agg(F.max_by("hash", "seq").alias("hash"))
    for _ in range(LEVELS):
        heads = heads.groupBy("session_id", F.floor(F.col("part") / SEGMENT).cast("bigint").alias("up")).agg(
            sha256_text(F.array_join(F.transform(
                F.array_sort(F.collect_list(F.struct("part", "hash"))), lambda x: x["hash"]), "|")).alias("hash")
        ).withColumnRenamed("up", "part")
    return heads.groupBy("session_id").agg(F.max_by("hash", "part").alias("head_hash"))


def content_breaks(rows: DataFrame, recomputed: Column) -> DataFrame:
    """Rows whose stored hash differs from the recomputed one. No shuffle."""
    return rows.filter(F.col("hash") != recomputed).select("seq", F.lit("content-tampered").alias("reason"), F.lit(3).alias("prec"))


def link_breaks(rows: DataFrame) -> DataFrame:
    """Rows whose prev_hash is not the hash of the row before; an equi join on seq."""
    before = rows.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("_before"))
    expected = F.when(F.col("seq") == 1, F.lit(V.GENESIS)).otherwise(F.col("_before"))
    return rows.select("seq", "prev_hash").join(before, "seq", "left").filter(
        expected.isNotNull() & (F.col("prev_hash") != expected)
    ).select("seq", F.lit("broken-link").alias("reason"), F.lit(2).alias("prec"))


def sequence_breaks(rows: DataFrame) -> DataFrame:
    """Rows after a gap: their predecessor does not exist."""
    seqs = rows.select("seq")
    return seqs.filter("seq > 1").join(
        seqs.select((F.col("seq") + 1).alias("seq")), "seq", "left_anti"
    ).select("seq", F.lit("bad-sequence").alias("reason"), F.lit(1).alias("prec"))


def chain_breaks(rows: DataFrame, recomputed: Column) -> DataFrame:
    return sequence_breaks(rows).unionByName(link_breaks(rows)).unionByName(content_breaks(rows, recomputed))


def first_break(breaks: DataFrame) -> DataFrame:
    """Smallest broken position; sequence before link before content."""
    return breaks.agg(F.min(F.struct("seq", "prec", "reason")).alias("b")).filter("b IS NOT NULL").select("b.seq", "b.reason")


def truncation(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """Compare the rows present with the recorded count and head."""
    return meta.select(
        "count", "head_hash", rows.agg(F.count(F.lit(1))).scalar().alias("have"),
        rows.agg(F.max_by("hash", "seq")).scalar().alias("last_hash"),
    ).withColumn("truncated", (F.col("have") != F.col("count")) | ~F.col("last_hash").eqNullSafe(F.col("head_hash")))


def check_checkpoints(marks: DataFrame, rows: DataFrame) -> DataFrame:
    """Checkpoints or receipts against the chain: ok, missing event, or other hash."""
    have = rows.select("seq", F.col("hash").alias("_hash"))
    return marks.join(have, "seq", "left").withColumn(
        "status", F.when(F.col("_hash").isNull(), "truncated").when(F.col("_hash") != F.col("head_hash"), "anchor-mismatch")
        .otherwise("ok")).drop("_hash")


def lost_watermarks(watermarks: DataFrame, marks: DataFrame) -> DataFrame:
    """Watermarks whose checkpoint is no longer in the store."""
    return watermarks.join(marks.select("seq", "head_hash"), ["seq", "head_hash"], "left_anti")


def custody_status(rows: DataFrame, breaks: DataFrame, marks: DataFrame) -> DataFrame:
    """One row: intact or not, first break, head, and the latest checkpoint."""
    head = rows.agg(F.max("seq").alias("head_seq"), F.count(F.lit(1)).alias("count"))
    latest = marks.agg(F.max("seq").alias("latest_mark"))
    broken = breaks.agg(F.min(F.struct("seq", "prec", "reason")).alias("b"))
    return head.select(
        "head_seq", "count", broken.select("b.reason").scalar().alias("break_reason"),
        broken.select("b.seq").scalar().alias("break_seq"), latest.scalar().alias("latest_mark_seq"),
    ).withColumn("ok", F.col("break_reason").isNull())


def prune_blobs(blobs: DataFrame, events: DataFrame, cutoff: str, pruned_at: str) -> DataFrame:
    """Drop the content of bodies that no event at or after the cutoff refers to."""
    live = events.filter((F.col("ts") >= cutoff) & F.col("d.mutation.content_hash").isNotNull()).select(
        F.col("d.mutation.content_hash").alias("content_hash")).distinct().withColumn("_live", F.lit(True))
    dead = F.col("_live").isNull() & F.col("content").isNotNull()
    return blobs.join(live, "content_hash", "left").select(
        "content_hash", F.when(~dead, F.col("content")).alias("content"), "bytes",
        F.when(dead, F.lit(pruned_at)).otherwise(F.col("pruned_at")).alias("pruned_at"), dead.alias("pruned_now"))


def blob_stats(pruned: DataFrame) -> DataFrame:
    return pruned.agg(
        F.count(F.lit(1)).alias("blobs"), F.count_if(F.col("content").isNotNull()).alias("live"),
        F.count_if("pruned_now").alias("pruned"),
        F.coalesce(F.sum(F.when(F.col("pruned_now"), F.col("bytes"))), F.lit(0)).alias("bytes_freed"))


def layer_digest(events: DataFrame, columns: list[str]) -> DataFrame:
    """Order-free digest of a table, to show that a job left it unchanged."""
    # A sum, not an exclusive or: equal rows add up and do not cancel.
    return events.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string").alias("digest"))
