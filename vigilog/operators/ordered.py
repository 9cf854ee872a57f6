"""Ordered, per-key operators that never put a whole key into one task.

A session may hold a third of all rows, so a plain window over its key is not an
option. Each operator here cuts a key into buckets of its order column, works
inside the buckets in parallel, and carries one summary row per bucket across
bucket borders. Only the summaries of a key meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BUCKET_WIDTH = 4096


def seq_bucket(order: Column, width: int = BUCKET_WIDTH) -> Column:
    return F.floor(order / width).cast("bigint")


def row_index(df: DataFrame, keys: list[str], bucket: Column, order: list[str], name: str) -> DataFrame:
    """Exact 1-based position of every row inside its key.

    `bucket` must not decrease along `order`.
    """
    rows = df.withColumn("_b", bucket)
    sizes = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(*keys, "_b").orderBy(*order)
    return (
        rows.withColumn("_i", F.row_number().over(inside))
        .join(offsets, [*keys, "_b"])
        .withColumn(name, (F.col("_offset") + F.col("_i")).cast("bigint"))
        .drop("_b", "_i", "_offset")
    )


def carry_last(
    df: DataFrame, keys: list[str], order: str, value: Column, name: str, *,
    include_current: bool = True, width: int = BUCKET_WIDTH,
) -> DataFrame:
    """Last non-null `value` at or before (or strictly before) each row of a key."""
    rows = df.withColumn("_b", seq_bucket(F.col(order), width)).withColumn("_v", value)
    tails = (
        rows.filter(F.col("_v").isNotNull())
        .groupBy(*keys, "_b")
        .agg(F.max_by("_v", order).alias("_tail"))
    )
    # One row per (key, bucket) present in the data, so that a bucket without a
    # value of its own still receives the carried one.
    present = rows.select(*keys, "_b").distinct().join(tails, [*keys, "_b"], "left")
    earlier = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carried = present.select(*keys, "_b", F.last("_tail", True).over(earlier).alias("_carried")).filter(
        F.col("_carried").isNotNull())
    last_row = 0 if include_current else -1
    inside = W.partitionBy(*keys, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, last_row)
    return (
        rows.withColumn("_near", F.last("_v", True).over(inside))
        .join(carried, [*keys, "_b"], "left")
        .withColumn(name, F.coalesce("_near", "_carried"))
        .drop("_b", "_v", "_near", "_carried")
    )


def previous_row(
    df: DataFrame, keys: list[str], order: str, value: Column, name: str, width: int = BUCKET_WIDTH
) -> DataFrame:
    """`value` of the row immediately before, per key; null on a key's first row."""
    return carry_last(df, keys, order, value, name, include_current=False, width=width)


def nearest_before(
    left: DataFrame, right: DataFrame, keys: list[str], order: str, reach: int, payload: list[str], name: str
) -> DataFrame:
    """Nearest `right` row with order in [left.order - reach, left.order - 1], per key.

    A bounded as-of join: both sides meet on buckets of width `reach`, so a
    bucket holds at most `reach` rows per key and the join is a plain equi join.
    """
    anchors = right.select(
        *keys,
        F.explode(
            F.array(seq_bucket(F.col(order), reach), seq_bucket(F.col(order), reach) + 1)
        ).alias("_b"),
        F.struct(F.col(order).alias(order), *payload).alias("_anchor"),
    )
    near = (F.col(f"_anchor.{order}") < F.col(order)) & (F.col(order) - F.col(f"_anchor.{order}") <= reach)
    found = (
        left.select(*keys, order)
        .withColumn("_b", seq_bucket(F.col(order), reach))
        .join(anchors, [*keys, "_b"])
        .filter(near)
        .groupBy(*keys, order)
        .agg(F.max_by("_anchor", F.col(f"_anchor.{order}")).alias(name))
    )
    return left.join(found, [*keys, order])
