"""Connected components of links between 64-bit nodes.

Alternating large-star and small-star steps: each node's larger neighbours are
tied to its smallest neighbour, then its smaller ones are. Both steps are a
minimum per node, which is combined before the shuffle, and a join back, whose
hot keys Spark splits. The links of each round are written to the shared
folder, so a lost executor costs a round at most and no plan grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import saved


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def components(links: DataFrame) -> DataFrame:
    """`node` and `component` (its smallest node) for each node that has a link; `links` has columns `a` and `b`."""
    now = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct()
    now = saved(now, "links")
    state = _state(now)
    while state[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = saved(small.unionAll(low.select("hi", F.col("m").alias("lo"))).distinct(), "links")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
