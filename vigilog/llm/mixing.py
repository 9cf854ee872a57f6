"""Mixing sources to target weights with exact word budgets.

Every document gets a key from a hash of its id and text. Within a source,
documents are dealt into ranges of that key; word counts are summed per range,
the sums are prefix-summed per source, and a running sum inside each range
gives every document its place on the source's word axis. A source's mix is a
stretch of that axis, repeated in epochs and cut at its exact budget, so the
last document of a source may be taken in part.

Hash-random keys make ranges of one source equally large whatever the source
holds, so a hot source spreads over RANGES tasks. Reruns agree, as nothing
depends on row order or on partitions; equal rows have equal keys and are
interchangeable. A null text has size 0 and is never taken. Null sources are a
source of their own, last in order. Only the named columns are read; an empty
table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilog.llm.common import fresh, saved, word_count

#: Weights by the order of sources, the share of all words to take, the most epochs.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
#: Ranges of the key in each source.
RANGES = 4096


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """One row per source (`source`, `source_size`): its weight and its target in words.

    The budget is shared by weight; a source never gets more than `epochs` times
    its size, and the excess is shared again by weight among the others. With
    sources sorted by size per weight, those that hit their limit come first, so
    one running sum finds the level at which nobody is above it.
    """
    in_order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    everything = Window.partitionBy(F.lit(1))
    by_ratio = Window.orderBy("ratio", "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = (sizes.withColumn("place", F.row_number().over(in_order) - 1).withColumn("weight", weight)
            .withColumn("limit", F.col("source_size") * epochs).withColumn("ratio", F.col("limit") / F.col("weight")))
    rows = rows.withColumn("level", (F.lit(share) * F.sum("source_size").over(everything)
                                     - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(onward))
    # The first source in this order that stays below its limit gives the level for all.
    fits = F.when(F.col("level") <= F.col("ratio"), F.col("level"))
    all_rows = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.first(fits, ignorenulls=True).over(all_rows)
    target = F.least(F.col("limit").cast("double"), F.coalesce(level * F.col("weight"), F.col("limit").cast("double")))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def _key(doc_id: Column, text: Column, seed: int) -> Column:
    parts = [F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))]
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42,
        weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """One row per document: `doc_id`, `source`, `mix_key`, `size`, `source_size`, `target`, `taken` (words, repeats counted)."""
    sized = saved(docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"),
        _key(F.col(f"`{doc_id}`"), F.col(f"`{text}`"), seed).alias("mix_key")), "mix-sizes")
    digits = len(f"{RANGES - 1:x}")
    sized = sized.withColumn("part", (F.conv(F.substring("mix_key", 1, digits), 16, 10).cast("int") % RANGES))
    parts = sized.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("part_start", F.coalesce(F.sum("part_size").over(ahead), F.lit(0)))
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
    goals = goals.drop("weight").withColumnRenamed("source", "goal_source")
    starts = (parts.join(goals, F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source", "part_size")
              .withColumnsRenamed({"source": "part_source", "part": "in_part"}))
    within = Window.partitionBy("source", "part").orderBy("mix_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("part_source")) & (F.col("part") == F.col("in_part")))
    budget = F.floor("target")
    rounds = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - rounds * F.col("source_size") - F.col("part_start") - F.col("inside")
    taken = rounds * F.col("size") + F.least(F.greatest(rest, F.lit(0)), F.col("size"))
    return placed.select("doc_id", "source", "mix_key", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", n_chars: str | None = "n_chars",
          seed: int = 42) -> DataFrame:
    """The mix itself: a row for each time that a document is taken, with its columns; a part taken at a cut has the words before the cut."""
    cut, word, copy = fresh(docs, "taken"), fresh(docs, "size"), fresh(docs, "copy")
    mine = fresh(docs, "mix_key")
    # Equal keys are equal texts of one id: each is taken as often, in words, as all of them together.
    plan = mix(docs, doc_id, text, source, seed).groupBy("source", "mix_key").agg(
        F.sum("taken").alias("all"), F.first("size").alias(word), F.count("*").alias("n"))
    plan = plan.select(F.col("source").alias("plan_source"), F.col("mix_key").alias("plan_key"), word,
                       F.ceil(F.col("all") / F.col("n")).alias(cut)).where(F.col(cut) > 0)
    keyed = docs.withColumn(mine, _key(F.col(f"`{doc_id}`"), F.col(f"`{text}`"), seed))
    plan = plan.withColumnsRenamed({"plan_source": fresh(docs, "plan_source"), "plan_key": fresh(docs, "plan_key")})
    to_source, to_key = plan.columns[0], plan.columns[1]
    taken = keyed.join(plan, keyed[source].eqNullSafe(plan[to_source]) & (keyed[mine] == plan[to_key]))
    full = F.floor(F.col(cut) / F.col(word)).cast("int")
    part = (F.col(cut) - full * F.col(word)).cast("int")
    copies = F.concat(F.array_repeat(F.lit(0), full), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    taken = taken.withColumn(copy, F.explode(copies))
    # Pieces begin at words, and white space stays with the word before it; leading white space is a piece of its own.
    pieces = F.split(F.col(f"`{text}`"), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(F.col(f"`{text}`").rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    whole = F.col(copy) == 0
    out = taken.withColumn(text, F.when(whole, F.col(f"`{text}`")).otherwise(
        F.array_join(F.slice(pieces, F.lit(1), F.col(copy) + lead), "")))
    if n_chars and n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(whole, F.col(f"`{n_chars}`")).otherwise(F.length(text).cast("long")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
