"""SimHash near-duplicates by anchor points of a covering code.

A text's fingerprint has the majority bits of its shingles' hashes. Anchors are
the words of the binary Hamming code of length 63 over fingerprint bits 1 to 63:
it is perfect, so every point has an anchor within its covering radius, 1. Two
fingerprints that differ in at most 2 bits have a point halfway, at most 1 from
each, and that point's anchor is at most 1 + 1 from both. So each fingerprint
goes to every anchor within 2 (the radius plus half of the threshold on either
side, the sharp form of radius plus threshold): itself if it is a code word, else
one anchor at distance 1 and 31 at distance 2. No link can be missed, and only
fingerprints in the same small ball meet; an anchor has at most 4,034 different
ones around it, whatever the table holds.

Equal fingerprints are one node from the start. Around an anchor a search over
exact Hamming distances finds the local groups and gives one link per member;
these links are joined to components over the whole table.

Null and empty texts have fingerprint zero and link like any other. Null ids
are kept; a component's id is the smallest id that is not null, or null if
there is none. Equal rows get equal results; an empty table gives an empty
result. Only the named columns are read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import matched, saved, small_batches
from vigilog.llm.components import components
from vigilog.llm.runs import shared

#: Words of a shingle, seed of XXH64, bits in which linked fingerprints may differ.
SHINGLE = 3
SEED = 42
DISTANCE = 2

_BITS = np.arange(1, 64, dtype=np.int64)
_POWERS = np.left_shift(np.uint64(1), _BITS.astype(np.uint64))
_BLOCK = 1 << 15


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a whole text, as an unsigned number."""
    # Bytes split at ASCII white space alone and lower ASCII letters alone.
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    hashes = map(partial(xxhash.xxh64_intdigest, seed=SEED), map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)))))
    n = len(words) - SHINGLE + 1
    values = np.fromiter(hashes, np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, _BLOCK):
        part = values[k:k + _BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64), dtype="int64")


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every (anchor, fingerprint) within distance 2 over bits 1 to 63; unsigned numbers."""
    points = prints & ~np.uint64(1)
    set_bits = (points[:, None] >> _BITS.astype(np.uint64)[None, :]) & np.uint64(1)
    syndrome = np.bitwise_xor.reduce(np.where(set_bits == 1, _BITS[None, :], 0), axis=1)
    code = syndrome == 0
    rest, s, own = points[~code], syndrome[~code], prints[~code]
    near = rest ^ np.left_shift(np.uint64(1), s.astype(np.uint64))
    # Two flips i and j reach a code word when their numbers xor to the syndrome; each pair once.
    other = _BITS[None, :] ^ s[:, None]
    row, col = np.nonzero((_BITS[None, :] < other) & (other > 0))
    far = rest[row] ^ _POWERS[col] ^ np.left_shift(np.uint64(1), other[row, col].astype(np.uint64))
    return np.concatenate([points[code], near, far]), np.concatenate([prints[code], own, own[row]])


def _anchor_rows(batches):
    for batch in batches:
        values = batch["value"].to_numpy().astype(np.int64).view(np.uint64)
        for k in range(0, len(values), 4096):
            key, value = anchors(values[k:k + 4096])
            yield pd.DataFrame({"key": key.view(np.int64), "value": value.view(np.int64)})


def local_links(values: np.ndarray) -> list[tuple[int, int]]:
    """Links that tie together all different fingerprints of one ball that hang together: one per member, to its group's first."""
    left, links = values.copy(), []
    while len(left):
        root, todo = left[0], [left[0]]
        left = left[1:]
        while todo and len(left):
            close = np.bitwise_count((left ^ todo.pop()).view(np.uint64)) <= DISTANCE
            found = left[close].tolist()
            links += [(int(root), x) for x in found]
            todo += found
            left = left[~close]
    return links


def _ball_links(keys: np.ndarray, values: np.ndarray, first: np.ndarray) -> pd.DataFrame:
    sizes = np.diff(first)
    two = first[:-1][sizes == 2]
    close = np.bitwise_count((values[two] ^ values[two + 1]).view(np.uint64)) <= DISTANCE
    a, b = values[two][close], values[two + 1][close]
    more = [link for k in np.flatnonzero(sizes > 2) for link in local_links(values[first[k]:first[k + 1]])]
    if more:
        x, y = np.array(more, np.int64).T
        a, b = np.concatenate([a, x]), np.concatenate([b, y])
    return pd.DataFrame({"a": a, "b": b}).drop_duplicates()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: `doc_id`, `text_hash`, `fingerprint` (16 hex digits), `component_id`."""
    small_batches(docs.sparkSession)
    of_text = F.pandas_udf(_fingerprints, "long")
    prints = saved(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"),
                               of_text(F.col(f"`{text}`")).alias("value")), "fingerprints")
    nodes = prints.groupBy("value").agg(F.min("doc_id").alias("first_id"))
    around = nodes.select("value").mapInPandas(_anchor_rows, "key long, value long")
    roots = components(shared(around, _ball_links, "a long, b long"))
    nodes = nodes.join(roots.withColumnRenamed("node", "value"), "value", "left")
    root = F.coalesce("component", "value")
    first = nodes.where("component is not null").groupBy("component").agg(F.min("first_id").alias("component_id"))
    linked = nodes.join(first, "component", "left").select(
        F.col("value").alias("of"), F.when(F.col("component").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"))
    return prints.join(linked, prints["value"] == linked["of"]).select(
        "doc_id", "text_hash", F.lower(F.lpad(F.hex("value"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, with its columns: the one with the smallest id, of several such the first by text."""
    found = saved(near_duplicates(docs, doc_id, text), "near-duplicates")
    # Components without any id are told apart by their fingerprints' class only; each keeps one row.
    group = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("nameless")]
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    kept = found.groupBy(*group).agg(F.min(rank).alias("k")).select("k.doc_id", "k.text_hash")
    counts = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    same = kept["doc_id"].eqNullSafe(counts["doc_id"]) & (kept["text_hash"] == counts["text_hash"])
    drop = saved(counts.join(kept, same, "left_anti").select(F.col("doc_id").alias("drop_id"), F.col("text_hash").alias("drop_hash")), "dropped")
    again = saved(counts.where("n > 1").join(kept, same, "left_semi").select(F.col("doc_id").alias("drop_id"), F.col("text_hash").alias("drop_hash")), "repeated")

    def on(few: DataFrame):
        return docs[doc_id].eqNullSafe(few["drop_id"]) & (F.xxhash64(docs[text]) == few["drop_hash"])

    left = matched(docs, drop, on(drop), "left_anti")
    if n := again.count():  # rows that are kept and stand there more than once
        once = matched(left, again, on(again), "left_semi", n).dropDuplicates([doc_id, text])
        left = matched(left, again, on(again), "left_anti", n).unionAll(once)
    return left
