"""Near-duplicate texts at a Jaccard similarity, by SimHash anchors over blocks and an exact check.

Texts of similarity 0.8 (sets of five-word shingles, A-Z lowered) differ in some
15 % of SimHash bits, far beyond the 2 bits of `simhash`. So a text has BLOCKS
fingerprint blocks of 31 bits, and in each block it goes to every word of the binary
Hamming code of length 31 within distance 2 (covering radius 1 plus half of a
threshold of 2): to 1 or 16 anchors. Texts meet in a block for sure if they differ in
at most 2 of its bits, and now and then in 3 or 4. That is a matter of chance for texts
just above the limit: at 12 % of differing bits over 99 % meet in one of 12 blocks, at
15 % some 93 %. What meets is judged exactly.

Around an anchor, rows are streamed over in the order of their first fingerprints of 64
bits. One is a candidate with each leader before it (one that no leader was near) and
with the one that came last near the same leader, if they differ in at most NEAR_BITS.
So a group is not held in memory and its pairs are not laid out; leaders of an anchor
are far from each other. Candidates are checked by their exact similarity from whole
texts, first each text with its smallest partner, then all that are still in
different components.

What anchors left to chance is then sought exactly, among texts still in different
components. Two texts of similarity 0.8 share at least 80 % of the shingles of either, so
if all put their shingles in one order, the first 20 % of each and SHARED more have at
least SHARED in common (all of them, in texts with fewer). Texts that share as many of
these, and whose sizes and parities of shingles in bins allow 0.8, are checked as above. The order is by hash, with
shingles that many such texts have put last, which leaves few texts to a shingle; any order
gives the same pairs that are similar enough.

Equal texts are one node. Null and empty texts have no shingles and are similar to each
other; a text with fewer than five words has its whole sequence as its one shingle. A
very long text is worked on alone, a stretch of shingles at a time. Null ids sort last.
Rows of one id and text are kept once. Empty tables give empty results. Only the named
columns are read, and names that clash with helper columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilog.llm.common import fresh, matched, saved, small_batches
from vigilog.llm.components import components
from vigilog.llm.words import Words, groups, mix, powers, texts_of

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS = 12
#: Shingles that the beginnings of two similar texts have in common.
SHARED = 4
#: Texts that have a shingle in their beginnings from which on it is put last, and how many such shingles are.
OFTEN = 16
_LAST = 100_000
#: Numbers of 64 bits that tell how many shingles fall into each of as many bins, odd or even.
PARITIES = 8
#: Differing bits of 64 up to which two texts at an anchor are compared exactly.
NEAR_BITS = 18

_LENGTH = 31
_NUMBERS = np.arange(1, _LENGTH + 1, dtype=np.int64)
_STRETCH = 1 << 13
_SEEN = 100_000
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_SALTS = np.random.default_rng(5).integers(1, 1 << 63, BLOCKS // 2, dtype=np.uint64)
_LINK = "a long, b long"


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Different hashes of the shingles of one text's word hashes."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    sums = np.full(n, size, np.uint64)
    for k, power in enumerate(powers(_Q, size)):
        sums += words[k:k + n] * power
    return np.unique(mix(sums))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Exact Jaccard similarity of two sets, given as arrays without repeats; two empty sets are equal."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def beginning(shingles: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
    """The first shingles of a set in the common order: by hash, those of `last` (sorted) at the end."""
    keep = len(shingles) - (4 * len(shingles) + 4) // 5 + SHARED
    if last is not None and len(last):
        often = last[np.minimum(np.searchsorted(last, shingles), len(last) - 1)] == shingles
        shingles = np.concatenate([shingles[~often], shingles[often]])
    return shingles[:keep]


def parities(shingles: np.ndarray) -> np.ndarray:
    """A bit per bin of shingles, set if an odd number is in it: two sets differ in at least as many shingles as bits."""
    odd = np.bincount((shingles & np.uint64(64 * PARITIES - 1)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def _per_text(texts: list[str | None]) -> Iterator[np.ndarray]:
    found = Words(texts)
    edges = np.searchsorted(found.owner, np.arange(len(texts) + 1))
    for begin, end in zip(edges[:-1], edges[1:]):
        yield shingle_hashes(found.hash[begin:end])


def fingerprints(shingles: np.ndarray) -> np.ndarray:
    """Majority bits of a set of shingles: one number of 64 bits per two blocks."""
    out = np.zeros(len(_SALTS), np.uint64)
    for k, salt in enumerate(_SALTS if len(shingles) else ()):
        ones = np.zeros(64, np.int64)
        for begin in range(0, len(shingles), _STRETCH):
            part = mix(shingles[begin:begin + _STRETCH] ^ salt)
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(shingles), bitorder="little").view(np.uint64)[0]
    return out


def anchors(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the point, anchor) for every code word within distance 2 of each point of 31 bits."""
    bits = (points[:, None] >> (_NUMBERS - 1)[None, :]) & 1
    syndrome = np.bitwise_xor.reduce(np.where(bits == 1, _NUMBERS[None, :], 0), axis=1)
    exact, rest = np.flatnonzero(syndrome == 0), np.flatnonzero(syndrome)
    s = syndrome[rest]
    one = points[rest] ^ np.left_shift(1, s - 1)
    # Two flips reach a code word when their numbers xor to the syndrome; each pair once.
    other = _NUMBERS[None, :] ^ s[:, None]
    row, col = np.nonzero((_NUMBERS[None, :] < other) & (other > 0))
    two = points[rest][row] ^ np.left_shift(1, _NUMBERS[col] - 1) ^ np.left_shift(1, other[row, col] - 1)
    return np.concatenate([exact, rest, rest[row]]), np.concatenate([points[exact], one, two])


def _print_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    # Copies met in one task need their fingerprints once; forgetting some only costs time.
    seen: dict[int, np.ndarray] = {}
    starts: dict[int, tuple] = {}
    for frame in groups(batches):
        if len(seen) > _SEEN:
            seen.clear()
        nodes = frame["node"].tolist()
        new = frame[[n not in seen for n in nodes]].drop_duplicates("node")
        for node, shingles in zip(new["node"].tolist(), _per_text(texts_of(new))):
            seen[node] = fingerprints(shingles).view(np.int64)
            starts[node] = len(shingles), beginning(shingles).view(np.int64), parities(shingles)
        if nodes:
            prints = np.stack([seen[n] for n in nodes])
            # A task tells a text's beginning once.
            told = [starts.pop(n, (None, None, None)) for n in nodes]
            yield frame[["none", "doc_id", "node"]].assign(
                size=pd.array([t[0] for t in told], "Int64"), start=pd.Series([t[1] for t in told], frame.index, object),
                odd=pd.Series([t[2] for t in told], frame.index, object), **{f"p{k}": prints[:, k] for k in range(prints.shape[1])})


def _begun_anew(last: np.ndarray):
    """A function over texts: their beginnings with the shingles of `last` put last."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in groups(batches):
            sets = list(_per_text(texts_of(frame)))
            if sets:
                yield pd.DataFrame({"node": frame["node"].to_numpy(), "size": [len(x) for x in sets], "start": [beginning(x, last).view(np.int64) for x in sets]})
    return run


def _around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    low = np.int64((1 << _LENGTH) - 1)
    for frame in batches:
        values = frame["p0"].to_numpy()
        for block in range(BLOCKS):
            bits = frame[f"p{block // 2}"].to_numpy()
            at, anchor = anchors((bits >> (_LENGTH * (block % 2))) & low)
            yield pd.DataFrame({"key": anchor | (np.int64(block) << 32), "value": values[at]})


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by key and value: each with the leaders of its key and the last one near the same leader."""
    key, leaders = None, []  # each leader's fingerprint, and that of the last one near it
    for frame in batches:
        if not len(frame):
            continue
        keys, values = frame["key"].to_numpy(), frame["value"].to_numpy().view(np.uint64).tolist()
        edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])).tolist()
        out = set()
        for begin, end in zip(edges, edges[1:]):
            if keys[begin] != key:
                if end == begin + 1 < len(keys):
                    continue
                key, leaders = keys[begin], []
            for mine in values[begin:end]:
                alone = True
                for leader in leaders:
                    if (leader[0] ^ mine).bit_count() <= NEAR_BITS:
                        alone = False
                        out.add((leader[0], mine))
                        if (leader[1] ^ mine).bit_count() <= NEAR_BITS:
                            out.add((leader[1], mine))
                        leader[1] = mine
                if alone:
                    leaders.append([mine, mine])
        if out:
            yield pd.DataFrame(np.array(list(out), np.uint64).view(np.int64), columns=["a", "b"])


def _checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in groups(batches, "text"):
        pairs = zip(_per_text(texts_of(frame, "text_a")), _per_text(texts_of(frame, "text")))
        good = np.array([similarity(a, b) >= SIMILARITY for a, b in pairs], bool)
        yield frame.loc[good, ["a", "b"]]


def _placed(named: DataFrame, prints: DataFrame, ends: DataFrame) -> DataFrame:
    """`node` and `text` of the nodes of `ends`, each from its first place; rows of one id and text stay repeated."""
    first = prints.join(ends, "node", "left_semi").groupBy("node").agg(F.min(F.struct("none", "doc_id")).alias("at"))
    first = saved(first.select(F.col("at.none").alias("in_none"), F.col("at.doc_id").alias("in_doc"), F.col("node").alias("in_node")), "similar-places")
    here = (named["none"] == first["in_none"]) & (named["doc_id"] == first["in_doc"]) & (named["node"] == first["in_node"])
    return matched(named, first, here, "inner").select("node", "text")


def _texts(named: DataFrame, prints: DataFrame, ends: DataFrame) -> DataFrame:
    """`node` and `text` of the nodes of `ends`; saved."""
    return saved(_placed(named, prints, ends).dropDuplicates(["node"]), "similar-texts")


def _similar(named: DataFrame, prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs of texts, given by their hashes, whose exact similarity is high enough; saved."""
    texts = _texts(named, prints, pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct())
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.withColumnRenamed("node", "b"), "b")
    return saved(both.select("a", "b", "text_a", "text").mapInPandas(_checked, _LINK), "similar-links")


def _apart(starts: DataFrame) -> DataFrame:
    """`key`, `node`, `root`, `size` of the shingles in beginnings of texts of several components; the one shuffle of all beginnings carries these four only."""
    rows = starts.select("node", "root", "size", F.explode("start").alias("key")).repartition("key")
    whole = Window.partitionBy("key")
    rows = rows.select("*", F.min("root").over(whole).alias("low"), F.max("root").over(whole).alias("high")).where("low <> high")
    return rows.select("key", "node", "root", "size").dropDuplicates(["key", "node"])


def _missed(named: DataFrame, prints: DataFrame, roots: DataFrame) -> DataFrame:
    """All pairs of texts of different components that may be similar enough; saved."""
    told = prints.where("size > 0")
    named_roots = roots.select(F.col("node").alias("of"), "component")

    def rooted(starts: DataFrame) -> DataFrame:
        both = matched(starts, named_roots, starts["node"] == named_roots["of"], "left")
        return both.select("node", F.coalesce("component", "node").alias("root"), "size", "start")

    starts = told.select("node", "size", "start")
    rows = saved(_apart(rooted(starts)), "similar-apart")
    often = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > OFTEN).orderBy(F.desc("n"), "key").limit(_LAST).select("key")
    last = np.sort(np.array([r["key"] for r in often.collect()], np.int64).view(np.uint64))
    if len(last):
        # A beginning without any of these shingles stays as it is.
        ends = saved(rows.join(F.broadcast(often), "key", "left_semi").select("node").distinct(), "similar-often")
        anew = _placed(named, prints, ends).mapInPandas(_begun_anew(last), "node long, size long, start array<long>")
        of = ends.select(F.col("node").alias("of"))
        starts = matched(starts, of, starts["node"] == of["of"], "left_anti").unionByName(anew)
        rows = _apart(rooted(starts))
    # Parities are wide, so they join the few rows that are left.
    rows = saved(rows.join(told.select("node", "odd").dropDuplicates(["node"]), "node"), "similar-apart")
    a, b = (rows.select("key", *[F.col(n).alias(f"{n}_{c}") for n in ("node", "root", "size", "odd")]) for c in "ab")
    apart = sum(F.bit_count(F.col("odd_a")[k].bitwiseXOR(F.col("odd_b")[k])) for k in range(PARITIES))
    # Sets of similarity 0.8 differ in at most a ninth of both sizes.
    fits = (F.col("root_a") < F.col("root_b")) & (9 * apart <= F.col("size_a") + F.col("size_b")) & (5 * F.least("size_a", "size_b") >= 4 * F.greatest("size_a", "size_b"))
    met = a.join(b, "key").where(fits).groupBy("node_a", "node_b").agg(F.count("*").alias("n"), F.first(F.greatest("size_a", "size_b")).alias("size"))
    enough = F.col("n") >= F.least(F.lit(SHARED), F.ceil(4 * F.col("size") / 5))
    return saved(met.where(enough).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")), "similar-missed")


def _tied(roots: DataFrame, links: DataFrame) -> DataFrame:
    """`node` and `component` of saved `roots` with further `links` taken in; saved. Only components that these tie together are followed, not their texts."""
    for end in "ab":
        of = roots.select(F.col("node").alias("of"), "component")
        links = matched(links, of, links[end] == of["of"], "left").withColumn(end, F.coalesce("component", end)).drop("of", "component")
    ties = saved(components(links), "similar-ties")
    of = ties.select(F.col("node").alias("of"), F.col("component").alias("now"))
    held = matched(roots, of, roots["component"] == of["of"], "left").select("node", F.coalesce("now", "component").alias("component"))
    return saved(held.unionByName(ties.join(roots, "node", "left_anti")), "similar-roots")


def _found(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """`none` (whether the id is null), `doc_id` (0 then), `node` (the text's hash) and `component` per row of `docs`."""
    small_batches(docs.sparkSession)
    number = F.col(f"`{doc_id}`").cast("long")
    named = docs.select(
        number.isNull().alias("none"), F.coalesce(number, F.lit(0)).alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("node"), F.col(f"`{text}`").alias("text"))
    columns = ", ".join(f"p{k} long" for k in range(len(_SALTS)))
    prints = saved(named.mapInPandas(_print_rows, f"none boolean, doc_id long, node long, size long, start array<long>, odd array<long>, {columns}"), "similar-prints")
    # Texts of equal first fingerprints are one point, and candidates with the first of them.
    texts = prints.drop("none", "doc_id", "size", "start", "odd").dropDuplicates(["node"])
    points = saved(texts.groupBy("p0").agg(F.min(F.struct("node", *[f"p{k}" for k in range(1, len(_SALTS))])).alias("of")).select("p0", "of.*"), "similar-points")
    balls = points.drop("node").mapInPandas(_around, "key long, value long").repartition("key").sortWithinPartitions("key", "value")
    near = saved(balls.mapInPandas(_candidates, _LINK).distinct(), "similar-near")
    of_a, of_b = (points.select(F.col("p0").alias(f"p_{c}"), F.col("node").alias(f"node_{c}")) for c in "ab")
    near = near.join(of_a, F.col("a") == F.col("p_a")).join(of_b, F.col("b") == F.col("p_b")).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    equal = texts.select("p0", F.col("node").alias("b")).join(points.select("p0", F.col("node").alias("a")), "p0").select("a", "b")
    pairs = saved(near.unionAll(equal).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "similar-pairs")
    # First each text with its smallest partner only: of a large group of near copies that leaves few pairs between components.
    nearest = saved(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "similar-nearest")
    links = _similar(named, prints, nearest)
    roots = saved(components(links), "similar-roots")

    def root_of(end: str) -> DataFrame:
        return roots.select(F.col("node").alias(end), F.col("component").alias(f"root_{end}"))

    rest = pairs.join(nearest, ["a", "b"], "left_anti").join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
    rest = saved(rest.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"), "similar-rest")
    roots = _tied(roots, _similar(named, prints, rest))
    missed = _missed(named, prints, roots)
    if not missed.isEmpty():
        roots = _tied(roots, _similar(named, prints, missed))
    found = prints.select("none", "doc_id", "node").join(roots, "node", "left")
    return found.select("none", "doc_id", "node", F.coalesce("component", "node").alias("component"))


def similar_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id`, `text_hash`, `component` per row of `docs`: the class of texts that hang together by similarity, named by a text's hash."""
    return _found(docs, doc_id, text).select(F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"), F.col("node").alias("text_hash"), "component")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class of similar texts, with its columns: the one with the smallest id, of several such the first by text hash."""
    found = saved(_found(docs, doc_id, text), "similar")
    place = F.struct("none", "doc_id", "node")
    kept = found.groupBy("component").agg(F.min(place).alias("kept"))
    judged = found.groupBy("component", place.alias("place")).agg(F.count("*").alias("n")).join(kept, "component")
    of_none, of_doc, of_node = (fresh(docs, c) for c in ("of_none", "of_doc", "of_node"))
    named = [F.col("place.none").alias(of_none), F.col("place.doc_id").alias(of_doc), F.col("place.node").alias(of_node)]
    drop = saved(judged.where("place <> kept").select(*named), "similar-dropped")
    again = saved(judged.where("place = kept and n > 1").select(*named), "similar-repeated")

    def on(few: DataFrame) -> Column:
        number = docs[doc_id].cast("long")
        return (number.isNull() == few[of_none]) & (F.coalesce(number, F.lit(0)) == few[of_doc]) & (F.xxhash64(docs[text]) == few[of_node])

    left = matched(docs, drop, on(drop), "left_anti")
    if n := again.count():  # rows that are kept and stand there more than once
        once = matched(left, again, on(again), "left_semi", n).dropDuplicates([doc_id, text])
        left = matched(left, again, on(again), "left_anti", n).unionAll(once)
    return left
