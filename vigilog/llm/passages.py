"""Repeated passages, found by banded MinHash over short paragraphs.

A paragraph ends at a line end or at a sentence end, and has four words at
least; a passage copied into other text has the same paragraphs wherever it
stands, but for the one that its first words complete. Equal paragraphs share a
content hash. For others, MinHash signatures over shingles of five words are
cut into BANDS bands of ROWS values: at a Jaccard similarity of 0.8, 1 - (1 -
0.8 ** 2) ** 6 = 99.8 % of pairs collide in a band. Paragraphs that collide are
compared by their exact Jaccard similarity (set of five-word shingles, A-Z
lowered; fewer words: the whole sequence), and links of 0.8 or more are joined
to classes by connected components.

Of each class the occurrence that is first by id stays; the others are marked.
So is every stretch of RUN_WORDS words that stands at an earlier place already,
wherever it starts and ends: of each such stretch the hash of its least
ANCHOR_WORDS words is its anchor, so equal stretches have equal anchors, and only
stretches whose anchor is met at two places are laid out and compared by their own
hashes. A run of marked paragraphs and stretches in a document is a repeated
passage if it has MIN_WORDS words or more, so short common lines and sentences stay
where they are.

Null and empty texts have no paragraphs. Rows with equal id and text count as
one document. Null ids sort first and are matched as equal. An empty table gives an
empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilog.llm.common import fresh, matched, saved, small_batches, word_count
from vigilog.llm.components import components
from vigilog.llm.runs import collisions, whole_runs
from vigilog.llm.words import Words, groups, mix, powers, sequence_hash, texts_of

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 6, 2
#: Least words of a paragraph, and of a run of repeated ones.
LEAST_WORDS = 4
MIN_WORDS = 20
#: Words of a stretch that is found wherever it starts and ends, and of the anchors in it.
RUN_WORDS = 50
ANCHOR_WORDS = 25
#: Places of one anchor from which its stretches are dealt to several groups.
HOT_PLACES = 50_000
#: Narrow rows handed on at a time.
NARROW_ROWS = 50_000

_SEEN = 400_000
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SALTS = np.random.default_rng(42).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True


class Paragraphs:
    """The paragraphs of some whole texts, as arrays: text number, place in it, character range, words, content hash."""

    def __init__(self, texts: list[str | None]):
        found = Words(texts)
        data, starts, ends, owner, text_ends = found.data, found.starts, found.ends, found.owner, found.text_ends
        self.text = np.zeros(0, np.int64)
        self.n = 0
        if not found.n:
            return
        self.words = found.hash
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        gap_end = np.append(starts[1:], len(data))
        last = np.append(owner[1:] != owner[:-1], True)
        stop = last | _ENDS[data[ends - 1]] | (lines[gap_end] > lines[ends])
        cuts, begin = [], 0
        for k, final in zip(np.flatnonzero(stop).tolist(), last[stop].tolist()):
            if final or k + 1 - begin >= LEAST_WORDS:
                cuts.append(k + 1)
                begin = k + 1
        last_word = np.array(cuts) - 1
        self.first = np.concatenate([[0], np.array(cuts[:-1], np.int64)])
        self.n_words = last_word - self.first + 1
        self.n = len(cuts)
        self.hash = sequence_hash(self.words, self.first, self.n_words, _Q)
        self.text = owner[self.first]
        opens = np.concatenate([[0], np.flatnonzero(np.diff(self.text)) + 1])
        self.place = np.arange(self.n) - np.repeat(opens, np.diff(np.append(opens, self.n)))
        self.word = self.first - np.repeat(self.first[opens], np.diff(np.append(opens, self.n)))
        # Characters: bytes that do not continue one; surrogates stand for one as well.
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        base = chars[np.concatenate([[0], text_ends[:-1]])][self.text]
        self.start = chars[starts[self.first]] - base
        text_close = chars[text_ends - 1][self.text] - base
        follows = np.append(self.text[1:] == self.text[:-1], False)
        self.end = np.where(follows, np.append(self.start[1:], 0), text_close)

    def bands(self) -> tuple[np.ndarray, np.ndarray]:
        """(band key, content hash) of each different paragraph that may resemble an unequal one."""
        none = np.zeros(0, np.uint64)
        if not self.n:
            return none, none
        # With fewer shingles than 1 / (1 - similarity) - 1, one shingle of difference is too much.
        least = SHINGLE + int(np.ceil(1 / (1 - SIMILARITY) - 1 - 1e-9)) - 1
        _, one = np.unique(self.hash, return_index=True)
        one = np.sort(one[self.n_words[one] >= least])
        if not len(one):
            return none, none
        n = len(self.words) - SHINGLE + 1
        shingles = np.zeros(n, np.uint64)
        for k, power in enumerate(powers(_Q, SHINGLE)):
            shingles += self.words[k:k + n] * power
        shingles = mix(shingles)
        cuts = np.stack([self.first[one], self.first[one] + self.n_words[one] - SHINGLE + 1], axis=1).ravel()
        keys = []
        for band in range(BANDS):
            key = np.full(len(one), band, np.uint64)
            for salt in _SALTS[band * ROWS:(band + 1) * ROWS]:
                salted = np.append(mix(shingles ^ salt), np.uint64(0))
                key = mix(key * _P + np.minimum.reduceat(salted, cuts)[::2])
            keys.append(key)
        return np.concatenate(keys), np.tile(self.hash[one], BANDS)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each stretch of `size` words, by its first word."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    sums, have, power = words, 1, np.array([_Q])
    while have * 2 <= size:
        sums = sums[:-have] + sums[have:] * power
        power, have = power * power, have * 2
    # Two stretches that overlap or touch are the whole one.
    return mix(sums[:n] * _P + mix(sums[size - have:size - have + n]))


class Stretches:
    """The stretches of RUN_WORDS words inside each of some texts: first word, content hash, anchor."""

    def __init__(self, found: Words):
        n = found.n - RUN_WORDS + 1
        self.first = np.zeros(0, np.int64)
        self.owner, self.hash, self.anchor, self.anchors = self.first, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if n < 1:
            return
        inside = found.owner[:n] == found.owner[RUN_WORDS - 1:]
        self.first = np.flatnonzero(inside)
        self.owner = found.owner[self.first]
        self.hash = window_hashes(found.hash, RUN_WORDS)[self.first]
        self.values = window_hashes(found.hash, ANCHOR_WORDS)
        span, least, have = RUN_WORDS - ANCHOR_WORDS + 1, self.values, 1
        while have * 2 <= span:
            least, have = np.minimum(least[:-have], least[have:]), have * 2
        least = np.minimum(least[:n], least[span - have:span - have + n])
        self.anchor = least[self.first]
        # Places of anchors, each once however many stretches it serves.
        at = np.zeros(len(self.values), bool)
        for k in range(span):
            at[k:k + n] |= inside & (least == self.values[k:k + n])
        self.anchors = np.flatnonzero(at)


_OCCURRENCE = "doc_id long, text_hash long, place int, word long, start long, end long, n_words int, hash long"
_AT = "none boolean, doc_id long, text_hash long, word int, start int, end int"
_STRETCH = f"hash long, salt int, {_AT}"
_LATER = f"{_AT}, class_id long, kept_none boolean, kept_id long, n_copies long"


#: What names a document in the stretches' rows: whether its id is null, its id or 0, and its text.
_DOC = ("none", "doc_id", "text_hash")


def _occurrence_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in groups(batches):
        p = Paragraphs(texts_of(frame))
        if p.n:
            yield pd.DataFrame({
                "doc_id": frame["doc_id"].array[p.text], "text_hash": frame["text_hash"].to_numpy()[p.text],
                "place": p.place.astype(np.int32), "word": p.word, "start": p.start, "end": p.end, "n_words": p.n_words.astype(np.int32),
                "hash": p.hash.view(np.int64)})


def _band_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    # Copies met in one task need their bands once; forgetting some only costs rows.
    seen: set[int] = set()
    for frame in groups(batches):
        keys, values = Paragraphs(texts_of(frame)).bands()
        if not len(keys):
            continue
        own = values[:len(values) // BANDS].tolist()
        new = np.tile(np.array([v not in seen for v in own]), BANDS)
        if len(seen) > _SEEN:
            seen.clear()
        seen.update(own)
        yield pd.DataFrame({"key": keys[new].view(np.int64), "value": values[new].view(np.int64)})


def _anchor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in groups(batches):
        found = Words(texts_of(frame))
        s = Stretches(found)
        if len(s.anchors):
            rows = pd.DataFrame({"text": found.owner[s.anchors], "value": s.values[s.anchors].view(np.int64)})
            rows = rows.groupby(["text", "value"], sort=False).size().reset_index(name="n")
            at = rows["text"].to_numpy()
            yield pd.DataFrame({**{c: frame[c].to_numpy()[at] for c in _DOC}, "value": rows["value"], "n": rows["n"].astype(np.int32)})


def _stretch_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in groups(batches):
        found = Words(texts_of(frame))
        s = Stretches(found)
        edges = np.searchsorted(s.owner, np.arange(len(frame) + 1))
        wanted, salt = np.zeros(len(s.first), bool), np.zeros(len(s.first), np.int32)
        for k, (values, parts, of_text) in enumerate(zip(frame["anchors"], frame["parts"], frame["text_hash"])):
            part = slice(edges[k], edges[k + 1])
            values, parts = np.asarray(values, np.int64).view(np.uint64), np.asarray(parts, np.int64)
            wanted[part] = np.isin(s.anchor[part], values)
            for value, n in zip(values[parts > 1], parts[parts > 1].tolist()):
                salt[part][s.anchor[part] == value] = 1 + of_text % n
        first, owner = s.first[wanted], s.owner[wanted]
        if not len(first):
            continue
        chars = np.concatenate([[0], np.cumsum((found.data & 0xC0) != 0x80)])
        base = chars[np.concatenate([[0], found.text_ends[:-1]])][owner]
        after = first + RUN_WORDS
        last = np.append(found.owner, -1)[after] != owner
        end = np.where(last, chars[found.text_ends - 1][owner], chars[np.append(found.starts, 0)[after]])
        yield pd.DataFrame({
            "hash": s.hash[wanted].view(np.int64), "salt": salt[wanted], **{c: frame[c].to_numpy()[owner] for c in _DOC},
            "word": (first - np.searchsorted(found.owner, owner)).astype(np.int32),
            "start": (chars[found.starts[first]] - base).astype(np.int32), "end": (end - base).astype(np.int32)})


def _together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same rows in fewer and larger frames; batches are small for the sake of whole texts, these rows are narrow."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= NARROW_ROWS:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def _later_stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by hash, salt and place: those that do not overlap the first of their group, with that first's id.

    The first of a salted group is given too, with 0 copies. A group is streamed over, so its size is not bound by memory.
    """
    held, seen = None, 0  # the first row of the group that is open, and its rows so far
    for frame in _together(batches):
        n = len(frame)
        if not n:
            continue
        columns = {c: frame[c].to_numpy() for c in frame.columns}
        new = np.ones(n, bool)
        for k, c in enumerate(("hash", "salt")):
            differs = np.append(held is None or held[c] != columns[c][0], columns[c][1:] != columns[c][:-1])
            new = new & differs if not k else new | differs
        at = np.where(new, np.arange(n), -1)
        np.maximum.accumulate(at, out=at)
        before = at < 0

        def first(c: str) -> np.ndarray:
            own = columns[c][np.maximum(at, 0)]
            return np.where(before, held[c], own) if before.any() else own

        count = np.arange(n) - at + 1
        count[before] = seen + np.arange(1, n + 1)[before]
        same = np.ones(n, bool)
        for c in _DOC:
            same &= first(c) == columns[c]
        opens = new & (columns["salt"] > 0)
        take = opens | ~same | (columns["word"] >= first("word") + RUN_WORDS)
        if take.any():
            yield pd.DataFrame({
                **{c: columns[c][take] for c in (*_DOC, "word", "start", "end")}, "class_id": columns["hash"][take],
                "kept_none": first("none")[take], "kept_id": first("doc_id")[take], "n_copies": np.where(opens, 0, count)[take]})
        held, seen = {c: first(c)[-1] for c in columns}, int(count[-1])


def _joined_stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by document and word: one row per run of stretches that touch (two, if a frame ends inside one)."""
    for frame in _together(batches):
        if not len(frame):
            continue
        word = frame["word"].to_numpy()
        opens = np.append(True, word[1:] > word[:-1] + RUN_WORDS)
        for c in _DOC:
            opens[1:] |= frame[c].to_numpy()[1:] != frame[c].to_numpy()[:-1]
        at = np.flatnonzero(opens)
        last = np.append(at[1:], len(frame)) - 1
        out = frame.iloc[at].reset_index(drop=True)
        named = ~frame["kept_none"].to_numpy()
        most = np.iinfo(np.int64).max
        out["kept_id"] = np.minimum.reduceat(np.where(named, frame["kept_id"].to_numpy(), most), at)
        out["kept_none"] = ~np.logical_or.reduceat(named, at)
        out["n_copies"] = np.maximum.reduceat(frame["n_copies"].to_numpy(), at)
        out["end"] = frame["end"].to_numpy()[last]
        out["n_words"] = word[last] - word[at] + RUN_WORDS
        yield out[[*_DOC, "word", "start", "end", "class_id", "kept_none", "kept_id", "n_copies", "n_words"]]


def shingle_set(text: str) -> frozenset:
    """Five-word shingles of a paragraph, or its whole sequence of words if it has fewer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return frozenset(zip(*(words[k:] for k in range(SHINGLE)))) if len(words) >= SHINGLE else frozenset([tuple(words)])


def jaccard(a: frozenset, b: frozenset) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def linked_members(sets: list[frozenset]) -> list[tuple[int, int]]:
    """Links that tie together all members that hang together by similarity.

    A shingle that only one member has is in no intersection. So members with equal sets of other shingles and equal sizes are of
    one kind: they have equal similarities to all others, and all or none of them to each other; variants of a template come
    to few kinds. Two similar sets share one of the rarest shingles of both, so a kind meets only those that have one of its
    own rarest; of these, kinds that already hang together with it are passed over.
    """
    if len(sets) == 2:
        return [(0, 1)] if jaccard(*sets) >= SIMILARITY else []
    count = Counter(chain.from_iterable(sets))
    kinds: dict[tuple[frozenset, int], list[int]] = defaultdict(list)
    for k, one in enumerate(sets):
        kinds[frozenset(s for s in one if count[s] > 1), len(one)].append(k)
    members = list(kinds.values())
    root = list(range(len(kinds)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    by_shingle: dict[tuple, list[int]] = defaultdict(list)
    links, apart = [], set()
    shapes = list(kinds)
    for k, (mine, size) in enumerate(shapes):
        if len(members[k]) > 1:
            if len(mine) / (2 * size - len(mine)) >= SIMILARITY:
                links += [(members[k][0], m) for m in members[k][1:]]
            else:
                apart.add(k)
        most = size - ceil(SIMILARITY * size - 1e-9) + 1 - (size - len(mine))
        rare = sorted(mine, key=lambda s: (count[s], s))[:max(0, most)]
        for other in dict.fromkeys(chain.from_iterable(by_shingle[s] for s in rare)):
            if find(other) == find(k):
                continue
            both = len(mine & shapes[other][0])
            if both / (size + shapes[other][1] - both) < SIMILARITY:
                continue
            links.append((members[other][0], members[k][0]))
            for one, to in ((k, other), (other, k)):
                if one in apart:
                    links += [(members[to][0], m) for m in members[one][1:]]
                    apart.discard(one)
            root[find(k)] = find(other)
        for s in rare:
            by_shingle[s].append(k)
    return links


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in whole_runs(batches, "key"):
        keys, values, sets = frame["key"].to_numpy(), frame["value"].tolist(), [shingle_set(t) for t in frame["content"]]
        edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])).tolist()
        out = []
        for begin, end in zip(edges, edges[1:]):
            out += [(values[begin + a], values[begin + b]) for a, b in linked_members(sets[begin:end])]
        if out:
            yield pd.DataFrame(out, columns=["a", "b"]).drop_duplicates()


def _named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), F.col(f"`{text}`").alias("text"))


def _contents(named: DataFrame, places: DataFrame, wanted: DataFrame) -> DataFrame:
    """`value` and `content` of wanted content hashes, each read from one occurrence."""
    first = F.min(F.struct("doc_id", "text_hash", "start", "end")).alias("at")
    at = saved(matched(places, wanted, places["hash"] == wanted["value"], "inner").groupBy("value").agg(first).select(
        "value", F.col("at.doc_id").alias("in_doc"), F.col("at.text_hash").alias("in_text"), F.col("at.start").alias("start"), F.col("at.end").alias("end")), "paragraph-places")
    here = named["doc_id"].eqNullSafe(at["in_doc"]) & (named["text_hash"] == at["in_text"])
    piece = F.substring(F.col("text"), F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    return matched(named, at, here, "inner").select("value", piece.alias("content")).dropDuplicates(["value"])


def _told_apart(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The first document of each text, as `doc_id`, `text_hash` and `text`; and all others, with that first one's id and the number of both."""
    named = _named(docs, doc_id, text)
    equal = named.groupBy("text_hash").agg(F.min(F.struct("doc_id")).alias("first"), F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"))
    equal = saved(equal.where("n > 1").select(F.col("text_hash").alias("equal_hash"), F.col("first.doc_id").alias("first_id"), "ids"), "passage-equal")
    both = matched(named, equal, named["text_hash"] == equal["equal_hash"], "left")
    own = F.col("equal_hash").isNull() | F.col("doc_id").eqNullSafe(F.col("first_id"))
    copies = both.where(~own).select("doc_id", "text_hash", word_count(F.col("text")).alias("n_words"), F.length("text").alias("n_chars"), "first_id", "ids")
    return both.where(own).select("doc_id", "text_hash", "text"), copies.dropDuplicates(["doc_id", "text_hash"])


def classes(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Saved occurrences of all paragraphs, and (`node`, `component`) of the content hashes that resemble unequal ones."""
    small_batches(named.sparkSession)
    places = saved(named.mapInPandas(_occurrence_rows, _OCCURRENCE), "paragraphs")
    hits = saved(collisions(named.select("text").mapInPandas(_band_rows, "key long, value long")), "paragraph-hits")
    wanted = saved(hits.select("value").distinct(), "paragraph-values")
    texts = saved(_contents(named, places, wanted), "paragraph-texts")
    together = hits.join(texts, "value").repartition("key").sortWithinPartitions("key", "value")
    return places, components(together.mapInPandas(_verified, "a long, b long"))


def _after_first(rows: DataFrame) -> DataFrame:
    order = ["hash", "salt", F.col("none").desc(), "doc_id", "text_hash", "word"]
    return rows.repartition("hash", "salt").sortWithinPartitions(*order).mapInPandas(_later_stretches, _LATER)


def stretches(named: DataFrame, hot_places: int = HOT_PLACES) -> DataFrame:
    """Stretches of RUN_WORDS words that stand at an earlier place already, joined to runs.

    Rows go to the others of their hash in one shuffle, and the later ones back to their document in a second. If an anchor has
    more than `hot_places` places, its stretches are dealt to several groups by their text; the first rows of those groups meet in
    a second round, so one place is kept in all. `kept_doc_id` is then the first of a group.
    """
    named = named.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text_hash", "text")
    anchors = saved(named.mapInPandas(_anchor_rows, "none boolean, doc_id long, text_hash long, value long, n int"), "stretch-anchors")
    often = anchors.groupBy("value").agg(F.sum("n").alias("n")).where("n > 1")
    often = saved(often.select(F.col("value").alias("often"), F.ceil(F.col("n") / hot_places).cast("long").alias("n_parts")), "stretch-shared")
    by_text = matched(anchors, often, anchors["value"] == often["often"], "inner").groupBy(*[F.col(c).alias(f"in_{c}") for c in _DOC]).agg(
        F.collect_list("often").alias("anchors"), F.collect_list("n_parts").alias("parts"))
    by_text = saved(by_text, "stretch-texts")
    here = (named["none"] == by_text["in_none"]) & (named["doc_id"] == by_text["in_doc_id"]) & (named["text_hash"] == by_text["in_text_hash"])
    # Lists of anchors are not narrow rows, so this join is never broadcast by count.
    wanted = named.join(by_text, here).select(*_DOC, "text", "anchors", "parts")
    later = _after_first(wanted.mapInPandas(_stretch_rows, _STRETCH))
    if not often.where("n_parts > 1").isEmpty():
        later = saved(later, "stretch-later")
        firsts = later.where("n_copies = 0").withColumnRenamed("class_id", "hash").withColumn("salt", F.lit(0))
        later = later.where("n_copies > 0").unionAll(_after_first(firsts.select("hash", "salt", *_DOC, "word", "start", "end")))
    by_place = later.repartition(*_DOC).sortWithinPartitions(*_DOC, "word")
    runs = by_place.mapInPandas(_joined_stretches, _LATER + ", n_words int")
    return runs.select(
        F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"), "text_hash", "word", "start", "end", "n_words", "class_id",
        F.when(~F.col("kept_none"), F.col("kept_id")).alias("kept_doc_id"), "n_copies")


_MARKED = ["doc_id", "text_hash", "word", "start", "end", "n_words", "class_id", "kept_doc_id", "n_copies"]


def _later(each: DataFrame, key: str, place: str, name: str) -> DataFrame:
    """The rows of `each` but for the first of their `key`, once each, with the first's id and the number of rows."""
    at = F.struct(F.col("doc_id"), F.col("text_hash"), F.col(place))
    first = each.groupBy(key).agg(F.min(at).alias("kept"), F.count("*").alias("n_copies")).where("n_copies > 1")
    # Written, so that the join reads a table of its own and Spark can split its hot classes.
    first = saved(first.withColumnRenamed(key, "first_class"), name)
    later = matched(each, first, each[key] == first["first_class"], "inner")
    same = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("text_hash") == F.col("kept.text_hash"))
    later = later.where(~same | (F.col(place) > F.col(f"kept.{place}")))
    return later.select(*each.columns, F.col("kept.doc_id").alias("kept_doc_id"), "n_copies").dropDuplicates(["doc_id", "text_hash", place])


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per repeated passage that is to go.

    `doc_id`, `text_hash`, `start` and `end` (characters, end excluded), `n_words`, `n_paragraphs`, `kept_doc_id` (smallest id that
    has an earlier copy of a part of it), `class_id` (of its first paragraph or stretch), `n_copies` (most texts that have a part,
    for stretches those up to this one). A document that is a copy as a whole is one passage, of no paragraphs: its class is its
    text's hash, its copies are those of the text.
    """
    small_batches(docs.sparkSession)
    named, copies = _told_apart(docs, doc_id, text)
    places, roots = classes(named)
    roots = saved(roots.withColumnsRenamed({"node": "of_hash"}), "paragraph-classes")
    each = matched(places, roots, places["hash"] == roots["of_hash"], "left").select(
        "doc_id", "text_hash", "place", "word", "start", "end", "n_words", F.coalesce("component", "hash").alias("class_id"))
    marked = _later(each, "class_id", "place", "passage-firsts").select(*_MARKED, F.lit(1).alias("paragraph"))
    again = stretches(named)
    marked = marked.unionAll(again.select(*_MARKED, F.lit(0).alias("paragraph"))).withColumn("stop", F.col("word") + F.col("n_words"))
    in_text = Window.partitionBy("doc_id", "text_hash").orderBy("word", "stop", "paragraph")
    reached = F.max("stop").over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    runs = marked.withColumn("opens", F.coalesce(F.col("word") > reached, F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("opens").over(in_text.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.groupBy("doc_id", "text_hash", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max("stop") - F.min("word")).alias("n_words"), F.sum("paragraph").alias("n_paragraphs"),
        F.min("kept_doc_id").alias("kept_doc_id"), F.min_by("class_id", F.struct("word", "stop", "paragraph")).alias("class_id"), F.max("n_copies").alias("n_copies"))
    whole = copies.select(
        "doc_id", "text_hash", F.lit(0).alias("start"), F.col("n_chars").alias("end"), "n_words", F.lit(0).alias("n_paragraphs"),
        F.col("first_id").alias("kept_doc_id"), F.col("text_hash").alias("class_id"), F.col("ids").alias("n_copies"))
    return found.drop("run").unionByName(whole).where(F.col("n_words") >= min_words)


def _without(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    out = []
    for text, begin, end in zip(texts, starts, ends):
        if begin is not None and text is not None:
            parts, at = [], 0
            for a, b in sorted(zip(begin, end)):
                parts.append(text[at:a])
                at = b
            text = "".join([*parts, text[at:]])
        out.append(text)
    return pd.Series(out, dtype=object)


def removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """`docs` with repeated passages cut out of the texts; documents that have no word left go, if they had any."""
    spans = repeated(docs, doc_id, text).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    named = ("cut_doc", "cut_hash", "cut_starts", "cut_ends")
    names = [fresh(docs, n) for n in named]
    spans = saved(spans.select(*[c.alias(n) for c, n in zip((F.col("doc_id"), F.col("text_hash"), F.col("spans.start"), F.col("spans.end")), names)]), "passage-cuts")
    same = docs[doc_id].cast("long").eqNullSafe(spans[names[0]]) & (F.xxhash64(docs[text]) == spans[names[1]])
    joined = matched(docs, spans, same, "left")
    cut = F.col(names[2]).isNotNull()
    less = F.pandas_udf(_without, "string").asNondeterministic()
    short = joined.withColumn(text, F.when(cut, less(F.col(f"`{text}`"), F.col(names[2]), F.col(names[3]))).otherwise(F.col(f"`{text}`")))
    if n_chars and n_chars in docs.columns:
        short = short.withColumn(n_chars, F.when(cut, F.length(text).cast("long")).otherwise(F.col(f"`{n_chars}`")))
    return short.where(~cut | F.col(f"`{text}`").rlike(r"[^\x20\x09-\x0D]")).select(*[F.col(f"`{c}`") for c in docs.columns])
