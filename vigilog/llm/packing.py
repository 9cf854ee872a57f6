"""Packing token sequences by non-negative least squares over length classes.

Documents are tokenised and cut into windows and a rest, so that every id lies
in one piece. Piece lengths fall into classes of GRAIN tokens; the counts per
class are all that the driver sees, 256 numbers whatever the table holds.
Combinations of at most DEPTH classes that fill a window exactly are the columns
of a least-squares problem, whose solution says how often to repeat each. The
counts are rounded down to whole numbers that the classes can serve; what is
left is packed greedily, largest class first, each time with the largest classes
that still fit, as often as the rarest of them allows.

The layout is a short list of combinations and repeats. A piece finds its place
from its rank in its class, which comes from counts per range of a hash key, so
no class, however common, is ordered in one task.

Null and empty texts are the end id alone. Equal rows are packed each on its
own and are interchangeable. An empty table gives an empty result. Long texts are
tokenised one at a time. Only the named columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilog.llm.common import saved, small_batches

WINDOW = 2048
GRAIN = 8
DEPTH = 3
END_ID = 1
#: Ranges of the hash key in each class, for ranks.
RANGES = 1024
#: Words whose ids a worker keeps: a store for speed, results do not depend on it.
KEPT_WORDS = 400_000

# White space at which this tokeniser never joins anything.
_CHUNK = re.compile(r"[^ \n\t\r]+")
_SPECIAL = "<|"
# Words whose pieces follow from their letters alone: printable ASCII without apostrophes (contractions are pieces of their own), and
# Latin letters of one code point each, which have one lower case and are in composed form.
_SIMPLE = re.compile("[!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_PIECE = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level names of the Latin letters: printable bytes stand for themselves, the others for code points from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    name = {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}
    return {c: "".join(name[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)}


_BYTE_LETTERS = _byte_letters()


class WordTokenizer:
    """Ids of whole texts as little-endian 32-bit numbers, a word at a time.

    The vocabulary's rules drop white space and never look across it, so a
    text's ids are its words' ids in a row. The pieces of simple words go to the
    merge rules directly, all other words through the whole tokeniser.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.merges = self.whole.model
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        got = self.parts.get(piece)
        if got is None:
            got = np.array([t.id for t in self.merges.tokenize(piece.translate(_BYTE_LETTERS))], "<u4").tobytes()
            if len(self.parts) < KEPT_WORDS:
                self.parts[piece] = got
        return got

    def _word(self, word: str) -> bytes:
        if _SIMPLE.fullmatch(word) and _SPECIAL not in word:
            pieces = _PIECE.findall(word.lower())
            got = self._piece(pieces[0]) if len(pieces) == 1 else b"".join(map(self._piece, pieces))
        else:
            got = np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.known) < KEPT_WORDS:
            self.known[word] = got
        return got

    def ids(self, text: str | None) -> bytes:
        known, word = self.known, self._word
        return b"".join([known[w] if w in known else word(w) for w in _CHUNK.findall(text)]) if text else b""


@lru_cache(maxsize=1)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, window: int = WINDOW,
           keep_ids: bool = False) -> DataFrame:
    """Pieces of every document: `doc_id`, `start`, `length`, `ids_crc32`, `doc_tokens`, and `ids` (binary, 32-bit) if asked for."""
    small_batches(docs.sparkSession)
    path = path or vocabulary()
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = tokenizer(path)
        for batch in batches:
            rows = []
            for doc, content in zip(batch["doc_id"], batch["text"]):
                data = coder.ids(content if isinstance(content, str) else None) + end
                total = len(data) // 4
                for start in range(0, total, window):
                    part = data[4 * start:4 * (start + window)]
                    rows.append((None if pd.isna(doc) else int(doc), start, len(part) // 4, zlib.crc32(part), total, *([part] if keep_ids else [])))
            out = pd.DataFrame(rows, columns=columns)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInPandas(cut, schema)


def combinations(units: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Up to `depth` class sizes, largest first, that fill a window of so many units exactly."""
    def fill(left: int, most: int, deep: int) -> Iterator[tuple[int, ...]]:
        if left <= most:
            yield (left,)
        if deep > 1:
            for size in range(min(most, left - 1), 0, -1):
                if size * deep < left:
                    break
                yield from ((size, *rest) for rest in fill(left - size, size, deep - 1))

    return sorted(set(fill(units, units, depth)), reverse=True)


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares with no negative part, by active sets: the column that helps most comes in, columns that would turn negative go out."""
    n = a.shape[1]
    x, inside = np.zeros(n), np.zeros(n, bool)
    gram, target = None, a.T @ b
    enough = 1e-9 * max(1.0, np.abs(target).max(initial=0))
    for _ in range(3 * a.shape[0] + 30):
        slope = target - a.T @ (a[:, inside] @ x[inside])
        slope[inside] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= enough:
            break
        inside[best] = True
        while True:
            at = np.flatnonzero(inside)
            gram = a[:, at].T @ a[:, at]
            gram[np.diag_indices(len(at))] += 1e-9
            z = np.linalg.solve(gram, target[at])
            if z.min() > 0:
                x[:] = 0
                x[at] = z
                break
            low = z <= 0
            now = x[at]
            step = np.min(now[low] / np.maximum(now[low] - z[low], 1e-300))
            x[at] = now + step * (z - now)
            out = at[low & (x[at] <= 1e-12 * max(1.0, x.max()))]
            if not len(out):
                out = at[low][np.argmin(x[at][low])][None]
            x[out] = 0
            inside[out] = False
            if not inside.any():
                break
    return x


def layout(counts: dict[int, int], units: int = WINDOW // GRAIN, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(class sizes, repeats) that place every piece of a histogram by class."""
    left = np.zeros(units + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    out: list[tuple[tuple[int, ...], int]] = []

    def place(sizes: tuple[int, ...], most: int | None = None) -> None:
        need = np.bincount(sizes, minlength=units + 1)
        n = int((left[need > 0] // need[need > 0]).min())
        n = n if most is None else min(n, most)
        if n > 0:
            left[:] -= n * need
            out.append((sizes, n))

    columns = [c for c in combinations(units, depth) if all(left[s] for s in c)]
    if columns:
        a = np.stack([np.bincount(c, minlength=units + 1)[1:] for c in columns], axis=1).astype(float)
        repeats = np.floor(nnls(a, left[1:].astype(float)) + 1e-6).astype(np.int64)
        for k in np.argsort(-repeats, kind="stable"):
            if repeats[k] > 0:
                place(columns[k], int(repeats[k]))
    while left.any():
        free, sizes, have = units, [], left.copy()
        while free > 0 and (fits := np.flatnonzero(have[:free + 1])).size:
            size = int(fits[-1])
            take = min(int(have[size]), free // size)
            sizes += [size] * take
            have[size] -= take
            free -= size * take
        place(tuple(sizes))
    return out


def packed(cut: DataFrame, window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH) -> DataFrame:
    """`cut` (pieces, saved) with `sequence_id` and `offset`."""
    spark = cut.sparkSession
    key = F.xxhash64("doc_id", "start", "ids_crc32")
    rows = cut.withColumn("size", F.ceil(F.col("length") / grain).cast("int")).withColumn("key", key)
    rows = rows.withColumn("range", F.pmod("key", F.lit(RANGES)).cast("int"))
    groups = saved(rows.groupBy("size", "range").agg(F.count("*").alias("n")), "piece-counts")
    # At most window / grain rows.
    counts = {r["size"]: r["n"] for r in groups.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    slots, begun, sequence = [], dict.fromkeys(counts, 0), 0
    for sizes, n in layout(counts, window // grain, depth):
        for part, size in enumerate(sizes):
            slots.append((size, begun[size], begun[size] + n, sequence, part))
            begun[size] += n
        sequence += n
    table = spark.createDataFrame(slots, "slot_size int, slot_from long, slot_to long, first_sequence long, part int")
    ahead = Window.partitionBy("size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(F.col("size").alias("in_size"), F.col("range").alias("in_range"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("size", "range").orderBy("key", "doc_id", "start", "ids_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(within) - 1)
    ranked = ranked.join(groups, (F.col("size") == F.col("in_size")) & (F.col("range") == F.col("in_range")))
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("ahead"))
    here = (F.col("size") == F.col("slot_size")) & (F.col("rank") >= F.col("slot_from")) & (F.col("rank") < F.col("slot_to"))
    # The layout is bounded by the number of classes, not by the table.
    placed = ranked.join(F.broadcast(table), here).withColumn("sequence_id", F.col("first_sequence") + F.col("rank") - F.col("slot_from"))
    before = Window.partitionBy("sequence_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*cut.columns, "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most WINDOW ids."""
    return packed(saved(pieces(docs, doc_id, text, path, keep_ids=keep_ids), "pieces"))


def sequences(packs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per sequence of `pack(..., keep_ids=True)`: `sequence_id`, `tokens`, `padded_to`, `ids` (binary, without padding)."""
    whole = packs.groupBy("sequence_id").agg(
        F.sum("length").alias("tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    exact = F.bit_count("tokens") == 1
    return whole.select("sequence_id", "tokens", F.when(exact, F.col("tokens")).otherwise(F.lit(window)).alias("padded_to"),
                        F.aggregate("parts.ids", F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"))
