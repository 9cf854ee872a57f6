"""Runs of words that repeat with a period, by seeds and their extension along diagonals.

A run is a stretch of words with smallest period q, at least max(LEAST, TIMES * q)
words long, that neither neighbour extends. Words q apart are equal all along it, so
it is a stretch of one diagonal (lag q) of the text against itself, at least
(TIMES - 1) * q long. Lags are taken by scales: for q from s to 2s - 1 (s a
power of two), k-grams of k = 2s words are indexed, since every run of such a q has
at least (TIMES - 1) * s >= k matching places. As a k-gram is longer than the period and q the smallest
one, the next place of a k-gram in a run is exactly q further on. So of all pairs
of a k-gram's places only neighbours at a lag of this scale are seeds, and no
pairs of a frequent gram are laid out. The gram names of a scale come from pairs of those of
the scale before, whole numbers throughout, and only grams met twice in a document go on to the next scale,
so equal names mean equal words and texts without repeats cost one pass.

Of the seeds, those at multiples of s suffice: a run's seeds are s + 1 in a row at
least. Each is extended both ways along its diagonal, in steps of doubling length, unless the table
of the furthest place covered on its lag says that an earlier extension has been there.

Every text is one row and is worked on whole, whatever its length: memory grows with
its words. Null and empty texts have no words and no runs. Equal rows get equal
results. Null ids are kept. An empty table gives an empty result. Only the
named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import small_batches
from vigilog.llm.words import groups, texts_of

#: Least words of a run, and least length in periods.
LEAST, TIMES = 6, 4

Run = tuple[int, int, int]


def _reach(words: np.ndarray, a: int, b: int, most: int, step: int) -> int:
    """How many words from `a` and from `b` on, in the direction `step`, are equal; `most` at most."""
    done, size = 0, 16
    while done < most:
        size = min(size, most - done)
        x = words[a + done:a + done + size] if step > 0 else words[a - done - size + 1:a - done + 1][::-1]
        y = words[b + done:b + done + size] if step > 0 else words[b - done - size + 1:b - done + 1][::-1]
        differ = np.flatnonzero(x != y)
        if len(differ):
            return done + int(differ[0])
        done += size
        size *= 2
    return done


def _renamed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A small whole number for each pair of small whole numbers, equal for equal pairs."""
    return np.unique(first * (int(second.max(initial=0)) + 1) + second, return_inverse=True)[1].astype(np.int64)


def _often(at: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places and names of those names that stand there twice or more."""
    often = np.bincount(name)[name] > 1 if len(at) else np.zeros(0, bool)
    return at[often], name[often]


def seeds(words: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(scale, places, lags) of the seeds of each scale; `words` are numbers, `owner` their documents in order."""
    n = len(words)
    at, name, size, scale = *_often(np.arange(n), _renamed(owner, words)), 1, 1
    while len(at):
        # From names of grams of `size` words, at the places `at`, to those of 2 * scale words.
        while size < 2 * scale and len(at):
            whole = np.full(n, -1, np.int64)
            whole[at] = name
            after = at + size
            ok = (after < n) & (whole[np.minimum(after, n - 1)] >= 0)
            # The document is part of a word's name, so a gram across its end is met nowhere else: it goes like all that stand alone.
            at, name = _often(at[ok], _renamed(name[ok], whole[after[ok]]))
            size *= 2
        order = np.lexsort((at, name))
        place = at[order]
        lag = np.diff(place)
        good = (name[order][1:] == name[order][:-1]) & (lag >= scale) & (lag < 2 * scale) & (place[:-1] % scale == 0)
        place, lag = place[:-1][good], lag[good]
        by_place = np.argsort(place, kind="stable")
        yield scale, place[by_place], lag[by_place]
        scale *= 2


def runs_of(words: np.ndarray, owner: np.ndarray, begins: np.ndarray) -> list[list[Run]]:
    """All runs of each document, by start and then period; document k has the words from begins[k] up to begins[k + 1]."""
    out: list[list[Run]] = [[] for _ in range(len(begins) - 1)]
    for _, places, lags in seeds(words, owner):
        covered: dict[int, int] = {}
        for i, q in zip(places.tolist(), lags.tolist()):
            if covered.get(q, -1) > i:
                continue
            doc = int(owner[i])
            low, high = int(begins[doc]), int(begins[doc + 1])
            end = i + _reach(words, i, i + q, high - i - q, 1)
            start = i - _reach(words, i - 1, i - 1 + q, i - low, -1)
            covered[q] = end
            if end + q - start >= max(LEAST, TIMES * q):
                out[doc].append((start - low, end + q - start, q))
    for own in out:
        own.sort(key=lambda r: (r[0], r[2]))
    return out


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length in periods; of several the first, then that with the smaller period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of `n` words stay when each run is cut down to its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def restarted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document, of which one id in ten by crc32 has its tail replaced by repeats of that tail's beginning; null ids stay."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


Rewrite = Callable[[object, list[bytes]], list[bytes]]
SCHEMA = ("doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, "
          "strongest struct<start: long, length: long, period: long>, collapsed string")


def periodic(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rewrite: Rewrite | None = None) -> DataFrame:
    """One row per document: its runs, the strongest of them, and its text with every run cut down to one period.

    The words of the collapsed text are joined by one space. `rewrite` changes a document's words, given its id, before the search.
    """
    small_batches(docs.sparkSession)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in groups(batches):
            ids = [None if pd.isna(i) else int(i) for i in frame["doc_id"]]
            # Bytes split at ASCII white space alone.
            each = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts_of(frame)]
            if rewrite is not None:
                each = [rewrite(i, w) for i, w in zip(ids, each)]
            numbers: dict[bytes, int] = {}
            begins = np.cumsum([0, *map(len, each)])
            words = np.fromiter((numbers.setdefault(w, len(numbers)) for own in each for w in own), np.int64, int(begins[-1]))
            owner = np.repeat(np.arange(len(each)), np.diff(begins))
            all_runs = runs_of(words, owner, begins)
            rows = []
            for i, own, runs in zip(ids, each, all_runs):
                left = [own[k] for k in np.flatnonzero(kept_words(len(own), runs)).tolist()] if runs else own
                rows.append((i, len(own), runs, strongest(runs), b" ".join(left).decode("utf-8", "surrogatepass")))
            out = pd.DataFrame(rows, columns=["doc_id", "n_words", "runs", "strongest", "collapsed"])
            names = ("start", "length", "period")
            out["runs"] = [[dict(zip(names, r)) for r in runs] for runs in out["runs"]]
            out["strongest"] = [None if r is None else dict(zip(names, r)) for r in out["strongest"]]
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    named = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return named.mapInPandas(found, SCHEMA)
