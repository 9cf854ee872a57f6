"""Runs by seeds and extension against every stretch of every lag."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from corpus_rows import LONG, PROSE, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from vigilog.llm import periodic
from vigilog.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """Every lag's stretches of equal words, long enough and of no smaller period."""
    found, n = [], len(words)
    numbers = {}
    w = np.array([numbers.setdefault(x, len(numbers)) for x in words], np.int64)
    for q in range(1, n // 4 + 1):
        same = np.concatenate([[False], w[:-q] == w[q:], [False]])
        edge = np.flatnonzero(np.diff(same.astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            length = b - a + q
            # A stretch of four periods or more has a smaller one only if that divides it.
            if length >= max(6, 4 * q) and not any(q % p == 0 and (w[a:a + length - p] == w[a + p:a + length]).all() for p in range(1, q)):
                found.append((a, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def ours(texts):
    numbers = {}
    begins = np.cumsum([0, *map(len, texts)])
    words = np.array([numbers.setdefault(x, len(numbers)) for t in texts for x in t], np.int64)
    return periodic.runs_of(words, np.repeat(np.arange(len(texts)), np.diff(begins)), begins)


def rewritten(i, words):
    h = zlib.crc32(str(i).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    a, p = h // 10 % n, 0
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]


def row(i, text, change=True):
    words = WORD.findall(text or "")
    words = rewritten(i, words) if change and i is not None else words
    runs = brute(words)
    top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    left = " ".join(w for k, w in enumerate(words) if k not in gone)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (i, len(runs), *top, None if top[0] is None else 1000 * top[1] // top[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(left))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), min_size=1, max_size=4))
def test_small_alphabets(texts):
    assert ours(texts) == [brute(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 5), min_size=1, max_size=25), st.integers(1, 9)), min_size=1, max_size=6))
def test_planted_powers(parts):
    words = [w for unit, times in parts for w in unit * times]
    assert ours([words, words[::-1], words[:-3]]) == [brute(words), brute(words[::-1]), brute(words[:-3])]


def test_long_runs_and_frequent_words():
    rng = np.random.default_rng(2)
    unit = rng.integers(0, 40, 700).tolist()
    text = rng.integers(0, 9, 300).tolist() + unit * 5 + unit[:50] + [7] * 2000 + [1, 2] * 900 + unit[:123] * 4
    assert ours([text, [3] * 5, [3] * 6, [1, 2, 1, 2, 1, 2, 1, 2], [1, 2] * 3]) == [
        brute(text), [], [(0, 6, 1)], [(0, 8, 2)], []]


def test_cut_down_texts():
    kept = periodic.kept_words(12, [(2, 8, 2)])
    assert np.flatnonzero(kept).tolist() == [0, 1, 2, 3, 10, 11]
    assert periodic.strongest([]) is None
    assert periodic.strongest([(9, 8, 2), (0, 12, 3), (5, 8, 2)]) == (0, 12, 3)


def test_query_against_brute_force(spark, sf):
    got = sorted(tuple(r)[:8] for r in QUERIES["op12_periodic_runs"](spark, sf).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect())
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted(row(r["doc_id"], r["text"]) for r in docs)
    assert sum(r[1] > 0 for r in got) >= 10


ROWS = [(None, None, None, "a"), (None, "a " * 9, "en", "a"), (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n\r\x0b\x0c ", "en", "a"),
        (4, "b\x0bb\x0cb b\tb\nB", "en", "a"), (5, "é x é x é x é x", "en", "a"), (6, PROSE * 5, "en", "a"), (6, PROSE * 5, "en", "a"),
        (7, LONG[:40_000], "en", "a"), (8, "\U0001f642 " * 50_000, "en", "a"), (9, "x" * 200_000, "en", "a")]


def test_odd_rows(spark):
    got = periodic.periodic(documents(spark, ROWS)).collect()
    want = {(i, t): brute(WORD.findall(t or "")) if i != 8 else [(0, 50_000, 1)] for i, t, _, _ in ROWS}
    assert sorted((str(r["doc_id"]), str([tuple(x) for x in r["runs"]])) for r in got) == sorted(
        (str(i), str(want[i, t])) for i, t, _, _ in ROWS)
    assert {r["collapsed"] for r in got if r["doc_id"] == 6} == {" ".join((PROSE).split())}
    assert [r["strongest"] for r in got if r["doc_id"] == 8] == [(0, 50_000, 1)]


def test_empty_table(spark, none):
    assert periodic.periodic(none).count() == 0


@pytest.mark.parametrize("words", [[], [b"a"], [b"a", b"b", b"c", b"d"] * 30])
def test_restarted_words(words):
    for i in range(200):
        assert periodic.restarted(i, words) == rewritten(i, words)
    assert periodic.restarted(None, words) == words
