"""A gated recurrent language model with a class-factored softmax, for whole-document log-likelihoods.

Words that are frequent in the training documents (VOCABULARY of them, with the
end of a text) have classes of about equal weight; every other word belongs to a
shape class, told from its last letters alone. The network, a gated recurrent unit in
numpy, reads frequent words and shapes and predicts the next class, and inside a
class of frequent words the word. A word of a shape class then has its share of
the class from counts over all training documents, lowered by a discount that goes
to the class's unseen words: counts seen once and twice give it, as usual.

So a text's score is a sum over positions of the network's part, with the state
carried over all windows of the text, and a sum over its rarer words of their
shares, which needs no order. Counts of all words of all training documents are
gathered on Spark and joined to the rarer words of all documents; only LOOKUP of
them, the most frequent, are sent to the executors.

The network starts from the counts (its biases give each class and word its
frequency) and is trained by truncated backpropagation in ROUNDS rounds. In a
round every task trains its own copy on a slice of its training documents, one in
SLICES by a hash of their text and another slice each round, so that the rounds
together meet every training document; the copies are averaged, weighted by their tokens. The work thus grows with the table, and the tasks
never wait for one another within a round.

Null and empty texts are the end alone. A null id counts as empty text in the
fold. Without any training document, counts are 0 and the score of a token is its
share of one class of unseen words. Equal rows get equal scores; an empty table gives
an empty result. Words are told apart by 64-bit hashes. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import fold, saved, small_batches
from vigilog.llm.words import Words, groups, mix, texts_of

#: Ids in held-out documents leave this remainder.
FOLDS, HELD_OUT = 7, 2
#: Frequent words that the network predicts one by one, with the end; words with counts in the executors; letters' classes.
VOCABULARY = 2048
LOOKUP = 20_000
SUFFIXES = 16
#: Most words in a class, and about how many classes the frequent words get by weight.
CLASS_WORDS, CLASSES = 64, 48
HIDDEN = 24
#: Truncated backpropagation: places in a window, documents side by side.
STEPS, LANES = 16, 512
ROUNDS = SLICES = 4
#: Tokens of texts that are scored side by side.
ABREAST = 1_500_000
RATE = 0.06

_SHAPES = 3 * SUFFIXES
_MARKS = np.zeros(256, np.int64)
_MARKS[[ord(c) for c in ",;:"]] = 1
_MARKS[[ord(c) for c in ".!?"]] = 2
_LN10 = math.log(10)
_KEPT = 1_000_000
_TILE = 1024


def shapes(words: Words) -> np.ndarray:
    """The shape class of each word: its final mark, and a hash of the two letters before it."""
    data, last = words.data, words.ends - 1
    mark = _MARKS[data[last]]
    at = np.maximum(last - (mark > 0), words.starts)
    before = np.maximum(at - 1, words.starts)
    pair = data[at].astype(np.uint64) * np.uint64(256) + data[before].astype(np.uint64)
    return mark * SUFFIXES + (mix(pair) % np.uint64(SUFFIXES)).astype(np.int64)


@dataclass
class Lexicon:
    """What the executors know of the counts: bounded by LOOKUP, CLASS_WORDS and the number of shapes, not by the table."""

    hashes: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    ends: int
    tokens: int
    distinct: int
    shape_sum: np.ndarray
    shape_kinds: np.ndarray
    shape_discount: np.ndarray
    class_of: np.ndarray = field(default=None)
    members: list = field(default=None)
    weight: np.ndarray = field(default=None)

    @property
    def n_classes(self) -> int:
        return len(self.members) + _SHAPES

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash among the frequent ones, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.tokens + self.distinct + 1))

    def shares(self, shape: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log10 of a rarer word's share of its shape class; count 0 stands for all unseen words together."""
        total = np.maximum(self.shape_sum[shape], 1)
        unseen = (self.shape_discount[shape] * self.shape_kinds[shape] + 1) / (total + 1)
        seen = np.maximum(count - self.shape_discount[shape], 1e-3) / (total + 1)
        return np.log10(np.where(count > 0, seen, unseen))


def counted(docs: DataFrame) -> DataFrame:
    """Saved `hash`, `shape`, `n` of all words of the training documents of `docs` (`text`, `held_out`)."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def merged() -> pd.DataFrame:
            both, n = _merge(held, counts)
            return pd.DataFrame({"hash": both[0].view(np.int64), "shape": both[1].astype(np.int32), "n": n})

        for frame in groups(batches):
            words = Words(texts_of(frame))
            kinds, at, n = np.unique(words.hash, return_index=True, return_counts=True)
            held.append(np.stack([kinds, shapes(words)[at].astype(np.uint64)]) if len(kinds) else np.zeros((2, 0), np.uint64))
            counts.append(n.astype(np.int64))
            if sum(h.shape[1] for h in held) > _KEPT:
                both, n = _merge(held, counts)
                if both.shape[1] > _KEPT // 2:
                    yield merged()
                    held, counts = [], []
                else:
                    held, counts = [both], [n]
        if held:
            yield merged()

    partial = docs.where(~F.col("held_out")).select("text").mapInPandas(rows, "hash long, shape int, n long")
    return saved(partial.groupBy("hash", "shape").agg(F.sum("n").alias("n")), "word-counts")


def _merge(held: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    both, n = np.concatenate(held, axis=1), np.concatenate(counts)
    order = np.argsort(both[0], kind="stable")
    both, n = both[:, order], n[order]
    first = np.flatnonzero(np.append(True, both[0, 1:] != both[0, :-1])) if both.shape[1] else np.zeros(0, np.int64)
    return both[:, first], np.add.reduceat(n, first) if len(first) else n


def lexicon(counts: DataFrame, ends: int) -> Lexicon:
    """From saved counts: totals by Spark, and the LOOKUP most frequent words."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.col("n").desc(), "hash").limit(LOOKUP).toPandas()
    top = top.sort_values(["n", "hash"], ascending=[False, True], kind="stable")
    # Words that the network predicts are no part of their shape class.
    sums = np.zeros((4, _SHAPES))
    for r in counts.groupBy("shape").agg(F.sum("n"), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).collect():
        sums[:, r[0]] = r[1:]
    for h, shape, n in top.head(VOCABULARY - 1).itertuples(index=False):
        sums[:, shape] -= (n, 1, n == 1, n == 2)
    discount = np.clip(sums[2] / np.maximum(sums[2] + 2 * sums[3], 1), 0.1, 0.95)
    hashes = top["hash"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    ids = np.where(np.arange(len(top)) < VOCABULARY - 1, np.arange(1, len(top) + 1), 0)
    book = Lexicon(hashes[order], top["n"].to_numpy(np.int64)[order], ids[order], ends, int(total[0]) + ends,
                   int(total[1]) + (ends > 0), sums[0], sums[1], discount)
    weight = np.concatenate([[ends], top["n"].to_numpy(float)[:VOCABULARY - 1]])
    by_weight = np.argsort(-weight, kind="stable")
    book.members, now, mass = [], [], 0.0
    for w in by_weight.tolist():
        now.append(w)
        mass += weight[w]
        if mass >= weight.sum() / CLASSES or len(now) == CLASS_WORDS:
            book.members.append(np.array(now))
            now, mass = [], 0.0
    if now:
        book.members.append(np.array(now))
    book.class_of = np.zeros(len(weight), np.int64)
    for c, m in enumerate(book.members):
        book.class_of[m] = c
    book.weight = weight
    return book


def _row_sums(x: np.ndarray) -> np.ndarray:
    return x @ np.ones(x.shape[1], x.dtype)


def _column_sums(x: np.ndarray) -> np.ndarray:
    return np.ones(len(x), x.dtype) @ x


def sums_by(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids in order, and the sum of each one's rows."""
    order = np.argsort(ids.astype(np.int16) if not len(ids) or ids.max() < 1 << 15 else ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
    return ids[first], np.add.reduceat(rows.take(order, axis=0), first, axis=0) if len(ids) else rows[:0]


def _sigmoid(x: np.ndarray) -> None:
    """In place; what overflows has the right limit, 0."""
    with np.errstate(over="ignore"):
        np.exp(np.negative(x, out=x), out=x)
    x += 1
    np.reciprocal(x, out=x)


def log_sums(logits: np.ndarray, bound: float) -> np.ndarray:
    """log of the sum of exp of each row, in place. States lie within -1 and 1, so `bound` on the logits shows that nothing can overflow."""
    top = np.zeros(len(logits), logits.dtype)
    if not bound < 80:
        top = logits.max(axis=1)
        logits -= top[:, None]
    np.exp(logits, out=logits)
    return np.log(_row_sums(logits)) + top


def _exp(logits: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """exp of each row, in place, up to a factor of its own, and its sum; `bound` as above."""
    if not bound < 80:
        logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    return logits, _row_sums(logits)


class Network:
    """A gated recurrent unit over symbols (0: end, then frequent words, then shapes) with a class-factored softmax."""

    NAMES = ("x", "u", "b", "c", "cb", "o", "ob")

    def __init__(self, book: Lexicon, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.book, self.words = book, len(book.class_of)
        h = HIDDEN
        self.x = rng.normal(0, 0.3, (self.words + _SHAPES, 3 * h)).astype(np.float32)
        self.u = rng.normal(0, 1 / math.sqrt(h), (h, 3 * h)).astype(np.float32)
        self.b = np.zeros(3 * h, np.float32)
        self.c = rng.normal(0, 0.05, (h, book.n_classes)).astype(np.float32)
        self.o = rng.normal(0, 0.05, (self.words, h)).astype(np.float32)
        mass = np.concatenate([[book.weight[m].sum() for m in book.members], book.shape_sum]) + 0.5
        self.cb = np.log(mass / mass.sum()).astype(np.float32)
        # Rows of `o` stand class by class, so that a class is a slice of them.
        by_class = np.concatenate(book.members) if book.members else np.zeros(0, np.int64)
        self.ob = np.log(book.weight[by_class] + 0.5).astype(np.float32)
        self.slot = np.zeros(self.words, np.int64)
        self.slot[by_class] = np.arange(self.words)
        self.begin = np.cumsum([0, *map(len, book.members)])

    def parameters(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in self.NAMES]

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for p in self.parameters():
            p[...] = flat[at:at + p.size].reshape(p.shape)
            at += p.size

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parameters()])

    def step(self, symbols: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        a, v = self.x.take(symbols, axis=0), h @ self.u
        a += self.b
        k = HIDDEN
        gates = a[:, :2 * k] + v[:, :2 * k]
        _sigmoid(gates)
        z, r = gates[:, :k], gates[:, k:]
        n = r * v[:, 2 * k:]
        n += a[:, 2 * k:]
        np.tanh(n, out=n)
        return n + z * (h - n), z, r, n, v[:, 2 * k:]

    def targets(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each symbol, and whether it is a frequent word."""
        word = symbols < self.words
        return np.where(word, self.book.class_of[np.where(word, symbols, 0)], symbols - self.words + len(self.book.members)), word

    def log_parts(self, h: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each symbol after its state."""
        classes, word = self.targets(symbols)
        out, bound = np.empty(len(h), np.float32), (np.abs(self.c).sum(axis=0) + np.abs(self.cb)).max()
        for k0 in range(0, len(h), _TILE):
            tile = slice(k0, k0 + _TILE)
            logits = h[tile] @ self.c
            logits += self.cb
            own = logits[np.arange(len(logits)), classes[tile]]
            out[tile] = own - log_sums(logits, bound)
        rows, cuts = self._by_class(classes, word)
        mine, slots, added = h.take(rows, axis=0), self.slot[symbols[rows]], np.empty(len(rows), np.float32)
        bounds = self._bounds()
        for c, begin, end in cuts:
            own, part = slice(self.begin[c], self.begin[c + 1]), slice(begin, end)
            inner = mine[part] @ self.o[own].T
            inner += self.ob[own]
            wanted = inner[np.arange(end - begin), slots[part] - self.begin[c]]
            added[part] = wanted - log_sums(inner, bounds[c])
        out[rows] += added
        return out

    def _bounds(self) -> np.ndarray:
        """The most that logits inside each class can come to."""
        most = _row_sums(np.abs(self.o)) + np.abs(self.ob)
        return np.maximum.reduceat(most, self.begin[:-1]) if len(most) else most

    def _by_class(self, classes: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """The places of frequent words, class by class, and each class with its part of them; a class of one word has nothing left to predict."""
        at = np.flatnonzero(word & (np.diff(self.begin, append=0) > 1)[np.where(word, classes, 0)])
        at = at[np.argsort(classes[at].astype(np.int16), kind="stable")]
        bounds = np.searchsorted(classes[at], np.arange(len(self.book.members) + 1)).tolist()
        return at, [(c, a, b) for c, (a, b) in enumerate(zip(bounds, bounds[1:])) if b > a]

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 of the network's part of each text of symbols, its end included; all texts step side by side."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        lengths = np.array([len(texts[k]) for k in order])
        flat = np.concatenate([texts[k] for k in order])
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        h = np.zeros((len(texts), HIDDEN), np.float32)
        last = np.zeros(len(texts), np.int64)
        sums = np.zeros(len(texts))
        states, wanted, owners, held = [], [], [], 0

        def settle() -> None:
            if states:
                who = np.concatenate(owners)
                sums[:] += np.bincount(who, self.log_parts(np.concatenate(states), np.concatenate(wanted)), len(sums))

        for t in range(int(lengths[0]) if len(texts) else 0):
            live = int(np.searchsorted(-lengths, -t, side="left"))
            h = self.step(last[:live], h[:live])[0]
            now = flat[begin[:live] + t]
            states.append(h)
            wanted.append(now)
            owners.append(np.arange(live))
            held += live
            last = now
            if held > 32_768:
                settle()
                states, wanted, owners, held = [], [], [], 0
        settle()
        out = np.empty(len(texts))
        out[order] = sums / _LN10
        return out

    def train(self, texts: list[np.ndarray], rate: float = RATE, squares: list[np.ndarray] | None = None) -> int:
        """One pass of truncated backpropagation; windows of STEPS in LANES streams of equal length, into which all texts in a row are cut. Returns the tokens learned from."""
        if not texts:
            return 0
        flat = np.concatenate(texts)
        width = -(-len(flat) // LANES)
        symbols, fresh, real = np.zeros(LANES * width, np.int64), np.zeros(LANES * width, bool), np.zeros(LANES * width, bool)
        symbols[:len(flat)] = flat
        real[:len(flat)] = True
        fresh[np.cumsum([0, *[len(t) for t in texts[:-1]]])] = True
        symbols, fresh, real = (x.reshape(LANES, width) for x in (symbols, fresh, real))
        previous = np.where(fresh, 0, np.roll(symbols, 1, axis=1))
        previous[1:, 0] = np.where(fresh[1:, 0], 0, symbols[:-1, -1])
        squares = squares if squares is not None else [np.full(p.shape, 1e-5, np.float32) for p in self.parameters()]
        h = np.zeros((LANES, HIDDEN), np.float32)
        for begin in range(0, width, STEPS):
            w = slice(begin, begin + STEPS)
            if real[:, w].any():  # the last streams may have ended
                h = self._window(symbols[:, w], previous[:, w], fresh[:, w], real[:, w], h, rate, squares)
        return int(real.sum())

    def _window(self, symbols, previous, fresh, real, h, rate, squares) -> np.ndarray:
        k, steps = HIDDEN, symbols.shape[1]
        heard = previous.T.ravel()
        inputs = (self.x.take(heard, axis=0) + self.b).reshape(steps, LANES, 3 * k)
        before, after, gates, news, mixed = (np.empty((steps, LANES, n), np.float32) for n in (k, k, 2 * k, k, k))
        for t in range(steps):
            np.copyto(before[t], h)
            before[t][fresh[:, t]] = 0
            v = before[t] @ self.u
            g = np.add(inputs[t, :, :2 * k], v[:, :2 * k], out=gates[t])
            _sigmoid(g)
            mixed[t] = v[:, 2 * k:]
            n = np.multiply(g[:, k:], mixed[t], out=news[t])
            n += inputs[t, :, 2 * k:]
            np.tanh(n, out=n)
            h = np.subtract(before[t], n, out=after[t])
            h *= g[:, :k]
            h += n
        keep = np.flatnonzero(real.T.ravel())
        every = len(keep) == steps * LANES
        states = after.reshape(-1, k) if every else after.reshape(-1, k)[keep]
        wanted = symbols.T.ravel()[keep]
        scale = np.float32(1 / len(keep))
        classes, word = self.targets(wanted)
        grad_c, grad_cb, down = np.zeros_like(self.c), np.zeros_like(self.cb), np.empty_like(states)
        bound = (np.abs(self.c).sum(axis=0) + np.abs(self.cb)).max()
        for k0 in range(0, len(states), _TILE):  # tiles stay in the cache
            tile = slice(k0, k0 + _TILE)
            p = states[tile] @ self.c
            p += self.cb
            p, sums = _exp(p, bound)
            p *= (scale / sums)[:, None]
            p[np.arange(len(p)), classes[tile]] -= scale
            grad_c += states[tile].T @ p
            grad_cb += _column_sums(p)
            np.matmul(p, self.c.T, out=down[tile])
        grad_o, grad_ob = np.zeros_like(self.o), np.zeros_like(self.ob)
        rows, cuts = self._by_class(classes, word)
        mine, slots = states.take(rows, axis=0), self.slot[wanted[rows]]
        inner, bounds = np.empty_like(mine), self._bounds()
        for c, begin, end in cuts:
            own, part = slice(self.begin[c], self.begin[c + 1]), slice(begin, end)
            q = mine[part] @ self.o[own].T
            q += self.ob[own]
            q, sums = _exp(q, bounds[c])
            q *= (scale / sums)[:, None]
            q[np.arange(end - begin), slots[part] - self.begin[c]] -= scale
            np.matmul(q.T, mine[part], out=grad_o[own])
            grad_ob[own] = _column_sums(q)
            np.matmul(q, self.o[own], out=inner[part])
        down[rows] += inner
        if not every:
            whole = np.zeros((steps * LANES, k), np.float32)
            whole[keep] = down
            down = whole
        down = down.reshape(steps, LANES, k)
        grad_a, grad_v = (np.empty((steps, LANES, 3 * k), np.float32) for _ in range(2))
        back, turned = np.zeros((LANES, k), np.float32), np.ascontiguousarray(self.u.T)
        # What does not depend on later steps, for all steps at once.
        z, r = gates[:, :, :k], gates[:, :, k:]
        to_new, to_z, to_r = (1 - z) * (1 - news * news), (before - news) * z * (1 - z), mixed * r * (1 - r)
        for t in range(steps - 1, -1, -1):
            back += down[t]
            a, v = grad_a[t], grad_v[t]
            dn = np.multiply(back, to_new[t], out=a[:, 2 * k:])
            np.multiply(back, to_z[t], out=a[:, :k])
            np.multiply(dn, to_r[t], out=a[:, k:2 * k])
            v[:, :2 * k] = a[:, :2 * k]
            np.multiply(dn, r[t], out=v[:, 2 * k:])
            back *= z[t]
            back += v @ turned
            back[fresh[:, t]] = 0
        flat = grad_a.reshape(-1, 3 * k)
        grad_u, grad_b = before.reshape(-1, k).T @ grad_v.reshape(-1, 3 * k), _column_sums(flat)
        ids, grad_x = sums_by(heard, flat)
        norm = math.sqrt(sum(float(np.vdot(g, g)) for g in (grad_x, grad_u, grad_c, grad_o)))
        clip = np.float32(min(1.0, 5.0 / max(norm, 1e-9)))
        squares[0][ids] += (grad_x * clip) ** 2
        self.x[ids] -= rate * clip * grad_x / np.sqrt(squares[0][ids])
        for p_, s, g in zip(self.parameters()[1:], squares[1:], (grad_u, grad_b, grad_c, grad_cb, grad_o, grad_ob)):
            s += (g * clip) ** 2
            p_ -= rate * clip * g / np.sqrt(s)
        return h


def symbols_of(book: Lexicon, words: Words, texts: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of each text with its end; for every word its shape, its place in the lookup (or -1) and whether it is a symbol of its own."""
    shape, at = shapes(words), book.look_up(words.hash)
    own = np.where(at >= 0, book.ids[at] if len(book.ids) else 0, 0)
    symbol = np.where(own > 0, own, len(book.class_of) + shape)
    cuts = np.searchsorted(words.owner, np.arange(texts + 1))
    return [np.append(symbol[cuts[k]:cuts[k + 1]], 0) for k in range(texts)], shape, at, own > 0


def round_texts(docs: DataFrame, k: int, slices: int = SLICES) -> DataFrame:
    """`text` of the training documents that round `k` learns from."""
    return docs.where(~F.col("held_out") & (F.pmod(F.xxhash64("text_hash"), F.lit(slices)) == k % slices)).select("text")


def trained(docs: DataFrame, book: Lexicon, rounds: int = ROUNDS, slices: int = SLICES) -> Network:
    """Rounds of local training on slices of the training documents of `docs` (`text`, `text_hash`, `held_out`) and averaging."""
    spark, parts = docs.sparkSession, 16
    network = Network(book)
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(network)

        def learn(batches: Iterator[pd.DataFrame], k: int = k, shared=shared) -> Iterator[pd.DataFrame]:
            mine, tokens = None, 0
            for frame in batches:
                if mine is None:
                    mine = Network(shared.value.book)
                    mine.load(shared.value.flat())
                    squares = [np.full(p.shape, 1e-5, np.float32) for p in mine.parameters()]
                words = Words(texts_of(frame))
                tokens += mine.train(symbols_of(mine.book, words, len(frame))[0], RATE / (1 + 0.5 * k), squares)
            if mine is not None:
                cuts = np.array_split(mine.flat() * np.float32(tokens), parts)
                yield pd.DataFrame({"part": np.arange(parts), "share": hash(cuts[0].tobytes()) % 64, "tokens": float(tokens), "sums": [c.tobytes() for c in cuts]})

        def total(frame: pd.DataFrame) -> pd.DataFrame:
            sums = np.sum([np.frombuffer(s, np.float64 if len(s) == size[frame["part"].iat[0]] * 8 else np.float32) for s in frame["sums"]], axis=0, dtype=np.float64)
            return pd.DataFrame([(frame["part"].iat[0], 0, frame["tokens"].sum(), sums.tobytes())], columns=["part", "share", "tokens", "sums"])

        size = [len(c) for c in np.array_split(network.flat(), parts)]
        schema = "part int, share int, tokens double, sums binary"
        copies = round_texts(docs, k, slices).mapInPandas(learn, schema)
        # Copies are summed by groups first, so that no task holds a part of all of them.
        sums = copies.groupBy("part", "share").applyInPandas(total, schema).groupBy("part").applyInPandas(total, schema)
        rows = sorted(sums.collect(), key=lambda r: r["part"])
        if rows and rows[0]["tokens"] > 0:
            network.load(np.concatenate([np.frombuffer(r["sums"]) / r["tokens"] for r in rows]).astype(np.float32))
    return network


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id`, `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score` of every document."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    value = F.col(f"`{text}`")
    named = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(value).alias("text_hash"),
                        (fold(F.col(f"`{doc_id}`"), FOLDS) == HELD_OUT).alias("held_out"), value.alias("text"))
    counts = counted(named)
    ends = docs.select((fold(F.col(f"`{doc_id}`"), FOLDS) == HELD_OUT).alias("held_out")).where("not held_out").count()
    book = lexicon(counts, ends)
    network = trained(named, book)
    shared = spark.sparkContext.broadcast(network)

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = shared.value
        own = mine.book
        held: list[tuple[pd.DataFrame, list[np.ndarray]]] = []

        def settled() -> pd.DataFrame:
            frames = pd.concat([f for f, _ in held], ignore_index=True)
            frames["part"] += mine.score([s for _, symbols in held for s in symbols])
            return frames

        for frame in groups(batches):
            words, n = Words(texts_of(frame)), len(frame)
            symbols, shape, at, single = symbols_of(own, words, n)
            known = at >= 0
            count = np.where(known, own.counts[at] if len(own.counts) else 0, 0)
            share = np.where(known & ~single, own.shares(shape, count), 0.0)
            base = np.where(known, own.base(count), 0.0)
            lengths = np.bincount(words.owner, minlength=n)
            held.append((pd.DataFrame({
                "doc_id": frame["doc_id"].array, "text_hash": frame["text_hash"].array, "held_out": frame["held_out"].array,
                "n_tokens": lengths + 1, "n_known": np.bincount(words.owner, known, n).astype(np.int64) + (own.ends > 0),
                "n_rare": lengths - np.bincount(words.owner, known, n).astype(np.int64),
                "base": np.bincount(words.owner, base, n) + float(own.base(np.array(own.ends))),
                "part": np.bincount(words.owner, share, n)}), [x.astype(np.int32) for x in symbols]))
            # Many texts step side by side, so that the long ones do not step alone.
            if sum(int(f["n_tokens"].sum()) for f, _ in held) > ABREAST:
                yield settled()
                held = []
        if held:
            yield settled()

    def rare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value.book
        for frame in groups(batches):
            words = Words(texts_of(frame))
            at = np.flatnonzero(own.look_up(words.hash) < 0)
            order = at[np.lexsort((words.hash[at], words.owner[at]))]
            if not len(order):
                continue
            owner, hashes = words.owner[order], words.hash[order]
            first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])))
            yield pd.DataFrame({
                "doc_key": frame["doc_key"].to_numpy()[owner[first]], "hash": hashes[first].view(np.int64),
                "shape": shapes(words)[order[first]].astype(np.int32), "times": np.diff(np.append(first, len(order))).astype(np.int32)})

    local = saved(named.mapInPandas(parts, "doc_id long, text_hash long, held_out boolean, n_tokens long, n_known long, n_rare long, base double, part double"), "lm-parts")
    key = F.xxhash64("doc_id", "text_hash")
    words = named.select(key.alias("doc_key"), "text").mapInPandas(rare, "doc_key long, hash long, shape int, times int")
    seen = words.join(counts.select("hash", F.col("n").alias("count")), "hash", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    # A row for each shape, whatever the table holds.
    table = spark.createDataFrame(
        [(k, float(book.shape_discount[k]), float(max(book.shape_sum[k], 1) + 1), float(book.shape_discount[k] * book.shape_kinds[k] + 1))
         for k in range(_SHAPES)], "of_shape int, discount double, total double, unseen double")
    seen = seen.join(F.broadcast(table), F.col("shape") == F.col("of_shape"))
    known = F.col("count") > 0
    share = F.log10(F.when(known, F.greatest(F.col("count") - F.col("discount"), F.lit(1e-3))).otherwise(F.col("unseen")) / F.col("total"))
    base = F.log10((F.col("count") + 1) / F.lit(float(book.tokens + book.distinct + 1)))
    rest = seen.groupBy("doc_key").agg(
        F.sum("times").alias("all"), F.sum(F.when(known, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * base).alias("rare_base"), F.sum(F.col("times") * share).alias("rare_share"))
    out = local.withColumn("doc_key", key).join(rest, "doc_key", "left")
    # Equal rows have added up in the sums by key: each gets its part by its own number of rarer words.
    own = F.when(F.col("n_rare") > 0, F.col("n_rare") / F.col("all")).otherwise(F.lit(0.0))
    add = lambda c: own * F.coalesce(F.col(c), F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.round(add("known")).cast("long")).alias("n_known"),
                      F.lit(book.tokens).cast("long").alias("train_tokens"), (F.col("base") + add("rare_base")).alias("base_score"),
                      (F.col("part") + add("rare_share")).alias("score"))
