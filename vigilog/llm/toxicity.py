"""Toxicity by a convolutional text classifier in numpy.

Words (A-Z lowered, ASCII punctuation at their ends removed) are hashed to
BUCKETS rows of an embedding; filters of several widths slide over the whole
text, the maximum of each filter over the text is kept, and a logistic layer
turns the maxima into a score. Words that fewer than MIN_DOCS training documents
have get the zero vector, so that rare words cannot be learned by heart.

The classifier is fitted on at most SAMPLE labelled documents, those with the
smallest hashes of their ids: that bound is what lets one process fit it. All
documents are scored, whole, on Spark. Thresholds per language are calibrated on
the scores of all labelled documents outside the held-out fold, by histograms
that Spark sums; they only decide `flagged` and never touch a score.

Null and empty texts have the score of a text without known words. Null labels
do not count; of several labels of one id the largest does. Without any label all
scores are 0. Equal texts get equal scores. Languages without labels, and null languages
among them, get the threshold 0.5. An empty table gives an empty result. Long texts are
cut into overlapping stretches whose maxima are joined, which changes nothing.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilog.llm.common import fold, matched, saved, small_batches

BUCKETS = 1 << 20
DIMS = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
MIN_DOCS = 5
#: Most labelled documents that the classifier is fitted on.
SAMPLE = 12_000
EPOCHS = 8
BATCH = 64
#: Held out: ids whose crc32 leaves this remainder.
FOLDS, HELD_OUT = 5, 0
BINS = 200

_TRIM = string.punctuation.encode()
_STRETCH = 100_000
_PAD = max(WIDTHS) - 1


def buckets(text: str | None) -> np.ndarray:
    """The hashed words of a whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    hashes = [zlib.crc32(w.strip(_TRIM) or w) for w in words]
    return (np.array(hashes, np.int64) % BUCKETS).astype(np.int32)


@dataclass
class Model:
    """Row 0 of the embedding is the zero vector of unknown words and of the ends of texts."""

    row_of: np.ndarray
    embedding: np.ndarray
    filters: list[np.ndarray]
    filter_bias: np.ndarray
    weights: np.ndarray
    bias: float

    def responses(self, rows: np.ndarray) -> np.ndarray:
        """Each filter at each place; `rows` has _PAD zero rows at its end, which the result leaves out."""
        x = self.embedding[rows]
        n = len(rows) - _PAD
        out = np.empty((n, FILTERS * len(WIDTHS)), np.float32)
        for k, (width, filters) in enumerate(zip(WIDTHS, self.filters)):
            part = x[:n] @ filters[0]
            for j in range(1, width):
                part += x[j:n + j] @ filters[j]
            out[:, k * FILTERS:(k + 1) * FILTERS] = part
        return out

    def maxima(self, rows: np.ndarray) -> np.ndarray:
        """The largest response of each filter over one text; that of an unknown word if it has none."""
        best = np.zeros(FILTERS * len(WIDTHS), np.float32)
        for k in range(0, len(rows), _STRETCH):
            part = np.zeros(min(_STRETCH, len(rows) - k) + _PAD, np.int64)
            own = rows[k:k + len(part)]
            part[:len(own)] = own
            best = np.maximum(best, self.responses(part).max(axis=0))
        return best

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.bias == -np.inf:  # nothing was labelled
            return np.zeros(len(texts))
        pooled = np.zeros((len(texts), FILTERS * len(WIDTHS)), np.float32)
        hashed = [self.row_of[buckets(t)] for t in texts]
        group: list[int] = []
        size = 0
        for k, rows in enumerate([*hashed, None]):
            if group and (rows is None or size + len(rows) > _STRETCH):
                flat, starts = laid_out([hashed[g] for g in group])
                pooled[group] = np.maximum(np.maximum.reduceat(self.responses(flat), starts, axis=0), 0)
                group, size = [], 0
            if rows is not None:
                if len(rows) > _STRETCH:
                    pooled[k] = self.maxima(rows)
                elif len(rows):
                    group.append(k)
                    size += len(rows) + _PAD
        z = np.maximum(pooled + self.filter_bias, 0) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))


def laid_out(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, each followed by zero rows, and where each begins."""
    starts = np.concatenate([[0], np.cumsum([len(r) + _PAD for r in rows])[:-1]])
    flat = np.zeros(sum(len(r) + _PAD for r in rows), np.int64)
    for at, r in zip(starts, rows):
        flat[at:at + len(r)] = r
    return flat, starts


def fit(samples: list[np.ndarray], labels: np.ndarray, seed: int = 42) -> Model:
    """Stochastic gradient steps on log loss; only the places that won a maximum pass gradients on."""
    rng = np.random.default_rng(seed)
    docs_of = np.zeros(BUCKETS, np.int32)
    for s in samples:
        docs_of[np.unique(s)] += 1
    known = np.flatnonzero(docs_of >= MIN_DOCS)
    row_of = np.zeros(BUCKETS, np.int32)
    row_of[known] = np.arange(1, len(known) + 1)
    embedding = rng.normal(0, 0.1, (len(known) + 1, DIMS)).astype(np.float32)
    embedding[0] = 0
    share = float(np.clip(labels.mean() if len(labels) else 0.0, 1e-6, 1 - 1e-6))
    total = FILTERS * len(WIDTHS)
    model = Model(row_of, embedding, [rng.normal(0, 0.5, (w, DIMS, FILTERS)).astype(np.float32) / w for w in WIDTHS],
                  np.zeros(total, np.float32), rng.normal(0, 0.3, total).astype(np.float32), float(np.log(share / (1 - share))))
    if not len(labels) or labels.min() == labels.max():
        model.weights[:] = 0
        if not len(labels):
            model.bias = -np.inf
        return model
    rows = [row_of[s] for s in samples]
    squares: dict[str, np.ndarray] = {}

    def step(name: str, value: np.ndarray, grad: np.ndarray, rate: float) -> None:
        seen = squares.setdefault(name, np.full(value.shape, 1e-6, np.float32))
        seen += grad * grad
        value -= (rate * grad / np.sqrt(seen)).astype(np.float32)

    seen_rows = np.full(embedding.shape, 1e-6, np.float32)
    full = np.flatnonzero([len(r) > 0 for r in rows])
    for epoch in range(EPOCHS):
        rate = 0.15 / (1 + epoch)
        order = rng.permutation(full)
        for k in range(0, len(order), BATCH):
            chosen = order[k:k + BATCH]
            flat, starts = laid_out([rows[i] for i in chosen])
            responses = model.responses(flat)
            best = np.maximum.reduceat(responses, starts, axis=0)
            sizes = np.diff(np.append(starts, len(responses)))
            owner = np.repeat(np.arange(len(chosen)), sizes)
            won = responses == best[owner]
            # The first winning place of each text and filter.
            place = np.minimum.reduceat(np.where(won, np.arange(len(responses))[:, None], len(responses)), starts, axis=0)
            raw = np.maximum(best, 0) + model.filter_bias
            pooled = np.maximum(raw, 0)
            z = pooled @ model.weights + model.bias
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[chosen]).astype(np.float32) / len(chosen)
            down = np.outer(error, model.weights) * (raw > 0)
            step("weights", model.weights, pooled.T @ error + 1e-4 * model.weights, rate)
            model.bias -= rate * float(error.sum())
            step("filter_bias", model.filter_bias, down.sum(axis=0), rate)
            down = down * (best > 0)
            grads_at, grads = [], []
            for m, (width, filters) in enumerate(zip(WIDTHS, model.filters)):
                own, at = down[:, m * FILTERS:(m + 1) * FILTERS], place[:, m * FILTERS:(m + 1) * FILTERS]
                change = np.zeros_like(filters)
                for j in range(width):
                    ids = flat[np.minimum(at + j, len(flat) - 1)]
                    x = model.embedding[ids]
                    change[j] = np.einsum("bf,bfd->df", own, x)
                    grads_at.append(ids.ravel())
                    grads.append((own[:, :, None] * filters[j].T[None, :, :]).reshape(-1, DIMS))
                step(f"filter{m}", filters, change + 1e-5 * filters, rate)
            ids, back = np.unique(np.concatenate(grads_at), return_inverse=True)
            grad = np.zeros((len(ids), DIMS), np.float32)
            np.add.at(grad, back, np.concatenate(grads))
            grad[ids == 0] = 0
            seen_rows[ids] += grad * grad
            model.embedding[ids] -= rate * grad / np.sqrt(seen_rows[ids])
    return model


def _labels(labels: DataFrame) -> DataFrame:
    fine = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    return fine.groupBy(F.col("doc_id").alias("label_id")).agg(F.max(F.col("toxic").cast("int")).alias("label"))


def trained(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, sample: int = SAMPLE, seed: int = 42) -> Model:
    """Fitted on at most `sample` labelled documents; `allowed` is a condition on `label_id`."""
    small_batches(docs.sparkSession)
    chosen = _labels(labels)
    chosen = chosen.where(allowed) if allowed is not None else chosen
    chosen = saved(chosen.orderBy(F.xxhash64("label_id"), "label_id").limit(sample), "toxic-sample")
    texts = matched(docs.select("doc_id", "text"), chosen, F.col("doc_id") == F.col("label_id"), "inner")
    hashed = F.pandas_udf(lambda ts: pd.Series([buckets(t).tobytes() for t in ts], dtype=object), "binary").asNondeterministic()
    rows = texts.select("doc_id", "label", hashed("text").alias("words")).toPandas().sort_values(["doc_id", "words"], kind="stable")
    return fit([np.frombuffer(w, np.int32) for w in rows["words"]], rows["label"].to_numpy(np.float32), seed)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` without its text: `doc_id`, `lang`, `score`."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.scores([t if isinstance(t, str) else None for t in texts]), dtype=float)

    return docs.select("doc_id", "lang", F.pandas_udf(score, "double")("text").alias("score"))


def thresholds(scores: DataFrame, labels: DataFrame, allowed: Column) -> DataFrame:
    """`for_lang` and `threshold`: the score with the best F1 in each language, from BINS counts of labelled scores."""
    bin_of = F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int")
    known = scores.join(_labels(labels).where(allowed), F.col("doc_id") == F.col("label_id"))
    bins = known.groupBy("lang", bin_of.alias("bin")).agg(F.sum("label").alias("hit"), F.count("*").alias("n"))
    down = Window.partitionBy("lang").orderBy(F.col("bin").desc())
    bins = bins.withColumn("hits", F.sum("hit").over(down)).withColumn("taken", F.sum("n").over(down))
    bins = bins.withColumn("positives", F.sum("hit").over(Window.partitionBy("lang")))
    f1 = 2 * F.col("hits") / (F.col("taken") + F.col("positives"))
    best = bins.where("positives > 0").groupBy("lang").agg(F.max_by("bin", F.struct(f1, "bin")).alias("bin"))
    return best.select(F.col("lang").alias("for_lang"), (F.col("bin") / BINS).alias("threshold"))


def classified(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """`doc_id`, `held_out`, `score`, `predicted` (1 from 0.5), `threshold` of its language, `flagged` (1 from there)."""
    allowed = fold(F.col("label_id"), FOLDS) != HELD_OUT
    model = trained(docs, labels, allowed, sample)
    scores = saved(scored(docs, model), "toxicity")
    levels = saved(thresholds(scores, labels, allowed), "toxicity-thresholds")
    out = matched(scores, levels, F.col("lang").eqNullSafe(F.col("for_lang")), "left")
    level = F.coalesce("threshold", F.lit(0.5))
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), level.alias("threshold"),
                      (F.col("score") >= level).cast("int").alias("flagged"))
