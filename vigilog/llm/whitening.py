"""Whitening of vectors by spectrum slicing.

Components of vectors become whole numbers, so that sums over all rows are exact
and do not depend on how Spark deals them. Of each different vector one is in the fit
list; its sums and, after each entry is centred at the whole number next to the mean,
its second moments are added up per task by numpy and by Spark over the tasks.
What centring at a whole number leaves is taken off exactly. The covariance has
the square of the vectors' length in entries, whatever the table holds; only
it is brought to the driver.

The leading eigenvalues are found by spectrum slicing. By Sylvester's law, the
signs of D in an LDL' factorisation of the covariance less a shift count the
eigenvalues above the shift. Bisection by such counts isolates the k-th largest
in an interval of its own. Rayleigh quotient iteration, whose steps
converge cubically, then finds it and its vector; a result outside the interval
is refused and the interval halved. At last two counts close around the result
certify that it is the k-th. Eigenvalues that double precision cannot tell apart
are found together, as an orthonormal basis of their space.

Rows whose vector is null or has null or non-finite entries take no part. All
fitted vectors have one length: that of most different vectors, of several such the
longest; rows of other lengths take no part. Entries beyond 2**52 in size after scaling
count as 2**52. Repeated rows are answered each; null ids are answered with
null. Directions without variance (within rounding) have no component, so
a table with one vector, or none, gives no rows. A deviation beyond 64 bits is null.
Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import saved, small_batches

#: The scale and the shift of components, and how many directions are kept.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16

_MOST = float(2 ** 52)
#: Up to this distance from the centre, products and their sums over a batch are exact in doubles.
_EXACT = 1 << 18
_SPLIT = 32
_EPS = float(np.finfo(float).eps)
#: Choice of 2 by 2 pivots that bounds the growth of a factorisation.
_PIVOT = (1 + 17 ** 0.5) / 8


def inertia(a: np.ndarray, shift: float) -> tuple[int, int]:
    """How many eigenvalues of a symmetric matrix lie above and below `shift`, from the signs of D in LDL' with full pivoting."""
    m = a - shift * np.eye(len(a))
    above = below = 0
    while len(m):
        diagonal = np.abs(np.diagonal(m))
        p = int(diagonal.argmax())
        off = np.abs(m)
        np.fill_diagonal(off, -1.0)
        r, s = np.unravel_index(int(off.argmax()), m.shape)
        if diagonal[p] == 0 and off[r, s] <= 0:
            break
        if diagonal[p] >= _PIVOT * off[r, s]:
            d = m[p, p]
            above, below = above + (d > 0), below + (d < 0)
            rest = np.delete(np.arange(len(m)), p)
            column = m[rest, p]
            m = m[np.ix_(rest, rest)] - np.outer(column, column / d)
        else:
            # A pivot block of two with a large entry off its diagonal has an eigenvalue of either sign.
            above, below = above + 1, below + 1
            pair, rest = np.array([r, s]), np.delete(np.arange(len(m)), [r, s])
            columns = m[np.ix_(rest, pair)]
            m = m[np.ix_(rest, rest)] - columns @ np.linalg.solve(m[np.ix_(pair, pair)], columns.T)
        m = (m + m.T) / 2
    return int(above), int(below)


@dataclass
class Slices:
    """Counts of eigenvalues above the shifts tried so far, kept for all intervals."""

    a: np.ndarray

    def __post_init__(self):
        self.size = float(np.abs(self.a).sum(axis=1).max()) if len(self.a) else 0.0
        # By Gershgorin's discs all eigenvalues lie within the largest row sum.
        self.known = {-2 * self.size: len(self.a), 2 * self.size: 0}

    def above(self, shift: float) -> int:
        if shift not in self.known:
            self.known[shift] = inertia(self.a, shift)[0]
        return self.known[shift]

    def around(self, k: int) -> tuple[float, float]:
        """The closest shifts known with at least `k` and with fewer eigenvalues above."""
        return (max(s for s, n in self.known.items() if n >= k), min(s for s, n in self.known.items() if n < k))


def _solved(a: np.ndarray, shift: float, y: np.ndarray, size: float) -> np.ndarray:
    for step in range(8):
        try:
            x = np.linalg.solve(a - shift * np.eye(len(a)), y)
        except np.linalg.LinAlgError:
            x = np.full_like(y, np.nan)
        if np.isfinite(x).all():
            return x
        shift += 2.0 ** step * _EPS * size
    raise ArithmeticError("a shifted covariance cannot be solved")


def _quotient(a: np.ndarray, shift: float, start: np.ndarray, size: float) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration from `shift`: an eigenvalue and its unit vector."""
    v = start
    for _ in range(2):
        v = _solved(a, shift, v, size)
        v /= np.linalg.norm(v)
    value, best = float(v @ a @ v), np.inf
    for _ in range(30):
        left = float(np.linalg.norm(a @ v - value * v))
        if left <= 2 * _EPS * size or left >= best:
            break
        best = left
        w = _solved(a, value, v, size)
        w /= np.linalg.norm(w)
        v, value = w, float(w @ a @ w)
    return value, v


def leading(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` largest eigenvalues of a symmetric matrix by falling size, and their unit vectors as rows."""
    slices, rng = Slices(a), np.random.default_rng(42)
    values, vectors = [], []
    size, narrow = slices.size, 8 * len(a) * _EPS * slices.size
    while len(values) < min(most, len(a)) and size:
        k = len(values) + 1
        low, high = slices.around(k)
        alone = slices.above(low) == k and slices.above(high) == k - 1
        if high - low > narrow and not alone:
            slices.above((low + high) / 2)
            continue
        if not alone:  # several within rounding: a basis of their space
            together = slices.above(low) - (k - 1)
            basis = rng.normal(size=(len(a), together))
            for _ in range(4):
                basis = _solved(a, (low + high) / 2, basis, size)
                basis -= np.array(vectors).T @ (np.array(vectors) @ basis) if vectors else 0
                basis = np.linalg.qr(basis)[0]
            own = np.einsum("ik,ij,jk->k", basis, a, basis)
            for j in np.argsort(-own, kind="stable"):
                values.append(float(own[j]))
                vectors.append(basis[:, j])
            continue
        value, v = _quotient(a, (low + high) / 2, rng.normal(size=len(a)), size)
        off = max(narrow, 4 * float(np.linalg.norm(a @ v - value * v)))
        if not low - narrow <= value <= high + narrow or not (slices.above(value - off) >= k > slices.above(value + off)):
            if high - low <= narrow:
                raise ArithmeticError("an isolated eigenvalue was not reached")
            slices.above((low + high) / 2)
            continue
        if vectors:
            v = v - np.array(vectors).T @ (np.array(vectors) @ v)
            v /= np.linalg.norm(v)
        values.append(value)
        vectors.append(v)
    return np.array(values[:most]), np.array(vectors[:most]).reshape(len(values[:most]), len(a))


@dataclass
class Fit:
    """Sums, centre and kept directions; its size depends on the vectors' length alone."""

    n: int
    dims: int
    sums: list[int]
    centre: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def left(self) -> list[int]:
        """n times the distance from the centre to the mean."""
        return [s - self.n * int(c) for s, c in zip(self.sums, self.centre)]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        centred = (x - self.centre) - np.array([r / self.n for r in self.left])
        return centred @ (self.vectors / np.sqrt(self.values)[:, None]).T

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - sums) ** 2 over the dimensions, exact; None beyond 64 bits."""
        y = x - self.centre
        reach = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if reach * reach * self.dims < 1 << 63:
            z = y * self.n - np.array(self.left, np.int64)
            return (z * z).sum(axis=1).tolist()
        rows = ((y.astype(object) * self.n - np.array(self.left, object)) ** 2).sum(axis=1)
        return [int(d) if d < 1 << 63 else None for d in rows]


def scaled(value: Column) -> Column:
    """Entries of a vector as whole numbers."""
    def whole(c: Column) -> Column:
        return F.floor(F.least(F.greatest(F.lit(float(SCALE)) * c.cast("double"), F.lit(-_MOST)), F.lit(_MOST))).cast("long") + SHIFT

    return F.transform(value, whole)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    value = F.col(f"`{embedding}`")
    fine = F.forall(value, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where(value.isNotNull() & fine).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), scaled(value).alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _table(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def _sums(kinds: DataFrame, dims: int) -> list[int]:
    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims, object)
        for _, x in _blocks(batches, dims):
            total += x.sum(axis=0).astype(object)
        yield _table(i=np.arange(dims, dtype=np.int32), high=np.array([int(t) >> _SPLIT for t in total], np.int64),
                     low=np.array([int(t) & ((1 << _SPLIT) - 1) for t in total], np.int64))

    out = [0] * dims
    for r in kinds.mapInArrow(added, "i int, high long, low long").groupBy("i").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect():
        out[r["i"]] = (r["high"] << _SPLIT) + r["low"]
    return out


def _covariance(kinds: DataFrame, n: int, sums: list[int], centre: np.ndarray) -> np.ndarray:
    dims = len(sums)
    i, j = np.triu_indices(dims)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, rest = np.zeros((dims, dims), np.int64), np.zeros((dims, dims))
        for _, x in _blocks(batches, dims):
            y = x - centre
            far = (np.abs(y) >= _EXACT).any(axis=1)
            for k in range(0, len(y), 1000):
                near = y[k:k + 1000][~far[k:k + 1000]].astype(float)
                whole += (near.T @ near).astype(np.int64)
            if far.any():  # such large entries are added up in doubles
                rest += y[far].astype(float).T @ y[far].astype(float)
        own = whole[i, j]
        yield _table(i=i.astype(np.int32), j=j.astype(np.int32), high=own >> _SPLIT, low=own & ((1 << _SPLIT) - 1), rest=rest[i, j])

    out = np.zeros((dims, dims))
    total = kinds.mapInArrow(added, "i int, j int, high long, low long, rest double").groupBy("i", "j").agg(
        F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("rest").alias("rest"))
    left = [s - n * int(c) for s, c in zip(sums, centre)]
    for r in total.collect():
        exact = Fraction(((r["high"] << _SPLIT) + r["low"]) * n - left[r["i"]] * left[r["j"]], n * n)
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = float(exact + Fraction(r["rest"]) / n)
    return out


def fitted(kinds: DataFrame, most: int = COMPONENTS) -> Fit | None:
    """The fit of saved different vectors `x`, all of those of the leading length; None if there are none."""
    first = kinds.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("dims").desc()).first()
    if first is None or not first["dims"]:
        return None
    n, dims = first["n"], first["dims"]
    kinds = kinds.where(F.size("x") == dims)
    sums = _sums(kinds, dims)
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    a = _covariance(kinds, n, sums, centre)
    values, vectors = leading(a, most)
    trace = float(np.trace(a))
    real = values > dims * _EPS * trace
    return Fit(n, dims, sums, centre, values[real], vectors[real], trace)


def identity_error(kinds: DataFrame, fit: Fit) -> float:
    """The largest entry, by size, of the covariance of the whitened fit list less the identity, measured over all of it."""
    most = len(fit.values)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((most + 1, most))
        for _, x in _blocks(batches, fit.dims):
            w = fit.whiten(x)
            total[:most] += w.T @ w
            total[most] += w.sum(axis=0)
        i, j = np.indices(total.shape)
        yield _table(i=i.ravel().astype(np.int32), j=j.ravel().astype(np.int32), m=total.ravel())

    total = np.zeros((most + 1, most))
    own = kinds.where(F.size("x") == fit.dims).mapInArrow(added, "i int, j int, m double").groupBy("i", "j").agg(F.sum("m").alias("m"))
    for r in own.collect():
        total[r["i"], r["j"]] = r["m"] / fit.n
    return float(np.abs(total[:most] - np.outer(total[most], total[most]) - np.eye(most)).max(initial=0.0))


def whitened(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """A row per vector and component: `vec_id`, `component`, `n`, `deviation`, `whitened`, `explained`, `identity_error`."""
    spark = vectors.sparkSession
    small_batches(spark)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = usable(vectors, vec_id, embedding)
    # Equal vectors meet before the shuffle, so that a frequent one costs a row per task.
    kinds = saved(rows.select("x").distinct(), "vector-kinds")
    fit = fitted(kinds, most)
    if fit is None or not len(fit.values):
        return spark.createDataFrame([], schema)
    error = identity_error(kinds, fit)
    width = len(fit.values)
    share = fit.values / fit.trace

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, fit.dims):
            n = len(x)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id").take(pa.array(np.repeat(np.arange(n), width))),
                "component": np.tile(np.arange(1, width + 1, dtype=np.int32), n), "n": np.full(n * width, fit.n),
                "deviation": pa.array(fit.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(n), width))),
                "whitened": fit.whiten(x).ravel(), "explained": np.tile(share, n), "identity_error": np.full(n * width, error)})

    return rows.where(F.size("x") == fit.dims).mapInArrow(answers, schema)
