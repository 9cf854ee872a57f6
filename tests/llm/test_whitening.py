"""Spectrum slicing against a whole eigendecomposition, and whitening against brute force."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from vigilog.llm import whitening
from vigilog.llm.queries import QUERIES

SCHEMA = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType())), StructField("n", StringType()),
                     StructField("x", StringType()), StructField("component", StringType())])


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], SCHEMA)


def brute(rows, most=16):
    """{vec_id: [(deviation, |whitened| of each component), ...]}, n and explained shares."""
    fine = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kinds = sorted({tuple(x) for _, x in fine})
    n, sums = len(kinds), [sum(c) for c in zip(*kinds)]
    a = np.array(kinds, float) - np.array([s / n for s in sums])
    values, directions = np.linalg.eigh(a.T @ a / n)
    values, directions = values[::-1][:most], directions[:, ::-1][:, :most]
    out = defaultdict(list)
    for i, x in fine:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        out[i].append((deviation, (np.array(x) - np.array([s / n for s in sums])) @ directions / np.sqrt(values)))
    return out, n, values / np.trace(a.T @ a / n)


def held(got, rows, most=16):
    wanted, n, shares = brute(rows, most)
    found = defaultdict(lambda: defaultdict(list))
    for r in got:
        assert r["n"] == n and r["identity_error"] <= 1e-9
        assert math.isclose(r["explained"], shares[r["component"] - 1], rel_tol=1e-9)
        found[r["vec_id"]][r["component"]].append((r["deviation"], r["whitened"]))
    assert set(found) == set(wanted)
    signs = {}
    for i, own in wanted.items():
        assert set(found[i]) == set(range(1, len(shares) + 1))
        for k, values in found[i].items():
            assert sorted(d for d, _ in values) == sorted(d for d, _ in own)
            if len(own) == 1:
                w, v = values[0][1], float(own[0][1][k - 1])
                assert math.isclose(abs(w), abs(v), rel_tol=1e-6, abs_tol=1e-7)
                if abs(v) > 1e-3:
                    assert signs.setdefault(k, w * v > 0) == (w * v > 0)


@pytest.mark.parametrize("dims", [1, 2, 3, 17, 40])
@pytest.mark.parametrize("kind", ["any", "equal", "thin", "blocks", "near"])
def test_leading_eigenvalues(dims, kind):
    rng = np.random.default_rng(dims)
    turn = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
    values = {"any": rng.exponential(size=dims), "equal": np.ones(dims), "thin": np.arange(dims) < dims // 3 + 1.0,
              "blocks": np.where(np.arange(dims) < dims // 2, 3.0, 1.0), "near": 1 + 1e-7 * np.arange(dims)}[kind].astype(float)
    a = turn @ np.diag(values) @ turn.T
    a = (a + a.T) / 2
    got, directions = whitening.leading(a, 16)
    most = min(16, dims)
    assert np.allclose(got, np.sort(values)[::-1][:most], atol=1e-12)
    assert np.allclose(directions @ directions.T, np.eye(most), atol=1e-9)
    assert np.allclose(directions @ a @ directions.T, np.diag(got), atol=1e-12)


def test_inertia_counts_with_pivots_of_two():
    a = np.array([[0.0, 1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 5.0]])
    assert whitening.inertia(a, 0.0) == (2, 1)
    assert whitening.inertia(a, 1.0)[0] == 1  # an eigenvalue at the shift counts on neither side
    assert whitening.inertia(np.zeros((3, 3)), 0.0) == (0, 0)
    rng = np.random.default_rng(3)
    b = rng.normal(size=(30, 30))
    b += b.T
    values = np.linalg.eigvalsh(b)
    for shift in (-3.0, 0.0, 0.5, 4.0):
        assert whitening.inertia(b, shift) == ((values > shift).sum(), (values < shift).sum())


def test_query_against_brute_force(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    held(QUERIES["op11_spectrum_whitening"](spark, sf).collect(), rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(60)]
    hot = [0.5, 0.25, -0.125, 1.0, 2.0, 3.0]
    rows += [(100 + k, hot) for k in range(40)] + [(7, rows[7][1]), (None, hot)]
    odd = [(200, None), (201, [1.0, None, 0, 0, 0, 0]), (202, [float("nan")] * 6), (203, [float("inf")] + [0.0] * 5), (204, []), (205, [1.0, 2.0])]
    held(whitening.whitened(vectors(spark, [(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in rows + odd])).collect(), rows)


def test_tables_without_directions(spark):
    assert whitening.whitened(vectors(spark, [])).count() == 0
    assert whitening.whitened(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitening.whitened(vectors(spark, [(1, [])])).count() == 0
    # One direction of two varies.
    got = whitening.whitened(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 3.0]), (3, [1.0, 4.0])])).collect()
    assert sorted((r["vec_id"], r["component"]) for r in got) == [(1, 1), (2, 1), (3, 1)]


def test_huge_entries(spark):
    rows = [(k, [1e12 * k, float(k % 3)]) for k in range(9)] + [(20, [1e300, 0.0])]
    got = whitening.whitened(vectors(spark, rows)).collect()
    assert {r["vec_id"] for r in got} == {i for i, _ in rows}
    assert all(math.isfinite(r["whitened"]) for r in got) and any(r["deviation"] is None for r in got)
