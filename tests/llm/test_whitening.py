"""Whitening: exact covariances by fractions, the eigen-solve by its residuals and numpy's, edge rows."""

import math
from fractions import Fraction

import numpy as np
import pytest

from ledgerweave.llm import whitening as w

VECTORS = "vec_id long, embedding array<float>, component string, n string, whitened string"


def test_products_and_sums_lose_nothing():
    rng = np.random.default_rng(0)
    a, b = (rng.normal(size=200) * 2.0 ** rng.integers(-40, 40, 200) for _ in range(2))
    for x, y, s, e in zip(a, b, *w.two_sum(a, b)):
        assert Fraction(x) + Fraction(y) == Fraction(s) + Fraction(e)
    for x, y, p, e in zip(a, b, *w.two_product(a, b)):
        assert Fraction(x) * Fraction(y) == Fraction(p) + Fraction(e)


@pytest.mark.parametrize("rows, size", [(1, 1), (7, 3), (500, 4), (33, 40)])
def test_outer_sums_by_fractions(rows, size):
    """A common offset of 2**35 beside a spread of some hundreds: what plain doubles lose."""
    x = np.random.default_rng(rows).integers(-300, 300, (rows, size)) + (1 << 35)
    sums = [int(s) for s in x.sum(0)]
    model = w.Whitening(rows, sums, np.zeros((size, 0)), np.zeros(0), 0.0)
    high, low = w.outer_sum(model.centre(x))
    for k, (i, j) in enumerate(zip(*np.triu_indices(size))):
        true = sum((Fraction(int(r[i])) - Fraction(sums[i], rows)) * (Fraction(int(r[j])) - Fraction(sums[j], rows)) for r in x)
        assert abs(w.exact(high[k], low[k]) - true) <= Fraction(rows * 300**2, 1 << 90)


def matrix(kind, n):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, n))
    q = np.linalg.qr(a)[0]
    a = {"full": a @ a.T, "one": np.eye(n), "two": q @ np.diag(np.where(np.arange(n) < n // 2, 1.0, 3.0)) @ q.T, "zero": np.zeros((n, n)), "near": np.diag(np.arange(n) * 1.0) + 1e-9, "graded": q @ np.diag(10.0 ** -np.arange(n).clip(max=12)) @ q.T, "low": a[:, :1] @ a[:, :1].T}[kind]
    return (a + a.T) / 2


@pytest.mark.parametrize("kind", ["full", "one", "two", "zero", "near", "graded", "low"])
@pytest.mark.parametrize("n", [1, 2, 3, 8, 65, 130])
def test_eigen_solve(kind, n):
    a = matrix(kind, n)
    scale = max(1.0, np.abs(a).max())
    d, e, q = w.tridiagonal(a)
    t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    assert np.abs(q @ t @ q.T - a).max() <= 1e-12 * scale
    values, vectors = w.divide_and_conquer(d, e)
    assert (np.diff(values) >= 0).all() and np.abs(t @ vectors - vectors * values).max() <= 1e-12 * scale
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() <= 1e-12
    values, vectors = w.eigen(a.astype(np.longdouble))
    assert np.abs(values[::-1] - np.linalg.eigvalsh(a)).max() <= 1e-12 * scale
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * scale * n
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() <= 1e-14
    assert (vectors[np.abs(vectors).argmax(0), np.arange(n)] > 0).all()


def brute(rows, components=8):
    """(id, component) -> values, by exact covariances and numpy's solver, up to a component's sign."""
    good = [(i, [math.floor(1024 * np.float64(np.float32(c))) + 100000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) and abs(c) <= w.LARGEST for c in v)]
    sizes = [len(v) for _, v in good]
    size = max(set(sizes), key=lambda s: (sizes.count(s), s))
    good = [(i, v) for i, v in good if len(v) == size]
    n = len(good)
    sums = [sum(c) for c in zip(*(v for _, v in good))]
    centred = [[Fraction(c) - Fraction(s, n) for c, s in zip(v, sums)] for _, v in good]
    v = np.array([[float(sum(r[i] * r[j] for r in centred) / n) for j in range(size)] for i in range(size)])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    some = min(components, int((values > 1e-10 * values[0]).sum()))
    out = []
    for (i, x), r in zip(good, centred):
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        for k in range(some):
            out.append((i, k + 1, n, deviation, abs(float(np.array(r, float) @ vectors[:, k])) / values[k] ** 0.5, values[k] / np.trace(v)))
    return out


def test_rows_by_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=12) * np.arange(1, 13) + 5).astype(np.float32).tolist()) for i in range(150)]
    rows += [(None, rows[0][1]), (5, rows[1][1]), (5, rows[1][1]), (6, None), (7, []), (8, [None] * 12), (9, [float("nan")] + [0.0] * 11), (10, [math.inf] * 12), (11, [1.0] * 11), (12, [3e38] * 12)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], VECTORS).repartition(5)
    got = w.whiten(df)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], r[4])
    want = sorted(brute(rows), key=key)
    made = sorted(((r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in got), key=key)
    assert [r[:4] for r in made] == [r[:4] for r in want]
    assert np.allclose([r[4:] for r in made], [r[4:] for r in want], rtol=1e-9, atol=1e-10)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-12
    x = np.array([r["whitened"] for r in sorted(got, key=lambda r: (r["component"], r["vec_id"] is None, r["vec_id"], r["deviation"]))]).reshape(8, -1)
    assert np.abs(x @ x.T / x.shape[1] - np.eye(8)).max() < 1e-12


def test_few_directions_and_none(spark):
    rank_two = [(i, [float(i), 2.0 * i, float(i % 3), 7.0]) for i in range(30)]
    rows = lambda vectors: w.whiten(spark.createDataFrame([(*v, "x", "y", "z") for v in vectors], VECTORS)).collect()
    assert {r["component"] for r in rows(rank_two)} == {1, 2} and rows(rank_two)[0]["identity_error"] < 1e-10
    assert rows([]) == rows([(1, [1.0, 2.0])]) == rows([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == rows([(1, None), (2, [math.nan])]) == []


def test_deviations_beyond_64_bits():
    x = np.array([[1 << 39], [0], [5]], np.int64)
    model = w.Whitening(3, [(1 << 39) + 5], np.zeros((1, 0)), np.zeros(0), 0.0)
    assert model.deviations(x) == [None, None, None]
    small = w.Whitening(3, [9], np.zeros((1, 0)), np.zeros(0), 0.0)
    assert small.deviations(np.array([[1], [2], [6]])) == [36, 9, 81]
    wide = w.Whitening(2, [1 << 31], np.zeros((1, 0)), np.zeros(0), 0.0)
    assert wide.deviations(np.array([[1 << 31], [0]])) == [1 << 62, 1 << 62]
