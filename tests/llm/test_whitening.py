"""Whitening against an eigensolver, exact polynomials, and unusual rows."""

import math
from fractions import Fraction

import numpy as np
import pytest

from corvane.llm import whitening as wh

ROWS = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def plain(rows):
    """Distinct integer vectors, their covariance, and every row's integers."""
    x = {i: tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for i, v in rows}
    fit = np.array(sorted(set(x.values())), dtype=float)
    return x, fit, np.cov(fit.T, bias=True).reshape(fit.shape[1], -1)


def test_whitening_matches_a_plain_one(spark):
    draw = np.random.default_rng(4)
    data = draw.normal(size=(60, 5)) * [3, 2, 1, 0.5, 0.2]
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(data)] + [(100, [float(c) for c in data[0]])]
    x, fit, cov = plain(rows)
    got = wh.whiten(vectors(spark, [(i, v, 0) for i, v in rows]), 3).collect()
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    n, sums = len(fit), [int(s) for s in fit.sum(0)]
    assert len(got) == 61 * 3 and {r["n"] for r in got} == {60}
    for r in got:
        k = r["component"] - 1
        away = np.array(x[r["vec_id"]]) - fit.mean(0)
        assert abs(abs(r["whitened"]) - abs(away @ basis[:, k]) / math.sqrt(values[k])) < 1e-8
        assert abs(r["explained"] - values[k] / values.sum()) < 1e-10
        assert int(r["deviation"]) == sum((n * a - s) ** 2 for a, s in zip(x[r["vec_id"]], sums))
        assert r["identity_error"] < 1e-9


def test_dropped_repeated_and_degenerate_rows(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None, 0), (2, [1.0, None], 0), (3, [nan, 1.0], 0), (4, [inf, 1.0], 0), (5, [1.0], 0), (6, [], 0)]
    good = [(10, [1.0, 1.0], None), (10, [1.0, 1.0], 1), (None, [3.0, 3.0], 2), (11, [1.0, 1.0], 3)]
    got = wh.whiten(vectors(spark, bad + good)).collect()
    assert [(r["component"], r["n"]) for r in got] == [(1, 2)] * 4  # one direction has variance
    assert sorted(str(r["vec_id"]) for r in got) == ["10", "10", "11", "None"]
    assert {round(abs(r["whitened"]), 12) for r in got} == {1.0}
    assert wh.whiten(vectors(spark, good[:2])).count() == 0
    assert wh.whiten(vectors(spark, bad[:4])).count() == wh.whiten(vectors(spark, [])).count() == 0
    clash = vectors(spark, good).selectExpr("*", "1 as n", "2 as component", "3 as x")
    assert wh.whiten(clash).count() == 4


def test_huge_entries_and_equal_variances(spark):
    rows = [(k, [s if i == j else 0.0 for i in range(4)], 0) for k, (j, s) in enumerate(
        (j, s) for j in range(4) for s in (2.0, -2.0))]
    got = wh.whiten(vectors(spark, rows)).collect()
    assert len(got) == 32 and {round(r["explained"], 12) for r in got} == {0.25}
    assert max(r["identity_error"] for r in got) < 1e-12
    got = wh.whiten(vectors(spark, [(1, [3e38, 1.0], 0), (2, [-3e38, 2.0], 0), (3, [1.0, 3.0], 0)])).collect()
    assert {r["component"] for r in got} == {1, 2} and max(r["identity_error"] for r in got) < 1e-4


@pytest.mark.parametrize("d", [1, 2, 3, 7])
def test_polynomial_and_roots_are_exact(spark, d):
    draw = np.random.default_rng(d)
    b = draw.integers(-50, 50, (d, d + 2)).astype(object)
    a = b @ b.T
    f = wh.characteristic_polynomial(spark, a)
    for x in (0, 1, -7, 1000):
        m = [[Fraction(int(v)) for v in row] for row in (np.eye(d, dtype=int).astype(object) * x - a)]
        det = Fraction(1)
        for i in range(d):  # plain elimination
            p = next((r for r in range(i, d) if m[r][i]), None)
            if p is None:
                det = Fraction(0)
                break
            if p != i:
                m[i], m[p], det = m[p], m[i], -det
            det *= m[i][i]
            for r in range(i + 1, d):
                q = m[r][i] / m[i][i]
                m[r] = [u - q * v for u, v in zip(m[r], m[i])]
        assert sum(c * x ** k for k, c in enumerate(f)) == det
    found = [m / 2 ** s for m, s in (wh.refined(f, m, s, w) for m, s, w, _ in wh.largest_roots(f, d))]
    assert np.allclose(found, np.linalg.eigvalsh(a.astype(float))[::-1], rtol=1e-9)


def test_exact_products_of_wide_numbers():
    draw = np.random.default_rng(1)
    for top in (10, 1 << 30, 1 << 61):
        y = draw.integers(-top, top, (5000, 3))
        assert (wh.exact_products(y) == y.astype(object).T @ y.astype(object)).all()
