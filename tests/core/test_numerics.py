import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import calculus as c
from tessera.functions import matrices as m
from tessera.functions import signals as s

G = np.random.default_rng(3)
A = G.standard_normal((5, 5))
P = A @ A.T + np.eye(5)
B = G.standard_normal(5)


def test_factorisations():
    p, low, up = m.lu(A)
    np.testing.assert_allclose(p @ low @ up, A, atol=1e-12)
    np.testing.assert_allclose(m.lu_solve((p, low, up), B), np.linalg.solve(A, B))
    np.testing.assert_allclose(m.cho_solve(m.cho_factor(P), B), np.linalg.solve(P, B))
    low, diagonal = m.ldl(P)
    np.testing.assert_allclose(low @ diagonal @ low.T, P)
    h, q = m.hessenberg(A)
    np.testing.assert_allclose(q @ h @ q.T, A, atol=1e-12)
    assert abs(np.tril(h, -2)).max() == 0
    t, z = m.schur(A)
    np.testing.assert_allclose(z @ t @ z.conj().T, A, atol=1e-9)
    np.testing.assert_allclose(np.sort_complex(np.diag(t).round(8)), np.sort_complex(np.linalg.eigvals(A).round(8)), atol=1e-7)
    u, v = m.polar(A)
    np.testing.assert_allclose(u @ v, A)
    np.testing.assert_allclose(u @ u.T, np.eye(5), atol=1e-12)
    np.testing.assert_allclose(m.logm(m.expm(P / 10)), P / 10, atol=1e-9)
    np.testing.assert_allclose(m.sqrtm(P) @ m.sqrtm(P), P)
    low_rank = A[:, :2] @ G.standard_normal((2, 6))
    places, coefficients = m.interpolative(low_rank, 2)
    np.testing.assert_allclose(low_rank[:, places] @ coefficients, low_rank, atol=1e-10)
    np.testing.assert_allclose(m.dtrsv(np.tril(P), B), np.linalg.solve(np.tril(P), B))
    np.testing.assert_allclose(m.dtrsv(np.triu(P), B, lower=False), np.linalg.solve(np.triu(P), B))
    np.testing.assert_allclose(m.dtrsv(np.tril(P), B, transposed=True), np.linalg.solve(np.tril(P).T, B))


def test_structured():
    assert m.toeplitz([1, 2, 3], [1, 5, 6]).tolist() == [[1, 5, 6], [2, 1, 5], [3, 2, 1]]
    assert m.circulant([1, 2, 3]).tolist() == [[1, 3, 2], [2, 1, 3], [3, 2, 1]]
    assert m.hankel([1, 2, 3], [3, 4, 5]).tolist() == [[1, 2, 3], [2, 3, 4], [3, 4, 5]]
    assert m.pascal(4).tolist() == [[1, 1, 1, 1], [1, 2, 3, 4], [1, 3, 6, 10], [1, 4, 10, 20]]
    np.testing.assert_allclose(m.hilbert(4) @ m.inv_hilbert(4), np.eye(4), atol=1e-9)
    h = m.hadamard(8)
    np.testing.assert_allclose(h @ h.T, 8 * np.eye(8))
    np.testing.assert_allclose(sorted(np.linalg.eigvals(m.companion([1, -6, 11, -6])).real), [1, 2, 3])
    assert m.block_diag(np.ones((1, 2)), 2 * np.ones((2, 1))).tolist() == [[1, 1, 0], [0, 0, 2], [0, 0, 2]]
    assert m.fiedler([1, 4, 9]).tolist() == [[0, 3, 8], [3, 0, 5], [8, 5, 0]]
    assert m.leslie([0.1, 2], [0.5]).tolist() == [[0.1, 2], [0.5, 0]]
    np.testing.assert_allclose(m.dft(5) @ B, np.fft.fft(B))


def test_columns_and_tall_tables(spark):
    df = spark.createDataFrame([(A.tolist(), B.tolist()), (None, B.tolist())], "a array<array<double>>, b array<double>")
    got = df.select(m.column(m.inv, F.col("a")).alias("i"), m.column(m.det, F.col("a"), kind="double").alias("d"), m.column(m.solve, F.col("a"), F.col("b"), kind="array<double>").alias("x")).collect()
    np.testing.assert_allclose(got[0].i, np.linalg.inv(A))
    assert got[0].d == pytest.approx(np.linalg.det(A)) and got[1].i is None
    np.testing.assert_allclose(got[0].x, np.linalg.solve(A, B))
    x = G.standard_normal((200, 3))
    y = x @ [1, 2, 3] + 4 + G.standard_normal(200)
    table = spark.createDataFrame(np.hstack([x, y[:, None]]).tolist(), "a double, b double, c double, y double")
    fit = m.least_squares(table, "y", "a", "b", "c")
    full = np.hstack([np.ones((200, 1)), x])
    np.testing.assert_allclose(fit["coefficients"], np.linalg.lstsq(full, y, rcond=None)[0])
    np.testing.assert_allclose(m.tall_svd(table, "a", "b", "c")[0], np.linalg.svd(x, compute_uv=False))
    np.testing.assert_allclose(np.abs(m.tall_r(table, "a", "b", "c")), np.abs(np.linalg.qr(x)[1]))
    np.testing.assert_allclose(m.principal_components(table, 2, "a", "b", "c")[0], np.linalg.eigvalsh(np.cov(x.T))[::-1][:2])


def test_signals(spark):
    x, k = G.standard_normal(40), G.standard_normal(7)
    for mode in ("full", "same", "valid"):
        np.testing.assert_allclose(s.convolve(x, k, mode), np.convolve(x, k, mode))
        np.testing.assert_allclose(s.fft_convolve(x, k, mode), np.convolve(x, k, mode), atol=1e-12)
    np.testing.assert_allclose(s.correlate(x, k, "valid"), np.correlate(x, k, "valid"))
    b, a = s.butter(2, 0.3)
    np.testing.assert_allclose(b, [0.13110644, 0.26221288, 0.13110644], atol=1e-7)
    np.testing.assert_allclose(a, [1, -0.74778918, 0.27221494], atol=1e-7)
    high, _ = s.butter(3, 0.4, "high")
    assert abs(high.sum()) < 1e-12
    y = s.lfilter(b, a, x)
    for n in range(2, 40):
        assert y[n] == pytest.approx(b @ x[n - 2 : n + 1][::-1] - a[1:] @ y[n - 2 : n][::-1])
    tone = np.sin(2 * np.pi * 10 * np.arange(1000) / 100)
    f, p = s.welch(tone, 100, 200)
    assert f[np.argmax(p)] == 10 and p.sum() * (f[1] - f[0]) == pytest.approx(0.5, rel=0.02)
    df = spark.createDataFrame([(x.tolist(),), (None,)], "x array<double>")
    got = df.select(s.column(s.fft, F.col("x"), parts=np.imag).alias("i")).collect()
    np.testing.assert_allclose(got[0].i, np.fft.fft(x).imag, atol=1e-12)
    rows = [(g, float(t), float(t * t)) for g in "ab" for t in (0, 0.5, 2, 3, 3.5, 4)] + [("c", 1.0, 1.0), ("d", 0.0, 1.0), ("d", 2.0, 3.0)]
    t = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.g: r.integral for r in s.simpson(t, "x", "y", "g").collect()}
    assert got["a"] == pytest.approx(64 / 3) and got["c"] == 0 and got["d"] == 4
    got = {r.g: r.integral for r in s.trapezoid(t, "x", "y", "g").collect()}
    assert got["b"] == pytest.approx(np.trapezoid([0, 0.25, 4, 9, 12.25, 16], [0, 0.5, 2, 3, 3.5, 4]))


def test_calculus(spark):
    assert c.quad(math.exp, 0, 1)[0] == pytest.approx(math.e - 1, abs=1e-10)
    assert c.quad(lambda x: math.exp(-x * x), -math.inf, math.inf)[0] == pytest.approx(math.sqrt(math.pi), abs=1e-8)
    assert c.quad(lambda x: 1 / (1 + x * x), 1, math.inf)[0] == pytest.approx(math.pi / 4, abs=1e-8)
    assert c.fixed_quad(lambda x: x**9, 0, 1) == pytest.approx(0.1)
    assert c.romberg(math.sin, 0, math.pi) == pytest.approx(2)
    assert c.dblquad(lambda y, x: x * y, 0, 1, lambda x: 0, lambda x: x)[0] == pytest.approx(1 / 8)
    assert c.tplquad(lambda z, y, x: 1.0, 0, 1, lambda x: 0, lambda x: x, lambda x, y: 0, lambda x, y: y)[0] == pytest.approx(1 / 6)
    np.testing.assert_allclose(c.odeint(lambda y, t: [y[1], -y[0]], [0, 1], [0, 1, 3])[:, 0], np.sin([0, 1, 3]), atol=1e-6)
    t, y = c.solve_ivp(lambda t, y: -2 * y, (0, 2), [1])
    assert y[-1][0] == pytest.approx(math.exp(-4), rel=1e-6) and t[-1] == 2
    x = np.linspace(0, 3, 13)
    spline = c.CubicSpline(x, np.sin(x))
    np.testing.assert_allclose(spline(x), np.sin(x))
    np.testing.assert_allclose(spline([1.1, 1.9]), np.sin([1.1, 1.9]), atol=1e-3)
    line = c.BSpline([0, 0, 1, 2, 2], [0, 1, 4], 1)
    np.testing.assert_allclose(line([0, 0.5, 1.5, 2]), [0, 0.5, 2.5, 4])
    assert c.BSpline([0, 0, 0, 0, 1, 1, 1, 1], [1, 1, 1, 1])(0.3)[0] == pytest.approx(1)
    at = G.standard_normal((20, 2))
    rbf = c.RBFInterpolator(at, at[:, 0] * 2 + at[:, 1])
    np.testing.assert_allclose(rbf([[0.1, 0.2]]), [0.4], atol=1e-6)
    f = c.Interp1D([0, 1, 3], [0, 10, 30], "previous")
    assert f([0.5, 1, 2.9]).tolist() == [0, 10, 10]
    assert c.Interp1D([0, 1, 3], [0, 10, 30], "nearest")([0.4, 0.6, 2.1]).tolist() == [0, 10, 30]
    df = spark.createDataFrame([(0.5,), (None,)], "x double").select(c.interpolate(c.Interp1D([0, 1], [0, 2]), F.col("x")).alias("y"))
    assert [r.y for r in df.collect()] == [1.0, None]
