"""Special functions, vectorised over NumPy arrays: gamma, beta, error and Bessel families."""

from __future__ import annotations

import math

import numpy as np

gammaln = np.vectorize(math.lgamma, otypes=[float])
gamma = np.vectorize(math.gamma, otypes=[float])
erf = np.vectorize(math.erf, otypes=[float])
erfc = np.vectorize(math.erfc, otypes=[float])


def betaln(a, b):
    return gammaln(a) + gammaln(b) - gammaln(np.add(a, b))


def beta(a, b):
    return np.exp(betaln(a, b))


def digamma(x):
    """Recurrence up to 10, then the asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(10):
        small = x < 10
        out = np.where(small, out - 1 / np.where(small, x, 1), out)
        x = np.where(small, x + 1, x)
    r = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


psi = digamma


def polygamma(n: int, x):
    """n = 0 is digamma; above, (-1)^(n+1) n! times the Hurwitz zeta function of n + 1."""
    return digamma(x) if n == 0 else (-1) ** (n + 1) * math.factorial(n) * hurwitz(n + 1.0, x)


def hurwitz(s: float, a):
    """Sum of (a + k)^-s by Euler-Maclaurin."""
    a = np.array(a, float)
    n = 12
    total = sum((a + k) ** -s for k in range(n))
    x = a + n
    total = total + x ** (1 - s) / (s - 1) + 0.5 * x**-s
    term = s * x ** (-s - 1)
    for k, b in enumerate((1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730), 1):
        total = total + b / math.factorial(2 * k) * term
        term = term * (s + 2 * k - 1) * (s + 2 * k) / (x * x)
    return total


def zeta(s: float) -> float:
    return float(hurwitz(s, 1.0))


def gammainc(a, x):
    """Regularised lower incomplete gamma function."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.zeros(a.shape)
    series = (x > 0) & (x < a + 1)
    term = np.where(series, 1 / a, 0.0)
    total, k = term.copy(), 0
    while np.any(np.abs(term) > 1e-17 * np.abs(total)) and k < 2000:
        k += 1
        term = term * x / (a + k)
        total = total + term
    front = np.exp(np.where(x > 0, -x + a * np.log(np.where(x > 0, x, 1)) - gammaln(a), -np.inf))
    out = np.where(series, total * front, out)
    far = x >= a + 1
    b = np.where(far, x + 1 - a, 1.0)
    c, d = np.full(a.shape, 1e300), 1 / b
    h = d.copy()
    for i in range(1, 2000):  # Lentz's continued fraction of the upper function
        an = -i * (i - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        c = b + an / c
        c = np.where(np.abs(c) < 1e-300, 1e-300, c)
        step = d * c
        h = np.where(far, h * step, h)
        if np.all(~far | (np.abs(step - 1) < 1e-16)):
            break
    with np.errstate(invalid="ignore", over="ignore"):
        return np.where(far, np.where(np.isinf(x), 1.0, 1 - front * h), out)


def betainc(a, b, x):
    """Regularised incomplete beta function, by the continued fraction on the side where it converges fast."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    inside = (y > 0) & (y < 1)
    z = np.where(inside, y, 0.5)
    front = np.exp(p * np.log(z) + q * np.log1p(-z) - betaln(p, q)) / p
    tiny = 1e-300
    c, d = np.ones(a.shape), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 500):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-16):
            break
    value = np.where(inside, front * h, np.where(y <= 0, 0.0, 1.0))
    return np.where(flip, 1 - value, value)


def erfinv(y):
    """From a rational start, two Newton steps."""
    y = np.asarray(y, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        ln = np.log1p(-y * y)
        t = 2 / (math.pi * 0.147) + ln / 2
        x = np.sign(y) * np.sqrt(np.sqrt(t * t - ln / 0.147) - t)
        for _ in range(3):
            x = np.where(np.abs(y) < 1, x - (erf(x) - y) / (2 / math.sqrt(math.pi) * np.exp(-x * x)), x)
    return np.where(np.abs(y) < 1, x, np.where(np.abs(y) == 1, np.sign(y) * np.inf, np.nan))


def _bessel_integral(f, n=400):
    t = (np.arange(n) + 0.5) * math.pi / n
    return f(t).mean(-1)


def bessel_j(order: int, x):
    """J of an integer order by the midpoint rule, which converges geometrically here."""
    x = np.asarray(x, float)[..., None]
    return _bessel_integral(lambda t: np.cos(order * t - x * np.sin(t)))


def bessel_i(order: int, x):
    x = np.asarray(x, float)[..., None]
    return _bessel_integral(lambda t: np.exp(x * np.cos(t)) * np.cos(order * t))


def i0(x):
    return bessel_i(0, x)


def i1(x):
    return bessel_i(1, x)


def bessel_k(order: float, x):
    """K by the trapezoid rule over cosh."""
    x = np.asarray(x, float)[..., None]
    t = np.linspace(0, 12, 2401)
    y = np.exp(-x * np.cosh(t)) * np.cosh(order * t)
    return np.trapezoid(y, t, axis=-1)


def comb(n: int, k: int) -> float:
    return float(math.comb(n, k)) if 0 <= k <= n else 0.0


def factorial(n: int) -> float:
    return float(math.factorial(n))
