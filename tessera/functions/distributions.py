"""Probability distributions: pdf or pmf, cdf, quantile, log density, mean and variance, vectorised over arrays.

:func:`column` lifts any of them to a DataFrame column through an Arrow batch.
Distributions without a closed quantile find it by bisection of the cdf.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import special as sp


class Distribution:
    """Base: subclasses give ``pdf`` and ``cdf`` (or a numeric cdf), ``mean`` and ``var``."""

    low, high = -np.inf, np.inf
    discrete = False

    def logpdf(self, x):
        with np.errstate(divide="ignore"):
            return np.log(self.pdf(x))

    def sf(self, x):
        return 1 - self.cdf(x)

    def cdf(self, x):
        """Numeric integral of the density by panels of Gauss-Legendre nodes."""
        x = np.asarray(x, float)
        start = self.low if np.isfinite(self.low) else self.mean() - 40 * math.sqrt(self.var())
        node, weight = np.polynomial.legendre.leggauss(40)
        end = np.clip(x, start, self.high)[..., None, None]
        edge = start + (end - start) * np.linspace(0, 1, 33)[:-1][:, None]
        half = (end - start) / 64
        return np.clip((self.pdf(edge + half * (node + 1)) * weight * half).sum((-1, -2)), 0, 1)

    def ppf(self, p):
        """The smallest x with cdf at least p."""
        p = np.asarray(p, float)
        low = np.full(p.shape, self.low if np.isfinite(self.low) else -1.0)
        high = np.full(p.shape, self.high if np.isfinite(self.high) else 1.0)
        for _ in range(200):
            grow = (self.cdf(high) < p) & ~np.isfinite(self.high)
            high = np.where(grow, high * 2 + 1, high)
            fall = (self.cdf(low) > p) & ~np.isfinite(self.low)
            low = np.where(fall, low * 2 - 1, low)
            if not (grow | fall).any():
                break
        for _ in range(200):
            mid = np.floor((low + high) / 2) if self.discrete else (low + high) / 2
            up = self.cdf(mid) < p
            low, high = np.where(up, mid + 1 if self.discrete else mid, low), np.where(up, high, mid)
        with np.errstate(invalid="ignore"):
            return np.where(p <= 0, self.low, np.where(p >= 1, self.high, high))

    def sample(self, n: int, seed: int) -> np.ndarray:
        return self.ppf(np.random.default_rng(seed).random(n))


def _make(name: str, doc: str, args: str, **parts) -> type[Distribution]:
    """A class from expressions over its parameters; ``x`` or ``p`` is the argument."""
    names = args.split()

    def init(self, *values, **named):
        for k, v in [*zip(names, values, strict=False), *named.items()]:
            setattr(self, k, v)
        self.low, self.high = (parts.get(k, lambda s, d=d: d)(self) for k, d in (("low", -np.inf), ("high", np.inf)))

    body = {"__init__": init, "__doc__": doc, "discrete": parts.get("discrete", False)}
    for k in ("pdf", "cdf", "ppf", "logpdf"):
        if k in parts:
            def method(self, x, f=parts[k]):
                with np.errstate(all="ignore"):
                    return f(self, np.asarray(x, float))
            body[k] = method
    for k in ("mean", "var"):
        body[k] = parts[k]
    return type(name, (Distribution,), body)


def _phi(z):
    return np.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def _Phi(z):
    return 0.5 * sp.erfc(-np.asarray(z) / math.sqrt(2))


def _Phinv(p):
    return math.sqrt(2) * sp.erfinv(2 * np.asarray(p) - 1)


G = math.gamma
zero = lambda s: 0.0

Normal = _make("Normal", "Gaussian.", "mu sigma", pdf=lambda s, x: _phi((x - s.mu) / s.sigma) / s.sigma, cdf=lambda s, x: _Phi((x - s.mu) / s.sigma), ppf=lambda s, p: s.mu + s.sigma * _Phinv(p), mean=lambda s: s.mu, var=lambda s: s.sigma**2)
ChiSquared = _make("ChiSquared", "Chi-square.", "df", low=zero, pdf=lambda s, x: np.where(x > 0, np.exp((s.df / 2 - 1) * np.log(np.maximum(x, 1e-300)) - x / 2 - s.df / 2 * math.log(2) - math.lgamma(s.df / 2)), 0), cdf=lambda s, x: sp.gammainc(s.df / 2, np.maximum(x, 0) / 2), mean=lambda s: s.df, var=lambda s: 2 * s.df)
StudentT = _make("StudentT", "Student's t.", "df", pdf=lambda s, x: np.exp(math.lgamma((s.df + 1) / 2) - math.lgamma(s.df / 2)) / math.sqrt(s.df * math.pi) * (1 + x * x / s.df) ** (-(s.df + 1) / 2), cdf=lambda s, x: np.where(x >= 0, 1 - 0.5 * sp.betainc(s.df / 2, 0.5, s.df / (s.df + x * x)), 0.5 * sp.betainc(s.df / 2, 0.5, s.df / (s.df + x * x))), mean=lambda s: 0.0 if s.df > 1 else math.nan, var=lambda s: s.df / (s.df - 2) if s.df > 2 else math.inf)
FDist = _make("FDist", "F.", "df1 df2", low=zero, pdf=lambda s, x: np.where(x > 0, np.exp(s.df1 / 2 * math.log(s.df1 / s.df2) + (s.df1 / 2 - 1) * np.log(np.maximum(x, 1e-300)) - (s.df1 + s.df2) / 2 * np.log1p(s.df1 * np.maximum(x, 0) / s.df2) - sp.betaln(s.df1 / 2, s.df2 / 2)), 0), cdf=lambda s, x: sp.betainc(s.df1 / 2, s.df2 / 2, s.df1 * np.maximum(x, 0) / (s.df1 * np.maximum(x, 0) + s.df2)), mean=lambda s: s.df2 / (s.df2 - 2) if s.df2 > 2 else math.inf, var=lambda s: 2 * s.df2**2 * (s.df1 + s.df2 - 2) / (s.df1 * (s.df2 - 2) ** 2 * (s.df2 - 4)) if s.df2 > 4 else math.inf)
Lognormal = _make("Lognormal", "exp of a Gaussian.", "mu sigma", low=zero, pdf=lambda s, x: np.where(x > 0, _phi((np.log(x) - s.mu) / s.sigma) / (x * s.sigma), 0), cdf=lambda s, x: np.where(x > 0, _Phi((np.log(np.maximum(x, 1e-300)) - s.mu) / s.sigma), 0), ppf=lambda s, p: np.exp(s.mu + s.sigma * _Phinv(p)), mean=lambda s: math.exp(s.mu + s.sigma**2 / 2), var=lambda s: math.expm1(s.sigma**2) * math.exp(2 * s.mu + s.sigma**2))
Weibull = _make("Weibull", "Weibull.", "shape scale", low=zero, pdf=lambda s, x: np.where(x >= 0, s.shape / s.scale * (x / s.scale) ** (s.shape - 1) * np.exp(-((x / s.scale) ** s.shape)), 0), cdf=lambda s, x: np.where(x > 0, -np.expm1(-((np.maximum(x, 0) / s.scale) ** s.shape)), 0), ppf=lambda s, p: s.scale * (-np.log1p(-p)) ** (1 / s.shape), mean=lambda s: s.scale * G(1 + 1 / s.shape), var=lambda s: s.scale**2 * (G(1 + 2 / s.shape) - G(1 + 1 / s.shape) ** 2))
Pareto = _make("Pareto", "Pareto with minimum xm.", "alpha xm", low=lambda s: s.xm, pdf=lambda s, x: np.where(x >= s.xm, s.alpha * s.xm**s.alpha / x ** (s.alpha + 1), 0), cdf=lambda s, x: np.where(x >= s.xm, 1 - (s.xm / np.maximum(x, s.xm)) ** s.alpha, 0), ppf=lambda s, p: s.xm * (1 - p) ** (-1 / s.alpha), mean=lambda s: s.alpha * s.xm / (s.alpha - 1) if s.alpha > 1 else math.inf, var=lambda s: s.xm**2 * s.alpha / ((s.alpha - 1) ** 2 * (s.alpha - 2)) if s.alpha > 2 else math.inf)
Cauchy = _make("Cauchy", "Cauchy.", "loc scale", pdf=lambda s, x: 1 / (math.pi * s.scale * (1 + ((x - s.loc) / s.scale) ** 2)), cdf=lambda s, x: 0.5 + np.arctan((x - s.loc) / s.scale) / math.pi, ppf=lambda s, p: s.loc + s.scale * np.tan(math.pi * (p - 0.5)), mean=lambda s: math.nan, var=lambda s: math.nan)
Laplace = _make("Laplace", "Laplace.", "loc scale", pdf=lambda s, x: np.exp(-np.abs(x - s.loc) / s.scale) / (2 * s.scale), cdf=lambda s, x: np.where(x < s.loc, 0.5 * np.exp((x - s.loc) / s.scale), 1 - 0.5 * np.exp(-(x - s.loc) / s.scale)), ppf=lambda s, p: np.where(p < 0.5, s.loc + s.scale * np.log(2 * p), s.loc - s.scale * np.log(2 - 2 * p)), mean=lambda s: s.loc, var=lambda s: 2 * s.scale**2)
Logistic = _make("Logistic", "Logistic.", "loc scale", pdf=lambda s, x: np.exp(-np.abs(x - s.loc) / s.scale) / (s.scale * (1 + np.exp(-np.abs(x - s.loc) / s.scale)) ** 2), cdf=lambda s, x: 1 / (1 + np.exp(-(x - s.loc) / s.scale)), ppf=lambda s, p: s.loc + s.scale * np.log(p / (1 - p)), mean=lambda s: s.loc, var=lambda s: s.scale**2 * math.pi**2 / 3)
Gumbel = _make("Gumbel", "Largest extreme value.", "loc scale", pdf=lambda s, x: np.exp(-(x - s.loc) / s.scale - np.exp(-(x - s.loc) / s.scale)) / s.scale, cdf=lambda s, x: np.exp(-np.exp(-(x - s.loc) / s.scale)), ppf=lambda s, p: s.loc - s.scale * np.log(-np.log(p)), mean=lambda s: s.loc + 0.5772156649015329 * s.scale, var=lambda s: math.pi**2 / 6 * s.scale**2)
Rayleigh = _make("Rayleigh", "Rayleigh.", "sigma", low=zero, pdf=lambda s, x: np.where(x >= 0, x / s.sigma**2 * np.exp(-x * x / (2 * s.sigma**2)), 0), cdf=lambda s, x: np.where(x > 0, -np.expm1(-x * x / (2 * s.sigma**2)), 0), ppf=lambda s, p: s.sigma * np.sqrt(-2 * np.log1p(-p)), mean=lambda s: s.sigma * math.sqrt(math.pi / 2), var=lambda s: (2 - math.pi / 2) * s.sigma**2)
Rice = _make("Rice", "Rice.", "nu sigma", low=zero, pdf=lambda s, x: np.where(x > 0, x / s.sigma**2 * np.exp(-((x - s.nu) ** 2) / (2 * s.sigma**2)) * sp.i0(x * s.nu / s.sigma**2) * np.exp(-x * s.nu / s.sigma**2), 0), mean=lambda s: s.sigma * math.sqrt(math.pi / 2) * float(np.exp(-s.nu**2 / (4 * s.sigma**2)) * ((1 + s.nu**2 / (2 * s.sigma**2)) * sp.i0(s.nu**2 / (4 * s.sigma**2)) + s.nu**2 / (2 * s.sigma**2) * sp.i1(s.nu**2 / (4 * s.sigma**2)))), var=lambda s: 2 * s.sigma**2 + s.nu**2 - Rice.mean(s) ** 2)
Nakagami = _make("Nakagami", "Nakagami.", "m omega", low=zero, pdf=lambda s, x: np.where(x > 0, 2 * (s.m / s.omega) ** s.m / G(s.m) * x ** (2 * s.m - 1) * np.exp(-s.m * x * x / s.omega), 0), cdf=lambda s, x: sp.gammainc(s.m, s.m * np.maximum(x, 0) ** 2 / s.omega), mean=lambda s: G(s.m + 0.5) / G(s.m) * math.sqrt(s.omega / s.m), var=lambda s: s.omega * (1 - (G(s.m + 0.5) / G(s.m)) ** 2 / s.m))
VonMises = _make("VonMises", "Circular normal about mu.", "mu kappa", low=lambda s: s.mu - math.pi, high=lambda s: s.mu + math.pi, pdf=lambda s, x: np.exp(s.kappa * np.cos(x - s.mu)) / (2 * math.pi * sp.i0(s.kappa)), mean=lambda s: s.mu, var=lambda s: 1 - float(sp.i1(s.kappa) / sp.i0(s.kappa)))
HalfNormal = _make("HalfNormal", "Absolute value of a centred Gaussian.", "sigma", low=zero, pdf=lambda s, x: np.where(x >= 0, 2 * _phi(x / s.sigma) / s.sigma, 0), cdf=lambda s, x: np.where(x > 0, sp.erf(x / (s.sigma * math.sqrt(2))), 0), ppf=lambda s, p: s.sigma * math.sqrt(2) * sp.erfinv(p), mean=lambda s: s.sigma * math.sqrt(2 / math.pi), var=lambda s: s.sigma**2 * (1 - 2 / math.pi))
TruncatedNormal = _make("TruncatedNormal", "Gaussian between a and b.", "mu sigma a b", low=lambda s: s.a, high=lambda s: s.b, pdf=lambda s, x: np.where((x >= s.a) & (x <= s.b), _phi((x - s.mu) / s.sigma) / s.sigma / _tn(s)[2], 0), cdf=lambda s, x: np.clip((_Phi((x - s.mu) / s.sigma) - _Phi(_tn(s)[0])) / _tn(s)[2], 0, 1), ppf=lambda s, p: s.mu + s.sigma * _Phinv(_Phi(_tn(s)[0]) + p * _tn(s)[2]), mean=lambda s: s.mu + s.sigma * _tn(s)[3], var=lambda s: s.sigma**2 * (1 + (_tn(s)[0] * _phi(_tn(s)[0]) - _tn(s)[1] * _phi(_tn(s)[1])) / _tn(s)[2] - _tn(s)[3] ** 2))
InverseGaussian = _make("InverseGaussian", "Wald.", "mu lam", low=zero, pdf=lambda s, x: np.where(x > 0, np.sqrt(s.lam / (2 * math.pi * x**3)) * np.exp(-s.lam * (x - s.mu) ** 2 / (2 * s.mu**2 * x)), 0), cdf=lambda s, x: np.where(x > 0, _Phi(np.sqrt(s.lam / x) * (x / s.mu - 1)) + np.exp(2 * s.lam / s.mu) * _Phi(-np.sqrt(s.lam / x) * (x / s.mu + 1)), 0), mean=lambda s: s.mu, var=lambda s: s.mu**3 / s.lam)
GeneralizedExtremeValue = _make("GeneralizedExtremeValue", "Extreme value with shape xi (not 0).", "mu sigma xi", low=lambda s: s.mu - s.sigma / s.xi if s.xi > 0 else -np.inf, high=lambda s: s.mu - s.sigma / s.xi if s.xi < 0 else np.inf, pdf=lambda s, x: np.where(1 + s.xi * (x - s.mu) / s.sigma > 0, _gev(s, x) ** (s.xi + 1) * np.exp(-_gev(s, x)) / s.sigma, 0), cdf=lambda s, x: np.where(1 + s.xi * (x - s.mu) / s.sigma > 0, np.exp(-_gev(s, x)), float(s.xi < 0)), ppf=lambda s, p: s.mu + s.sigma * ((-np.log(p)) ** -s.xi - 1) / s.xi, mean=lambda s: s.mu + s.sigma * (G(1 - s.xi) - 1) / s.xi if s.xi < 1 else math.inf, var=lambda s: s.sigma**2 * (G(1 - 2 * s.xi) - G(1 - s.xi) ** 2) / s.xi**2 if s.xi < 0.5 else math.inf)
Levy = _make("Levy", "One-sided stable of index 1/2.", "loc scale", low=lambda s: s.loc, pdf=lambda s, x: np.where(x > s.loc, np.sqrt(s.scale / (2 * math.pi)) * np.exp(-s.scale / (2 * (x - s.loc))) / (x - s.loc) ** 1.5, 0), cdf=lambda s, x: np.where(x > s.loc, sp.erfc(np.sqrt(s.scale / (2 * np.maximum(x - s.loc, 1e-300)))), 0), ppf=lambda s, p: s.loc + s.scale / _Phinv(1 - np.asarray(p) / 2) ** 2, mean=lambda s: math.inf, var=lambda s: math.inf)
Beta = _make("Beta", "Beta on (0, 1).", "a b", low=zero, high=lambda s: 1.0, pdf=lambda s, x: np.where((x > 0) & (x < 1), np.exp((s.a - 1) * np.log(x) + (s.b - 1) * np.log1p(-x) - sp.betaln(s.a, s.b)), 0), cdf=lambda s, x: sp.betainc(s.a, s.b, np.clip(x, 0, 1)), mean=lambda s: s.a / (s.a + s.b), var=lambda s: s.a * s.b / ((s.a + s.b) ** 2 * (s.a + s.b + 1)))
Gamma = _make("Gamma", "Gamma by shape and scale.", "shape scale", low=zero, pdf=lambda s, x: np.where(x > 0, np.exp((s.shape - 1) * np.log(x) - x / s.scale - s.shape * math.log(s.scale) - math.lgamma(s.shape)), 0), cdf=lambda s, x: sp.gammainc(s.shape, np.maximum(x, 0) / s.scale), mean=lambda s: s.shape * s.scale, var=lambda s: s.shape * s.scale**2)
Exponential = _make("Exponential", "Exponential by rate.", "rate", low=zero, pdf=lambda s, x: np.where(x >= 0, s.rate * np.exp(-s.rate * x), 0), cdf=lambda s, x: np.where(x > 0, -np.expm1(-s.rate * x), 0), ppf=lambda s, p: -np.log1p(-p) / s.rate, mean=lambda s: 1 / s.rate, var=lambda s: 1 / s.rate**2)
Uniform = _make("Uniform", "Uniform between a and b.", "a b", low=lambda s: s.a, high=lambda s: s.b, pdf=lambda s, x: np.where((x >= s.a) & (x <= s.b), 1 / (s.b - s.a), 0), cdf=lambda s, x: np.clip((x - s.a) / (s.b - s.a), 0, 1), ppf=lambda s, p: s.a + p * (s.b - s.a), mean=lambda s: (s.a + s.b) / 2, var=lambda s: (s.b - s.a) ** 2 / 12)
Triangular = _make("Triangular", "Triangular with mode c.", "a b c", low=lambda s: s.a, high=lambda s: s.b, pdf=lambda s, x: np.where((x < s.a) | (x > s.b), 0, np.where(x < s.c, 2 * (x - s.a) / ((s.b - s.a) * (s.c - s.a)), 2 * (s.b - x) / ((s.b - s.a) * (s.b - s.c)))), cdf=lambda s, x: np.where(x <= s.a, 0, np.where(x < s.c, (x - s.a) ** 2 / ((s.b - s.a) * (s.c - s.a)), np.where(x < s.b, 1 - (s.b - x) ** 2 / ((s.b - s.a) * (s.b - s.c)), 1))), mean=lambda s: (s.a + s.b + s.c) / 3, var=lambda s: (s.a**2 + s.b**2 + s.c**2 - s.a * s.b - s.a * s.c - s.b * s.c) / 18)
Poisson = _make("Poisson", "Poisson.", "lam", low=zero, discrete=True, pdf=lambda s, x: np.where(x >= 0, np.exp(x * math.log(s.lam) - s.lam - sp.gammaln(x + 1)), 0), cdf=lambda s, x: np.where(x >= 0, 1 - sp.gammainc(np.floor(np.maximum(x, 0)) + 1, s.lam), 0), mean=lambda s: s.lam, var=lambda s: s.lam)
Binomial = _make("Binomial", "Binomial.", "n p", low=zero, high=lambda s: float(s.n), discrete=True, pdf=lambda s, x: np.where((x >= 0) & (x <= s.n), np.exp(sp.gammaln(s.n + 1.0) - sp.gammaln(np.clip(x, 0, s.n) + 1) - sp.gammaln(s.n - np.clip(x, 0, s.n) + 1) + x * math.log(s.p) + (s.n - x) * math.log1p(-s.p)), 0), cdf=lambda s, x: np.where(x < 0, 0, np.where(x >= s.n, 1, sp.betainc(np.maximum(s.n - np.floor(np.clip(x, 0, s.n)), 1e-9), np.floor(np.clip(x, 0, s.n)) + 1, 1 - s.p))), mean=lambda s: s.n * s.p, var=lambda s: s.n * s.p * (1 - s.p))
NegativeBinomial = _make("NegativeBinomial", "Failures before the r-th success.", "r p", low=zero, discrete=True, pdf=lambda s, x: np.where(x >= 0, np.exp(sp.gammaln(np.maximum(x, 0) + s.r) - sp.gammaln(np.maximum(x, 0) + 1) - math.lgamma(s.r) + s.r * math.log(s.p) + x * math.log1p(-s.p)), 0), cdf=lambda s, x: np.where(x >= 0, sp.betainc(s.r, np.floor(np.maximum(x, 0)) + 1, s.p), 0), mean=lambda s: s.r * (1 - s.p) / s.p, var=lambda s: s.r * (1 - s.p) / s.p**2)
Geometric = _make("Geometric", "Trials to the first success.", "p", low=lambda s: 1.0, discrete=True, pdf=lambda s, x: np.where(x >= 1, s.p * (1 - s.p) ** (x - 1), 0), cdf=lambda s, x: np.where(x >= 1, 1 - (1 - s.p) ** np.floor(x), 0), mean=lambda s: 1 / s.p, var=lambda s: (1 - s.p) / s.p**2)
Bernoulli = _make("Bernoulli", "One trial.", "p", low=zero, high=lambda s: 1.0, discrete=True, pdf=lambda s, x: np.where(x == 1, s.p, np.where(x == 0, 1 - s.p, 0)), cdf=lambda s, x: np.where(x < 0, 0, np.where(x < 1, 1 - s.p, 1)), mean=lambda s: s.p, var=lambda s: s.p * (1 - s.p))


SkewNormal = _make("SkewNormal", "Gaussian, skewed by alpha.", "loc scale alpha", pdf=lambda s, x: 2 * _phi((x - s.loc) / s.scale) * _Phi(s.alpha * (x - s.loc) / s.scale) / s.scale, mean=lambda s: s.loc + s.scale * s.alpha / math.sqrt(1 + s.alpha**2) * math.sqrt(2 / math.pi), var=lambda s: s.scale**2 * (1 - 2 * s.alpha**2 / (1 + s.alpha**2) / math.pi))
PowerLaw = _make("PowerLaw", "Density x ** -alpha from xmin on.", "alpha xmin", low=lambda s: s.xmin, pdf=lambda s, x: np.where(x >= s.xmin, (s.alpha - 1) / s.xmin * (x / s.xmin) ** -s.alpha, 0), cdf=lambda s, x: np.where(x >= s.xmin, 1 - (s.xmin / np.maximum(x, s.xmin)) ** (s.alpha - 1), 0), ppf=lambda s, p: s.xmin * (1 - p) ** (-1 / (s.alpha - 1)), mean=lambda s: s.xmin * (s.alpha - 1) / (s.alpha - 2) if s.alpha > 2 else math.inf, var=lambda s: s.xmin**2 * ((s.alpha - 1) / (s.alpha - 3) - ((s.alpha - 1) / (s.alpha - 2)) ** 2) if s.alpha > 3 else math.inf)


class Finite(Distribution):
    """A distribution on 0..n-1 (or from ``start``) by its probabilities."""

    discrete = True

    def __init__(self, p, start: int = 0):
        self.p, self.start = np.asarray(p, float), start
        self.low, self.high = float(start), float(start + len(self.p) - 1)

    def pdf(self, x):
        k = np.asarray(x, float) - self.start
        inside = (k >= 0) & (k < len(self.p)) & (k == np.floor(k))
        return np.where(inside, self.p[np.clip(k, 0, len(self.p) - 1).astype(int)], 0.0)

    def cdf(self, x):
        k = np.floor(np.asarray(x, float)) - self.start
        return np.where(k < 0, 0.0, np.cumsum(self.p)[np.clip(k, 0, len(self.p) - 1).astype(int)])

    def mean(self):
        return float((self.p * (np.arange(len(self.p)) + self.start)).sum())

    def var(self):
        k = np.arange(len(self.p)) + self.start
        return float((self.p * (k - self.mean()) ** 2).sum())


def Hypergeometric(N: int, K: int, n: int) -> Finite:
    """Successes in n draws from N with K successes."""
    return Finite([sp.comb(K, k) * sp.comb(N - K, n - k) / sp.comb(N, n) for k in range(n + 1)])


def Zipf(s: float, n: int) -> Finite:
    w = np.arange(1, n + 1, dtype=float) ** -s
    return Finite(w / w.sum(), 1)


def DiscreteUniform(a: int, b: int) -> Finite:
    return Finite(np.full(b - a + 1, 1 / (b - a + 1)), a)


def Boltzmann(lam: float, n: int) -> Finite:
    """Weights exp(-lam k) on 0 to n - 1."""
    w = np.exp(-lam * np.arange(n))
    return Finite(w / w.sum())


def _tn(s):
    a, b = (s.a - s.mu) / s.sigma, (s.b - s.mu) / s.sigma
    z = float(_Phi(b) - _Phi(a))
    return a, b, z, float((_phi(a) - _phi(b)) / z)


def _gev(s, x):
    return np.maximum(1 + s.xi * (x - s.mu) / s.sigma, 1e-300) ** (-1 / s.xi)


class MultivariateNormal:
    """Gaussian vector with mean and covariance."""

    def __init__(self, mean, cov):
        self.mean, self.cov = np.asarray(mean, float), np.asarray(cov, float)
        self.chol = np.linalg.cholesky(self.cov)

    def mahalanobis(self, x):
        z = np.linalg.solve(self.chol, (np.asarray(x, float) - self.mean).T)
        return np.sqrt((z**2).sum(0))

    def logpdf(self, x):
        return -0.5 * (self.mahalanobis(x) ** 2 + len(self.mean) * math.log(2 * math.pi)) - np.log(np.diag(self.chol)).sum()

    def pdf(self, x):
        return np.exp(self.logpdf(x))

    def sample(self, n: int, seed: int):
        return self.mean + np.random.default_rng(seed).standard_normal((n, len(self.mean))) @ self.chol.T

    def marginal(self, keep):
        return MultivariateNormal(self.mean[keep], self.cov[np.ix_(keep, keep)])

    def conditional(self, known: dict[int, float]):
        b = list(known)
        a = [i for i in range(len(self.mean)) if i not in known]
        k = np.linalg.solve(self.cov[np.ix_(b, b)], self.cov[np.ix_(b, a)]).T
        mean = self.mean[a] + k @ (np.array([known[i] for i in b]) - self.mean[b])
        return MultivariateNormal(mean, self.cov[np.ix_(a, a)] - k @ self.cov[np.ix_(b, a)])


class GaussianCopula:
    """Uniforms tied by a Gaussian correlation matrix."""

    def __init__(self, corr):
        self.corr = np.asarray(corr, float)

    def sample(self, n: int, seed: int):
        return _Phi(MultivariateNormal(np.zeros(len(self.corr)), self.corr).sample(n, seed))

    def pdf(self, u):
        z = _Phinv(np.asarray(u, float))
        inverse = np.linalg.inv(self.corr) - np.eye(len(self.corr))
        return np.exp(-0.5 * (z @ inverse * z).sum(-1)) / math.sqrt(np.linalg.det(self.corr))

    def columns(self, spark, n: int, seed: int):
        """(u0, u1, ...): n rows, drawn in the JVM."""
        chol = np.linalg.cholesky(self.corr)
        rows = spark.range(n).select(*[F.randn(seed + k).alias(f"z{k}") for k in range(len(chol))])
        mixed = [sum((F.lit(float(chol[i, k])) * F.col(f"z{k}") for k in range(i + 1)), F.lit(0.0)) for i in range(len(chol))]
        return rows.select(*[column(Normal(0, 1), "cdf", m).alias(f"u{i}") for i, m in enumerate(mixed)])


def column(d: Distribution, method: str, c: Column) -> Column:
    """``d.method`` of a column, batch by batch."""

    @F.pandas_udf("double")
    def apply(x: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(getattr(d, method)(x.to_numpy(float)), float))

    return apply(c.cast("double"))
