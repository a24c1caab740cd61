"""Option prices as Column expressions, lattice and simulated prices, processes, portfolios."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.distributions import Normal

_N = Normal(0.0, 1.0)


def normal_cdf(c: Column) -> Column:
    """Gaussian distribution function in the JVM, by the 7.1.26 rational form of erf (error below 1.5e-7)."""
    x = F.abs(c) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return F.when(c >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def _d(s: Column, k: Column, t: Column, r: Column, v: Column) -> tuple[Column, Column]:
    d1 = (F.ln(s / k) + (r + v * v / 2) * t) / (v * F.sqrt(t))
    return d1, d1 - v * F.sqrt(t)


def black_scholes(s: Column, k: Column, t: Column, r: Column, v: Column, call: bool = True) -> Column:
    d1, d2 = _d(s, k, t, r, v)
    if call:
        return s * normal_cdf(d1) - k * F.exp(-r * t) * normal_cdf(d2)
    return k * F.exp(-r * t) * normal_cdf(-d2) - s * normal_cdf(-d1)


def greeks(s: Column, k: Column, t: Column, r: Column, v: Column) -> dict[str, Column]:
    """Of a call: delta, gamma, vega, theta, rho."""
    d1, d2 = _d(s, k, t, r, v)
    density = F.exp(-d1 * d1 / 2) / math.sqrt(2 * math.pi)
    return {
        "delta": normal_cdf(d1), "gamma": density / (s * v * F.sqrt(t)), "vega": s * density * F.sqrt(t),
        "theta": -s * density * v / (2 * F.sqrt(t)) - r * k * F.exp(-r * t) * normal_cdf(d2), "rho": k * t * F.exp(-r * t) * normal_cdf(d2),
    }


def _price(s, k, t, r, v, call):
    d1 = (np.log(s / k) + (r + v * v / 2) * t) / (v * np.sqrt(t))
    d2 = d1 - v * np.sqrt(t)
    sign = 1 if call else -1
    return sign * (s * _N.cdf(sign * d1) - k * np.exp(-r * t) * _N.cdf(sign * d2))


def implied_volatility(price: Column, s: Column, k: Column, t: Column, r: Column, call: bool = True) -> Column:
    """Volatility by bisection over whole batches; null where no volatility below 10 gives the price."""

    @F.pandas_udf("double")
    def solve(p: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, e: pd.Series) -> pd.Series:
        p, a, b, c, e = (x.to_numpy(float) for x in (p, a, b, c, e))
        low, high = np.full(len(p), 1e-6), np.full(len(p), 10.0)
        bad = (p < _price(a, b, c, e, low, call) - 1e-12) | (p > _price(a, b, c, e, high, call))
        for _ in range(80):
            mid = (low + high) / 2
            up = _price(a, b, c, e, mid, call) < p
            low, high = np.where(up, mid, low), np.where(up, high, mid)
        return pd.Series(np.where(bad, np.nan, high)).where(~pd.Series(bad), None)

    return solve(price, s, k, t, r)


def binomial_tree(s: float, k: float, t: float, r: float, v: float, n: int, call: bool = True, american: bool = False) -> float:
    u = math.exp(v * math.sqrt(t / n))
    p = (math.exp(r * t / n) - 1 / u) / (u - 1 / u)
    sign, keep = (1 if call else -1), math.exp(-r * t / n)
    prices = lambda m: s * u ** (np.arange(m, -m - 1, -2, dtype=float))
    value = np.maximum(sign * (prices(n) - k), 0)
    for m in range(n - 1, -1, -1):
        value = keep * (p * value[:-1] + (1 - p) * value[1:])
        if american:
            value = np.maximum(value, sign * (prices(m) - k))
    return float(value[0])


def brownian_paths(spark: SparkSession, t: float, steps: int, paths: int, seed: int, drift: float = 0.0, vol: float = 1.0, start: float | None = None) -> DataFrame:
    """(path, step, x): Brownian motion, geometric from ``start`` if there is one; paths are spread over the tasks."""

    def run(batches):
        for pdf in batches:
            for i in pdf["id"]:
                z = np.random.default_rng([seed, int(i)]).standard_normal(steps)
                h = t / steps
                inc = (drift - (vol * vol / 2 if start is not None else 0)) * h + vol * math.sqrt(h) * z
                x = np.concatenate([[0.0], np.cumsum(inc)])
                yield pd.DataFrame({"path": i, "step": np.arange(steps + 1), "x": x if start is None else start * np.exp(x)})

    return spark.range(paths).mapInPandas(run, "path long, step long, x double")


def monte_carlo_price(spark: SparkSession, s: float, k: float, t: float, r: float, v: float, paths: int, seed: int, call: bool = True) -> DataFrame:
    """Discounted mean pay-off and its standard error, JVM-side from seeded normals."""
    z = spark.range(paths).select(F.randn(seed).alias("z"))
    end = s * F.exp((r - v * v / 2) * t + v * math.sqrt(t) * F.col("z"))
    pay = F.greatest((end - k) if call else (k - end), F.lit(0.0)) * math.exp(-r * t)
    return z.select(pay.alias("p")).agg(F.avg("p").alias("price"), (F.stddev_samp("p") / F.sqrt(F.count("p"))).alias("error"))


def quadratic_variation(df: DataFrame, by: str, order: str, x: str) -> DataFrame:
    from pyspark.sql import Window

    step = F.col(x) - F.lag(x).over(Window.partitionBy(by).orderBy(order))
    return df.select(by, (step * step).alias("q")).groupBy(by).agg(F.sum("q").alias("quadratic_variation"))


def covariation(df: DataFrame, by: str, order: str, x: str, y: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(order)
    step = lambda c: F.col(c) - F.lag(c).over(w)
    return df.select(by, (step(x) * step(y)).alias("q")).groupBy(by).agg(F.sum("q").alias("covariation"))


def sde_paths(spark: SparkSession, drift, diffusion, start, t: float, steps: int, paths: int, seed: int, method: str = "euler", limit: int = 100_000_000) -> DataFrame:
    """(path, step, t, x: array) of dX = drift(x, t) dt + diffusion(x, t) dW, a system if ``start`` has several numbers.

    ``drift`` and ``diffusion`` take arrays (paths by variables) and return alike;
    each variable has its own noise. ``euler`` or, with the diffusion's own
    derivative by differences, ``milstein``. More than ``limit`` numbers are refused.
    """
    x0 = np.atleast_1d(np.asarray(start, float))
    if paths * (steps + 1) * len(x0) > limit:
        raise ValueError("more numbers than the limit")
    h = t / steps

    def run(batches):
        for pdf in batches:
            for a in range(0, len(pdf), 256):
                ids = pdf["id"].to_numpy()[a : a + 256]
                noise = np.stack([np.random.default_rng([seed, int(i)]).standard_normal((steps, len(x0))) for i in ids]) * math.sqrt(h)
                x = np.broadcast_to(x0, (len(ids), len(x0))).copy()
                out = [x]
                for k in range(steps):
                    b, w = np.asarray(diffusion(x, k * h), float), noise[:, k]
                    new = x + np.asarray(drift(x, k * h), float) * h + b * w
                    if method == "milstein":
                        e = 1e-5 * np.maximum(1.0, np.abs(x))
                        slope = (np.asarray(diffusion(x + e, k * h), float) - np.asarray(diffusion(x - e, k * h), float)) / (2 * e)
                        new = new + 0.5 * b * slope * (w * w - h)
                    x = new
                    out.append(x)
                cells = np.stack(out, 1)
                yield pd.DataFrame({"path": np.repeat(ids, steps + 1), "step": np.tile(np.arange(steps + 1), len(ids)), "t": np.tile(np.arange(steps + 1) * h, len(ids)), "x": list(cells.reshape(-1, len(x0)))})

    return spark.range(paths).mapInPandas(run, "path long, step long, t double, x array<double>")


def ornstein_uhlenbeck(spark: SparkSession, rate: float, mean: float, vol: float, start: float, t: float, steps: int, paths: int, seed: int) -> DataFrame:
    """(path, step, x) by the exact transition from step to step."""
    h = t / steps
    keep, spread = math.exp(-rate * h), vol * math.sqrt(-math.expm1(-2 * rate * h) / (2 * rate))

    def run(batches):
        for pdf in batches:
            for i in pdf["id"]:
                z = np.random.default_rng([seed, int(i)]).standard_normal(steps)
                x = np.empty(steps + 1)
                x[0] = start
                for k in range(steps):
                    x[k + 1] = mean + (x[k] - mean) * keep + spread * z[k]
                yield pd.DataFrame({"path": i, "step": np.arange(steps + 1), "x": x})

    return spark.range(paths).mapInPandas(run, "path long, step long, x double")


def brownian_bridge(spark: SparkSession, start: float, end: float, t: float, steps: int, paths: int, seed: int, vol: float = 1.0) -> DataFrame:
    """(path, step, x): Brownian motion pinned at both ends."""
    free = brownian_paths(spark, t, steps, paths, seed, 0.0, vol)
    last = free.filter(F.col("step") == steps).select("path", F.col("x").alias("_end"))
    at = F.col("step") / steps
    return free.join(last, "path").select("path", "step", (F.lit(float(start)) + F.col("x") + at * (F.lit(float(end - start)) - F.col("_end"))).alias("x"))


def efficient_frontier(returns, cov, points: int) -> list[tuple[float, float, np.ndarray]]:
    """(return, risk, weights) from the least to the largest single return."""
    m, c = np.asarray(returns, float), np.asarray(cov, float)
    out = []
    for target in np.linspace(m.min(), m.max(), points):
        w = target_return(m, c, float(target))
        out.append((float(target), float(np.sqrt(w @ c @ w)), w))
    return out


def portfolio(weights, returns, cov, risk_free: float = 0.0, confidence: float = 0.95) -> dict[str, float]:
    """Return, risk, Sharpe ratio, Gaussian value at risk and expected shortfall."""
    w, m, c = np.asarray(weights, float), np.asarray(returns, float), np.asarray(cov, float)
    mean, risk = float(w @ m), float(np.sqrt(w @ c @ w))
    z = float(_N.ppf(confidence))
    return {
        "return": mean, "risk": risk, "sharpe": (mean - risk_free) / risk if risk > 1e-15 else 0.0,
        "var": z * risk - mean, "cvar": float(_N.pdf(z)) / (1 - confidence) * risk - mean,
    }


def min_variance(cov) -> np.ndarray:
    x = np.linalg.solve(np.asarray(cov, float), np.ones(len(cov)))
    return x / x.sum()


def max_sharpe(returns, cov, risk_free: float = 0.0) -> np.ndarray:
    x = np.linalg.solve(np.asarray(cov, float), np.asarray(returns, float) - risk_free)
    return x / x.sum()


def target_return(returns, cov, target: float) -> np.ndarray:
    """Least variance with a given return, by the Lagrange system."""
    m, c = np.asarray(returns, float), np.asarray(cov, float)
    n = len(m)
    a = np.block([[c, m[:, None], np.ones((n, 1))], [m[None], np.zeros((1, 2))], [np.ones((1, n)), np.zeros((1, 2))]])
    return np.linalg.solve(a, np.concatenate([np.zeros(n), [target, 1.0]]))[:n]
