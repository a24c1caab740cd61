import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import finance as fi, learning as le


def test_options(spark):
    df = spark.createDataFrame([(100.0, 100.0, 1.0, 0.05, 0.2)], "s double, k double, t double, r double, v double")
    cols = [F.col(c) for c in "sktrv"]
    row = df.select(fi.black_scholes(*cols).alias("c"), fi.black_scholes(*cols, call=False).alias("p"), fi.greeks(*cols)["delta"].alias("d")).first()
    assert row.c == pytest.approx(10.4506, abs=1e-3) and row.p == pytest.approx(5.5735, abs=1e-3) and row.d == pytest.approx(0.6368, abs=1e-4)
    assert df.select(fi.implied_volatility(F.lit(10.450583572185565), *cols[:4]).alias("v")).first().v == pytest.approx(0.2, abs=1e-6)
    assert fi.binomial_tree(100, 100, 1, 0.05, 0.2, 500) == pytest.approx(10.45, abs=0.01)
    assert fi.binomial_tree(100, 100, 1, 0.05, 0.2, 200, call=False, american=True) > row.p
    mc = fi.monte_carlo_price(spark, 100, 100, 1, 0.05, 0.2, 200_000, 1).first()
    assert abs(mc.price - row.c) < 5 * mc.error
    paths = fi.brownian_paths(spark, 1.0, 200, 20, 3)
    assert fi.quadratic_variation(paths, "path", "step", "x").agg(F.avg("quadratic_variation")).first()[0] == pytest.approx(1, abs=0.1)


def test_portfolios():
    cov, m = np.array([[0.04, 0.01], [0.01, 0.09]]), np.array([0.05, 0.1])
    w = fi.target_return(m, cov, 0.08)
    assert w.sum() == pytest.approx(1) and w @ m == pytest.approx(0.08)
    assert fi.portfolio(fi.max_sharpe(m, cov), m, cov)["sharpe"] >= fi.portfolio(fi.min_variance(cov), m, cov)["sharpe"]


def test_losses_and_metrics(spark):
    r = np.random.default_rng(0)
    y, p = r.integers(0, 2, 300), r.random(300).round(2)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(p, y, strict=True)], "p double, y double")
    loss = df.agg(*[v.alias(k) for k, v in le.losses(F.col("p"), F.col("y")).items()]).first()
    assert loss.mse == pytest.approx(((p - y) ** 2).mean()) and loss.mae == pytest.approx(abs(p - y).mean())
    pairs = [(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]
    assert le.auc(df, "p", "y").first().auc == pytest.approx(np.mean(pairs))
    got = df.agg(*[v.alias(k) for k, v in le.binary_metrics(F.col("p"), F.col("y")).items()]).first()
    assert got.accuracy == pytest.approx(((p >= 0.5) == y).mean())
    assert le.cosine_decay(1.0, 5, 10) == pytest.approx(0.5) and le.exponential_decay(1.0, 15, 10, 0.5, True) == 0.5 and math.isclose(le.warmup(1.0, 4, 10), 0.5)
