import math

import numpy as np
import pytest

from tessera.functions import distributions as d
from tessera.operators import stats as s


@pytest.fixture(scope="module")
def sample(spark):
    g = np.random.default_rng(12)
    x = np.round(g.normal(3, 2, 240), 1)
    y = np.round(x * 0.5 + g.normal(0, 1, 240), 1)
    z = g.integers(0, 5, 240).astype(float)
    group = np.array(["a", "b", "c"])[g.integers(0, 3, 240)]
    rows = [(float(a), float(b), float(c), str(k)) for a, b, c, k in zip(x, y, z, group, strict=True)]
    return spark.createDataFrame(rows, "x double, y double, z double, g string"), x, y, z, group


def mid_ranks(v):
    return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])


def test_kendall_is_all_pairs(sample):
    df, x, y, z, _ = sample
    for a, b, u, v in (("x", "y", x, y), ("z", "y", z, y), ("z", "z", z, z)):
        signs = [(np.sign(u[i] - u[j]), np.sign(v[i] - v[j])) for i in range(len(u)) for j in range(i)]
        n0 = len(signs)
        want = sum(p * q for p, q in signs) / math.sqrt((n0 - sum(p == 0 for p, _ in signs)) * (n0 - sum(q == 0 for _, q in signs)))
        assert s.kendall(df, a, b)["statistic"] == pytest.approx(want, abs=1e-12)


def test_spread_tests(sample):
    df, x, _, _, group = sample
    a, b = x[group == "a"], x[group == "b"]
    r = mid_ranks(np.concatenate([a, b]))
    n, k = len(r), len(a)
    m = ((r[:k] - (n + 1) / 2) ** 2).sum()
    want = (m - k * (n * n - 1) / 12) / math.sqrt(k * (n - k) * (n + 1) * (n * n - 4) / 180)
    assert s.mood(df, "x", "g", "a", "b")["statistic"] == pytest.approx(want)
    dev = np.concatenate([abs(x[group == k] - np.median(x[group == k])) for k in "abc"])
    owner = np.concatenate([[k] * (group == k).sum() for k in "abc"])
    score = d.Normal(0, 1).ppf((mid_ranks(dev) / (len(dev) + 1) + 1) / 2)
    want = sum((owner == k).sum() * (score[owner == k].mean() - score.mean()) ** 2 for k in "abc") / score.var(ddof=1)
    assert s.fligner(df, "x", "g")["statistic"] == pytest.approx(want)


def test_friedman(sample):
    df, x, y, z, _ = sample
    rows = np.stack([x, y, z], 1)
    sums = sum(np.array([(r < v).sum() + ((r == v).sum() + 1) / 2 for v in r]) for r in rows)
    want = 12 / (len(rows) * 3 * 4) * ((sums - len(rows) * 2) ** 2).sum()
    assert s.friedman(df, "x", "y", "z")["statistic"] == pytest.approx(want)


def test_normality(sample):
    df, x, *_ = sample
    v = np.sort(x)
    n = len(v)
    z = d.Normal(x.mean(), x.std(ddof=1)).cdf(v)
    i = np.arange(n)
    want = (-n - ((2 * i + 1) * (np.log(z) + np.log(1 - z[::-1]))).sum() / n) * (1 + 0.75 / n + 2.25 / n**2)
    assert s.anderson_darling(df, "x")["statistic"] == pytest.approx(want)
    m = d.Normal(0, 1).ppf((i + 0.375) / (n + 0.25))
    got = s.shapiro(df, "x")
    assert got["statistic"] == pytest.approx((m @ v) ** 2 / (m @ m) / ((v - v.mean()) ** 2).sum()) and 0 <= got["pvalue"] <= 1
    assert s.normaltest(df, "x")["pvalue"] > 0.01
    f = d.Normal(3, 2).cdf(v)
    assert s.ks_1samp(df, "x", d.Normal(3, 2))["statistic"] == pytest.approx(max(((i + 1) / n - f).max(), (f - i / n).max()))


def test_other_measures(sample):
    df, x, y, z, group = sample
    r = s.point_biserial(df.selectExpr("x", "g = 'a' AS f"), "x", "f")["statistic"]
    assert r == pytest.approx(np.corrcoef(x, group == "a")[0, 1])
    p = np.linalg.inv(np.corrcoef([x, y, z]))
    assert s.partial_correlation(df, "x", "y", "z")["statistic"] == pytest.approx(-p[0, 1] / math.sqrt(p[0, 0] * p[1, 1]))
    a, b = x[group == "a"], x[group == "b"]
    at = np.sort(np.concatenate([a, b]))
    gap = abs(np.searchsorted(np.sort(a), at, "right") / len(a) - np.searchsorted(np.sort(b), at, "right") / len(b))
    assert s.ks_2samp(df, "x", "g", "a", "b")["statistic"] == pytest.approx(gap.max())
    assert s.wasserstein(df, "x", "g", "a", "b").first().distance == pytest.approx((gap[:-1] * np.diff(at)).sum())
    assert s.trim_mean(df, "x", 0.1).first().trim_mean == pytest.approx(np.sort(x)[24:-24].mean())
    assert s.chi_square(df.sparkSession.createDataFrame([(10.0, 12.0), (14.0, 12.0)], "o double, e double"), "o", "e")["statistic"] == pytest.approx(8 / 12)
