"""Windows, functions, distributions, graphs and factors against plain Python."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import dates, distributions as d, mathematics as m, special as sp, strings
from tessera.operators import arrays as a, category, factors as fa, graph as g, stats as s, structure as st, windows as w

S = w.Series(("k",), ("t",))


@pytest.fixture(scope="module")
def series(spark):
    values = [3.0, None, 5.0, 4.0, 8.0, 8.0, 1.0, 2.0]
    return values, spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, t int, v double")


def got(df, c):
    return [r.x for r in df.select("t", c.alias("x")).orderBy("t").collect()]


def test_rolling(series):
    values, df = series
    seen = lambda i, n: [v for v in values[i - n + 1 : i + 1] if v is not None]
    assert got(df, w.rolling(S, F.col("v"), 3, "mean")) == pytest.approx([None, None] + [statistics.mean(seen(i, 3)) for i in range(2, 8)])
    assert got(df, w.rolling(S, F.col("v"), 3, "std")) == pytest.approx([None, None] + [statistics.stdev(seen(i, 3)) for i in range(2, 8)])
    assert got(df, w.rolling(S, F.col("v"), 9, "sum")) == [None] * 8
    assert got(df, w.rolling_quantile(S, F.col("v"), 4, 0.5))[3:] == [statistics.median(seen(i, 4)) for i in range(3, 8)]
    dd = got(df, w.rolling_max_drawdown(S, F.col("v"), 4))
    assert dd[6] == pytest.approx(7 / 8) and dd[4] == pytest.approx(1 / 5)
    assert got(df, w.cumulative(S, F.col("v"), "max")) == [3, 3, 5, 5, 8, 8, 8, 8]
    assert got(df, w.diff(S, F.col("v"))) == [None, -3, 5, -1, 4, 0, -7, 1]
    assert got(df, w.rank_average(F.col("v"), ["k"])) == [3, None, 5, 4, 6.5, 6.5, 1, 2]


def test_ewm_keeps_its_state_over_nulls(series):
    values, df = series
    out = {r.t: r for r in w.ewm(df, S, "v", 3).collect()}
    mean, var = 3.0, 0.0
    for i, v in list(enumerate(values))[1:]:
        if v is None:
            assert out[i].ewm_mean is None or math.isnan(out[i].ewm_mean)
            continue
        delta = v - mean
        mean, var = mean + 0.5 * delta, 0.5 * (var + 0.5 * delta * delta)
        assert out[i].ewm_mean == pytest.approx(mean) and out[i].ewm_var == pytest.approx(var)


def test_strings_and_dates(spark):
    df = spark.createDataFrame([("  aé.b\t",), (None,), ("",)], "s string")
    x = df.select(strings.strip(F.col("s")).alias("a"), strings.byte_length(F.col("s")).alias("n"), strings.contains(F.col("s"), ".").alias("c"), strings.split(F.col("s"), ".").alias("p"), strings.byte_slice(F.col("s"), -2, 0).alias("e")).collect()
    assert x[0].a == "aé.b" and x[0].n == 8 and x[0].c and x[0].p == ["  aé", "b\t"] and x[0].e == "b\t"
    assert x[1].a is None and x[1].c is False and x[2].p == [""]
    one = spark.sql("SELECT timestamp '2024-01-31 23:30:00' AS t")
    r = one.select(dates.weekday(F.col("t")).alias("w"), dates.shift(F.col("t"), 1, "M").alias("clamped"), dates.shift(F.col("t"), 1, "M", overflow=True).alias("over"), dates.between_time(F.col("t"), "23:00:00", "01:00:00").alias("b")).first()
    assert r.w == 3 and r.clamped.day == 29 and (r.over.month, r.over.day) == (3, 2) and r.b
    assert spark.createDataFrame([("2024-02-30x",), ("2024-02-03",)], "s string").select(dates.parse(F.col("s")).alias("t")).collect()[1].t.day == 3
    assert dates.date_range(spark, "2024-01-01 00:00:00", "2024-01-03 00:00:00", "H").count() == 49


def test_mathematics(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (-7.0, 2.0), (None, 1.0)], "a double, b double")
    x = [r.q for r in df.select(m.divide(F.col("a"), F.col("b")).alias("q")).collect()]
    assert x[0] == math.inf and math.isnan(x[1]) and x[2] == -3.5 and x[3] is None
    r = df.filter("a = -7").select(m.BINARY["remainder"](F.col("a"), F.col("b")).alias("r"), m.around(F.lit(2.5)).alias("e"), m.log(F.col("b") - 2).alias("l"), m.divmod_(F.col("a"), F.col("b"))[0].alias("q")).first()
    assert r.r == math.remainder(-7, 2) and r.e == 2.0 and r.l == -math.inf and r.q == -4.0


def test_special_and_distributions():
    assert sp.gammainc(1, 1.7) == pytest.approx(1 - math.exp(-1.7)) and sp.gammainc(2, 5.0) == pytest.approx(1 - 6 * math.exp(-5)) and sp.betainc(2, 3, 0.4) == pytest.approx(0.5248)
    assert sp.digamma(0.5) == pytest.approx(-1.9635100260214235) and sp.zeta(2.0) == pytest.approx(math.pi**2 / 6) and sp.i0(1.0) == pytest.approx(1.2660658777520082)
    for dist in (d.Normal(1, 2), d.ChiSquared(3), d.StudentT(5), d.FDist(4, 9), d.Lognormal(0, 0.5), d.Weibull(1.5, 2), d.Pareto(3, 1), d.Cauchy(0, 1), d.Laplace(0, 1), d.Logistic(1, 2), d.Gumbel(0, 1), d.Rayleigh(2), d.Rice(1, 1), d.Nakagami(1, 2), d.VonMises(0, 2), d.HalfNormal(1), d.TruncatedNormal(0, 1, -1, 2), d.InverseGaussian(1, 2), d.GeneralizedExtremeValue(0, 1, 0.2), d.Levy(0, 1), d.Beta(2, 5), d.Gamma(2, 3), d.Exponential(2), d.Uniform(1, 3), d.Triangular(0, 3, 1)):
        p = np.array([0.1, 0.5, 0.9])
        x = dist.ppf(p)
        assert dist.cdf(x) == pytest.approx(p, abs=1e-6), type(dist)
        h = 1e-4 * np.maximum(0.1, np.abs(x))
        assert (dist.cdf(x + h) - dist.cdf(x - h)) / (2 * h) == pytest.approx(dist.pdf(x), rel=2e-3), type(dist)
    for dist in (d.Poisson(3), d.Binomial(10, 0.3), d.NegativeBinomial(3, 0.4), d.Geometric(0.3), d.Bernoulli(0.2), d.Hypergeometric(20, 7, 5), d.Zipf(1.5, 9)):
        k = np.arange(0, 200)
        assert dist.pdf(k).sum() == pytest.approx(1, abs=1e-9) and (dist.pdf(k) * k).sum() == pytest.approx(dist.mean(), abs=1e-6)
        assert dist.cdf(4) == pytest.approx(dist.pdf(np.arange(5)).sum())


def test_statistics(spark):
    r = np.random.default_rng(0)
    x, y = r.normal(size=60).round(1), r.normal(0.4, 1.3, size=50).round(1)
    df = spark.createDataFrame([("x", float(v)) for v in x] + [("y", float(v)) for v in y], "g string, v double")
    u = sum((a > b) + 0.5 * (a == b) for a in x for b in y)
    assert s.mann_whitney(df, "v", "g", "x", "y")["statistic"] == min(u, 3000 - u)
    grid = np.unique(np.concatenate([x, y]))
    gap = max(abs((x <= v).mean() - (y <= v).mean()) for v in grid)
    assert s.ks_2samp(df, "v", "g", "x", "y")["statistic"] == pytest.approx(gap)
    t = s.ttest_ind(df, "v", "g", "x", "y")
    assert t["statistic"] == pytest.approx((x.mean() - y.mean()) / math.sqrt(x.var(ddof=1) / 60 + y.var(ddof=1) / 50)) and 0 < t["pvalue"] < 1
    assert s.fisher_exact([[8, 2], [1, 5]])["pvalue"] == pytest.approx(0.03497, abs=1e-4)
    assert s.trim_mean(df.filter("g = 'x'"), "v", 0.1).first()[0] == pytest.approx(np.sort(x)[6:-6].mean())


def test_graphs(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (4, 3), (3, 5), (8, 9)], "src long, dst long")
    assert {r.node: r.distance for r in g.distances(e, 1).collect()} == {1: 0, 2: 1, 4: 1, 3: 2, 5: 3}
    assert g.shortest_path(e, 1, 5) == [1, 2, 3, 5] and g.shortest_path(e, 5, 1) == []
    assert {r.node: r.component for r in g.weak_components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}
    assert {r.node: r.level for r in g.topological_levels(e).collect()} == {1: 0, 2: 1, 4: 1, 3: 2, 5: 3, 8: 0, 9: 1}
    assert not g.is_dag(e.union(spark.createDataFrame([(5, 1)], "src long, dst long")))
    assert (2, 4) in {tuple(r) for r in g.moralize(e).collect()}
    rank = {r.node: r.rank for r in g.pagerank(e).collect()}
    assert sum(rank.values()) == pytest.approx(1, abs=1e-4) and rank[5] > rank[1]


def test_student_network(spark):
    """The five-node student network of the textbooks."""
    f = lambda cols, rows: spark.createDataFrame(rows, cols)
    grade = {(0, 0): (0.3, 0.4, 0.3), (0, 1): (0.9, 0.08, 0.02), (1, 0): (0.05, 0.25, 0.7), (1, 1): (0.5, 0.3, 0.2)}
    factors = [
        f("d int, v double", [(0, 0.6), (1, 0.4)]), f("i int, v double", [(0, 0.7), (1, 0.3)]),
        f("g int, i int, d int, v double", [(k, i, dd, p[k]) for (i, dd), p in {(0, 0): grade[0, 0], (1, 0): grade[0, 1], (0, 1): grade[1, 0], (1, 1): grade[1, 1]}.items() for k in range(3)]),
        f("l int, g int, v double", [(0, 0, 0.1), (1, 0, 0.9), (0, 1, 0.4), (1, 1, 0.6), (0, 2, 0.99), (1, 2, 0.01)]),
    ]
    post = {r.g: r.v for r in fa.query(factors, ["g"], {"d": 1, "i": 0}).collect()}
    assert post == pytest.approx({0: 0.05, 1: 0.25, 2: 0.7})
    assert {r.l: r.v for r in fa.query(factors, ["l"]).collect()}[1] == pytest.approx(0.502336)
    assert fa.map_query(factors, ["g"], {"d": 0, "i": 1}) == {"g": 0}


def test_structure(spark):
    r = np.random.default_rng(1)
    a = r.integers(0, 2, 2000)
    b = np.where(r.random(2000) < 0.9, a, 1 - a)
    c = np.where(r.random(2000) < 0.9, b, 1 - b)
    data = spark.createDataFrame([tuple(map(int, x)) for x in zip(a, b, c, strict=True)], "a int, b int, c int")
    assert {frozenset(e) for e in st.chow_liu(data, ["a", "b", "c"])} == {frozenset("ab"), frozenset("bc")}
    assert {frozenset(e) for e in st.hill_climb(data, ["a", "b", "c"])} == {frozenset("ab"), frozenset("bc")}


def test_arrays_and_categories(spark):
    x, y = np.arange(6.0).reshape(2, 3), np.arange(12.0).reshape(3, 4)
    p, q = a.from_numpy(spark, x), a.from_numpy(spark, y)
    assert (a.to_numpy(a.matmul(p, q), (2, 4)) == x @ y).all()
    assert (a.to_numpy(a.einsum("ij,jk->ki", p, q), (4, 2)) == (x @ y).T).all()
    assert a.to_numpy(a.reduce_axes(p, "var", "i0"), (3,)) == pytest.approx(x.var(0))
    assert (a.to_numpy(a.cumulative(p, "i1"), (2, 3)) == x.cumsum(1)).all()
    u, v = a.from_numpy(spark, np.array([1.0, 2, 3])), a.from_numpy(spark, np.array([0.5, 1]))
    assert a.to_numpy(a.convolve(u, v), (4,)) == pytest.approx(np.convolve([1, 2, 3], [0.5, 1]))
    df = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    assert {r.c: r.code for r in category.codes(df, "c").collect()} == {"a": 0, "b": 1, None: -1}
