"""Statistics and hypothesis tests over columns: sufficient statistics by aggregates, p-values from small results.

Rank tests rank distinct values by ranges, so no task holds all rows. Statistics
come back as one-row frames; p-values are computed on the driver from those few
numbers, and groups are summed in Spark however many there are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import distributions as d
from tessera.operators import ranks
from tessera.sources.shared import cut as written


def p_t(t: float, df: float) -> float:
    return float(2 * (1 - d.StudentT(df).cdf(abs(t)))) if df > 0 and math.isfinite(t) else (0.0 if math.isinf(t) else 1.0)


def p_chi2(x: float, df: float) -> float:
    return float(1 - d.ChiSquared(df).cdf(x)) if df > 0 else 1.0


def p_f(f: float, a: float, b: float) -> float:
    return float(1 - d.FDist(a, b).cdf(f)) if a > 0 and b > 0 else 1.0


def p_normal(z: float) -> float:
    return float(2 * (1 - d.Normal(0, 1).cdf(abs(z))))


def moments(df: DataFrame, c: str) -> DataFrame:
    """n, mean, m2, m3, m4 (central power means) in two passes, the second about the mean."""
    mean = df.agg(F.avg(c)).first()[0] or 0.0
    x = F.col(c).cast("double") - F.lit(mean)
    return df.agg(F.count(c).alias("n"), F.lit(mean).alias("mean"), *[F.avg(F.pow(x, F.lit(float(k)))).alias(f"m{k}") for k in (2, 3, 4)])


def describe(df: DataFrame, c: str) -> DataFrame:
    """n, min, max, mean, sample variance, biased skewness and excess kurtosis."""
    m = moments(df, c).crossJoin(F.broadcast(df.agg(F.min(c).alias("min"), F.max(c).alias("max"))))
    return m.select("n", "min", "max", "mean", (F.col("m2") * F.col("n") / F.nullif(F.col("n") - 1, F.lit(0))).alias("variance"), skew_of().alias("skewness"), kurtosis_of().alias("kurtosis"))


def skew_of() -> Column:
    return F.coalesce(F.when(F.col("m2") > 0, F.col("m3") / F.pow("m2", F.lit(1.5))), F.lit(0.0))


def kurtosis_of() -> Column:
    return F.coalesce(F.when(F.col("m2") > 0, F.col("m4") / F.pow("m2", F.lit(2.0)) - 3), F.lit(0.0))


def iqr(df: DataFrame, c: str) -> DataFrame:
    low, high = ranks.quantiles(df, c, [0.25, 0.75])
    return df.sparkSession.createDataFrame([(None if low is None else high - low,)], "iqr double")


def sem(df: DataFrame, c: str) -> DataFrame:
    return df.agg((F.stddev_samp(c) / F.sqrt(F.count(c))).alias("sem"))


def trim_mean(df: DataFrame, c: str, cut: float) -> DataFrame:
    """Mean without the floor(cut n) smallest and largest; only distinct values are ordered."""
    values = written(ranks.value_ranks(df.select(F.col(c).cast("double").alias("v")), "v"), "trim")
    n = values.agg(F.sum("n")).first()[0] or 0
    g = math.floor(n * cut)
    kept = F.greatest(F.least(F.col("below") + F.col("n"), F.lit(n - g)) - F.greatest("below", F.lit(g)), F.lit(0))
    return values.agg((F.sum(F.col("v") * kept) / F.sum(kept)).alias("trim_mean"))


def zscore(df: DataFrame, c: str) -> DataFrame:
    """``df`` with ``z`` by the sample deviation; 0 without spread."""
    s = df.agg(F.avg(c).alias("_m"), F.stddev_samp(c).alias("_s"))
    return df.crossJoin(F.broadcast(s)).withColumn("z", F.when(F.col("_s") > 0, (F.col(c) - F.col("_m")) / F.col("_s")).otherwise(0.0)).drop("_m", "_s")


def entropy(df: DataFrame, p: str, q: str | None = None) -> DataFrame:
    """Shannon entropy in nats of a column of probabilities, or divergence from q."""
    x = F.col(p)
    if q is None:
        return df.agg(F.sum(F.when(x > 0, -x * F.ln(x)).otherwise(0.0)).alias("entropy"))
    return df.agg(F.sum(F.when(x > 0, F.when(F.col(q) > 0, x * F.ln(x / F.col(q))).otherwise(F.lit(float("inf")))).otherwise(0.0)).alias("entropy"))


def zmap(scores: DataFrame, c: str, compare: DataFrame, other: str) -> DataFrame:
    """``scores`` with ``z`` by the mean and deviation of another column; 0 without spread."""
    s = compare.agg(F.avg(other).alias("_m"), F.stddev_samp(other).alias("_s"))
    return scores.crossJoin(F.broadcast(s)).withColumn("z", F.when(F.col("_s") > 0, (F.col(c) - F.col("_m")) / F.col("_s")).otherwise(0.0)).drop("_m", "_s")  # one row


def average_ranks(df: DataFrame, c: str, *keep: str) -> DataFrame:
    """``keep`` columns and ``rank``: ranks are found per distinct value and joined back."""
    return ranks.average_ranks(df.filter(F.col(c).isNotNull()), c).select(*keep, c, "rank")


def ttest_ind(df: DataFrame, c: str, group: str, a, b) -> dict[str, float]:
    """Welch's t between two groups of a column."""
    rows = {r[group]: r for r in df.filter(F.col(group).isin(a, b)).groupBy(group).agg(F.count(c).alias("n"), F.avg(c).alias("m"), F.var_samp(c).alias("v")).collect()}
    x, y = rows[a], rows[b]
    u, w = x.v / x.n, y.v / y.n
    if u + w == 0:
        return {"statistic": 0.0, "pvalue": 1.0}
    t = (x.m - y.m) / math.sqrt(u + w)
    return {"statistic": t, "pvalue": p_t(t, (u + w) ** 2 / (u * u / (x.n - 1) + w * w / (y.n - 1)))}


def ttest_1samp(df: DataFrame, c: str, mu: float) -> dict[str, float]:
    r = df.agg(F.count(c).alias("n"), F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).first()
    t = (r.m - mu) / (r.s / math.sqrt(r.n)) if r.s else 0.0
    return {"statistic": t, "pvalue": p_t(t, r.n - 1) if r.s else 1.0}


def ttest_rel(df: DataFrame, a: str, b: str) -> dict[str, float]:
    return ttest_1samp(df.select((F.col(a) - F.col(b)).alias("d")), "d", 0.0)


def mann_whitney(df: DataFrame, c: str, group: str, a, b) -> dict[str, float]:
    """min(U1, U2) with the plain normal approximation."""
    rows = {r[group]: r for r in average_ranks(df.filter(F.col(group).isin(a, b)), c, group).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum("rank").alias("r")).collect()}
    n, m = rows[a].n, rows[b].n
    u = rows[a].r - n * (n + 1) / 2
    u = min(u, n * m - u)
    return {"statistic": u, "pvalue": p_normal((u - n * m / 2) / math.sqrt(n * m * (n + m + 1) / 12))}


def wilcoxon(df: DataFrame, c: str) -> dict[str, float]:
    """T+ of the non-zero values' absolute ranks."""
    x = df.filter(F.col(c) != 0).select(F.abs(c).alias("a"), (F.col(c) > 0).alias("up"))
    r = average_ranks(x, "a", "up").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("up"), F.col("rank")).otherwise(0.0)).alias("w")).first()
    n = r.n
    return {"statistic": r.w, "pvalue": p_normal((r.w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24))}


def kruskal(df: DataFrame, c: str, group: str) -> dict[str, float]:
    """H without tie correction."""
    by = average_ranks(df, c, group).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum("rank").alias("r"))
    n, k, x = by.agg(F.sum("n"), F.count(F.lit(1)), F.sum(F.col("r") * F.col("r") / F.col("n"))).first()
    h = 12 / (n * (n + 1)) * x - 3 * (n + 1)
    return {"statistic": h, "pvalue": p_chi2(h, k - 1)}


def bartlett(df: DataFrame, c: str, group: str) -> dict[str, float]:
    by = df.groupBy(group).agg(F.count(c).alias("n"), F.var_samp(c).alias("v"))
    free = F.col("n") - 1
    n, k, square, logs, inverse = by.agg(F.sum("n"), F.count(F.lit(1)), F.sum(free * F.col("v")), F.sum(free * F.ln("v")), F.sum(1 / free)).first()
    t = ((n - k) * math.log(square / (n - k)) - logs) / (1 + (inverse - 1 / (n - k)) / (3 * (k - 1)))
    return {"statistic": t, "pvalue": p_chi2(t, k - 1)}


def levene(df: DataFrame, c: str, group: str) -> dict[str, float]:
    """About the means."""
    centre = df.groupBy(group).agg(F.avg(c).alias("_m"))
    z = df.join(centre, group).select(group, F.abs(F.col(c) - F.col("_m")).alias("z"))
    by = z.groupBy(group).agg(F.count("z").alias("n"), F.avg("z").alias("m"), F.var_pop("z").alias("v"))
    n, k, first, second, inside = by.agg(F.sum("n"), F.count(F.lit(1)), F.sum(F.col("n") * F.col("m")), F.sum(F.col("n") * F.col("m") * F.col("m")), F.sum(F.col("n") * F.col("v"))).first()
    w = (n - k) / (k - 1) * (second - first * first / n) / inside
    return {"statistic": w, "pvalue": p_f(w, k - 1, n - k)}


def pearson(df: DataFrame, a: str, b: str) -> dict[str, float]:
    r = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.covar_pop(a, b).alias("c"), F.stddev_pop(a).alias("x"), F.stddev_pop(b).alias("y")).first()
    if not r.n or not r.x or not r.y:
        return {"statistic": 0.0, "pvalue": 1.0}
    rho = r.c / (r.x * r.y)
    t = rho * math.sqrt((r.n - 2) / (1 - rho * rho)) if abs(rho) < 1 and r.n > 2 else math.inf
    return {"statistic": rho, "pvalue": p_t(t, r.n - 2)}


def spearman(df: DataFrame, a: str, b: str) -> dict[str, float]:
    x = average_ranks(df.select(a, b), a, b).withColumnRenamed("rank", "ra")
    return pearson(average_ranks(x, b, "ra"), "ra", "rank")


def linregress(df: DataFrame, x: str, y: str) -> dict[str, float]:
    r = df.agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("c")).first()
    slope = r.c / r.vx
    rho = r.c / math.sqrt(r.vx * r.vy) if r.vy else 0.0
    err = math.sqrt(max(0.0, (1 - rho * rho) * r.vy / r.vx / (r.n - 2)))
    return {"slope": slope, "intercept": r.my - slope * r.mx, "r": rho, "stderr": err, "pvalue": p_t(slope / err, r.n - 2) if err else 0.0}


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, observed, expected) of all cells, absent ones included."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("observed"))
    rows, cols = cells.groupBy(a).agg(F.sum("observed").alias("_r")), cells.groupBy(b).agg(F.sum("observed").alias("_c"))
    total = cells.agg(F.sum("observed")).first()[0] or 0
    full = rows.crossJoin(F.broadcast(cols)).join(cells, [a, b], "left").fillna(0, ["observed"])  # one row for each pair of levels
    return full.select(a, b, "observed", (F.col("_r") * F.col("_c") / F.lit(float(total or 1))).alias("expected"))


def chi2_contingency(df: DataFrame, a: str, b: str, lam: float = 1.0) -> dict[str, float]:
    """Power divergence of a contingency table without correction: lam 1 is Pearson's, 0 the G statistic."""
    c = contingency(df, a, b)
    o, e = F.col("observed").cast("double"), F.col("expected")
    if lam == 1:
        term = (o - e) * (o - e) / e
    elif lam == 0:
        term = F.when(o > 0, 2 * o * F.ln(o / e)).otherwise(0.0)
    else:
        term = F.when(o > 0, 2 / (lam * (lam + 1)) * o * (F.pow(o / e, F.lit(float(lam))) - 1)).otherwise(0.0)
    r = c.filter("expected > 0").agg(F.sum(term).alias("x"), F.count_distinct(a).alias("r"), F.count_distinct(b).alias("c")).first()
    dof = (r.r - 1) * (r.c - 1)
    return {"statistic": r.x or 0.0, "dof": dof, "pvalue": p_chi2(r.x or 0.0, dof)}


def fisher_exact(table: Sequence[Sequence[int]]) -> dict[str, float]:
    (a, b), (c, e) = table
    n, k, m = a + b + c + e, a + b, a + c
    pmf = d.Hypergeometric(n, k, m)
    p = pmf.pdf(np.arange(0, m + 1))
    return {"statistic": a * e / (b * c) if b * c else math.inf, "pvalue": float(min(1.0, p[p <= pmf.pdf(a) * (1 + 1e-7)].sum()))}


def jarque_bera(df: DataFrame, c: str) -> dict[str, float]:
    r = moments(df, c).select("n", skew_of().alias("s"), kurtosis_of().alias("k")).first()
    x = r.n / 6 * (r.s**2 + r.k**2 / 4)
    return {"statistic": x, "pvalue": p_chi2(x, 2)}


def ks_pvalue(distance: float, n: float) -> float:
    """The asymptotic series with the small-sample correction."""
    lam = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * distance
    return min(1.0, max(0.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * lam * lam) for j in range(1, 101))))


def _two_functions(df: DataFrame, c: str, group: str, a, b) -> tuple[DataFrame, Column, dict[str, float]]:
    """Distinct values v with both samples' running counts, the distance of the distribution functions, and the sizes."""
    v = df.filter(F.col(group).isin(a, b) & F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count_if(F.col(group) == F.lit(a)).alias("x"), F.count_if(F.col(group) == F.lit(b)).alias("y"))
    rows, n = ranks.running(v, ["v"], ["x", "y"])
    return rows, F.abs((F.col("x_before") + F.col("x")) / F.lit(float(n["x"])) - (F.col("y_before") + F.col("y")) / F.lit(float(n["y"]))), n


def ks_2samp(df: DataFrame, c: str, group: str, a, b) -> dict[str, float]:
    """Largest distance of the two empirical distribution functions, found at distinct values."""
    rows, gap, n = _two_functions(df, c, group, a, b)
    distance = rows.agg(F.max(gap)).first()[0]
    return {"statistic": distance, "pvalue": ks_pvalue(distance, n["x"] * n["y"] / (n["x"] + n["y"]))}


def ks_1samp(df: DataFrame, c: str, distribution: d.Distribution) -> dict[str, float]:
    """Largest distance of a column's distribution function from a given one."""
    v = written(ranks.value_ranks(df, c).withColumn("f", d.column(distribution, "cdf", F.col(c))), "ks")
    n = v.agg(F.sum("n")).first()[0]
    distance = v.agg(F.max(F.greatest((F.col("below") + F.col("n")) / F.lit(float(n)) - F.col("f"), F.col("f") - F.col("below") / F.lit(float(n))))).first()[0]
    return {"statistic": distance, "pvalue": ks_pvalue(distance, n)}


def wasserstein(df: DataFrame, c: str, group: str, a, b) -> DataFrame:
    """Area between the two distribution functions."""
    rows, gap, _ = _two_functions(df, c, group, a, b)
    return rows.select((gap * (F.col("next") - F.col("v"))).alias("area")).agg(F.sum("area").alias("distance"))


def friedman(df: DataFrame, *columns: str) -> dict[str, float]:
    """Ranks of the columns within each row; average ranks for ties, without tie correction."""
    k = len(columns)
    rank = [sum(((F.col(o) < F.col(c)).cast("int") for o in columns), F.lit(0)) + (sum(((F.col(o) == F.col(c)).cast("int") for o in columns), F.lit(0)) + 1) / 2 for c in columns]
    n, *sums = df.agg(F.count(F.lit(1)), *[F.sum(r) for r in rank]).first()
    x = 12 / (n * k * (k + 1)) * sum((r - n * (k + 1) / 2) ** 2 for r in sums)
    return {"statistic": x, "pvalue": p_chi2(x, k - 1)}


def mood(df: DataFrame, c: str, group: str, a, b) -> dict[str, float]:
    """Equal spread of two samples: squared distance of the first one's ranks from the middle."""
    ranked = written(average_ranks(df.filter(F.col(group).isin(a, b)), c, group), "mood")
    n, k = ranked.agg(F.count(F.lit(1)), F.count_if(F.col(group) == F.lit(a))).first()
    m = ranked.filter(F.col(group) == F.lit(a)).agg(F.sum(F.pow(F.col("rank") - (n + 1) / 2, F.lit(2.0)))).first()[0]
    z = (m - k * (n * n - 1) / 12) / math.sqrt(k * (n - k) * (n + 1) * (n * n - 4) / 180)
    return {"statistic": z, "pvalue": p_normal(z)}


def fligner(df: DataFrame, c: str, group: str) -> dict[str, float]:
    """Equal spread of groups: normal scores of the ranks of distances from each group's median."""
    centre = df.groupBy(group).agg(F.percentile(c, 0.5).alias("_m"))
    z = df.join(centre, group).select(group, F.abs(F.col(c) - F.col("_m")).alias("z"))
    ranked = written(average_ranks(z, "z", group), "fligner")
    n = ranked.count()
    scored = ranked.withColumn("s", d.column(d.Normal(0, 1), "ppf", (F.col("rank") / (n + 1) + 1) / 2))
    mean, var = scored.agg(F.avg("s"), F.var_samp("s")).first()
    by = scored.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("m"))
    k, x = by.agg(F.count(F.lit(1)), F.sum(F.col("n") * F.pow(F.col("m") - mean, F.lit(2.0)))).first()
    return {"statistic": x / var if var else 0.0, "pvalue": p_chi2(x / var, k - 1) if var else 1.0}


def normaltest(df: DataFrame, c: str) -> dict[str, float]:
    """Skewness and kurtosis, each made normal, squared and summed."""
    r = moments(df, c).select("n", skew_of().alias("s"), kurtosis_of().alias("k"), "m2").first()
    n = r.n
    if n < 20:
        raise ValueError("needs 20 values")
    if not r.m2:
        return {"statistic": 0.0, "pvalue": 1.0}
    y = r.s * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (b2 - 1)) - 1
    z1 = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(math.log(math.sqrt(w2)))
    x = (r.k + 6 / (n + 1)) / math.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5)))
    b1 = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / b1 * (2 / b1 + math.sqrt(1 + 4 / b1**2))
    z2 = (1 - 2 / (9 * a) - math.cbrt((1 - 2 / a) / (1 + x * math.sqrt(2 / (a - 4))))) / math.sqrt(2 / (9 * a))
    return {"statistic": z1 * z1 + z2 * z2, "pvalue": p_chi2(z1 * z1 + z2 * z2, 2)}


def anderson_darling(df: DataFrame, c: str) -> dict[str, float]:
    """Distance from the fitted normal law, weighted in the tails and corrected for size; compare with ``ANDERSON``."""
    n, mean, s = df.agg(F.count(c), F.avg(c), F.stddev_samp(c)).first()
    if not s:
        return {"statistic": math.inf}
    v = ranks.value_ranks(df, c).withColumn("z", d.column(d.Normal(mean, s), "cdf", F.col(c)))
    z = F.greatest(F.least("z", F.lit(1 - 1e-15)), F.lit(1e-15))
    low, high = F.col("below"), F.col("below") + F.col("n")
    term = (high * high - low * low) * F.ln(z) + ((n - low) * (n - low) - (n - high) * (n - high)) * F.ln(1 - z)
    a = -n - v.agg(F.sum(term)).first()[0] / n
    return {"statistic": a * (1 + 0.75 / n + 2.25 / n**2)}


#: Critical values of the normal case at 15, 10, 5, 2.5 and 1 % (fixed values).
ANDERSON = (0.576, 0.656, 0.787, 0.918, 1.092)


def shapiro(df: DataFrame, c: str) -> dict[str, float]:
    """Squared correlation with the expected normal order, by Blom's places; up to 5000 values as its p-value is fitted for."""
    x = df.filter(F.col(c).isNotNull()).select(F.col(c).cast("double").alias("x"), F.monotonically_increasing_id().alias("k"))
    x = written(x, "shapiro")
    n, square = x.agg(F.count("x"), F.var_pop("x") * F.count("x")).first()
    if not 3 <= n <= 5000:
        raise ValueError("needs 3 to 5000 values")
    if not square:
        return {"statistic": 1.0, "pvalue": 1.0}
    placed = ranks.numbered(x, ["x", "k"], "i").withColumn("m", d.column(d.Normal(0, 1), "ppf", (F.col("i") + 0.375) / (n + 0.25)))
    mx, mm = placed.agg(F.sum(F.col("m") * F.col("x")), F.sum(F.col("m") * F.col("m"))).first()
    w = min(1.0, mx * mx / mm / square)
    if w > 0.999:
        return {"statistic": w, "pvalue": 1.0}
    log = math.log(n)
    # fixed values: the fitted mean and spread of ln(1 - w) (small samples: of ln(-ln(1 - w)))
    if n <= 11:
        g = 0.459 * n - 2.273
        z = (math.log(-math.log(1 - w)) - (-1.2725 + 1.0521 * (g - 2) / g)) / (1.0308 - 0.26758 * (g - 2) / g)
    else:
        z = (math.log(1 - w) - (0.0038915 * log**3 - 0.083751 * log**2 - 0.31082 * log - 1.5861)) / math.exp(0.0030302 * log**2 - 0.082676 * log - 0.4803)
    return {"statistic": w, "pvalue": float(1 - d.Normal(0, 1).cdf(z))}


def point_biserial(df: DataFrame, c: str, flag: str) -> dict[str, float]:
    """Pearson's r with a boolean as 0 and 1."""
    return pearson(df.select(c, F.col(flag).cast("int").cast("double").alias("_flag")), c, "_flag")


def kendall(df: DataFrame, a: str, b: str) -> dict[str, float]:
    """tau-b with a normal p-value.

    Pairs are not formed. The rank of ``a`` is read in digits of 16: two values
    differ first in one digit, below which the rows of each leading part are
    ordered by ``b`` and counted against each other by running sums. Each digit is
    one aggregate and one sort by ranges.
    """
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    rank = ranks.value_ranks(both, a).select(a, F.col("below").alias("r"))
    cells = written(both.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")).join(rank, a).select("r", F.col(b).alias("y"), "n"), "kendall")
    n = cells.agg(F.sum("n")).first()[0] or 0
    if n < 3:
        raise ValueError("needs 3 pairs")
    total, shift = 0.0, 0
    while n >> shift:
        node, digit = F.shiftright("r", shift + 4), F.shiftright("r", shift).bitwiseAND(F.lit(15))
        by = cells.groupBy(node.alias("node"), "y").agg(*[F.sum(F.when(digit == k, F.col("n")).otherwise(0)).alias(f"d{k}") for k in range(16)])
        names = [f"d{k}" for k in range(16)]
        rows, _ = ranks.running(by, ["node", "y"], names)
        rows = written(rows, "kendall-digit")
        start = rows.groupBy("node").agg(*[F.min(f"{c}_before").alias(f"_{c}") for c in names])
        rows = rows.join(start, "node")
        below = [F.col(f"{c}_before") - F.col(f"_{c}") for c in names]
        sign = sum((F.col(names[e]) * below[d_] - F.col(names[d_]) * below[e] for e in range(16) for d_ in range(e)), F.lit(0.0))
        total += rows.agg(F.sum(sign)).first()[0] or 0.0
        shift += 4
    pairs = lambda key: cells.groupBy(key).agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0]
    n0 = n * (n - 1) / 2
    spread = (n0 - pairs("r")) * (n0 - pairs("y"))
    if not spread:
        return {"statistic": 0.0, "pvalue": 1.0}
    tau = total / math.sqrt(spread)
    return {"statistic": tau, "pvalue": p_normal(tau / math.sqrt(2 * (2 * n + 5) / (9 * n * (n - 1))))}


def partial_correlation(df: DataFrame, a: str, b: str, *controls: str) -> dict[str, float]:
    """Pearson's r of a and b given controls, from the inverse of the correlation matrix."""
    names = [a, b, *controls]
    row = df.dropna(subset=names).agg(F.count(F.lit(1)), *[F.covar_samp(x, y) for x in names for y in names]).first()
    p = np.linalg.inv(np.array(row[1:], float).reshape(len(names), -1))
    r, free = -p[0, 1] / math.sqrt(p[0, 0] * p[1, 1]), row[0] - 2 - len(controls)
    return {"statistic": r, "pvalue": p_t(r * math.sqrt(free / max(1e-300, 1 - r * r)), free)}


def fisher_z(r: Column) -> Column:
    """atanh of a correlation."""
    return F.atanh(r)


def chi_square(df: DataFrame, observed: str, expected: str, lam: float = 1.0) -> dict[str, float]:
    """Goodness of fit of two columns by power divergence; 1 is Pearson's, 0 the G statistic. n - 1 degrees of freedom."""
    o, e = F.col(observed).cast("double"), F.col(expected).cast("double")
    if lam == 1:
        term = (o - e) * (o - e) / e
    elif lam == 0:
        term = F.when(o > 0, 2 * o * F.ln(o / e)).otherwise(0.0)
    else:
        term = 2 / (lam * (lam + 1)) * o * (F.pow(o / e, F.lit(float(lam))) - 1)
    x, n = df.agg(F.sum(term), F.count(F.lit(1))).first()
    return {"statistic": x, "pvalue": p_chi2(x, n - 1)}


def as_frame(df: DataFrame, result: dict[str, float]) -> DataFrame:
    """A test's result as one row."""
    return df.sparkSession.createDataFrame([tuple(float(v) for v in result.values())], ", ".join(f"{k} double" for k in result))
