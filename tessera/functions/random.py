"""Seeded columns of random numbers, and random choices of rows.

Uniform and normal numbers come from the JVM's generators; other laws are their
quantiles at uniform numbers, or transforms. Streams are reproducible for a seed
and a partitioning; they are not those of another library.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import distributions as d


class Generator:
    """Columns of draws; each call moves on to a new stream."""

    def __init__(self, seed: int = 0):
        self.seed(seed)

    def seed(self, seed: int) -> None:
        self.start, self.calls = seed, 0

    def _next(self) -> int:
        self.calls += 1
        return self.start * 1_000_003 + self.calls

    def random(self) -> Column:
        """Uniform in [0, 1)."""
        return F.rand(self._next())

    rand = random

    def standard_normal(self) -> Column:
        return F.randn(self._next())

    randn = standard_normal

    def normal(self, mean: float = 0.0, sigma: float = 1.0) -> Column:
        return F.lit(float(mean)) + F.lit(float(sigma)) * self.standard_normal()

    def uniform(self, low: float = 0.0, high: float = 1.0) -> Column:
        return F.lit(float(low)) + F.lit(float(high - low)) * self.random()

    def randint(self, low: int, high: int) -> Column:
        """Whole numbers from ``low`` to before ``high``."""
        return (F.lit(low) + F.floor(self.random() * (high - low))).cast("long")

    def exponential(self, rate: float = 1.0) -> Column:
        return -F.log1p(-self.random()) / F.lit(float(rate))

    def quantile_of(self, law: d.Distribution) -> Column:
        """Draws of any distribution by its quantile function."""
        return d.column(law, "ppf", self.random())

    def poisson(self, lam: float) -> Column:
        return self.quantile_of(d.Poisson(lam)).cast("long")

    def binomial(self, n: int, p: float) -> Column:
        return self.quantile_of(d.Binomial(n, p)).cast("long")

    def beta(self, a: float, b: float) -> Column:
        return self.quantile_of(d.Beta(a, b))

    def gamma(self, shape: float, scale: float = 1.0) -> Column:
        return self.quantile_of(d.Gamma(shape, scale))

    def chisquare(self, df: float) -> Column:
        return self.quantile_of(d.ChiSquared(df))

    def standard_t(self, df: float) -> Column:
        return self.quantile_of(d.StudentT(df))

    def dirichlet(self, alpha: Sequence[float]) -> Column:
        """An array of shares: gamma draws over their sum."""
        laws = [d.Gamma(a, 1.0) for a in alpha]

        @F.pandas_udf("array<double>")
        def shares(u: pd.Series) -> pd.Series:
            draws = np.stack([law.ppf(x) for law, x in zip(laws, np.stack(u.to_list()).T, strict=True)], 1)
            return pd.Series(list(draws / draws.sum(1, keepdims=True)))

        return shares(F.array(*[self.random() for _ in alpha]))

    def multinomial(self, n: int, p: Sequence[float]) -> Column:
        """An array of counts of n draws."""
        cuts, total = [], 0.0
        for x in p[:-1]:
            total += x
            cuts.append(total)
        state = lambda u: sum(((u >= c).cast("int") for c in cuts), F.lit(0))
        draws = F.array(*[state(self.random()) for _ in range(n)])
        none = F.array(*[F.lit(0)] * len(p))
        return F.aggregate(draws, none, lambda n, s: F.transform(n, lambda x, k: x + (k == s).cast("int")))

    def choice(self, df: DataFrame, n: int, replace: bool = False) -> DataFrame:
        """n rows; with replacement each row's number of copies is drawn by a multinomial of uniform places."""
        if not replace:
            return df.orderBy(F.rand(self._next())).limit(n)
        from tessera.operators.ranks import numbered

        rows = numbered(df.withColumn("_k", F.monotonically_increasing_id()), ["_k"], "_place")
        total = rows.count()
        picks = df.sparkSession.range(n).select(F.floor(F.rand(self._next()) * total).cast("long").alias("_place"))
        return picks.join(rows, "_place").drop("_place", "_k")

    def shuffled(self, values: Column) -> Column:
        """An array column in random order."""
        return F.shuffle(values, self._next())

    def permutation(self, spark: SparkSession, n: int) -> DataFrame:
        """(i0, v): the numbers 0 to n - 1 in random order."""
        from tessera.operators.ranks import numbered

        rows = spark.range(n).withColumn("_u", F.rand(self._next()))
        return numbered(rows, ["_u", "id"], "i0").select("i0", F.col("id").cast("double").alias("v"))
