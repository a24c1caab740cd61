"""Learning from categorical tables: scores, dependence, trees, greedy search, adjustment.

Counts for many families come from one pass with grouping sets; the search over
structures runs on the driver over those small tables.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T



def family_counts(data: DataFrame, variable: str, parents: Sequence[str]) -> DataFrame:
    """n of each cell and t of its parents' values."""
    cells = data.groupBy(variable, *parents).agg(F.count(F.lit(1)).alias("n"))
    return cells.withColumn("t", F.sum("n").over(Window.partitionBy(*parents)))


@F.pandas_udf(T.DoubleType())
def _lgamma(x: pd.Series) -> pd.Series:
    return x.map(math.lgamma)


def local_scores(data: DataFrame, variable: str, parents: Sequence[str]) -> DataFrame:
    """One row: log_likelihood, aic, bic, k2 and bdeu (size 10) of a node given its parents; cells are summed where they are."""
    cards = data.agg(*[F.count_distinct(c).alias(f"c{i}") for i, c in enumerate((variable, *parents))], F.count(F.lit(1)).alias("rows")).first()
    r, q = cards[0], math.prod(cards[1 : 1 + len(parents)])
    k = (r - 1) * q
    cells = family_counts(data, variable, parents).select(*parents, F.col("n").cast("double").alias("_n"), F.col("t").cast("double").alias("_t"))
    alphas = (1.0, 10.0 / (r * q)) if r else (1.0, 1.0)
    n, t = F.col("_n"), F.col("_t")
    x, seen, *inner = cells.agg(F.sum(n * F.ln(n / t)), F.count(F.lit(1)), *[F.sum(_lgamma(n + a)) for a in alphas]).first()
    groups = cells.groupBy(*parents).agg(F.first("_t").alias("_t"))
    many, *outer = groups.agg(F.count(F.lit(1)), *[F.sum(_lgamma(t + r * a)) for a in alphas]).first()
    marginal = [many * math.lgamma(r * a) - (o or 0.0) + (i or 0.0) - seen * math.lgamma(a) if seen else 0.0 for a, i, o in zip(alphas, inner, outer, strict=True)]
    x = x or 0.0
    values = (x, x - k, x - 0.5 * k * math.log(max(cards["rows"], 1)), *map(float, marginal))
    return data.sparkSession.createDataFrame([values], "log_likelihood double, aic double, bic double, k2 double, bdeu double")


def mutual_information(data: DataFrame, variables: Sequence[str]) -> DataFrame:
    """(a, b, mi) of all pairs in nats; all pairs' counts in one pass."""
    pairs = list(combinations(variables, 2))
    rows = data.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")) for a, b in pairs])).alias("p")).select("p.*")
    cells = rows.groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("c"))
    w = lambda *by: F.sum("c").over(Window.partitionBy("a", "b", *by))
    cells = cells.withColumns({"cx": w("x"), "cy": w("y"), "n": w()})
    return cells.groupBy("a", "b").agg(F.sum(F.col("c") / F.col("n") * F.ln(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy")))).alias("mi"))


def chow_liu(data: DataFrame, variables: Sequence[str], root: str | None = None) -> list[tuple[str, str]]:
    """Edges of the maximum spanning tree of mutual information, away from the root (that with most information)."""
    mi = {(r.a, r.b): r.mi for r in mutual_information(data, variables).collect()}
    group = {v: v for v in variables}

    def find(v: str) -> str:
        while group[v] != v:
            v = group[v]
        return v

    links: dict[str, list[str]] = {v: [] for v in variables}
    for (a, b), _ in sorted(mi.items(), key=lambda x: (-x[1], x[0])):
        if find(a) != find(b):
            group[find(a)] = find(b)
            links[a].append(b)
            links[b].append(a)
    total = {v: sum(x for pair, x in mi.items() if v in pair) for v in variables}
    root = root or max(variables, key=lambda v: total[v])
    out, seen, queue = [], {root}, [root]
    while queue:
        v = queue.pop(0)
        for u in sorted(links[v]):
            if u not in seen:
                seen.add(u)
                out.append((v, u))
                queue.append(u)
    return out


def hill_climb(data: DataFrame, variables: Sequence[str], score: str = "bic", max_parents: int | None = None) -> list[tuple[str, str]]:
    """Greedy edge additions, removals and reversals while the score rises; a round's families are counted in one pass. No node gets more than ``max_parents``, if given."""
    from tessera.models.learning import DiscreteScore
    from tessera.models.learning import hill_climb as climb

    kind = {"log_likelihood": "loglik"}.get(score, score)
    return climb(DiscreteScore(data.select(*variables), kind), variables, max_parents=max_parents)


def backdoor(data: DataFrame, treatment: str, outcome: str, adjust: Sequence[str]) -> DataFrame:
    """(treatment, effect): the sum over z of E[outcome | t, z] P(z); unseen pairs count 0."""
    means = data.groupBy(treatment, *adjust).agg(F.avg(outcome).alias("m"))
    weights = data.groupBy(*adjust).agg(F.count(F.lit(1)).alias("k")).withColumn("w", F.col("k") / F.sum("k").over(Window.partitionBy()))
    return means.join(weights, list(adjust)).groupBy(treatment).agg(F.sum(F.col("m") * F.col("w")).alias("effect"))


def naive_bayes(data: DataFrame, label: str, features: Sequence[str]) -> dict[str, DataFrame]:
    """The label's and each feature's tables of ln P."""
    from tessera.operators.factors import fit_cpd

    return {f: fit_cpd(data, f, [] if f == label else [label]).withColumn("v", F.ln("v")) for f in (label, *features)}


def naive_bayes_scores(data: DataFrame, model: dict[str, DataFrame], label: str, *key: str) -> DataFrame:
    """(key, label, score) of each row and label: sums of logarithms, unseen values minus infinity."""
    features = [f for f in model if f != label]
    rows = data.select(*key, *features).crossJoin(F.broadcast(model[label].withColumnRenamed("v", "score")))  # a row for each label
    for f in features:
        rows = rows.join(model[f].withColumnRenamed("v", "w"), [f, label], "left")
        rows = rows.withColumn("score", F.col("score") + F.coalesce("w", F.lit(float("-inf")))).drop("w")
    return rows.select(*key, label, "score")
