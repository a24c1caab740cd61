"""Discrete factors as tables: one column for each variable and ``v``.

Products are joins on the shared variables, sums are group-bys, evidence is a
filter, so inference is a chain of joins and aggregates whose order the
elimination heuristic chooses.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scope(f: DataFrame) -> list[str]:
    return [c for c in f.columns if c != "v"]


def joint(data: DataFrame, variables: Sequence[str]) -> DataFrame:
    """The relative frequencies of the variables' values."""
    counts = data.groupBy(*variables).agg(F.count(F.lit(1)).cast("double").alias("v"))
    return counts.withColumn("v", F.col("v") / F.sum("v").over(Window.partitionBy()))


def fit_cpd(data: DataFrame, variable: str, parents: Sequence[str], prior: str = "none", size: float = 10.0) -> DataFrame:
    """P(variable | parents) by counts: prior none, k2 (1 to each cell), bdeu (size over cells) or uniform (1 over states)."""
    counts = data.groupBy(variable, *parents).agg(F.count(F.lit(1)).cast("double").alias("n"))
    if prior != "none":
        levels = [data.select(c).distinct() for c in (variable, *parents)]
        cards = [x.count() for x in levels]
        cells = 1
        for k in cards:
            cells *= k
        add = {"k2": 1.0, "bdeu": size / cells, "uniform": 1.0 / cards[0]}[prior]
        full = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), levels)  # one row for each cell of the table
        counts = full.join(counts, [variable, *parents], "left").withColumn("n", F.coalesce("n", F.lit(0.0)) + add)
    return counts.select(variable, *parents, (F.col("n") / F.sum("n").over(Window.partitionBy(*parents))).alias("v"))


def product(*factors: DataFrame) -> DataFrame:
    def two(a: DataFrame, b: DataFrame) -> DataFrame:
        shared = [c for c in scope(a) if c in scope(b)]
        other = b.withColumnRenamed("v", "w")
        both = a.join(other, shared) if shared else a.crossJoin(F.broadcast(other))
        return both.withColumn("v", F.col("v") * F.col("w")).drop("w")

    return reduce(two, factors)


def divide(a: DataFrame, b: DataFrame) -> DataFrame:
    """x / 0 is 0; b's scope lies in a's."""
    if not set(scope(b)) <= set(scope(a)):
        raise ValueError("the divisor has other variables")
    both = a.join(b.withColumnRenamed("v", "w"), scope(b), "left")
    return both.withColumn("v", F.coalesce(F.try_divide("v", "w"), F.lit(0.0))).drop("w")


def marginalize(f: DataFrame, away: Sequence[str]) -> DataFrame:
    return f.groupBy(*[c for c in scope(f) if c not in away]).agg(F.sum("v").alias("v"))


def maximize(f: DataFrame, away: Sequence[str]) -> DataFrame:
    return f.groupBy(*[c for c in scope(f) if c not in away]).agg(F.max("v").alias("v"))


def reduce_evidence(f: DataFrame, evidence: dict) -> DataFrame:
    """Rows that agree with the evidence, without its columns."""
    for c in [c for c in scope(f) if c in evidence]:
        f = f.filter(F.col(c) == F.lit(evidence[c])).drop(c)
    return f


def normalize(f: DataFrame) -> DataFrame:
    total = F.sum("v").over(Window.partitionBy())
    return f.withColumn("v", F.when(total > 0, F.col("v") / total).otherwise(F.col("v")))


def elimination_order(scopes: Sequence[set[str]], away: set[str], heuristic: str = "min_neighbors") -> list[str]:
    """Greedy order by neighbours or by the edges that elimination fills in."""
    links: dict[str, set[str]] = {}
    for x in scopes:
        for c in x:
            links.setdefault(c, set()).update(x - {c})
    left, out = set(away), []

    def cost(c: str) -> tuple:
        if heuristic == "min_fill":
            near = sorted(links[c])
            return (sum(b not in links[a] for i, a in enumerate(near) for b in near[i + 1 :]), c)
        return (len(links[c]), c)

    while left:
        c = min(left & links.keys(), key=cost, default=None)
        if c is None:
            break
        near = links.pop(c)
        for a in near:
            links[a] = (links[a] | near) - {a, c}
        left.discard(c)
        out.append(c)
    return out


def sum_product(factors: Sequence[DataFrame], order: Sequence[str], combine=marginalize) -> DataFrame:
    """Bucket elimination: what holds a variable is joined, then the variable summed (or maximised) out."""
    live = list(factors)
    for c in order:
        own = [f for f in live if c in scope(f)]
        if own:
            live = [f for f in live if c not in scope(f)] + [combine(product(*own), [c])]
    return product(*live)


def query(factors: Sequence[DataFrame], variables: Sequence[str], evidence: dict | None = None, heuristic: str = "min_neighbors") -> DataFrame:
    """P(variables | evidence) by variable elimination with the evidence pushed down first."""
    live = [reduce_evidence(f, evidence or {}) for f in factors]
    away = {c for f in live for c in scope(f)} - set(variables)
    return normalize(sum_product(live, elimination_order([set(scope(f)) for f in live], away, heuristic)))


def map_query(factors: Sequence[DataFrame], variables: Sequence[str], evidence: dict | None = None) -> dict:
    """The most probable values of the variables, first in order among equals."""
    best = query(factors, variables, evidence).orderBy(F.desc("v"), *variables).first()
    return {c: best[c] for c in variables}


def noisy_or(inhibit: dict[str, float], leak: float) -> list[tuple]:
    """Rows (parents..., child, v) of a binary noisy-or; leak multiplies the probability of off."""
    from itertools import product as states

    out = []
    for s in states((0, 1), repeat=len(inhibit)):
        off = leak
        for on, q in zip(s, inhibit.values(), strict=True):
            off *= q if on else 1.0
        out += [(*s, 0, off), (*s, 1, 1 - off)]
    return out
