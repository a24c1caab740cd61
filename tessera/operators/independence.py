"""Conditional-independence tests over tables, and structure search that uses them.

Statistics are aggregates: strata are groups of the conditioning columns, and
one pass counts all their cells. Graph work is on the driver, as networks have
few variables.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.stats import p_chi2, p_normal, p_t

Test = Callable[[str, str, Sequence[str]], tuple[float, float]]


def stratified(data: DataFrame, x: str, y: str, z: Sequence[str] = (), lam: float = 1.0) -> dict[str, float]:
    """Power divergence summed over the strata of z: lam 1 is chi-square, 0 the G statistic. dof (r-1)(c-1) a stratum."""
    cells = data.groupBy(x, y, *z).agg(F.count(F.lit(1)).cast("double").alias("_o"))
    levels = data.agg(F.count_distinct(x).alias("r"), F.count_distinct(y).alias("c")).first()
    w = lambda *by: F.sum("_o").over(Window.partitionBy(*by, *z))
    cells = cells.withColumns({"_n": w(), "_rx": w(x), "_cy": w(y)}).withColumn("_e", F.col("_rx") * F.col("_cy") / F.col("_n"))
    o, e = F.col("_o"), F.col("_e")
    # cells without a row have o = 0: chi-square then adds e, whose sum is n minus that of the cells seen
    per = {1.0: (o - e) * (o - e) / e - e, 0.0: 2 * o * F.ln(o / e)}.get(lam, 2 / (lam * (lam + 1) or 1) * o * (F.pow(o / e, F.lit(float(lam))) - 1))
    r = cells.groupBy(*z).agg(F.sum(per).alias("_s"), F.first("_n").alias("_n"))
    r = r.agg(F.sum(F.col("_s") + (F.col("_n") if lam == 1.0 else F.lit(0.0))).alias("s"), F.count(F.lit(1)).alias("k")).first()
    dof = (levels.r - 1) * (levels.c - 1) * (r.k or 0)
    return {"statistic": r.s or 0.0, "dof": dof, "pvalue": p_chi2(r.s or 0.0, dof)}


def partial_correlation(data: DataFrame, x: str, y: str, z: Sequence[str] = ()) -> dict[str, float]:
    """Correlation given z from one pass of sums of products, with t and Fisher-z p-values."""
    cols = [x, y, *z]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    row = data.dropna(subset=cols).agg(F.count(F.lit(1)).alias("n"), *[F.covar_samp(a, b).alias(f"{a}\t{b}") for a, b in pairs]).first()
    c = np.zeros((len(cols),) * 2)
    for (a, b) in pairs:
        c[cols.index(a), cols.index(b)] = c[cols.index(b), cols.index(a)] = row[f"{a}\t{b}"] or 0.0
    p = np.linalg.pinv(c)
    scale = math.sqrt(abs(p[0, 0] * p[1, 1]))
    r = float(-p[0, 1] / scale) if scale > 0 else 0.0
    dof = row.n - len(z) - 2
    if dof <= 0 or abs(r) >= 1:
        return {"statistic": r, "pvalue": 0.0 if abs(r) >= 1 else 1.0, "fisher_p": 0.0 if abs(r) >= 1 else 1.0}
    t = r * math.sqrt(dof / (1 - r * r))
    return {"statistic": r, "pvalue": p_t(t, dof), "fisher_p": p_normal(math.atanh(r) * math.sqrt(max(dof - 1, 0)))}


class Dag:
    """A small directed graph on the driver."""

    def __init__(self, edges: Sequence[tuple[str, str]], nodes: Sequence[str] = ()):
        self.nodes = sorted({*nodes, *(v for e in edges for v in e)})
        self.edges = set(edges)

    def parents(self, v: str) -> set[str]:
        return {a for a, b in self.edges if b == v}

    def children(self, v: str) -> set[str]:
        return {b for a, b in self.edges if a == v}

    def ancestors(self, of: set[str]) -> set[str]:
        out, stack = set(of), list(of)
        while stack:
            for p in self.parents(stack.pop()) - out:
                out.add(p)
                stack.append(p)
        return out

    def markov_blanket(self, v: str) -> set[str]:
        kids = self.children(v)
        return (self.parents(v) | kids | {p for k in kids for p in self.parents(k)}) - {v}

    def d_separated(self, x: set[str], y: set[str], z: set[str]) -> bool:
        """By the moral graph of the ancestors of all three."""
        keep = self.ancestors(x | y | z)
        links: dict[str, set[str]] = {v: set() for v in keep}
        for v in keep:
            ps = self.parents(v) & keep
            for a in ps:
                links[v].add(a)
                links[a].add(v)
            for a, b in combinations(ps, 2):
                links[a].add(b)
                links[b].add(a)
        seen, stack = set(x), [v for v in x]
        while stack:
            for u in links[stack.pop()] - z - seen:
                if u in y:
                    return False
                seen.add(u)
                stack.append(u)
        return not (x & y)

    def valid_backdoor(self, x: str, y: str, z: set[str]) -> bool:
        """z holds no descendant of x and blocks every path into x."""
        below, stack = set(), [x]
        while stack:
            for c in self.children(stack.pop()) - below:
                below.add(c)
                stack.append(c)
        return not (z & below) and Dag([e for e in self.edges if e[0] != x], self.nodes).d_separated({x}, {y}, z)

    def backdoor_sets(self, x: str, y: str) -> list[set[str]]:
        rest = [v for v in self.nodes if v not in (x, y)]
        return [set(s) for k in range(len(rest) + 1) for s in combinations(rest, k) if self.valid_backdoor(x, y, set(s))]


def structural_distance(a: Dag, b: Dag) -> int:
    """Additions, removals and reversals between two graphs, one a pair."""
    pairs = {frozenset(e) for e in a.edges | b.edges}
    return sum({e for e in a.edges if frozenset(e) == p} != {e for e in b.edges if frozenset(e) == p} for p in pairs)


def pc(data: DataFrame, variables: Sequence[str], alpha: float = 0.05, max_given: int | None = None) -> tuple[set[tuple[str, str]], set[frozenset[str]]]:
    """Directed and undirected edges by the PC algorithm with chi-square tests: skeleton, colliders, two Meek rules.

    Conditioning sets grow while a node has neighbours enough, up to ``max_given`` if given.
    """
    near = {v: set(variables) - {v} for v in variables}
    apart: dict[frozenset[str], set[str]] = {}
    k = 0
    while (max_given is None or k <= max_given) and any(len(n) > k for n in near.values()):
        for a, b in combinations(sorted(variables), 2):
            if b not in near[a]:
                continue
            for z in sorted({*combinations(sorted(near[a] - {b}), k), *combinations(sorted(near[b] - {a}), k)}):
                if stratified(data, a, b, z)["pvalue"] > alpha:
                    near[a].discard(b)
                    near[b].discard(a)
                    apart[frozenset((a, b))] = set(z)
                    break
        k += 1
    arrows: set[tuple[str, str]] = set()
    for c in sorted(variables):
        for a, b in combinations(sorted(near[c]), 2):
            if b not in near[a] and c not in apart.get(frozenset((a, b)), {c}):
                arrows |= {(a, c), (b, c)}
    links = {frozenset((a, b)) for a in variables for b in near[a]}
    while True:
        open_ = {e for e in links if not any((a, b) in arrows for a in e for b in e)}
        new = set()
        for e in open_:
            for b in e:
                c = next(iter(e - {b}))
                if any((a, b) in arrows and a not in near[c] and a != c for a in variables):
                    new.add((b, c))
                elif any((b, a) in arrows and (a, c) in arrows for a in variables):
                    new.add((b, c))
        new = {(a, b) for a, b in new if (b, a) not in new or a < b}
        if not new:
            return arrows, open_
        arrows |= new
