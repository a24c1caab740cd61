"""Tables over named discrete variables in NumPy, and conditional distributions.

A network's tables are small; data-sized factors are the frames of
``operators.factors``, and :meth:`Table.frame` and :func:`from_frame` go between.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession

Evidence = Mapping[str, int]


class Table:
    """Values over variables, the last varying fastest; states are numbers from 0."""

    def __init__(self, variables: Sequence[str], sizes: Sequence[int], values):
        self.variables = list(variables)
        self.values = np.asarray(values, float).reshape(tuple(sizes))
        if len(set(self.variables)) != len(self.variables):
            raise ValueError("a variable twice")

    @property
    def sizes(self) -> dict[str, int]:
        return dict(zip(self.variables, self.values.shape, strict=True))

    def aligned(self, variables: Sequence[str]) -> np.ndarray:
        """Values with axes in this order, size 1 where a variable is missing."""
        own = [v for v in variables if v in self.variables]
        a = self.values.transpose([self.variables.index(v) for v in own])
        return a.reshape([self.sizes.get(v, 1) for v in variables])

    def _with(self, other: Table, f: Callable) -> Table:
        names = [*self.variables, *[v for v in other.variables if v not in self.variables]]
        got = f(self.aligned(names), other.aligned(names))
        return Table(names, got.shape, got)

    def __mul__(self, other: Table) -> Table:
        return self._with(other, np.multiply)

    def __add__(self, other: Table) -> Table:
        return self._with(other, np.add)

    def __truediv__(self, other: Table) -> Table:
        """x / 0 is 0; the divisor has no other variables."""
        if not set(other.variables) <= set(self.variables):
            raise ValueError("the divisor has other variables")
        return self._with(other, lambda a, b: np.divide(a, b, out=np.zeros(np.broadcast_shapes(a.shape, b.shape)), where=np.broadcast_to(b != 0, np.broadcast_shapes(a.shape, b.shape))))

    def _away(self, away: Sequence[str], f: Callable) -> Table:
        keep = [v for v in self.variables if v not in away]
        got = f(self.values, axis=tuple(k for k, v in enumerate(self.variables) if v in away))
        return Table(keep, np.shape(got), got)

    def marginalize(self, away: Sequence[str]) -> Table:
        return self._away(away, np.sum)

    def maximize(self, away: Sequence[str]) -> Table:
        return self._away(away, np.max)

    def keep(self, variables: Sequence[str]) -> Table:
        """Summed to these variables, in this order."""
        got = self.marginalize([v for v in self.variables if v not in variables])
        return Table(variables, [got.sizes[v] for v in variables], got.aligned(variables))

    def reduce(self, evidence: Evidence) -> Table:
        own = {v: s for v, s in evidence.items() if v in self.variables}
        got = self.values[tuple(own.get(v, slice(None)) for v in self.variables)]
        return Table([v for v in self.variables if v not in own], np.shape(got), got)

    def normalize(self) -> Table:
        """Sums to 1; left as it is without a finite positive total."""
        total = self.values.sum()
        return Table(self.variables, self.values.shape, self.values / total if np.isfinite(total) and total else self.values)

    def best(self) -> dict[str, int]:
        """The states of the largest value, the first among equals."""
        return dict(zip(self.variables, map(int, np.unravel_index(int(np.argmax(self.values)), self.values.shape)), strict=True))

    def sample(self, n: int, seed: int) -> np.ndarray:
        """n rows of states."""
        flat = self.values.ravel() / self.values.sum()
        picks = np.random.default_rng(seed).choice(len(flat), n, p=flat)
        return np.stack(np.unravel_index(picks, self.values.shape), 1)

    def frame(self, spark: SparkSession) -> DataFrame:
        """(variables..., v), a row for each cell."""
        rows = [(*map(int, i), float(self.values[i])) for i in np.ndindex(*self.values.shape)]
        return spark.createDataFrame(rows, ", ".join([*[f"`{v}` int" for v in self.variables], "v double"]))


def from_frame(f: DataFrame) -> Table:
    """A table from rows (variables..., v) with states 0, 1, ...; cells that are missing are 0."""
    names = [c for c in f.columns if c != "v"]
    rows = f.select(*names, "v").collect()
    sizes = [1 + max((r[k] for r in rows), default=0) for k in range(len(names))]
    out = np.zeros(sizes)
    for r in rows:
        out[tuple(r[:-1])] = r[-1]
    return Table(names, sizes, out)


def identity(variables: Sequence[str], sizes: Sequence[int]) -> Table:
    return Table(variables, sizes, np.ones(sizes))


def product(tables: Sequence[Table]) -> Table:
    return reduce(lambda a, b: a * b, tables, Table([], [], 1.0))


class FactorSet:
    """Tables that stand for their product."""

    def __init__(self, tables: Sequence[Table] = ()):
        self.tables = list(tables)

    def add(self, table: Table) -> None:
        self.tables.append(table)

    def remove(self, table: Table) -> None:
        self.tables.remove(table)

    def variables(self) -> set[str]:
        return {v for t in self.tables for v in t.variables}

    def holding(self, variable: str) -> list[Table]:
        return [t for t in self.tables if variable in t.variables]

    def __mul__(self, other: FactorSet) -> FactorSet:
        return FactorSet(self.tables + other.tables)

    def __truediv__(self, other: FactorSet) -> FactorSet:
        return FactorSet([*self.tables, *[identity(t.variables, t.values.shape) / t for t in other.tables]])

    def marginalize(self, away: Sequence[str]) -> FactorSet:
        """Each variable is summed out of the product of the tables that hold it."""
        live = list(self.tables)
        for v in away:
            own = [t for t in live if v in t.variables]
            live = [t for t in live if v not in t.variables] + ([product(own).marginalize([v])] if own else [])
        return FactorSet(live)

    def whole(self) -> Table:
        return product(self.tables)


class FactorDict(dict):
    """Tables by name."""

    def whole(self) -> Table:
        return product(list(self.values()))

    def scopes(self) -> dict[str, list[str]]:
        return {k: t.variables for k, t in self.items()}


class CPD:
    """P(variable | parents): a row for each state, a column for each configuration of parents, the first the slowest."""

    def __init__(self, variable: str, size: int, values, parents: Sequence[str] = (), sizes: Sequence[int] = ()):
        self.variable, self.size, self.parents, self.sizes = variable, size, list(parents), list(sizes)
        self.values = np.asarray(values, float).reshape(size, -1)
        if self.values.shape[1] != math.prod(self.sizes):
            raise ValueError("the table's columns are not the parents' configurations")
        if not np.allclose(self.values.sum(0), 1, atol=1e-6):
            raise ValueError("a column does not sum to 1")

    def table(self) -> Table:
        return Table([self.variable, *self.parents], [self.size, *self.sizes], self.values)

    def reordered(self, parents: Sequence[str]) -> CPD:
        t = self.table().aligned([self.variable, *parents])
        return CPD(self.variable, self.size, t.reshape(self.size, -1), parents, t.shape[1:])

    def marginalize(self, away: Sequence[str]) -> CPD:
        """Parents left out, their configurations weighed alike."""
        t = self.table()
        got = t.marginalize(away)
        rest = [p for p in self.parents if p not in away]
        values = got.values.reshape(self.size, -1)
        return CPD(self.variable, self.size, values / values.sum(0), rest, [got.sizes[p] for p in rest])

    def reduce(self, evidence: Evidence) -> CPD:
        got = self.table().reduce({k: v for k, v in evidence.items() if k != self.variable})
        rest = [p for p in self.parents if p not in evidence]
        return CPD(self.variable, self.size, got.values.reshape(self.size, -1), rest, [got.sizes[p] for p in rest])


def from_table(t: Table, variable: str) -> CPD:
    """The conditional of one variable of a table; configurations without mass get equal shares."""
    parents = [v for v in t.variables if v != variable]
    values = t.aligned([variable, *parents]).reshape(t.sizes[variable], -1)
    total = values.sum(0)
    values = np.where(total > 0, values / np.where(total > 0, total, 1), 1 / len(values))
    return CPD(variable, len(values), values, parents, [t.sizes[p] for p in parents])


def random_cpd(variable: str, size: int, parents: Sequence[str] = (), sizes: Sequence[int] = (), seed: int = 0) -> CPD:
    w = np.random.default_rng(seed).random((size, math.prod(sizes)))
    return CPD(variable, size, w / w.sum(0), parents, sizes)


def uniform_cpd(variable: str, size: int, parents: Sequence[str] = (), sizes: Sequence[int] = ()) -> CPD:
    return CPD(variable, size, np.full((size, math.prod(sizes)), 1 / size), parents, sizes)


class Joint(Table):
    """A table that sums to 1."""

    def __init__(self, variables: Sequence[str], sizes: Sequence[int], values):
        super().__init__(variables, sizes, values)
        if not math.isclose(self.values.sum(), 1, abs_tol=1e-6):
            raise ValueError("does not sum to 1")

    def marginal(self, *variables: str) -> Joint:
        t = self.keep(variables)
        return Joint(t.variables, t.values.shape, t.values)

    def conditional(self, variables: Sequence[str], evidence: Evidence) -> Joint:
        t = self.reduce(evidence).keep(variables).normalize()
        return Joint(t.variables, t.values.shape, t.values)

    def independent(self, x: Sequence[str], y: Sequence[str], given: Sequence[str] = (), tolerance: float = 1e-9) -> bool:
        """Whether P(x, y, given) P(given) = P(x, given) P(y, given) in every cell."""
        names = [*x, *y, *given]
        left = self.keep(names) * self.keep(list(given)) if given else self.keep(names)
        right = self.keep([*x, *given]) * self.keep([*y, *given])
        return bool(np.allclose(left.aligned(names), right.aligned(names), atol=tolerance))

    def is_imap(self, edges: Sequence[tuple[str, str]]) -> bool:
        """Whether each variable is independent of its other non-descendants given its parents."""
        parents = {v: [a for a, b in edges if b == v] for v in self.variables}

        def below(v: str) -> set[str]:
            out: set[str] = set()
            todo = [v]
            while todo:
                for w in (b for a, b in edges if a == todo[-1] and b not in out):
                    out.add(w)
                    todo.append(w)
                    break
                else:
                    todo.pop()
            return out

        for v in self.variables:
            rest = [w for w in self.variables if w != v and w not in parents[v] and w not in below(v)]
            if rest and not self.independent([v], rest, parents[v]):
                return False
        return True


class LinearGaussianCPD:
    """A variable with mean b0 + sum b_k parent_k and a variance."""

    def __init__(self, variable: str, intercept: float, variance: float, parents: Sequence[str] = (), weights: Sequence[float] = ()):
        if variance < 0 or len(parents) != len(weights):
            raise ValueError("negative variance or as many weights as parents")
        self.variable, self.intercept, self.variance, self.parents, self.weights = variable, intercept, variance, list(parents), list(weights)

    def mean(self, given: Mapping[str, float]) -> float:
        return self.intercept + sum(w * given[p] for p, w in zip(self.parents, self.weights, strict=True))

    def column(self, noise=None):
        """The mean as a column over the parents' columns, with noise added if a column of standard normals is given."""
        from pyspark.sql import functions as F

        out = F.lit(float(self.intercept))
        for p, w in zip(self.parents, self.weights, strict=True):
            out = out + F.lit(float(w)) * F.col(p)
        return out if noise is None else out + F.lit(math.sqrt(self.variance)) * noise

    def logpdf(self, value: float, given: Mapping[str, float]) -> float:
        return -0.5 * (math.log(2 * math.pi * self.variance) + (value - self.mean(given)) ** 2 / self.variance)


def random_linear_gaussian(variable: str, parents: Sequence[str] = (), seed: int = 0) -> LinearGaussianCPD:
    g = np.random.default_rng(seed)
    return LinearGaussianCPD(variable, float(g.normal()), float(abs(g.normal()) + 0.1), parents, g.normal(size=len(parents)).tolist())


class FunctionalCPD:
    """A variable drawn by ``draw(parents' values, generator)``, arrays in and an array out."""

    def __init__(self, variable: str, draw: Callable[[dict[str, np.ndarray], np.random.Generator], np.ndarray], parents: Sequence[str] = ()):
        self.variable, self.draw, self.parents = variable, draw, list(parents)
