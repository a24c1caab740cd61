"""Networks and inference: directed, undirected, cluster and factor graphs, temporal and Gaussian networks, chains and SEMs.

Inference works on tables of :mod:`tessera.models.tables`; what reads rows
(predicting, simulating, fitting) is DataFrame code.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.matrices import least_squares, moments
from tessera.models import graphs as g
from tessera.models.tables import CPD, Evidence, FunctionalCPD, LinearGaussianCPD, Table, identity, product, random_cpd, random_linear_gaussian

C = F.col


def eliminate(tables: Sequence[Table], keep: Sequence[str], order: Sequence[str] | None = None, best: bool = False) -> Table:
    """Sums (or maximises) all other variables out, one at a time."""
    away = {v for t in tables for v in t.variables} - set(keep)
    live = list(tables)
    for v in [v for v in order or elimination_order(tables) if v in away]:
        own = product([t for t in live if v in t.variables])
        live = [t for t in live if v not in t.variables] + [own.maximize([v]) if best else own.marginalize([v])]
    return product(live)


def interaction_graph(tables: Sequence[Table]) -> g.Undirected:
    return g.Undirected([p for t in tables for p in itertools.combinations(t.variables, 2)], [v for t in tables for v in t.variables])


def elimination_order(tables: Sequence[Table], heuristic: str = "min_fill") -> list[str]:
    sizes = {v: n for t in tables for v, n in t.sizes.items()}
    return interaction_graph(tables).order(heuristic, sizes)


class MarkovNetwork:
    """Tables over an undirected graph."""

    def __init__(self, tables: Sequence[Table]):
        self.tables = list(tables)

    def graph(self) -> g.Undirected:
        return interaction_graph(self.tables)

    def partition(self) -> float:
        return float(eliminate(self.tables, []).values)

    def query(self, variables: Sequence[str], evidence: Evidence | None = None, virtual: Mapping[str, Sequence[float]] | None = None) -> Table:
        """P(variables | evidence); ``virtual`` weighs a variable's states by their likelihoods."""
        soft = [Table([v], [len(w)], w) for v, w in (virtual or {}).items()]
        return eliminate([t.reduce(evidence or {}) for t in [*self.tables, *soft]], variables).keep(list(variables)).normalize()

    def marginals(self, variables: Sequence[str], evidence: Evidence | None = None) -> dict[str, Table]:
        return {v: self.query([v], evidence) for v in variables}

    def map_query(self, variables: Sequence[str] | None = None, evidence: Evidence | None = None) -> dict[str, int]:
        """The most probable states of variables (all if none are named), the others summed out."""
        names = list(variables or [v for v in dict.fromkeys(v for t in self.tables for v in t.variables) if v not in (evidence or {})])
        return self.query(names, evidence).best()

    def max_marginal(self, variables: Sequence[str], evidence: Evidence | None = None) -> Table:
        """The largest value of the whole for each state of the variables."""
        return eliminate([t.reduce(evidence or {}) for t in self.tables], variables, best=True).keep(list(variables))

    def markov_blanket(self, v: str) -> set[str]:
        return self.graph().near[v]

    def to_factor_graph(self) -> FactorGraph:
        return FactorGraph(self.tables)

    def to_junction_tree(self) -> JunctionTree:
        return JunctionTree(self.tables)

    def to_bayesian(self) -> BayesianNetwork:
        """A directed network of the same distribution, along a perfect order of the triangulated graph."""
        graph = self.graph()
        order = graph.order()
        filled = graph.triangulate(order)
        cpds = []
        for k, v in enumerate(order):
            parents = [w for w in order[k + 1 :] if w in filled.near[v]]
            from tessera.models.tables import from_table

            cpds.append(from_table(eliminate(self.tables, [v, *parents]).keep([v, *parents]).normalize(), v))
        return BayesianNetwork(cpds)


class BayesianNetwork:
    """CPDs over a directed graph."""

    def __init__(self, cpds: Sequence[CPD]):
        self.cpds = {c.variable: c for c in cpds}
        self.order = g.topological_order(self.cpds, self.edges())

    def edges(self) -> list[g.Edge]:
        return [(p, v) for v, c in self.cpds.items() for p in c.parents]

    def check(self) -> bool:
        """Whether parents are variables and the sizes agree."""
        return all(p in self.cpds and self.cpds[p].size == n for c in self.cpds.values() for p, n in zip(c.parents, c.sizes, strict=True))

    def markov(self) -> MarkovNetwork:
        return MarkovNetwork([c.table() for c in self.cpds.values()])

    def query(self, variables: Sequence[str], evidence: Evidence | None = None, virtual: Mapping[str, Sequence[float]] | None = None) -> Table:
        return self.markov().query(variables, evidence, virtual)

    def map_query(self, variables: Sequence[str] | None = None, evidence: Evidence | None = None) -> dict[str, int]:
        return self.markov().map_query(variables, evidence)

    def do(self, states: Evidence) -> BayesianNetwork:
        """The network with variables set from outside."""
        fixed = [CPD(v, c.size, np.eye(c.size)[states[v]]) if v in states else c for v, c in self.cpds.items()]
        return BayesianNetwork(fixed)

    def effect(self, treatment: str, outcome: str, a: int = 1, b: int = 0) -> float:
        """The mean state of the outcome when the treatment is set to a, less that when set to b."""
        mean = lambda s: float(np.arange(self.cpds[outcome].size) @ self.do({treatment: s}).query([outcome]).values)
        return mean(a) - mean(b)

    def is_imap(self, joint: Table) -> bool:
        """Whether the network's product is the table."""
        names = list(self.cpds)
        return bool(np.allclose(product([c.table() for c in self.cpds.values()]).aligned(names), joint.aligned(names), atol=1e-9))

    def log_probability(self, data: DataFrame) -> Column:
        """The log probability of a row of states, a column over the variables' columns."""
        total = F.lit(0.0)
        for c in self.cpds.values():
            total = total + F.ln(_cell(c))
        return total

    def simulate(self, spark: SparkSession, n: int, seed: int, evidence: Evidence | None = None) -> DataFrame:
        """n rows drawn along the order; with evidence by rejection, in rounds until there are n."""
        rows = None
        share = float(self.query(list(evidence), {}).reduce(evidence).values) if evidence else 1.0
        if share <= 0:
            raise ValueError("evidence without probability")
        for k in range(60):
            draw = math.ceil(n / share * 1.1) + 10 if evidence else n
            new = spark.range(draw).withColumnRenamed("id", "row")
            for i, v in enumerate(self.order):
                cut = np.cumsum(self.cpds[v].values, 0)[:-1]
                u = F.rand(seed * 1000 + k * 100 + i)
                new = new.withColumn("_u", u)
                state = sum(((C("_u") >= _pick(self.cpds[v], row)).cast("int") for row in cut), F.lit(0))
                new = new.withColumn(v, state).drop("_u")
            for v, s in (evidence or {}).items():
                new = new.filter(C(v) == s)
            rows = new if rows is None else rows.unionByName(new)
            if not evidence or rows.count() >= n:
                return rows.limit(n).select(*self.order)
        raise ValueError("too little evidence")

    def posterior(self, data: DataFrame, target: str) -> DataFrame:
        """Distinct patterns of the other variables with ``p``, the target's distribution (an array) given them."""
        seen = [c for c in data.columns if c in self.cpds and c != target]
        patterns = data.select(*seen).distinct()
        net = self.markov()

        @F.pandas_udf("array<double>")
        def p(*cols: pd.Series) -> pd.Series:
            return pd.Series([net.query([target], {v: int(s) for v, s in zip(seen, row, strict=True) if s is not None and s == s}).values for row in zip(*cols, strict=True)])

        return patterns.withColumn("p", p(*[C(c) for c in seen]))

    def predict(self, data: DataFrame, target: str) -> DataFrame:
        """``data`` with the target's most probable state, found once for each pattern; nulls are unseen."""
        seen = [c for c in data.columns if c in self.cpds and c != target]
        best = self.posterior(data, target).withColumn("_best", F.array_position("p", F.array_max("p")).cast("int") - 1)
        on = [C(f"_l_{c}").eqNullSafe(C(c)) for c in seen]
        right = best.select(*[C(c).alias(f"_l_{c}") for c in seen], "_best")
        both = data.drop(target).join(right, on) if seen else data.drop(target).crossJoin(F.broadcast(right))
        return both.drop(*[f"_l_{c}" for c in seen]).withColumnRenamed("_best", target)

    def updated(self, data: DataFrame, rows_before: int) -> BayesianNetwork:
        """CPDs after more rows: the old ones count as ``rows_before`` rows; states out of range are skipped."""
        out = []
        for c in self.cpds.values():
            names = [c.variable, *c.parents]
            counts = np.zeros((c.size, *c.sizes))
            for r in data.groupBy(*names).count().collect():  # cells of a table
                at = r[:-1]
                if all(s is not None and 0 <= s < n for s, n in zip(at, counts.shape, strict=True)):
                    counts[tuple(at)] = r[-1]
            weight = self.query(c.parents).values.reshape(-1) if c.parents else np.ones(1)
            both = counts.reshape(c.size, -1) + c.values * weight * rows_before
            total = both.sum(0)
            out.append(CPD(c.variable, c.size, np.where(total > 0, both / np.where(total > 0, total, 1), c.values), c.parents, c.sizes))
        return BayesianNetwork(out)


def _pick(c: CPD, row: np.ndarray) -> Column:
    """The number of a row of a CPD for the parents' columns."""
    place = F.lit(0)
    for p, n in zip(c.parents, c.sizes, strict=True):
        place = place * n + C(p)
    return F.get(F.array(*[F.lit(float(x)) for x in row]), place)


def _cell(c: CPD) -> Column:
    place = C(c.variable)
    for p, n in zip(c.parents, c.sizes, strict=True):
        place = place * n + C(p)
    return F.get(F.array(*[F.lit(float(x)) for x in c.values.ravel()]), place)


def random_network(n: int, probability: float, states: int, seed: int) -> BayesianNetwork:
    edges = g.random_dag(n, probability, seed)
    names = [f"X{k}" for k in range(n)]
    parents = {v: sorted(a for a, b in edges if b == v) for v in names}
    return BayesianNetwork([random_cpd(v, states, parents[v], [states] * len(parents[v]), seed + k) for k, v in enumerate(names)])


class FactorGraph:
    """Variables and tables as two kinds of nodes."""

    def __init__(self, tables: Sequence[Table]):
        self.tables = list(tables)

    def edges(self) -> list[tuple[str, int]]:
        return [(v, k) for k, t in enumerate(self.tables) for v in t.variables]

    def to_markov(self) -> MarkovNetwork:
        return MarkovNetwork(self.tables)


class ClusterGraph:
    """Sets of variables, and links by index whose separators are what both ends share."""

    def __init__(self, clusters: Sequence[frozenset[str]], links: Sequence[tuple[int, int]]):
        self.clusters, self.links = list(clusters), list(links)

    def separator(self, i: int, j: int) -> frozenset[str]:
        return self.clusters[i] & self.clusters[j]

    def running_intersection(self) -> bool:
        """Whether the clusters that hold a variable hang together, for each one."""
        for v in frozenset().union(*self.clusters):
            own = [k for k, c in enumerate(self.clusters) if v in c]
            links = [(str(a), str(b)) for a, b in self.links if a in own and b in own]
            if len(own) > 1 and (not links or len(g.dfs(links, str(own[0]), False)) != len(own)):
                return False
        return True


class JunctionTree(ClusterGraph):
    """Cliques of the triangulated graph; :meth:`calibrate` passes messages inwards and outwards."""

    def __init__(self, tables: Sequence[Table]):
        graph = interaction_graph(tables)
        super().__init__(*graph.junction_tree())
        sizes = {v: n for t in tables for v, n in t.sizes.items()}
        self.potentials = [identity(sorted(c), [sizes[v] for v in sorted(c)]) for c in self.clusters]
        self.scale = 1.0
        for t in tables:
            home = next((k for k, c in enumerate(self.clusters) if set(t.variables) <= c), None)
            if home is None:
                self.scale *= float(t.values)
            else:
                self.potentials[home] = self.potentials[home] * t
        self.beliefs: list[Table] = []

    def schedule(self) -> list[tuple[int, int]]:
        """Messages from the leaves to a root of each part, then back."""
        near = {k: [b if a == k else a for a, b in self.links if k in (a, b)] for k in range(len(self.clusters))}
        seen: set[int] = set()
        inward: list[tuple[int, int]] = []
        for root in near:
            if root in seen:
                continue
            order, todo = [], [(root, -1)]
            while todo:
                k, up = todo.pop()
                seen.add(k)
                order.append((k, up))
                todo += [(m, k) for m in near[k] if m != up]
            inward += [(k, up) for k, up in reversed(order) if up >= 0]
        return inward + [(b, a) for a, b in reversed(inward)]

    def calibrate(self, evidence: Evidence | None = None, best: bool = False) -> JunctionTree:
        """Beliefs of all cliques, of sums or of largest values."""
        start = []
        for p in self.potentials:
            own = {v: s for v, s in (evidence or {}).items() if v in p.variables}
            mask = product([Table([v], [p.sizes[v]], np.eye(p.sizes[v])[s]) for v, s in own.items()])
            start.append(p * mask)
        messages: dict[tuple[int, int], Table] = {}
        for i, j in self.schedule():
            got = product([start[i], *[m for (a, b), m in messages.items() if b == i and a != j]])
            away = [v for v in got.variables if v not in self.separator(i, j)]
            messages[i, j] = got.maximize(away) if best else got.marginalize(away)
        self.beliefs = [product([p, *[m for (_, b), m in messages.items() if b == k]]) for k, p in enumerate(start)]
        self.best = best
        return self

    def is_calibrated(self) -> bool:
        """Whether neighbours agree on their separators."""
        side = lambda k, s: (self.beliefs[k]._away([v for v in self.beliefs[k].variables if v not in s], np.max if self.best else np.sum)).aligned(sorted(s))
        return bool(self.beliefs) and all(np.allclose(side(i, self.separator(i, j)), side(j, self.separator(i, j))) for i, j in self.links)

    def separator_beliefs(self) -> dict[tuple[int, int], Table]:
        return {(i, j): self.beliefs[i].keep(sorted(self.separator(i, j))) for i, j in self.links}

    def query(self, variables: Sequence[str], evidence: Evidence | None = None) -> Table:
        """From one clique's belief, or over the whole tree if no clique holds all variables."""
        self.calibrate(evidence)
        home = next((b for b in self.beliefs if set(variables) <= set(b.variables)), None)
        if home is not None:
            return home.keep(list(variables)).normalize()
        return eliminate([p.reduce(evidence or {}) for p in self.potentials], variables).keep(list(variables)).normalize()

    def map_query(self, evidence: Evidence | None = None) -> dict[str, int]:
        """The most probable states of all variables: clique by clique, those before fixed."""
        self.calibrate(evidence, best=True)
        out: dict[str, int] = dict(evidence or {})
        near = {k: [b if a == k else a for a, b in self.links if k in (a, b)] for k in range(len(self.clusters))}
        seen: set[int] = set()
        for root in near:
            todo = [root] if root not in seen else []
            while todo:
                k = todo.pop()
                seen.add(k)
                out |= self.beliefs[k].reduce(out).best()
                todo += [m for m in near[k] if m not in seen]
        return {v: s for v, s in out.items() if v not in (evidence or {})}


class MPLP:
    """The most probable states by block descent on the dual: messages from tables to variables.

    ``dual`` bounds the value from above, ``gap`` is what is left to the states found.
    """

    def __init__(self, tables: Sequence[Table], floor: float = 1e-300):
        self.tables = list(tables)
        self.log = [Table(t.variables, t.values.shape, np.log(np.maximum(t.values, floor))) for t in tables]
        self.sizes = {v: n for t in tables for v, n in t.sizes.items()}

    def run(self, rounds: int = 1000, tolerance: float = 1e-9) -> dict[str, int]:
        single = {v: sum((t.values for t in self.log if t.variables == [v]), np.zeros(n)) for v, n in self.sizes.items()}
        joint = [t for t in self.log if len(t.variables) > 1]
        to = {(k, v): np.zeros(self.sizes[v]) for k, t in enumerate(joint) for v in t.variables}
        last = math.inf
        for _ in range(rounds):
            for k, t in enumerate(joint):
                away = {v: single[v] + sum((m for (j, w), m in to.items() if w == v and j != k), np.zeros(self.sizes[v])) for v in t.variables}
                whole = t + sum((Table([v], [len(a)], a) for v, a in away.items()), Table([], [], 0.0))
                for v in t.variables:
                    to[k, v] = whole.maximize([w for w in t.variables if w != v]).values / len(t.variables) - away[v]
            belief = {v: single[v] + sum((m for (j, w), m in to.items() if w == v), np.zeros(n)) for v, n in self.sizes.items()}
            rest = sum(float((t + sum((Table([v], [self.sizes[v]], -to[k, v]) for v in t.variables), Table([], [], 0.0))).values.max()) for k, t in enumerate(joint))
            self.dual = sum(float(b.max()) for b in belief.values()) + rest
            if last - self.dual < tolerance:
                break
            last = self.dual
        self.states = {v: int(np.argmax(b)) for v, b in belief.items()}
        self.value = float(sum(t.reduce(self.states).values for t in self.log))
        self.gap = self.dual - self.value
        return self.states


class Sampling:
    """Approximate answers from drawn rows."""

    def __init__(self, net: BayesianNetwork):
        self.net = net

    def likelihood_weighted(self, spark: SparkSession, n: int, seed: int, evidence: Evidence) -> DataFrame:
        """Rows with the evidence set, and ``weight``, its probability given each row."""
        net = self.net.do(evidence)
        weight = F.lit(1.0)
        for v in evidence:
            weight = weight * _cell(self.net.cpds[v])
        return net.simulate(spark, n, seed).withColumn("weight", weight)

    def query(self, spark: SparkSession, variables: Sequence[str], evidence: Evidence, n: int, seed: int, method: str = "weighted") -> DataFrame:
        """(variables..., v): shares of the weights; ``weighted``, ``rejection`` or ``gibbs``."""
        if method == "weighted":
            rows = self.likelihood_weighted(spark, n, seed, evidence)
        elif method == "rejection":
            rows = self.net.simulate(spark, n, seed, evidence).withColumn("weight", F.lit(1.0))
        else:
            rows = self.gibbs(spark, n, seed, evidence).withColumn("weight", F.lit(1.0))
        got = rows.groupBy(*variables).agg(F.sum("weight").alias("w"))
        return got.select(*variables, (C("w") / F.sum("w").over(Window.partitionBy())).alias("v"))  # cells of a table

    def gibbs(self, spark: SparkSession, n: int, seed: int, evidence: Evidence | None = None, burn_in: int = 100, thin: int = 1, chains: int = 8) -> DataFrame:
        """Rows of chains that draw one variable at a time given its blanket; a chain a partition."""
        tables = [c.table() for c in self.net.cpds.values()]
        names, fixed = list(self.net.cpds), dict(evidence or {})
        each = math.ceil(n / chains)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for chain in (int(c) for batch in batches for c in batch.id):
                r = np.random.default_rng([seed, chain])
                state = {v: fixed.get(v, int(r.integers(self.net.cpds[v].size))) for v in names}
                rows = []
                for step in range(burn_in + each * thin):
                    for v in names:
                        if v in fixed:
                            continue
                        others = {w: s for w, s in state.items() if w != v}
                        p = np.prod([t.reduce(others).values for t in tables if v in t.variables], axis=0)
                        total = p.sum()
                        state[v] = int(r.choice(len(p), p=p / total)) if total > 0 else int(r.integers(len(p)))
                    if step >= burn_in and (step - burn_in) % thin == 0:
                        rows.append([state[v] for v in names])
                yield pd.DataFrame(rows, columns=names)

        return spark.range(0, chains, 1, chains).mapInPandas(run, ", ".join(f"`{v}` int" for v in names)).limit(n)


class DynamicNetwork:
    """A first slice and transitions: CPDs whose parents are ``name`` of this slice or ``name-`` of the one before."""

    def __init__(self, first: Sequence[CPD], transition: Sequence[CPD]):
        self.first, self.transition = list(first), list(transition)
        self.names = [c.variable for c in first]

    def unrolled(self, slices: int) -> BayesianNetwork:
        at = lambda v, t: f"{v[:-1]}@{t - 1}" if v.endswith("-") else f"{v}@{t}"
        out = []
        for t in range(slices):
            for c in self.first if t == 0 else self.transition:
                out.append(CPD(at(c.variable, t), c.size, c.values, [at(p, t) for p in c.parents], c.sizes))
        return BayesianNetwork(out)

    def _step(self, belief: Table, evidence: Evidence) -> Table:
        old = Table([f"{v}-" for v in belief.variables], belief.values.shape, belief.values)
        tables = [c.table().reduce(evidence) for c in self.transition]
        keep = [v for v in self.names if v not in evidence]
        got = eliminate([old, *tables], keep).keep(keep)
        whole = got * product([Table([v], [c.size], np.eye(c.size)[evidence[v]]) for v in self.names if v in evidence for c in self.first if c.variable == v])
        return whole.keep(self.names)

    def filtered(self, evidence: Sequence[Evidence]) -> list[Table]:
        """P(slice | evidence so far) for each slice."""
        out = []
        for t, e in enumerate(evidence):
            if t == 0:
                mask = product([Table([v], [c.size], np.eye(c.size)[e[v]]) for c in self.first for v in [c.variable] if v in e])
                belief = (product([c.table() for c in self.first]) * mask).keep(self.names)
            else:
                belief = self._step(out[-1], e)
            out.append(belief.normalize())
        return out

    def smoothed(self, evidence: Sequence[Evidence]) -> list[Table]:
        """P(slice | all evidence), forwards and then backwards."""
        forward = self.filtered(evidence)
        out = [forward[-1]]
        for t in range(len(evidence) - 2, -1, -1):
            old = Table([f"{v}-" for v in self.names], forward[t].values.shape, forward[t].values)
            both = product([old, *[c.table() for c in self.transition]])
            ahead = both.keep(self.names)
            got = (both * (out[0] / ahead)).keep([f"{v}-" for v in self.names])
            out.insert(0, Table(self.names, got.values.shape, got.values).normalize())
        return out

    def simulate(self, spark: SparkSession, sequences: int, slices: int, seed: int) -> DataFrame:
        """(sequence, t, variables...): all sequences advance together, a slice a step."""
        wide = self.unrolled(slices).simulate(spark, sequences, seed).withColumn("sequence", F.monotonically_increasing_id())
        rows = F.array(*[F.struct(F.lit(t).alias("t"), *[C(f"`{v}@{t}`").alias(v) for v in self.names]) for t in range(slices)])
        return wide.select("sequence", F.explode(rows).alias("r")).select("sequence", "r.*")

    @staticmethod
    def fit(data: DataFrame, sequence: str, time: str, first: Mapping[str, Sequence[str]], transition: Mapping[str, Sequence[str]], sizes: Mapping[str, int]) -> DynamicNetwork:
        """CPDs by counts: first rows of sequences, and rows with the one before by a window."""
        w = Window.partitionBy(sequence).orderBy(time)
        lagged = data.withColumns({f"{v}-": F.lag(v).over(w) for v in sizes} | {"_n": F.row_number().over(w)})

        def counted(rows: DataFrame, v: str, parents: Sequence[str]) -> CPD:
            shape = [sizes[x.rstrip("-")] for x in (v, *parents)]
            cells = np.zeros(shape)
            for r in rows.groupBy(v, *[f"`{p}`" for p in parents]).count().collect():  # cells of a table
                cells[tuple(r[:-1])] = r[-1]
            cells = cells.reshape(shape[0], -1)
            total = cells.sum(0)
            return CPD(v, shape[0], np.where(total > 0, cells / np.where(total > 0, total, 1), 1 / shape[0]), parents, shape[1:])

        return DynamicNetwork([counted(lagged.filter("_n = 1"), v, p) for v, p in first.items()], [counted(lagged.filter("_n > 1"), v, p) for v, p in transition.items()])


class LinearGaussianNetwork:
    """Linear Gaussian CPDs over a directed graph."""

    def __init__(self, cpds: Sequence[LinearGaussianCPD]):
        self.cpds = {c.variable: c for c in cpds}
        self.order = g.topological_order(self.cpds, [(p, c.variable) for c in cpds for p in c.parents])

    @staticmethod
    def fit(data: DataFrame, parents: Mapping[str, Sequence[str]]) -> LinearGaussianNetwork:
        """Least squares for each variable, all from one Gram matrix."""
        names = list(parents)
        n, sums, gram = moments(data, [F.lit(1.0), *names])
        at = {v: k + 1 for k, v in enumerate(names)}
        out = []
        for v, ps in parents.items():
            own = [0, *[at[p] for p in ps]]
            beta = np.linalg.solve(gram[np.ix_(own, own)], gram[own, at[v]])
            rest = gram[at[v], at[v]] - beta @ gram[own, at[v]]
            out.append(LinearGaussianCPD(v, float(beta[0]), max(0.0, float(rest / n)), list(ps), beta[1:].tolist()))
        return LinearGaussianNetwork(out)

    def joint(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean and covariance in the network's order."""
        at = {v: k for k, v in enumerate(self.order)}
        n = len(at)
        mean, b, noise = np.zeros(n), np.zeros((n, n)), np.zeros(n)
        for v, k in at.items():
            c = self.cpds[v]
            for p, w in zip(c.parents, c.weights, strict=True):
                b[k, at[p]] = w
            mean[k] = c.intercept + b[k] @ mean
            noise[k] = c.variance
        inside = np.linalg.inv(np.eye(n) - b)
        return mean, inside @ np.diag(noise) @ inside.T

    def predict(self, known: Mapping[str, float]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Mean and covariance of the other variables."""
        mean, cov = self.joint()
        have = [k for k, v in enumerate(self.order) if v in known]
        miss = [k for k in range(len(self.order)) if k not in have]
        gain = cov[np.ix_(miss, have)] @ np.linalg.inv(cov[np.ix_(have, have)]) if have else np.zeros((len(miss), 0))
        off = np.array([known[self.order[k]] for k in have]) - mean[have]
        return [self.order[k] for k in miss], mean[miss] + gain @ off, cov[np.ix_(miss, miss)] - gain @ cov[np.ix_(have, miss)]

    def log_likelihood(self, data: DataFrame) -> DataFrame:
        terms = [-0.5 * (math.log(2 * math.pi * c.variance) + F.pow(C(v) - c.column(), F.lit(2.0)) / c.variance) for v, c in self.cpds.items()]
        return data.agg(F.sum(sum(terms[1:], terms[0])).alias("log_likelihood"))

    def simulate(self, spark: SparkSession, n: int, seed: int) -> DataFrame:
        rows = spark.range(n)
        for k, v in enumerate(self.order):
            rows = rows.withColumn(v, self.cpds[v].column(F.randn(seed + k)))
        return rows.select(*self.order)


def random_linear_gaussian_network(n: int, probability: float, seed: int) -> LinearGaussianNetwork:
    edges = g.random_dag(n, probability, seed)
    return LinearGaussianNetwork([random_linear_gaussian(f"X{k}", sorted(a for a, b in edges if b == f"X{k}"), seed + k) for k in range(n)])


class FunctionalNetwork:
    """CPDs that are functions; drawn batch by batch in the network's order."""

    def __init__(self, cpds: Sequence[FunctionalCPD]):
        self.cpds = {c.variable: c for c in cpds}
        self.order = g.topological_order(self.cpds, [(p, c.variable) for c in cpds for p in c.parents])

    def simulate(self, spark: SparkSession, n: int, seed: int, do: Mapping[str, float] | None = None) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                r = np.random.default_rng([seed, int(batch.id.iloc[0])])
                out: dict[str, np.ndarray] = {}
                for v in self.order:
                    c = self.cpds[v]
                    fixed = (do or {}).get(v)
                    out[v] = np.full(len(batch), float(fixed)) if fixed is not None else np.broadcast_to(c.draw({p: out[p] for p in c.parents} | {"size": len(batch)}, r), len(batch)).astype(float)
                yield pd.DataFrame(out)

        return spark.range(n).mapInPandas(run, ", ".join(f"`{v}` double" for v in self.order))


class MarkovChain:
    """States 0, 1, ... and their transition matrix."""

    def __init__(self, transition, start: Sequence[float] | None = None):
        self.p = np.asarray(transition, float)
        if not np.allclose(self.p.sum(1), 1):
            raise ValueError("a row does not sum to 1")
        self.start = np.full(len(self.p), 1 / len(self.p)) if start is None else np.asarray(start, float)

    @staticmethod
    def fit(data: DataFrame, sequence: str, time: str, state: str, size: int) -> MarkovChain:
        """Counts of neighbours within sequences; states that nothing leaves get a uniform row."""
        after = F.lead(state).over(Window.partitionBy(sequence).orderBy(time))
        counts = np.zeros((size, size))
        for r in data.withColumn("_next", after).filter(C("_next").isNotNull()).groupBy(state, "_next").count().collect():  # cells of the matrix
            counts[r[0], r[1]] = r[2]
        total = counts.sum(1, keepdims=True)
        return MarkovChain(np.where(total > 0, counts / np.where(total > 0, total, 1), 1 / size))

    def stationary(self) -> np.ndarray:
        n = len(self.p)
        a = np.vstack([self.p.T - np.eye(n), np.ones(n)])
        return np.linalg.lstsq(a, np.append(np.zeros(n), 1), rcond=None)[0]

    def after(self, steps: int) -> np.ndarray:
        return self.start @ np.linalg.matrix_power(self.p, steps)

    def _links(self) -> list[g.Edge]:
        return [(str(i), str(j)) for i, j in zip(*np.nonzero(self.p), strict=True)]

    def is_irreducible(self) -> bool:
        parts = g.strong_components(self._links())
        return len(parts) == 1 and len(parts[0]) == len(self.p)

    def is_ergodic(self) -> bool:
        """Whether some power has no zero."""
        n = len(self.p)
        return bool((np.linalg.matrix_power((self.p > 0).astype(float) / n, (n - 1) ** 2 + 1) > 0).all())

    def absorbing(self) -> list[int]:
        return [k for k in range(len(self.p)) if self.p[k, k] == 1]

    def sample(self, spark: SparkSession, sequences: int, steps: int, seed: int) -> DataFrame:
        """(sequence, path): an array of states for each sequence, folded in the JVM."""
        rows = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in np.cumsum(self.p, 1)])
        pick = lambda row, u: F.least(F.size(F.filter(row, lambda x: x <= u)), F.lit(len(self.p) - 1))
        first = pick(F.array(*[F.lit(float(x)) for x in np.cumsum(self.start)]), F.rand(seed))
        noise = F.array(*[F.rand(seed + k + 1) for k in range(steps)])
        out = spark.range(sequences).select(C("id").alias("sequence"), F.array(first).alias("s"), noise.alias("u"))
        return out.select("sequence", F.aggregate("u", C("s"), lambda s, u: F.concat(s, F.array(pick(F.get(rows, F.element_at(s, -1)), u)))).alias("path"))


class SEM:
    """Linear structural equations: ``equations`` names each variable's causes, ``ties`` correlated errors."""

    def __init__(self, equations: Mapping[str, Sequence[str]], ties: Sequence[g.Edge] = (), latent: Sequence[str] = ()):
        self.equations, self.ties, self.latent = {k: list(v) for k, v in equations.items()}, list(ties), list(latent)
        for v in {p for ps in equations.values() for p in ps}:
            self.equations.setdefault(v, [])
        self.order = g.topological_order(self.equations, self.edges())
        self.coefficients: dict[g.Edge, float] = {}
        self.noise: dict[str, float] = dict.fromkeys(self.equations, 1.0)

    def edges(self) -> list[g.Edge]:
        return [(p, v) for v, ps in self.equations.items() for p in ps]

    @staticmethod
    def from_lavaan(text: str) -> SEM:
        directed, ties = g.from_lavaan(text)
        latent = [x.split("=~")[0].strip() for x in text.splitlines() if "=~" in x]
        return SEM.from_graph(directed, ties, latent)

    @staticmethod
    def from_graph(edges: Sequence[g.Edge], ties: Sequence[g.Edge] = (), latent: Sequence[str] = ()) -> SEM:
        out: dict[str, list[str]] = {}
        for a, b in edges:
            out.setdefault(a, [])
            out.setdefault(b, []).append(a)
        return SEM(out, ties, latent)

    @staticmethod
    def from_ram(names: Sequence[str], a: np.ndarray, s: np.ndarray) -> SEM:
        """From one-headed (a[i, j]: j causes i) and two-headed arrows."""
        a, s = np.asarray(a, float), np.asarray(s, float)
        out = SEM.from_graph([(names[j], names[i]) for i, j in zip(*np.nonzero(a), strict=True)], [(names[i], names[j]) for i, j in itertools.combinations(range(len(names)), 2) if s[i, j]])
        for v in names:
            out.equations.setdefault(v, [])
        out.order = g.topological_order(out.equations, out.edges())
        out.coefficients = {(names[j], names[i]): float(a[i, j]) for i, j in zip(*np.nonzero(a), strict=True)}
        out.noise = {v: float(s[k, k]) for k, v in enumerate(names)}
        return out

    @staticmethod
    def from_lisrel(names_x: Sequence[str], names_eta: Sequence[str], beta: np.ndarray, gamma: np.ndarray, psi: np.ndarray, phi: np.ndarray) -> SEM:
        """eta = beta eta + gamma xi + zeta with covariances psi (of zeta) and phi (of xi)."""
        n, m = len(names_eta), len(names_x)
        a, s = np.zeros((n + m, n + m)), np.zeros((n + m, n + m))
        a[:n, :n], a[:n, n:], s[:n, :n], s[n:, n:] = beta, gamma, psi, phi
        return SEM.from_ram([*names_eta, *names_x], a, s)

    def fit(self, data: DataFrame) -> SEM:
        """Least squares equation by equation over the observed variables, from one Gram matrix."""
        net = LinearGaussianNetwork.fit(data, {v: self.equations[v] for v in self.order if v not in self.latent and not set(self.equations[v]) & set(self.latent)})
        self.coefficients = {(p, v): w for v, c in net.cpds.items() for p, w in zip(c.parents, c.weights, strict=True)}
        self.noise |= {v: c.variance for v, c in net.cpds.items()}
        return self

    def covariance(self) -> np.ndarray:
        """What the coefficients and noises imply, in ``order``."""
        at = {v: k for k, v in enumerate(self.order)}
        b = np.zeros((len(at), len(at)))
        for (p, v), w in self.coefficients.items():
            b[at[v], at[p]] = w
        inside = np.linalg.inv(np.eye(len(at)) - b)
        return inside @ np.diag([self.noise[v] for v in self.order]) @ inside.T

    def simulate(self, spark: SparkSession, n: int, seed: int) -> DataFrame:
        cpds = [LinearGaussianCPD(v, 0.0, self.noise[v], ps, [self.coefficients.get((p, v), 1.0) for p in ps]) for v, ps in self.equations.items()]
        return LinearGaussianNetwork(cpds).simulate(spark, n, seed)


def two_stage(data: DataFrame, outcome: str, treatment: str, instruments: Sequence[str], covariates: Sequence[str] = ()) -> dict[str, float]:
    """Two-stage least squares from one Gram matrix: the effect, its error and the first stage's F."""
    names = [outcome, treatment, *instruments, *covariates]
    n, _, gram = moments(data, [F.lit(1.0), *names])
    at = {v: k + 1 for k, v in enumerate(names)}
    z, x = [0, *[at[v] for v in (*instruments, *covariates)]], [0, at[treatment], *[at[v] for v in covariates]]
    zz, zx, zy = gram[np.ix_(z, z)], gram[np.ix_(z, x)], gram[z, at[outcome]]
    middle = zx.T @ np.linalg.solve(zz, zx)
    beta = np.linalg.solve(middle, zx.T @ np.linalg.solve(zz, zy))
    rest = gram[at[outcome], at[outcome]] - 2 * beta @ gram[x, at[outcome]] + beta @ gram[np.ix_(x, x)] @ beta
    error = math.sqrt(rest / (n - len(x)) * np.linalg.inv(middle)[1, 1])
    t = at[treatment]
    left = lambda cols: gram[t, t] - gram[cols, t] @ np.linalg.solve(gram[np.ix_(cols, cols)], gram[cols, t])
    small, full = left([0, *[at[v] for v in covariates]]), left(z)
    f = (small - full) / len(instruments) / (full / (n - len(z)))
    return {"effect": float(beta[1]), "stderr": error, "first_stage_f": float(f)}


def adjusted(data: DataFrame, outcome: str, treatment: str, covariates: Sequence[str] = ()) -> dict[str, float]:
    """The treatment's coefficient in a linear fit with covariates, and its error."""
    fit = least_squares(data, outcome, treatment, *covariates)
    return {"effect": float(fit["coefficients"][1]), "stderr": float(fit["errors"][1])}


def double_ml(data: DataFrame, outcome: str, treatment: str, covariates: Sequence[str], order: str, folds: int = 5) -> dict[str, float]:
    """Residual on residual with contiguous folds of the order; each fold's moments are subtracted from the total.

    Linear nuisance models; one pass for the folds' moments.
    """
    from tessera.operators.ranks import numbered

    names = [*covariates, treatment, outcome]
    rows = numbered(data.dropna(subset=names), [order], "_place")
    n = rows.count()
    size = max(1, n // folds)
    rows = rows.withColumn("_fold", F.least(F.floor(C("_place") / size), F.lit(folds - 1)))
    x = [F.lit(1.0), *[C(c).cast("double") for c in names]]
    k = len(x)
    by = rows.groupBy("_fold").agg(F.count(F.lit(1)).alias("n"), *[F.sum(a * b) for i, a in enumerate(x) for b in x[: i + 1]]).collect()  # one row a fold
    grams = []
    for r in by:
        m = np.zeros((k, k))
        m[np.tril_indices(k)] = r[2:]
        grams.append(m + np.tril(m, -1).T)
    total, z = sum(grams), list(range(k - 2))
    tt = ty = yy = 0.0
    for m in grams:
        rest = total - m
        a, b = (np.linalg.solve(rest[np.ix_(z, z)], rest[z, c]) for c in (k - 2, k - 1))
        u, w = np.concatenate([-a, [1, 0]]), np.concatenate([-b, [0, 1]])  # residuals as combinations of columns
        tt, ty, yy = tt + u @ m @ u, ty + u @ m @ w, yy + w @ m @ w
    effect = ty / tt
    rest = yy - 2 * effect * ty + effect**2 * tt
    error = math.sqrt(rest / (n - 1) / tt)
    return {"effect": float(effect), "stderr": error, "low": float(effect - 1.959963984540054 * error), "high": float(effect + 1.959963984540054 * error), "rows": n}


Closure = Callable[[dict[str, float], float], float]


class SimpleCausalModel:
    """Named equations of parents and noise; for single rows and counterfactuals with the noise held."""

    def __init__(self, equations: Mapping[str, tuple[Sequence[str], Closure]]):
        self.equations = dict(equations)
        self.order = g.topological_order(self.equations, [(p, v) for v, (ps, _) in equations.items() for p in ps])

    def evaluate(self, noise: Mapping[str, float], do: Mapping[str, float] | None = None) -> dict[str, float]:
        out: dict[str, float] = {}
        for v in self.order:
            parents, f = self.equations[v]
            out[v] = do[v] if do and v in do else f({p: out[p] for p in parents}, noise.get(v, 0.0))
        return out
