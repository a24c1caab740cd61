"""Learning models from data: scores, searches, tests and estimators.

Counts and moments are Spark aggregates; many families' counts come from one
pass with grouping sets. Searches then run on the driver over those numbers.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.matrices import moments
from tessera.models import graphs as g
from tessera.models.networks import BayesianNetwork, LinearGaussianNetwork
from tessera.models.tables import CPD, Table, from_table
from tessera.operators.independence import stratified
from tessera.operators.stats import p_chi2, p_f, p_normal, p_t

C = F.col
Family = tuple[str, frozenset[str]]


# scores


def counts(data: DataFrame, families: Iterable[Sequence[str]]) -> dict[tuple[str, ...], dict[tuple, int]]:
    """Counts of the cells of each set of columns, all in one pass."""
    sets = sorted({tuple(sorted(f)) for f in families if f})
    if not sets:
        return {}
    names = sorted({c for s in sets for c in s})
    bits = {c: 1 << (len(names) - 1 - k) for k, c in enumerate(names)}
    rows = data.groupingSets([[C(c) for c in s] for s in sets], *[C(c) for c in names]).agg(F.grouping_id().alias("_id"), F.count(F.lit(1)).alias("_n")).collect()  # cells of tables
    by_id = {sum(b for c, b in bits.items() if c not in s): s for s in sets}
    out: dict[tuple[str, ...], dict[tuple, int]] = {s: {} for s in sets}
    for r in rows:
        s = by_id[r["_id"]]
        out[s][tuple(r[c] for c in s)] = r["_n"]
    return out


class DiscreteScore:
    """``loglik``, ``aic``, ``bic``, ``k2``, ``bdeu`` or ``bds`` of families; asked for in batches, kept once known."""

    def __init__(self, data: DataFrame, kind: str = "bic", size: float = 10.0):
        self.data, self.kind, self.size = data, kind, size
        self.cells: dict[tuple[str, ...], dict[tuple, int]] = {}
        row = data.agg(F.count(F.lit(1)), *[F.count_distinct(c) for c in data.columns]).first()
        self.rows, self.cards = row[0], dict(zip(data.columns, row[1:], strict=True))

    def prefetch(self, families: Iterable[Family]) -> None:
        wanted = {tuple(sorted({v, *ps})) for v, ps in families} - self.cells.keys()
        if wanted:
            self.cells |= counts(self.data, wanted)

    def local(self, v: str, parents: Iterable[str]) -> float:
        parents = sorted(parents)
        self.prefetch([(v, frozenset(parents))])
        names = tuple(sorted([v, *parents]))
        place = names.index(v)
        totals: dict[tuple, int] = {}
        for key, n in self.cells[names].items():
            rest = key[:place] + key[place + 1 :]
            totals[rest] = totals.get(rest, 0) + n
        r, q = self.cards[v], math.prod(self.cards[p] for p in parents)
        if self.kind in ("loglik", "aic", "bic"):
            fit = sum(n * math.log(n / totals[key[:place] + key[place + 1 :]]) for key, n in self.cells[names].items())
            return fit - {"loglik": 0.0, "aic": 1.0, "bic": 0.5 * math.log(max(self.rows, 1))}[self.kind] * (r - 1) * q
        alpha = {"k2": 1.0, "bdeu": self.size / (q * r), "bds": self.size / (q * q * r)}[self.kind]
        # configurations that no row has add nothing
        out = sum(math.lgamma(r * alpha) - math.lgamma(r * alpha + t) for t in totals.values())
        out += sum(math.lgamma(alpha + n) - math.lgamma(alpha) for n in self.cells[names].values())
        return out - (len(parents) if self.kind == "bds" else 0)

    def score(self, edges: Iterable[g.Edge], nodes: Iterable[str] | None = None) -> float:
        edges = list(edges)
        families = [(v, frozenset(a for a, b in edges if b == v)) for v in nodes or self.data.columns]
        self.prefetch(families)
        return sum(self.local(v, ps) for v, ps in families)


class GaussianScore:
    """``loglik``, ``aic`` or ``bic`` of linear Gaussian families, from one Gram matrix."""

    def __init__(self, data: DataFrame, kind: str = "bic"):
        self.kind, self.names = kind, data.columns
        self.rows, _, self.gram = moments(data, [F.lit(1.0), *self.names])

    def prefetch(self, families: Iterable[Family]) -> None:
        """All families are known."""

    def local(self, v: str, parents: Iterable[str]) -> float:
        own, t = [0, *[1 + self.names.index(p) for p in sorted(parents)]], 1 + self.names.index(v)
        rest = self.gram[t, t] - self.gram[own, t] @ np.linalg.lstsq(self.gram[np.ix_(own, own)], self.gram[own, t], rcond=None)[0]
        fit = -0.5 * self.rows * (math.log(2 * math.pi * max(rest / self.rows, 1e-300)) + 1)
        return fit - {"loglik": 0.0, "aic": 1.0, "bic": 0.5 * math.log(self.rows)}[self.kind] * (len(own) + 1)

    score = DiscreteScore.score

    @property
    def data(self):
        return type("Names", (), {"columns": self.names})


class ConditionalGaussianScore:
    """``loglik``, ``aic`` or ``bic`` of families that mix discrete and continuous variables.

    The joint density of continuous variables is Gaussian within each cell of the
    discrete ones; a family's score is that of the family less that of its parents.
    """

    def __init__(self, data: DataFrame, discrete: Sequence[str], kind: str = "bic"):
        self.data, self.discrete, self.kind = data, set(discrete), kind
        self.rows = data.count()
        self.known: dict[frozenset[str], tuple[float, int]] = {}

    def prefetch(self, families: Iterable[Family]) -> None:
        """Each set is one aggregate, asked for when needed."""

    def _fit(self, names: frozenset[str]) -> tuple[float, int]:
        if names not in self.known:
            cells, x = sorted(names & self.discrete), sorted(names - self.discrete)
            sums = [F.sum(C(a) * C(b)) for i, a in enumerate(x) for b in x[: i + 1]]
            fit, free = 0.0, 0
            for r in self.data.groupBy(*cells).agg(F.count(F.lit(1)), *[F.sum(c) for c in x], *sums).collect():  # cells of a table
                n, *rest = r[len(cells) :]
                fit += n * math.log(n / self.rows)
                free += 1
                if x:
                    mean = np.array(rest[: len(x)]) / n
                    second = np.zeros((len(x), len(x)))
                    second[np.tril_indices(len(x))] = rest[len(x) :]
                    cov = (second + np.tril(second, -1).T) / n - np.outer(mean, mean) + 1e-9 * np.eye(len(x))
                    fit -= 0.5 * n * (np.linalg.slogdet(2 * math.pi * cov)[1] + len(x))
                    free += len(x) * (len(x) + 3) // 2
            self.known[names] = fit, free - 1
        return self.known[names]

    def local(self, v: str, parents: Iterable[str]) -> float:
        parents = frozenset(parents)
        (fit, free), (less, fewer) = self._fit(parents | {v}), self._fit(parents) if parents else (0.0, 0)
        return fit - less - {"loglik": 0.0, "aic": 1.0, "bic": 0.5 * math.log(max(self.rows, 1))}[self.kind] * (free - fewer)

    score = DiscreteScore.score


# searches


@dataclass
class Knowledge:
    """Edges that must or may not be, and tiers: nothing points to an earlier one."""

    required: set[g.Edge] = field(default_factory=set)
    forbidden: set[g.Edge] = field(default_factory=set)
    tiers: list[set[str]] = field(default_factory=list)

    def allows(self, a: str, b: str) -> bool:
        tier = lambda v: next((k for k, t in enumerate(self.tiers) if v in t), None)
        late, early = tier(a), tier(b)
        return (a, b) not in self.forbidden and (b, a) not in self.required and not (late is not None and early is not None and late > early)


def _acyclic(edges: Iterable[g.Edge]) -> bool:
    try:
        g.topological_order([], edges)
    except ValueError:
        return False
    return True


def hill_climb(score, nodes: Sequence[str], start: Iterable[g.Edge] = (), max_parents: int | None = None, tabu: int = 0, white: set[g.Edge] | None = None, black: set[g.Edge] = frozenset(), knowledge: Knowledge | None = None, rounds: int = 10_000) -> list[g.Edge]:
    """Greedy additions, removals and reversals while the score rises; recently changed edges (``tabu``) rest.

    A round's families are scored in one pass.
    """
    know = knowledge or Knowledge()
    edges, resting = set(start) | know.required, []
    parents = lambda v, es: frozenset(a for a, b in es if b == v)
    may = lambda a, b: (a, b) not in black and (white is None or (a, b) in white) and know.allows(a, b)
    for _ in range(rounds):
        changes = []
        for a, b in itertools.permutations(sorted(nodes), 2):
            if frozenset((a, b)) in resting:
                continue
            if (a, b) in edges:
                if (a, b) not in know.required:
                    changes.append((a, b, edges - {(a, b)}))
                    if may(b, a):
                        changes.append((a, b, edges - {(a, b)} | {(b, a)}))
            elif (b, a) not in edges and may(a, b):
                changes.append((a, b, edges | {(a, b)}))
        changes = [(a, b, es) for a, b, es in changes if (max_parents is None or all(len(parents(v, es)) <= max_parents for v in (a, b))) and _acyclic(es)]
        score.prefetch([(v, parents(v, es)) for a, b, es in changes for v in (a, b)])
        gain = lambda a, b, es: sum(score.local(v, parents(v, es)) - score.local(v, parents(v, edges)) for v in (a, b))
        best = max(((gain(*c), c) for c in changes), key=lambda x: x[0], default=(0.0, None))
        if best[0] <= 1e-9:
            break
        a, b, edges = best[1]
        resting = (resting + [frozenset((a, b))])[-tabu:] if tabu else []
    return sorted(edges)


def exhaustive_search(score, nodes: Sequence[str]) -> list[g.Edge]:
    """The best of all directed acyclic graphs, by the best sink of each set of nodes."""
    nodes = sorted(nodes)
    subsets = [frozenset(s) for k in range(len(nodes)) for s in itertools.combinations(nodes, k)]
    score.prefetch([(v, s) for v in nodes for s in subsets if v not in s])
    best_parents: dict[Family, tuple[float, frozenset[str]]] = {}
    for s in subsets:  # smaller sets first
        for v in nodes:
            if v not in s:
                below = [best_parents[v, s - {w}] for w in s]
                best_parents[v, s] = max([(score.local(v, s), s), *below], key=lambda x: x[0])
    best: dict[frozenset[str], tuple[float, list[g.Edge]]] = {frozenset(): (0.0, [])}
    for s in [*subsets[1:], frozenset(nodes)]:
        options = []
        for v in sorted(s):
            value, ps = best_parents[v, s - {v}]
            options.append((best[s - {v}][0] + value, best[s - {v}][1] + [(p, v) for p in sorted(ps)]))
        best[s] = max(options, key=lambda x: x[0])
    return sorted(best[frozenset(nodes)][1])


def ges(score, nodes: Sequence[str]) -> g.PDAG:
    """Best single additions, then best removals, on a DAG; the class of what is left."""
    edges: set[g.Edge] = set()
    parents = lambda v, es: frozenset(a for a, b in es if b == v)
    for grow in (True, False):
        while True:
            new = [(a, b) for a, b in itertools.permutations(sorted(nodes), 2) if (a, b) not in edges and (b, a) not in edges and _acyclic(edges | {(a, b)})] if grow else sorted(edges)
            change = lambda e: edges | {e} if grow else edges - {e}
            score.prefetch([(e[1], parents(e[1], change(e))) for e in new])
            gains = [(score.local(e[1], parents(e[1], change(e))) - score.local(e[1], parents(e[1], edges)), e) for e in new]
            value, e = max(gains, key=lambda x: x[0], default=(0.0, None))
            if value <= 1e-9:
                break
            edges = change(e)
    return g.dag_to_pdag(edges)


def mmhc(data: DataFrame, score, nodes: Sequence[str], alpha: float = 0.05) -> list[g.Edge]:
    """Candidate neighbours by least dependence that no subset explains, kept if mutual; then hill climbing among them."""
    known: dict[tuple, float] = {}

    def p(a: str, b: str, z: tuple[str, ...]) -> float:
        key = (*sorted((a, b)), z)
        if key not in known:
            known[key] = stratified(data, a, b, z, 0.0)["pvalue"]
        return known[key]

    near: dict[str, list[str]] = {}
    for v in nodes:
        own: list[str] = []
        while True:
            worst = {w: max(p(v, w, z) for k in range(len(own) + 1) for z in itertools.combinations(sorted(own), k)) for w in sorted(set(nodes) - {v, *own})}
            best = min(worst, key=worst.get, default=None)
            if best is None or worst[best] > alpha:
                break
            own.append(best)
        near[v] = [w for w in own if all(p(v, w, z) <= alpha for k in range(len(own)) for z in itertools.combinations(sorted(set(own) - {w}), k))]
    white = {(a, b) for a in nodes for b in near[a] if a in near[b]}
    return hill_climb(score, nodes, white=white)


def expert_in_loop(data: DataFrame, nodes: Sequence[str], orient: Callable[[str, str], int], alpha: float = 0.05) -> list[g.Edge]:
    """Adds dependent pairs that are not yet explained, as an expert orients them: 1 for a to b, -1 for b to a, 0 for none.

    ``orient`` may ask a person or any service; nothing is called over a network here.
    """
    edges: set[g.Edge] = set()
    asked: set[frozenset[str]] = set()
    while True:
        options = []
        for a, b in itertools.combinations(sorted(nodes), 2):
            if frozenset((a, b)) in asked or {(a, b), (b, a)} & edges:
                continue
            z = sorted({x for x, y in edges if y in (a, b)} - {a, b})
            r = stratified(data, a, b, z)
            if r["pvalue"] <= alpha:
                options.append((r["statistic"], a, b))
        if not options:
            return sorted(edges)
        _, a, b = max(options)
        asked.add(frozenset((a, b)))
        said = orient(a, b)
        if said and _acyclic(edges | {(a, b) if said > 0 else (b, a)}):
            edges.add((a, b) if said > 0 else (b, a))


# tests


def modified_log_likelihood(data: DataFrame, x: str, y: str, z: Sequence[str] = ()) -> dict[str, float]:
    """The G statistic divided by Williams's correction of each stratum."""
    cells = counts(data, [(x, y, *z), (x, *z), (y, *z), z] if z else [(x, y), (x,), (y,)])
    name = lambda *c: tuple(sorted(c))
    full = cells[name(x, y, *z)]
    names = name(x, y, *z)
    at = {c: k for k, c in enumerate(names)}
    levels = lambda c: {k[at[c]] for k in full}
    r, c, strata = len(levels(x)), len(levels(y)), {}
    for key, n in full.items():
        strata.setdefault(tuple(key[at[v]] for v in z), {})[key[at[x]], key[at[y]]] = n
    total, dof = 0.0, 0
    for own in strata.values():
        n = sum(own.values())
        rows, cols = ({k: sum(m for q, m in own.items() if q[s] == k) for k in {q[s] for q in own}} for s in (0, 1))
        stat = 2 * sum(m * math.log(m * n / (rows[a] * cols[b])) for (a, b), m in own.items())
        correction = 1 + (n * sum(1 / m for m in rows.values()) - 1) * (n * sum(1 / m for m in cols.values()) - 1) / (6 * n * max((r - 1) * (c - 1), 1))
        total += stat / correction
        dof += (r - 1) * (c - 1)
    return {"statistic": total, "dof": dof, "pvalue": p_chi2(total, dof)}


def independence_match(known: Iterable[g.Independence], x: str, y: str, z: Sequence[str] = ()) -> bool:
    """Whether the assertion follows from known ones."""
    return g.Independences(known).entails(g.Independence([x], [y], z))


def _residual_moments(data: DataFrame, xs: Sequence[str], ys: Sequence[str], z: Sequence[str]) -> tuple[int, np.ndarray]:
    """Rows, and the matrix of sums of products of xs and ys after a linear fit on z."""
    n, _, gram = moments(data, [F.lit(1.0), *z, *xs, *ys])
    k = 1 + len(z)
    a, b = gram[:k, :k], gram[:k, k:]
    return n, gram[k:, k:] - b.T @ np.linalg.lstsq(a, b, rcond=None)[0]


def gcm(data: DataFrame, x: str, y: str, z: Sequence[str] = ()) -> dict[str, float]:
    """The normalised covariance of the residuals of x and y after linear fits on z."""
    from tessera.functions.matrices import least_squares

    fits = [least_squares(data, v, *z)["coefficients"] if z else np.array([data.agg(F.avg(v)).first()[0]]) for v in (x, y)]
    rest = [C(v) - sum((F.lit(float(b)) * C(c) for b, c in zip(beta[1:], z, strict=True)), F.lit(float(beta[0]))) for v, beta in zip((x, y), fits, strict=True)]
    n, mean, spread = data.select((rest[0] * rest[1]).alias("r")).agg(F.count("r"), F.avg("r"), F.stddev_pop("r")).first()
    t = math.sqrt(n) * mean / spread if spread else 0.0
    return {"statistic": t, "pvalue": p_normal(t)}


def pearson_equivalence(data: DataFrame, x: str, y: str, z: Sequence[str] = (), bound: float = 0.1) -> dict[str, float]:
    """Two one-sided tests that the partial correlation lies within the bound; a small p-value says it does."""
    n, m = _residual_moments(data, [x], [y], z)
    r = m[0, 1] / math.sqrt(m[0, 0] * m[1, 1]) if m[0, 0] * m[1, 1] > 0 else 0.0
    scale = math.sqrt(max(n - len(z) - 3, 1))
    upper = lambda v: 1 - p_normal(v) / 2 if v > 0 else p_normal(v) / 2  # noqa: E731  the normal cdf
    low = 1 - upper((math.atanh(r) + math.atanh(bound)) * scale)
    high = upper((math.atanh(r) - math.atanh(bound)) * scale)
    return {"statistic": r, "pvalue": max(low, high)}


def manova(data: DataFrame, xs: Sequence[str], ys: Sequence[str], z: Sequence[str] = (), kind: str = "wilks") -> dict[str, float]:
    """``wilks``, ``pillai``, ``hotelling`` or ``roy`` for two groups of variables given z, with an F approximation."""
    n, m = _residual_moments(data, xs, ys, z)
    p, q = len(ys), len(xs)
    xx, xy, yy = m[:q, :q], m[:q, q:], m[q:, q:]
    h = xy.T @ np.linalg.solve(xx, xy)
    roots = np.clip(np.linalg.eigvals(np.linalg.solve(yy - h, h)).real, 0, None)
    s, v = min(p, q), n - 1 - len(z) - q
    if kind == "wilks":
        value = float(np.prod(1 / (1 + roots)))
        t = math.sqrt((p * p * q * q - 4) / (p * p + q * q - 5)) if p * p + q * q > 5 else 1.0
        d1, d2 = p * q, t * (v - (p - q + 1) / 2) - (p * q - 2) / 2
        f = (value ** (-1 / t) - 1) * d2 / d1
    elif kind == "pillai":
        value = float((roots / (1 + roots)).sum())
        a, b = (abs(p - q) - 1) / 2, (v - p - 1) / 2
        d1, d2 = s * (2 * a + s + 1), s * (2 * b + s + 1)
        f = value / (s - value) * d2 / d1
    elif kind == "hotelling":
        value = float(roots.sum())
        a, b = (abs(p - q) - 1) / 2, (v - p - 1) / 2
        d1, d2 = s * (2 * a + s + 1), 2 * (s * b + 1)
        f = value * d2 / (s * d1)
    else:
        value = float(roots.max())
        d1 = max(p, q)
        d2 = v - d1 + q
        f = value * d2 / d1
    return {"statistic": value, "f": f, "pvalue": p_f(f, d1, d2)}


def tree_ci(data: DataFrame, x: str, y: str, z: Sequence[str], depth: int = 4) -> dict[str, float]:
    """Whether x helps a regression tree over z to tell y: the two trees' held-out errors (by a hash of the row), compared by F."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    rows = data.select(*[C(c).cast("double") for c in dict.fromkeys([x, y, *z])]).dropna()
    rows = rows.withColumn("_test", F.pmod(F.xxhash64(*rows.columns), F.lit(3)) == 0)
    errors = []
    for names in (list(z), [*z, x]):
        if not names:
            mean = rows.filter("not _test").agg(F.avg(y)).first()[0]
            errors.append(rows.filter("_test").agg(F.avg(F.pow(C(y) - F.lit(mean), F.lit(2.0)))).first()[0])
            continue
        wide = VectorAssembler(inputCols=names, outputCol="_v").transform(rows)
        model = DecisionTreeRegressor(featuresCol="_v", labelCol=y, predictionCol="_p", maxDepth=depth, minInstancesPerNode=10, seed=1).fit(wide.filter("not _test"))
        errors.append(model.transform(wide.filter("_test")).agg(F.avg(F.pow(C(y) - C("_p"), F.lit(2.0)))).first()[0])
    n = rows.filter("_test").count()
    f = errors[0] / errors[1] if errors[1] else math.inf
    return {"statistic": f, "pvalue": p_f(f, n - 1, n - 1) if math.isfinite(f) else 0.0}


# estimators


def em(data: DataFrame, start: BayesianNetwork, rounds: int = 100, tolerance: float = 1e-6) -> tuple[BayesianNetwork, float]:
    """CPDs and log likelihood with unseen variables or null cells; each distinct pattern is completed once a round."""
    seen = [v for v in start.cpds if v in data.columns]
    patterns = [(tuple(r[:-1]), r[-1]) for r in data.groupBy(*seen).count().collect()]  # patterns of model-sized data
    net, last = start, -math.inf
    for _ in range(rounds):
        expected = {v: np.zeros((c.size, *c.sizes)) for v, c in net.cpds.items()}
        total, markov = 0.0, net.markov()
        for states, n in patterns:
            known = {v: int(s) for v, s in zip(seen, states, strict=True) if s is not None}
            weight = float(_probability(markov, known))
            total += n * math.log(max(weight, 1e-300))
            for v, c in net.cpds.items():
                names = [v, *c.parents]
                free = [w for w in names if w not in known]
                post = markov.query(free, known).values if free else np.ones(())
                expected[v][tuple(known.get(w, slice(None)) for w in names)] += n * post
        cpds = []
        for v, c in net.cpds.items():
            cells = expected[v].reshape(c.size, -1)
            mass = cells.sum(0)
            cpds.append(CPD(v, c.size, np.where(mass > 0, cells / np.where(mass > 0, mass, 1), 1 / c.size), c.parents, c.sizes))
        net = BayesianNetwork(cpds)
        if total - last < tolerance * abs(total):
            return net, total
        last = total
    return net, last


def _probability(markov, known: Mapping[str, int]) -> float:
    from tessera.models.networks import eliminate

    return float(eliminate([t.reduce(known) for t in markov.tables], []).values)


def marginal_estimate(start: Sequence[Table], targets: Sequence[Table], rounds: int = 200, tolerance: float = 1e-10) -> list[Table]:
    """Tables whose product has the target marginals: each target in turn scales the first table that holds it (iterative proportional fitting)."""
    from tessera.models.networks import MarkovNetwork

    tables = [Table(t.variables, t.values.shape, t.values) for t in start]
    for _ in range(rounds):
        worst = 0.0
        for t in targets:
            now = MarkovNetwork(tables).query(t.variables)
            want = t.normalize()
            worst = max(worst, float(np.abs(now.values - want.values).max()))
            home = next(k for k, x in enumerate(tables) if set(t.variables) <= set(x.variables))
            tables[home] = tables[home] * (want / now)
        if worst < tolerance:
            break
    return tables


def mirror_descent(start: Sequence[Table], targets: Sequence[Table], rate: float = 1.0, rounds: int = 500, tolerance: float = 1e-8) -> list[Table]:
    """As :func:`marginal_estimate`, by steps in the logarithms against the squared distance of the marginals; the rate halves when that grows."""
    from tessera.models.networks import MarkovNetwork

    logs = [Table(t.variables, t.values.shape, np.log(np.maximum(t.values, 1e-300))) for t in start]
    exp = lambda ls: [Table(t.variables, t.values.shape, np.exp(t.values - t.values.max())) for t in ls]
    gap = lambda ls: [(t, MarkovNetwork(exp(ls)).query(t.variables).values - t.normalize().values) for t in targets]
    off = gap(logs)
    loss = sum(float((d**2).sum()) for _, d in off)
    for _ in range(rounds):
        if loss < tolerance**2:
            break
        new = list(logs)
        for t, d in off:
            home = next(k for k, x in enumerate(new) if set(t.variables) <= set(x.variables))
            new[home] = new[home] + Table(t.variables, d.shape, -rate * d / np.maximum(t.normalize().values, 1e-6))
        moved = gap(new)
        value = sum(float((d**2).sum()) for _, d in moved)
        if value < loss:
            logs, off, loss = new, moved, value
        else:
            rate /= 2
    return exp(logs)


def fit_network(data: DataFrame, edges: Sequence[g.Edge], sizes: Mapping[str, int], prior: str = "none", size: float = 10.0) -> BayesianNetwork:
    """CPDs by counts with a prior: ``none``, ``k2``, ``bdeu`` or ``uniform``; all families in one pass."""
    families = {v: [v, *sorted(a for a, b in edges if b == v)] for v in sizes}
    cells = counts(data, families.values())
    out = []
    for v, names in families.items():
        shape = [sizes[c] for c in names]
        table = np.zeros(shape)
        order = tuple(sorted(names))
        for key, n in cells[order].items():
            at = tuple(key[order.index(c)] for c in names)
            if all(s is not None and 0 <= s < k for s, k in zip(at, shape, strict=True)):
                table[at] = n
        q = math.prod(shape[1:])
        table += {"none": 0.0, "k2": 1.0, "bdeu": size / (q * shape[0]), "uniform": 1 / shape[0]}[prior]
        out.append(from_table(Table(names, shape, table), v))
    return BayesianNetwork(out)


# fit of a graph


def implied_independences(nodes: Sequence[str], edges: Sequence[g.Edge]) -> list[tuple[str, str, tuple[str, ...]]]:
    """For each pair that is not linked, the later node's parents separate it (those of both if needed)."""
    order = g.topological_order(nodes, edges)
    out = []
    for a, b in itertools.combinations(order, 2):
        if (a, b) not in edges:
            parents = sorted({x for x, y in edges if y == b} - {a})
            out.append((a, b, tuple(parents)))
    return out


def fisher_c(data: DataFrame, nodes: Sequence[str], edges: Sequence[g.Edge], test: Callable | None = None) -> dict[str, float]:
    """-2 sum ln p over the implied independences, a chi-square of twice as many degrees."""
    test = test or (lambda a, b, z: stratified(data, a, b, z)["pvalue"])
    ps = [max(test(a, b, z), 1e-300) for a, b, z in implied_independences(nodes, edges)]
    x = -2 * sum(map(math.log, ps))
    return {"statistic": x, "dof": 2 * len(ps), "pvalue": p_chi2(x, 2 * len(ps)) if ps else 1.0}


def correlation_score(data: DataFrame, nodes: Sequence[str], edges: Sequence[g.Edge], alpha: float = 0.05, test: Callable | None = None) -> float:
    """The F1 of d-connection as a forecast of marginal dependence."""
    test = test or (lambda a, b: stratified(data, a, b)["pvalue"])
    tied = {(a, b): test(a, b) <= alpha for a, b in itertools.combinations(sorted(nodes), 2)}
    graph = g.ADMG(edges, (), nodes)
    said = {(a, b): not graph.m_separated(a, b) for a, b in tied}
    tp = sum(tied[k] and said[k] for k in tied)
    wrong = sum(tied[k] != said[k] for k in tied)
    return 2 * tp / (2 * tp + wrong) if tp or wrong else 1.0


def linear_gaussian_mle(data: DataFrame, edges: Sequence[g.Edge], nodes: Sequence[str]) -> LinearGaussianNetwork:
    return LinearGaussianNetwork.fit(data, {v: sorted(a for a, b in edges if b == v) for v in nodes})


def coefficient_test(data: DataFrame, y: str, *xs: str) -> dict[str, tuple[float, float]]:
    """Each regressor's t and p-value in a linear fit."""
    from tessera.functions.matrices import least_squares

    fit = least_squares(data, y, *xs)
    t = fit["coefficients"] / fit["errors"]
    return {x: (float(t[k + 1]), p_t(float(t[k + 1]), fit["rows"] - len(xs) - 1)) for k, x in enumerate(xs)}
