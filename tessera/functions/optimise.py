"""Optimisers of Python functions over vectors, and small programs; one problem at a time, many through :func:`per_group`."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Objective = Callable[[np.ndarray], float]
Bounds = Sequence[tuple[float, float]]


@dataclass
class Result:
    """Where an optimiser ended, the value there, whether it met its test, and steps taken."""

    x: np.ndarray
    fun: float
    success: bool = True
    steps: int = 0


def gradient(f: Objective, x: np.ndarray, step: float = 6e-6) -> np.ndarray:
    """Central differences."""
    h = step * np.maximum(1.0, np.abs(x))
    return np.array([(f(x + e) - f(x - e)) / (2 * hi) for hi, e in zip(h, np.diag(h), strict=True)])


def minimize(f: Objective, x0: Sequence[float], method: str = "bfgs", tolerance: float = 1e-8, steps: int = 2000, grad: Callable | None = None) -> Result:
    """``bfgs`` (quasi-Newton with a backtracking search), ``cg`` or ``nelder-mead`` (a simplex, without gradients)."""
    x = np.asarray(x0, float)
    if method == "nelder-mead":
        return _nelder_mead(f, x, tolerance, steps)
    grad = grad or (lambda v: gradient(f, v))
    g, h, value = grad(x), np.eye(len(x)), f(x)
    direction = -g
    for k in range(steps):
        if np.abs(g).max() < tolerance * max(1.0, abs(value)) ** 0.5:
            return Result(x, value, True, k)
        direction = -h @ g if method == "bfgs" else direction
        slope = g @ direction
        if slope >= 0:
            direction, h, slope = -g, np.eye(len(x)), -g @ g
        t = 1.0
        while (new := f(x + t * direction)) > value + 1e-4 * t * slope and t > 1e-18:
            t /= 2
        if t <= 1e-18:
            return Result(x, value, bool(np.abs(g).max() < 1e-4), k)
        moved = t * direction
        x, value, g, old = x + moved, new, grad(x + moved), g
        y = g - old
        if method == "bfgs" and y @ moved > 1e-14:
            r = 1 / (y @ moved)
            left = np.eye(len(x)) - r * np.outer(moved, y)
            h = left @ h @ left.T + r * np.outer(moved, moved)
        elif method == "cg":
            direction = -g + max(0.0, g @ y / max(old @ old, 1e-300)) * direction
    return Result(x, value, False, steps)


def _nelder_mead(f: Objective, x: np.ndarray, tolerance: float, steps: int) -> Result:
    points = np.vstack([x, x + np.diag(np.where(x != 0, 0.05 * x, 0.00025) * 5)])
    values = np.array([f(p) for p in points])
    for k in range(steps * len(x)):
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if values[-1] - values[0] <= tolerance * 1e-2 and np.abs(points[1:] - points[0]).max() <= tolerance * 10:
            return Result(points[0], values[0], True, k)
        centre = points[:-1].mean(0)
        tried = lambda c: (centre + c * (points[-1] - centre), f(centre + c * (points[-1] - centre)))
        p, v = tried(-1.0)
        if v < values[0]:
            p2, v2 = tried(-2.0)
            p, v = (p2, v2) if v2 < v else (p, v)
        elif v >= values[-2]:
            p, v = tried(-0.5 if v < values[-1] else 0.5)
            if v >= values[-1]:
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = [f(q) for q in points[1:]]
                continue
        points[-1], values[-1] = p, v
    best = int(np.argmin(values))
    return Result(points[best], values[best], False, steps)


def minimize_scalar(f: Callable[[float], float], a: float, b: float, tolerance: float = 1e-9) -> Result:
    """Golden section between two ends."""
    ratio = (math.sqrt(5) - 1) / 2
    p, q = b - ratio * (b - a), a + ratio * (b - a)
    fp, fq, k = f(p), f(q), 0
    while b - a > tolerance * max(1.0, abs(a) + abs(b)):
        if fp < fq:
            b, q, fq = q, p, fp
            p = b - ratio * (b - a)
            fp = f(p)
        else:
            a, p, fp = p, q, fq
            q = a + ratio * (b - a)
            fq = f(q)
        k += 1
    x = (a + b) / 2
    return Result(np.array([x]), f(x), True, k)


def root_scalar(f: Callable[[float], float], a: float, b: float, tolerance: float = 1e-13) -> float:
    """A zero between two ends of different sign: false position, halved when it lags."""
    fa, fb = f(a), f(b)
    if fa * fb > 0:
        raise ValueError("both ends have one sign")
    for k in range(400):
        if fa == 0 or fb == 0 or abs(b - a) <= tolerance * max(1.0, abs(a) + abs(b)):
            break
        x = (a + b) / 2 if k % 3 == 2 else a - fa * (b - a) / (fb - fa)
        fx = f(x)
        if fa * fx <= 0:
            b, fb = x, fx
        else:
            a, fa = x, fx
    return a if abs(fa) < abs(fb) else b


def least_squares(residuals: Callable[[np.ndarray], np.ndarray], x0: Sequence[float], steps: int = 500, tolerance: float = 1e-12) -> Result:
    """Levenberg-Marquardt; ``fun`` is half the sum of squares."""
    x, damping = np.asarray(x0, float), 1e-3
    r = np.asarray(residuals(x), float)
    for k in range(steps):
        h = 1e-7 * np.maximum(1.0, np.abs(x))
        j = np.stack([(np.asarray(residuals(x + e), float) - np.asarray(residuals(x - e), float)) / (2 * hi) for hi, e in zip(h, np.diag(h), strict=True)], 1)
        a, b = j.T @ j, -j.T @ r
        move = np.linalg.solve(a + damping * np.diag(np.maximum(np.diag(a), 1e-12)), b)
        new = np.asarray(residuals(x + move), float)
        if new @ new < r @ r:
            done = r @ r - new @ new <= tolerance * (r @ r) or np.abs(move).max() <= tolerance
            x, r, damping = x + move, new, max(damping / 5, 1e-15)
            if done:
                return Result(x, float(r @ r) / 2, True, k)
        else:
            damping *= 4
            if damping > 1e12:
                return Result(x, float(r @ r) / 2, True, k)
    return Result(x, float(r @ r) / 2, False, steps)


def curve_fit(f: Callable, x: np.ndarray, y: np.ndarray, p0: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Parameters of f(x, *p) and their covariance."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    got = least_squares(lambda p: f(x, *p) - y, p0)
    h = 1e-7 * np.maximum(1.0, np.abs(got.x))
    j = np.stack([(f(x, *(got.x + e)) - f(x, *(got.x - e))) / (2 * hi) for hi, e in zip(h, np.diag(h), strict=True)], 1)
    return got.x, np.linalg.pinv(j.T @ j) * 2 * got.fun / max(len(y) - len(got.x), 1)


def linear_sum_assignment(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the cheapest assignment, by shortest augmenting paths."""
    cost = np.asarray(cost, float)
    if cost.shape[0] > cost.shape[1]:
        cols, rows = linear_sum_assignment(cost.T)
        order = np.argsort(rows)
        return rows[order], cols[order]
    n, m = cost.shape
    u, v, match = np.zeros(n), np.zeros(m + 1), np.full(m + 1, -1)
    for i in range(n):
        match[m], at = i, m
        least, came, used = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while match[at] >= 0:
            used[at] = True
            row = match[at]
            free = ~used[:m]
            reduced = cost[row] - u[row] - v[:m]
            better = free & (reduced < least)
            least[better], came[better] = reduced[better], at
            nxt = int(np.argmin(np.where(free, least, np.inf)))
            step = least[nxt]
            u[match[np.flatnonzero(used)]] += step
            v[used] -= step
            least[free] -= step
            at = nxt
        while at != m:
            match[at], at = match[came[at]], came[at]
    cols = np.flatnonzero(match[:m] >= 0)
    order = np.argsort(match[cols])
    return match[cols][order], cols[order]


def linprog(c: Sequence[float], a_ub=None, b_ub=None, a_eq=None, b_eq=None, bounds: Bounds | None = None) -> Result:
    """The least c x under a_ub x <= b_ub, a_eq x = b_eq and bounds (0 and up if none), by two simplex phases with Bland's rule."""
    c = np.asarray(c, float)
    n = len(c)
    low = np.array([0.0 if bounds is None else (-np.inf if b[0] is None else b[0]) for b in (bounds or [(0, None)] * n)])
    high = np.array([np.inf if b[1] is None else b[1] for b in (bounds or [(0, None)] * n)])
    free = np.isinf(low)  # x = plus - minus
    shift = np.where(free, 0.0, low)
    wide = np.hstack([np.eye(n), -np.eye(n)[:, free]])
    ub = [np.empty((0, n)) if a_ub is None else np.asarray(a_ub, float), np.eye(n)[np.isfinite(high)]]
    ub_b = np.concatenate([np.empty(0) if b_ub is None else np.asarray(b_ub, float), high[np.isfinite(high)]])
    ub = np.vstack(ub)
    eq = np.empty((0, n)) if a_eq is None else np.asarray(a_eq, float)
    a = np.vstack([np.hstack([ub @ wide, np.eye(len(ub))]), np.hstack([eq @ wide, np.zeros((len(eq), len(ub)))])])
    b = np.concatenate([ub_b - ub @ shift, (np.empty(0) if b_eq is None else np.asarray(b_eq, float)) - eq @ shift])
    a[b < 0], b = -a[b < 0], np.abs(b)
    rows, cols = a.shape
    table = np.hstack([a, np.eye(rows), b[:, None]])
    basis = np.arange(cols, cols + rows)

    def pivot(cost: np.ndarray, allowed: int) -> bool:
        for _ in range(50_000):
            reduced = cost[:allowed] - cost[basis] @ table[:, :allowed]
            enter = np.flatnonzero(reduced < -1e-9)
            if not len(enter):
                return True
            j = enter[0]
            up = np.flatnonzero(table[:, j] > 1e-9)
            if not len(up):
                return False
            ratio = table[up, -1] / table[up, j]
            best = up[ratio <= ratio.min() + 1e-12]
            i = best[np.argmin(basis[best])]
            table[i] /= table[i, j]
            others = np.arange(rows) != i
            table[others] -= np.outer(table[others, j], table[i])
            basis[i] = j
        return False

    pivot(np.concatenate([np.zeros(cols), np.ones(rows)]), cols + rows)
    if table[basis >= cols, -1].sum() > 1e-7:
        return Result(np.full(n, np.nan), np.inf, False)
    for i in np.flatnonzero(basis >= cols):  # leave no artificial variable in the basis if another fits
        j = np.flatnonzero(np.abs(table[i, :cols]) > 1e-9)
        if len(j):
            table[i] /= table[i, j[0]]
            others = np.arange(rows) != i
            table[others] -= np.outer(table[others, j[0]], table[i])
            basis[i] = j[0]
    bounded = pivot(np.concatenate([c @ wide, np.zeros(len(ub) + rows)]), cols)
    x = np.zeros(cols + rows)
    x[basis] = table[:, -1]
    x = wide @ x[: wide.shape[1]] + shift
    return Result(x, float(c @ x), True) if bounded else Result(x, -np.inf, False)


def milp(c: Sequence[float], integer: Sequence[bool], a_ub=None, b_ub=None, a_eq=None, b_eq=None, bounds: Bounds | None = None) -> Result:
    """As :func:`linprog` with whole numbers, by branch and bound."""
    n = len(c)
    best, todo = Result(np.full(n, np.nan), np.inf, False), [list(bounds or [(0, None)] * n)]
    while todo:
        own = todo.pop()
        got = linprog(c, a_ub, b_ub, a_eq, b_eq, own)
        if not got.success or got.fun >= best.fun - 1e-9:
            continue
        off = [k for k in range(n) if integer[k] and abs(got.x[k] - round(got.x[k])) > 1e-6]
        if not off:
            best = Result(np.where(integer, np.round(got.x), got.x), got.fun, True)
            continue
        k = off[0]
        low, high = own[k]
        todo += [[*own[:k], (low, math.floor(got.x[k])), *own[k + 1 :]], [*own[:k], (math.ceil(got.x[k]), high), *own[k + 1 :]]]
    return best


def qp_solve(q: np.ndarray, c: Sequence[float], a_eq=None, b_eq=None, a_ub=None, b_ub=None) -> Result:
    """The least x'qx / 2 + c'x for positive definite q, by an active set over its optimality system."""
    q, c = np.asarray(q, float), np.asarray(c, float)
    eq, be = (np.empty((0, len(c))), np.empty(0)) if a_eq is None else (np.asarray(a_eq, float), np.asarray(b_eq, float))
    ub, bu = (np.empty((0, len(c))), np.empty(0)) if a_ub is None else (np.asarray(a_ub, float), np.asarray(b_ub, float))

    def at(active: list[int]) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.vstack([eq, ub[active]]), np.concatenate([be, bu[active]])
        system = np.block([[q, a.T], [a, np.zeros((len(a), len(a)))]])
        got = np.linalg.lstsq(system, np.concatenate([-c, b]), rcond=None)[0]
        return got[: len(c)], got[len(c) + len(eq) :]

    start = linprog(np.zeros(len(c)), ub if len(ub) else None, bu if len(ub) else None, eq if len(eq) else None, be if len(eq) else None, [(None, None)] * len(c))
    if not start.success:
        return start
    x, active = start.x, []
    for k in range(1000):
        target, force = at(active)
        move = target - x
        if np.abs(move).max(initial=0) < 1e-10:
            if not len(force) or force.min() >= -1e-10:
                return Result(x, float(x @ q @ x / 2 + c @ x), True, k)
            active.pop(int(np.argmin(force)))
            continue
        rest = [i for i in range(len(ub)) if i not in active and ub[i] @ move > 1e-12]
        room = [(bu[i] - ub[i] @ x) / (ub[i] @ move) for i in rest]
        step = min([1.0, *room])
        x = x + max(step, 0.0) * move
        if room and min(room) < 1:
            active.append(rest[int(np.argmin(room))])
    return Result(x, float(x @ q @ x / 2 + c @ x), False)


# global


def differential_evolution(f: Objective, bounds: Bounds, seed: int = 0, generations: int = 300, size: int = 15) -> Result:
    """Random differences of a population, crossed with the best; polished at the end."""
    g, (low, high) = np.random.default_rng(seed), np.array(bounds, float).T
    n = max(5, size * len(low))
    points = low + g.random((n, len(low))) * (high - low)
    values = np.array([f(p) for p in points])
    for _ in range(generations):
        for i in range(n):
            a, b = points[g.choice(n, 2, replace=False)]
            trial = np.clip(points[np.argmin(values)] + g.uniform(0.5, 1) * (a - b), low, high)
            trial = np.where(g.random(len(low)) < 0.7, trial, points[i])
            if (v := f(trial)) <= values[i]:
                points[i], values[i] = trial, v
        if values.std() <= 1e-10 + 1e-8 * abs(values.mean()):
            break
    return _polished(f, points[np.argmin(values)], low, high)


def _polished(f: Objective, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> Result:
    got = minimize(lambda p: f(np.clip(p, low, high)), x, "nelder-mead", steps=400)
    x = np.clip(got.x, low, high)
    return Result(x, f(x), True, got.steps)


def basin_hopping(f: Objective, x0: Sequence[float], seed: int = 0, hops: int = 50, step: float = 0.5, temperature: float = 1.0) -> Result:
    """Local minima from random moves, taken if lower or by chance."""
    g = np.random.default_rng(seed)
    here = best = minimize(f, x0)
    for _ in range(hops):
        new = minimize(f, here.x + g.uniform(-step, step, len(here.x)))
        if new.fun < here.fun or g.random() < math.exp(min(0.0, -(new.fun - here.fun) / temperature)):
            here = new
        best = min(best, here, key=lambda r: r.fun)
    return best


def dual_annealing(f: Objective, bounds: Bounds, seed: int = 0, steps: int = 3000) -> Result:
    """Cauchy moves under a falling temperature, then a local search."""
    g, (low, high) = np.random.default_rng(seed), np.array(bounds, float).T
    x = low + g.random(len(low)) * (high - low)
    value = f(x)
    best, least = x, value
    for k in range(steps):
        t = 1 / (1 + 0.01 * k)
        new = low + np.mod(x + t * (high - low) * 0.2 * g.standard_cauchy(len(low)) - low, high - low)
        v = f(new)
        if v < value or g.random() < math.exp(min(0.0, -(v - value) / (t * (abs(value) + 1e-12)) * 5)):
            x, value = new, v
        if v < least:
            best, least = new, v
    return _polished(f, best, low, high)


def shgo(f: Objective, bounds: Bounds, points: int = 64) -> Result:
    """Local searches from the lowest of a Halton set, best first."""
    low, high = np.array(bounds, float).T
    primes = [p for p in range(2, 100) if all(p % q for q in range(2, int(p**0.5) + 1))][: len(low)]
    halton = np.array([[sum((k // p**i % p) / p ** (i + 1) for i in range(12)) for p in primes] for k in range(1, points + 1)])
    starts = sorted((low + h * (high - low) for h in halton), key=f)[: max(4, points // 8)]
    return min((_polished(f, s, low, high) for s in starts), key=lambda r: r.fun)


def direct(f: Objective, bounds: Bounds, evaluations: int = 4000) -> Result:
    """Thirds of the boxes that may hold the least value, by size and value."""
    low, high = np.array(bounds, float).T
    value = lambda u: f(low + u * (high - low))
    centre = np.full(len(low), 0.5)
    boxes = [(value(centre), centre, np.zeros(len(low), int))]
    used = 1
    while used < evaluations:
        by_size: dict[float, tuple] = {}
        for box in boxes:
            size = round(float(np.sqrt((9.0 ** -box[2]).sum())), 12)
            if size not in by_size or box[0] < by_size[size][0]:
                by_size[size] = box
        chosen, least = [], math.inf
        for size in sorted(by_size, reverse=True):  # larger boxes first; smaller ones only if lower
            if by_size[size][0] < least:
                least = by_size[size][0]
                chosen.append(by_size[size])
        taken = {id(b) for b in chosen}
        boxes = [b for b in boxes if id(b) not in taken]
        for v, u, cuts in chosen:
            k = int(np.argmin(cuts))
            new = cuts.copy()
            new[k] += 1
            for side in (-1, 0, 1):
                at = u.copy()
                at[k] += side * 3.0 ** -new[k]
                boxes.append((v if side == 0 else value(at), at, new))
            used += 2
    best = min(boxes, key=lambda b: b[0])
    return _polished(f, low + best[1] * (high - low), low, high)


def brute(f: Objective, bounds: Bounds, points: int = 20) -> Result:
    """The best place of a grid, polished."""
    low, high = np.array(bounds, float).T
    best = min((np.array(p) for p in itertools.product(*[np.linspace(a, b, points) for a, b in zip(low, high, strict=True)])), key=f)
    return _polished(f, best, low, high)


def per_group(df: DataFrame, by: Sequence[str], solve: Callable[[pd.DataFrame], Result], names: Sequence[str]) -> DataFrame:
    """One problem for each group: (by, names of x, fun, success). A group must fit into a task."""
    keys = [f for f in df.schema.fields if f.name in by]
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in keys], *[f"{n} double" for n in names], "fun double", "success boolean"])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        got = solve(rows)
        return pd.DataFrame([[*key, *map(float, got.x), float(got.fun), bool(got.success)]], columns=[*by, *names, "fun", "success"])

    return df.groupBy(*by).applyInPandas(run, schema)
