"""Dense matrices: solvers, decompositions and functions in NumPy, lifted to columns of small matrices.

:func:`column` applies any of them to a column of matrices (array of array of
double), batch by batch. A matrix with as many rows as a table is not gathered:
:func:`least_squares`, :func:`tall_r` and :func:`tall_svd` need its Gram matrix
only, which is one aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

solve, inv, pinv, det, slogdet, cond = np.linalg.solve, np.linalg.inv, np.linalg.pinv, np.linalg.det, np.linalg.slogdet, np.linalg.cond
eig, eigh, eigvals, cholesky, qr, matrix_rank, matrix_power, norm = np.linalg.eig, np.linalg.eigh, np.linalg.eigvals, np.linalg.cholesky, np.linalg.qr, np.linalg.matrix_rank, np.linalg.matrix_power, np.linalg.norm


def svd(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """u, singular values and v transposed, without superfluous columns."""
    return np.linalg.svd(a, full_matrices=False)


def lstsq(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(a, b, rcond=None)[0]


# factorisations


def lu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """p, l, u with a = p l u, rows exchanged for the largest pivot."""
    u = np.array(a, float)
    n = len(u)
    order, low = np.arange(n), np.eye(n)
    for k in range(min(u.shape)):
        best = k + int(np.argmax(np.abs(u[k:, k])))
        if u[best, k] == 0:
            continue
        u[[k, best]], order[[k, best]] = u[[best, k]], order[[best, k]]
        low[[k, best], :k] = low[[best, k], :k]
        low[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
        u[k + 1 :] -= low[k + 1 :, k, None] * u[k]
    return np.eye(n)[:, order], low, np.triu(u)


lu_factor = lu


def _forward(low: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = np.array(b, float)
    for k in range(len(x)):
        x[k] = (x[k] - low[k, :k] @ x[:k]) / low[k, k]
    return x


def _backward(up: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _forward(up[::-1, ::-1], np.asarray(b)[::-1])[::-1]


def lu_solve(factors: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
    p, low, up = factors
    return _backward(up, _forward(low, p.T @ np.asarray(b, float)))


cho_factor = cholesky


def cho_solve(low: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _backward(low.T, _forward(low, b))


def dtrsv(a: np.ndarray, x: np.ndarray, lower: bool = True, transposed: bool = False) -> np.ndarray:
    """Solves a triangular system."""
    a = np.asarray(a, float).T if transposed else np.asarray(a, float)
    return _forward(a, x) if lower != transposed else _backward(a, x)


def ldl(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit lower triangle and diagonal of a symmetric matrix, without pivoting."""
    a = np.array(a, float)
    n = len(a)
    low, diagonal = np.eye(n), np.zeros(n)
    for k in range(n):
        diagonal[k] = a[k, k] - (low[k, :k] ** 2 * diagonal[:k]).sum()
        if diagonal[k] == 0 and k + 1 < n:
            raise np.linalg.LinAlgError("zero pivot")
        low[k + 1 :, k] = (a[k + 1 :, k] - (low[k + 1 :, :k] * low[k, :k] * diagonal[:k]).sum(1)) / (diagonal[k] or 1)
    return low, np.diag(diagonal)


def hessenberg(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """h and orthogonal q with a = q h q', h without entries below the first subdiagonal."""
    h, q = np.array(a, float), np.eye(len(a))
    for k in range(len(h) - 2):
        x = h[k + 1 :, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(x)
        if size == 0:
            continue
        x /= size
        h[k + 1 :] -= 2 * np.outer(x, x @ h[k + 1 :])
        h[:, k + 1 :] -= 2 * np.outer(h[:, k + 1 :] @ x, x)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ x, x)
    return np.triu(h, -1), q


def schur(a: np.ndarray, steps: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Complex upper triangle t and unitary z with a = z t z*, by shifted QR steps on the Hessenberg form."""
    h, z = (x.astype(complex) for x in hessenberg(a))
    n = len(h)
    for end in range(n - 1, 0, -1):
        for _ in range(steps):
            if abs(h[end, end - 1]) < 1e-14 * (abs(h[end, end]) + abs(h[end - 1, end - 1])):
                break
            corner = np.linalg.eigvals(h[end - 1 : end + 1, end - 1 : end + 1])
            shift = corner[np.argmin(abs(corner - h[end, end]))]
            q, r = np.linalg.qr(h[: end + 1, : end + 1] - shift * np.eye(end + 1))
            h[: end + 1, : end + 1] = r @ q + shift * np.eye(end + 1)
            h[: end + 1, end + 1 :] = q.conj().T @ h[: end + 1, end + 1 :]
            z[:, : end + 1] = z[:, : end + 1] @ q
        h[end, end - 1] = 0
    return np.triu(h), z


def interpolative(a: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Column places and coefficients with a ~ a[:, places] @ coefficients, by pivoted orthogonalisation."""
    rest, places = np.array(a, float), []
    for _ in range(rank):
        k = int(np.argmax((rest**2).sum(0)))
        size = np.linalg.norm(rest[:, k])
        if size == 0:
            break
        unit = rest[:, k] / size
        places.append(k)
        rest = rest - np.outer(unit, unit @ rest)
    return np.array(places), lstsq(np.asarray(a, float)[:, places], np.asarray(a, float))


def polar(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orthogonal u and positive semi-definite p with a = u p."""
    u, s, v = svd(a)
    return u @ v, v.T @ np.diag(s) @ v


def expm(a: np.ndarray) -> np.ndarray:
    """Exponential by scaling, a Taylor sum and squaring."""
    a = np.asarray(a, float)
    halvings = max(0, int(np.ceil(np.log2(max(np.linalg.norm(a, 1), 1e-300)))) + 4)
    x = a / 2.0**halvings
    out = term = np.eye(len(a))
    for k in range(1, 18):
        term = term @ x / k
        out = out + term
    return np.linalg.matrix_power(out, 2**halvings)


def _by_eigenvalues(a: np.ndarray, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    w, v = np.linalg.eig(np.asarray(a, complex))
    out = v @ np.diag(f(w)) @ np.linalg.inv(v)
    return out.real if np.abs(out.imag).max(initial=0) < 1e-9 else out


def logm(a: np.ndarray) -> np.ndarray:
    """Principal logarithm of a diagonalisable matrix."""
    return _by_eigenvalues(a, np.log)


def sqrtm(a: np.ndarray) -> np.ndarray:
    return _by_eigenvalues(a, np.sqrt)


# structured matrices


def block_diag(*blocks: np.ndarray) -> np.ndarray:
    out = np.zeros((sum(len(b) for b in blocks), sum(b.shape[1] for b in blocks)))
    i = j = 0
    for b in blocks:
        out[i : i + len(b), j : j + b.shape[1]] = b
        i, j = i + len(b), j + b.shape[1]
    return out


def companion(c: Sequence[float]) -> np.ndarray:
    """Its eigenvalues are the roots of the polynomial, highest power first."""
    n = len(c) - 1
    out = np.eye(n, k=-1)
    out[0] = -np.asarray(c[1:], float) / c[0]
    return out


def toeplitz(c: Sequence[float], r: Sequence[float] | None = None) -> np.ndarray:
    r = c if r is None else r
    d = np.subtract.outer(np.arange(len(c)), np.arange(len(r)))
    return np.where(d >= 0, np.asarray(c, float)[np.maximum(d, 0)], np.asarray(r, float)[np.maximum(-d, 0)])


def circulant(c: Sequence[float]) -> np.ndarray:
    n = len(c)
    return np.asarray(c, float)[np.subtract.outer(np.arange(n), np.arange(n)) % n]


def hankel(c: Sequence[float], r: Sequence[float] | None = None) -> np.ndarray:
    r = np.zeros(len(c)) if r is None else r
    line = np.concatenate([c, np.asarray(r, float)[1:]])
    return line[np.add.outer(np.arange(len(c)), np.arange(len(r)))]


def hadamard(n: int) -> np.ndarray:
    if n & (n - 1):
        raise ValueError("not a power of 2")
    k = np.arange(n)
    return 1.0 - 2.0 * (np.bitwise_count(k[:, None] & k) & 1)


def hilbert(n: int) -> np.ndarray:
    return 1 / (np.add.outer(np.arange(n), np.arange(n)) + 1.0)


def pascal(n: int) -> np.ndarray:
    out = np.ones((n, n))
    for i in range(1, n):
        out[i, 1:] = [out[i - 1, 1 : j + 1].sum() + 1 for j in range(1, n)]
    return out


def inv_hilbert(n: int) -> np.ndarray:
    from math import comb

    cell = lambda i, j: (-1.0) ** (i + j) * (i + j - 1) * comb(n + i - 1, n - j) * comb(n + j - 1, n - i) * comb(i + j - 2, i - 1) ** 2
    return np.array([[cell(i, j) for j in range(1, n + 1)] for i in range(1, n + 1)])


def fiedler(c: Sequence[float]) -> np.ndarray:
    return np.abs(np.subtract.outer(np.asarray(c, float), np.asarray(c, float)))


def leslie(fertility: Sequence[float], survival: Sequence[float]) -> np.ndarray:
    out = np.diag(np.asarray(survival, float), -1)
    out[0] = fertility
    return out


def dft(n: int) -> np.ndarray:
    return np.exp(-2j * np.pi * np.outer(np.arange(n), np.arange(n)) / n)


# columns


def column(f: Callable[..., object], *cols: Column, kind: str = "array<array<double>>") -> Column:
    """``f`` of columns of matrices, vectors or numbers; ``kind`` is the result's type. Null in, null out; a singular matrix raises."""

    @F.pandas_udf(kind)
    def apply(*parts: pd.Series) -> pd.Series:
        out = []
        for row in zip(*parts, strict=True):
            if any(x is None for x in row):
                out.append(None)
                continue
            got = f(*[np.array([np.asarray(y, float) for y in x]) if isinstance(x, np.ndarray | list) else x for x in row])
            out.append(np.asarray(got).tolist() if isinstance(got, np.ndarray) else float(got))
        return pd.Series(out)

    return apply(*cols)


# as many rows as a table


def moments(df: DataFrame, columns: Sequence[str | Column]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows without nulls, sums and the Gram matrix of columns, in one aggregate."""
    x = [F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in columns]
    rows = df.select(*[c.alias(f"x{k}") for k, c in enumerate(x)]).dropna()
    names = rows.columns
    products = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[: i + 1]]
    n, *sums = rows.agg(F.count(F.lit(1)), *[F.sum(c) for c in names], *products).first()
    k = len(names)
    gram = np.zeros((k, k))
    gram[np.tril_indices(k)] = [v or 0.0 for v in sums[k:]]
    return n, np.array([v or 0.0 for v in sums[:k]]), gram + np.tril(gram, -1).T


def least_squares(df: DataFrame, y: str, *xs: str, intercept: bool = True) -> dict[str, object]:
    """Coefficients (the intercept first), their standard errors, residual variance and r squared of a linear fit."""
    ones = [F.lit(1.0)] if intercept else []
    n, sums, gram = moments(df, [*ones, *xs, y])
    a, b, total = gram[:-1, :-1], gram[:-1, -1], gram[-1, -1]
    beta = np.linalg.solve(a, b)
    rest = max(0.0, float(total - b @ beta))
    variance = rest / max(n - len(beta), 1)
    centred = total - sums[-1] ** 2 / n if intercept else total
    return {"coefficients": beta, "errors": np.sqrt(np.diag(np.linalg.inv(a)) * variance), "variance": variance, "r2": 1 - rest / centred if centred else 0.0, "rows": n}


def tall_r(df: DataFrame, *columns: str) -> np.ndarray:
    """The triangle of the QR decomposition of a table's columns, its diagonal positive."""
    return np.linalg.cholesky(moments(df, columns)[2]).T


def tall_svd(df: DataFrame, *columns: str) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, largest first, and right vectors (rows) of a table's columns."""
    w, v = np.linalg.eigh(moments(df, columns)[2])
    return np.sqrt(np.maximum(w[::-1], 0)), v[:, ::-1].T


def principal_components(df: DataFrame, k: int, *columns: str) -> tuple[np.ndarray, np.ndarray]:
    """The k largest variances and their directions."""
    n, sums, gram = moments(df, columns)
    w, v = np.linalg.eigh((gram - np.outer(sums, sums) / n) / (n - 1))
    return w[::-1][:k], v[:, ::-1][:, :k].T
