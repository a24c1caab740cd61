"""Window operators over ordered series: rolling, expanding, exponentially weighted, cumulative, ranks, risk.

A :class:`Series` names the partition and order; partitions are windows that
Spark sorts and spills, so operators scale with the number of series. Rolling
results are null until ``window`` rows have been seen, as positions count, not
values. Recursive operators without a frame form fold each series' array.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Series:
    """Where a series' rows are: its partition columns and unique order columns."""

    by: tuple[str, ...]
    order: tuple[str, ...]

    def window(self):
        return Window.partitionBy(*self.by).orderBy(*self.order)

    def last(self, n: int):
        return self.window().rowsBetween(1 - n, 0)

    def so_far(self):
        return self.window().rowsBetween(Window.unboundedPreceding, 0)

    def full(self, n: int, value: Column) -> Column:
        """The value where ``n`` rows have been seen."""
        return F.when(F.row_number().over(self.window()) >= n, value)


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


AGGREGATES = {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "var": F.var_samp, "min": F.min, "max": F.max, "count": F.count}


def rolling(s: Series, c: Column, n: int, how: str) -> Column:
    return s.full(n, _zero(AGGREGATES[how](c.cast("double")).over(s.last(n))))


def expanding(s: Series, c: Column, how: str) -> Column:
    return _zero(AGGREGATES[how](c.cast("double")).over(s.so_far()))


def rolling_quantile(s: Series, c: Column, n: int, q: float) -> Column:
    """Linear interpolation at q (n - 1)."""
    return s.full(n, _zero(F.percentile(c, q).over(s.last(n))))


def _moments(s: Series, c: Column, n: int) -> tuple[Column, Column, Column, Column, Column]:
    """Count and central power sums 2 to 4 of a frame, from its array about its own mean."""
    values = F.collect_list(c.cast("double")).over(s.last(n))
    k = F.size(values).cast("double")
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.nullif(k, F.lit(0.0))
    power = lambda p: F.aggregate(values, F.lit(0.0), lambda a, x: a + F.pow(x - mean, F.lit(p)))
    return k, mean, power(2.0), power(3.0), power(4.0)


def rolling_skew(s: Series, c: Column, n: int) -> Column:
    """Bias-corrected G1; 0 below three values or without variance."""
    k, _, m2, m3, _ = _moments(s, c, n)
    g1 = F.try_divide(m3 / k, F.pow(m2 / k, F.lit(1.5)))
    return s.full(n, F.when((k >= 3) & (m2 > 1e-24), g1 * F.sqrt(k * (k - 1)) / (k - 2)).otherwise(0.0))


def rolling_kurtosis(s: Series, c: Column, n: int) -> Column:
    """Bias-corrected excess G2; 0 below four values or without variance."""
    k, _, m2, _, m4 = _moments(s, c, n)
    g2 = F.try_divide(m4 / k, F.pow(m2 / k, F.lit(2.0))) - 3
    return s.full(n, F.when((k >= 4) & (m2 > 1e-24), ((k + 1) * g2 + 6) * (k - 1) / ((k - 2) * (k - 3))).otherwise(0.0))


def rolling_zscore(s: Series, c: Column, n: int) -> Column:
    std = F.stddev_samp(c).over(s.last(n))
    return s.full(n, F.when(std > 1e-12, (c - F.avg(c).over(s.last(n))) / std).otherwise(0.0))


def rolling_cov(s: Series, x: Column, y: Column, n: int) -> Column:
    return s.full(n, F.covar_samp(x, y).over(s.last(n)))


def rolling_corr(s: Series, x: Column, y: Column, n: int) -> Column:
    spread = F.stddev_pop(x).over(s.last(n)) * F.stddev_pop(y).over(s.last(n))
    return s.full(n, F.when(spread > 0, F.covar_pop(x, y).over(s.last(n)) / spread).otherwise(0.0))


def rolling_corr_matrix(df: DataFrame, s: Series, columns: Sequence[str], n: int) -> DataFrame:
    """Each row with the correlations of all column pairs of its frame, as ``corr_a_b``."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return df.withColumns({f"corr_{a}_{b}": rolling_corr(s, F.col(a).cast("double"), F.col(b).cast("double"), n) for a, b in pairs})


def cumulative(s: Series, c: Column, how: str) -> Column:
    """Running sum or product (nulls carry), maximum or minimum (null before the first value)."""
    if how == "sum":
        return _zero(F.sum(c).over(s.so_far()))
    if how == "prod":
        return F.coalesce(F.product(c.cast("double")).over(s.so_far()), F.lit(1.0))
    return {"max": F.max, "min": F.min}[how](c).over(s.so_far())


def shift(s: Series, c: Column, periods: int) -> Column:
    return F.lag(c, periods).over(s.window()) if periods >= 0 else F.lead(c, -periods).over(s.window())


def diff(s: Series, c: Column, periods: int = 1) -> Column:
    """x - x before, with nulls as 0; null where no row stands before."""
    row = F.row_number().over(s.window())
    return F.when(row > periods, F.coalesce(c, F.lit(0)) - F.coalesce(shift(s, c, periods), F.lit(0)))


def pct_change(s: Series, c: Column, periods: int = 1) -> Column:
    before = F.nullif(F.coalesce(shift(s, c, periods), F.lit(0.0)).cast("double"), F.lit(0.0))
    return F.when(F.row_number().over(s.window()) > periods, F.try_divide(F.coalesce(c, F.lit(0.0)) - before, before))


def rank_average(c: Column, by: Sequence[str] = ()) -> Column:
    """1-based average rank of the values within the partition; null for null."""
    w = Window.partitionBy(*by, c.isNull())
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, c))
    return F.when(c.isNotNull(), F.rank().over(w.orderBy(c)) + (ties - 1) / 2.0)


def _more(df: DataFrame, fields: str) -> T.StructType:
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(fields).fields])


def linear_recursion(q: float, u: np.ndarray, new: np.ndarray, carry: float) -> np.ndarray:
    """y[t] = q y[t - 1] + u[t], begun anew where ``new``; ``carry`` is the value before the first row.

    Scaled running sums over blocks in which the powers of q stay in range.
    """
    if q <= 0:
        return u.astype(float)
    out = np.empty(len(u))
    size = int(min(512, max(1, 200 / max(-math.log(q), 1e-9))))
    powers = float(q) ** np.arange(1, size + 1)
    for a in range(0, len(u), size):
        part, begun = u[a : a + size], new[a : a + size]
        p = powers[: len(part)]
        c = np.concatenate([[0.0], np.cumsum(part / p)])
        at = np.maximum.accumulate(np.where(begun, np.arange(len(part)), -1))
        out[a : a + size] = p * (c[1:] + np.where(at < 0, carry, -c[np.maximum(at, 0)]))
        carry = out[min(a + size, len(u)) - 1]
    return out


def _streamed(df: DataFrame, s: Series, fields: str, run) -> DataFrame:
    """``run`` of batches that hold series one after another, in order, with ``_series``, a number for each; a series may span many batches."""
    rows = df.withColumn("_series", F.xxhash64(*s.by)).repartition(*s.by).sortWithinPartitions(*s.by, *s.order)
    return rows.mapInPandas(run, _more(df, fields))


def ewm(df: DataFrame, s: Series, column: str, span: float) -> DataFrame:
    """Rows with ewm_mean, ewm_var and ewm_std: recursive, alpha = 2 / (span + 1), variance from 0.

    The recursions are running sums over sorted batches and go on from batch to
    batch; the result is null where the value is, and the state goes on.
    """
    alpha = 2 / (span + 1)

    def run(batches):
        last, m0, v0 = None, 0.0, 0.0
        for pdf in batches:
            x = pdf[column].to_numpy(float)
            mean, var = np.full(len(x), np.nan), np.full(len(x), np.nan)
            seen = np.flatnonzero(~np.isnan(x))
            if len(seen):
                v, key = x[seen], pdf["_series"].to_numpy()[seen]
                new = np.concatenate([[key[0] != last], key[1:] != key[:-1]])
                m = linear_recursion(1 - alpha, np.where(new, v, alpha * v), new, m0)
                d = np.where(new, 0.0, v - np.concatenate([[m0], m[:-1]]))
                w = linear_recursion(1 - alpha, (1 - alpha) * alpha * d * d, new, v0)
                mean[seen], var[seen] = m, w
                last, m0, v0 = key[-1], m[-1], w[-1]
            out = pdf.drop(columns="_series")
            for name, values in (("ewm_mean", mean), ("ewm_var", var), ("ewm_std", np.sqrt(var))):
                out[name] = pd.Series(values, index=out.index).astype(object).where(~np.isnan(x), None)
            yield out

    return _streamed(df, s, "ewm_mean double, ewm_var double, ewm_std double", run)


def ewm_corr(df: DataFrame, s: Series, columns: Sequence[str], span: int) -> DataFrame:
    """Recursive exponentially weighted correlations of column pairs, as ``corr_a_b``; nulls count as 0."""
    alpha = 2 / (span + 1)
    n = len(columns)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]

    def run(batches):
        last, m0, c0 = None, np.zeros(n), dict.fromkeys(pairs, 0.0)
        for pdf in batches:
            if not len(pdf):
                continue
            x, key = pdf[list(columns)].fillna(0).to_numpy(float).T, pdf["_series"].to_numpy()
            new = np.concatenate([[key[0] != last], key[1:] != key[:-1]])
            mean = [linear_recursion(1 - alpha, np.where(new, v, alpha * v), new, m) for v, m in zip(x, m0, strict=True)]
            d = [np.where(new, 0.0, v - np.concatenate([[m], y[:-1]])) for v, m, y in zip(x, m0, mean, strict=True)]
            cov = {(i, j): linear_recursion(1 - alpha, (1 - alpha) * alpha * d[i] * d[j], new, c0[i, j]) for i, j in pairs}
            last, m0, c0 = key[-1], [y[-1] for y in mean], {k: c[-1] for k, c in cov.items()}
            out = pdf.drop(columns="_series")
            for i, j in pairs:
                if i < j:
                    both = np.sqrt(cov[i, i] * cov[j, j])
                    out[f"corr_{columns[i]}_{columns[j]}"] = np.where(both > 1e-15, cov[i, j] / np.where(both > 1e-15, both, 1), 0.0)
            yield out

    return _streamed(df, s, ", ".join(f"corr_{columns[i]}_{columns[j]} double" for i, j in pairs if i < j), run)


# risk


def rolling_sharpe(s: Series, r: Column, n: int, risk_free: float = 0.0) -> Column:
    std = F.stddev_samp(r).over(s.last(n))
    return s.full(n, F.when(std > 1e-12, (F.avg(r).over(s.last(n)) - risk_free) / std).otherwise(0.0))


def rolling_sortino(s: Series, r: Column, n: int, risk_free: float = 0.0) -> Column:
    """Downside deviation over the returns below the rate, divided by their number less one."""
    low = F.when(r < risk_free, F.pow(r - risk_free, F.lit(2.0)))
    k, total = F.count(low).over(s.last(n)), F.sum(low).over(s.last(n))
    down = F.sqrt(total / F.nullif(k - 1, F.lit(0)))
    return s.full(n, F.when((k >= 2) & (down > 1e-12), (F.avg(r).over(s.last(n)) - risk_free) / down).otherwise(0.0))


def rolling_max_drawdown(s: Series, c: Column, n: int) -> Column:
    """The largest fall from the running peak of the frame, relative to the peak."""
    values = F.collect_list(c.cast("double")).over(s.last(n))
    start = F.struct(F.lit(float("-inf")).alias("p"), F.lit(0.0).alias("d"))

    def step(a: Column, x: Column) -> Column:
        peak = F.greatest(a["p"], x)
        return F.struct(peak.alias("p"), F.greatest(a["d"], F.when(peak > 0, (peak - x) / peak).otherwise(0.0)).alias("d"))

    return s.full(n, F.aggregate(values, start, step, lambda a: a["d"]))


def rolling_var(s: Series, r: Column, n: int, confidence: float) -> Column:
    return s.full(n, -_zero(F.percentile(r, 1 - confidence).over(s.last(n))))


def rolling_cvar(s: Series, r: Column, n: int, confidence: float) -> Column:
    """Minus the mean of the returns at or below the quantile."""
    values = F.collect_list(r.cast("double")).over(s.last(n))
    q = F.percentile(r, 1 - confidence).over(s.last(n))
    worst = F.filter(values, lambda x: x <= q)
    return s.full(n, _zero(-F.try_divide(F.aggregate(worst, F.lit(0.0), lambda a, x: a + x), F.size(worst))))


def rolling_beta(s: Series, asset: Column, bench: Column, n: int) -> Column:
    var = F.var_samp(bench).over(s.last(n))
    return s.full(n, F.when(var > 1e-15, F.covar_samp(asset, bench).over(s.last(n)) / var).otherwise(0.0))


def rolling_alpha(s: Series, asset: Column, bench: Column, n: int) -> Column:
    return F.avg(asset).over(s.last(n)) - rolling_beta(s, asset, bench, n) * F.avg(bench).over(s.last(n))


def rolling_r2(s: Series, asset: Column, bench: Column, n: int) -> Column:
    return F.pow(rolling_corr(s, asset, bench, n), F.lit(2.0))


def rolling_residual(s: Series, asset: Column, bench: Column, n: int) -> Column:
    return asset - (rolling_alpha(s, asset, bench, n) + rolling_beta(s, asset, bench, n) * bench)


#: Frames that are worked on at once.
FRAMES = 16_384


def _rolling_matrix(df: DataFrame, s: Series, n: int, fields: str, columns: Sequence[str], f) -> DataFrame:
    """``f`` of stacked frames (frames by rows by columns) gives a list of arrays, one a field; frames reach back into earlier batches."""
    names = [x.split(" ")[0] for x in fields.split(", ")]

    def run(batches):
        rows, keys = np.empty((0, len(columns))), np.empty(0, np.int64)
        for pdf in batches:
            had = len(rows)
            rows = np.concatenate([rows, pdf[list(columns)].fillna(0).to_numpy(float)])
            keys = np.concatenate([keys, pdf["_series"].to_numpy()])
            values: list[list] = [[None] * len(pdf) for _ in names]
            end = np.arange(max(had, n - 1), len(rows))
            end = end[keys[end] == keys[end - n + 1]]
            frames = np.lib.stride_tricks.sliding_window_view(rows, n, axis=0).transpose(0, 2, 1) if len(end) else None
            for a in range(0, len(end), FRAMES):
                own = end[a : a + FRAMES]
                for have, got in zip(values, f(frames[own - n + 1]), strict=True):
                    for at, x in zip((own - had).tolist(), got.tolist(), strict=True):
                        have[at] = x
            out = pdf.drop(columns="_series")
            for name, v in zip(names, values, strict=True):
                out[name] = pd.Series(v, index=out.index, dtype=object)
            rows, keys = rows[max(0, len(rows) - n + 1) :], keys[max(0, len(keys) - n + 1) :]
            yield out

    return _streamed(df, s, fields, run)


def rolling_multi_beta(df: DataFrame, s: Series, asset: str, factors: Sequence[str], n: int) -> DataFrame:
    """Betas of several factors (array ``betas``) by demeaned normal equations; zeros where they are singular."""

    def betas(x: np.ndarray) -> list[np.ndarray]:
        d = x - x.mean(1, keepdims=True)
        z = d[:, :, 1:].transpose(0, 2, 1)
        a, b = z @ d[:, :, 1:], z @ d[:, :, :1]
        full = np.linalg.matrix_rank(a) == a.shape[1]
        out = np.zeros(b.shape[:2])
        out[full] = np.linalg.solve(a[full], b[full])[:, :, 0]
        return [out]

    return _rolling_matrix(df, s, n, "betas array<double>", [asset, *factors], betas)


def rolling_pca(df: DataFrame, s: Series, columns: Sequence[str], n: int, k: int) -> DataFrame:
    """Largest eigenvalues and explained shares of each frame's covariance matrix."""

    def top(x: np.ndarray) -> list[np.ndarray]:
        d = x - x.mean(1, keepdims=True)
        w = np.linalg.eigvalsh(d.transpose(0, 2, 1) @ d / (n - 1))[:, ::-1]
        total = w.sum(1, keepdims=True)
        return [w[:, :k], np.where(total > 0, w[:, :k] / np.where(total > 0, total, 1), 0.0)]

    return _rolling_matrix(df, s, n, "eigenvalues array<double>, explained array<double>", columns, top)
