"""Signals: Fourier transforms, filters and spectra of array columns, and integrals of sampled data.

Each works on NumPy arrays; :func:`column` lifts it to a column of arrays. Sums over
windows of rows (:func:`trapezoid`, :func:`simpson`) stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

fft, ifft, rfft, irfft, fft2, ifft2, fft_freq, rfft_freq = np.fft.fft, np.fft.ifft, np.fft.rfft, np.fft.irfft, np.fft.fft2, np.fft.ifft2, np.fft.fftfreq, np.fft.rfftfreq
fft_real = rfft


def _mode(full: np.ndarray, n: int, m: int, mode: str) -> np.ndarray:
    if mode == "full":
        return full
    size = max(n, m) if mode == "same" else max(n, m) - min(n, m) + 1
    start = (len(full) - size) // 2
    return full[start : start + size]


def convolve(a: Sequence[float], b: Sequence[float], mode: str = "full") -> np.ndarray:
    return _mode(np.convolve(a, b), len(a), len(b), mode)


def correlate(a: Sequence[float], b: Sequence[float], mode: str = "full") -> np.ndarray:
    return _mode(np.convolve(a, np.asarray(b)[::-1]), len(a), len(b), mode)


def fft_convolve(a: Sequence[float], b: Sequence[float], mode: str = "full") -> np.ndarray:
    n = len(a) + len(b) - 1
    return _mode(irfft(rfft(a, n) * rfft(b, n), n), len(a), len(b), mode)


def hann(n: int) -> np.ndarray:
    """The periodic raised cosine."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def spectrogram(x: Sequence[float], rate: float = 1.0, size: int = 256, overlap: int | None = None, detrend: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequencies, middle times and power densities (frequency by time) of windows that overlap by half."""
    x = np.asarray(x, float)
    size = min(size, len(x))
    step = size - (size // 2 if overlap is None else overlap)
    parts = np.lib.stride_tricks.sliding_window_view(x, size)[::step]
    parts = (parts - parts.mean(1, keepdims=True) if detrend else parts) * hann(size)
    power = np.abs(rfft(parts, axis=1)) ** 2 / (rate * (hann(size) ** 2).sum())
    power[:, 1 : (size + 1) // 2] *= 2
    return rfft_freq(size, 1 / rate), (np.arange(len(parts)) * step + size / 2) / rate, power.T


def welch(x: Sequence[float], rate: float = 1.0, size: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and the mean power density over windows."""
    f, _, p = spectrogram(x, rate, size)
    return f, p.mean(1)


def butter(order: int, cutoff: float, kind: str = "low") -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of a digital Butterworth filter; the cutoff is a fraction of half the sampling rate."""
    if not 0 < cutoff < 1:
        raise ValueError("cutoff outside (0, 1)")
    warped = 4 * np.tan(np.pi * cutoff / 2)
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    poles = warped * poles if kind == "low" else warped / poles
    digital = (4 + poles) / (4 - poles)
    b, a = np.poly(np.full(order, -1.0 if kind == "low" else 1.0)), np.real(np.poly(digital))
    at = 1.0 if kind == "low" else -1.0
    return b * np.polyval(a, at) / np.polyval(b, at), a


def lfilter(b: Sequence[float], a: Sequence[float], x: Sequence[float]) -> np.ndarray:
    """The recursive filter a[0] y[n] = sum b[k] x[n-k] - sum a[k] y[n-k]."""
    b, a = np.asarray(b, float) / a[0], np.asarray(a, float) / a[0]
    fed = np.convolve(x, b)[: len(x)]
    out = np.zeros(len(fed))
    for n in range(len(fed)):
        back = out[max(0, n - len(a) + 1) : n][::-1]
        out[n] = fed[n] - a[1 : len(back) + 1] @ back
    return out


def column(f: Callable[..., np.ndarray], *cols: Column, parts: Callable[[np.ndarray], np.ndarray] = np.real) -> Column:
    """``f`` of array columns as an array of double; ``parts`` picks from complex results."""

    @F.pandas_udf("array<double>")
    def apply(*series: pd.Series) -> pd.Series:
        return pd.Series([None if any(x is None for x in row) else np.asarray(parts(f(*[np.asarray(x, float) for x in row])), float) for row in zip(*series, strict=True)])

    return apply(*cols)


def trapezoid(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """The integral of y over x for each group, by straight lines between neighbours."""
    order = Window.partitionBy(*by).orderBy(x)
    piece = (F.col(y) + F.lag(y).over(order)) / 2 * (F.col(x) - F.lag(x).over(order))
    return df.withColumn("_piece", piece).groupBy(*by).agg(F.coalesce(F.sum("_piece"), F.lit(0.0)).alias("integral"))


def simpson(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """The integral by parabolas through three neighbours at uneven steps; a last odd step is taken from the parabola before it."""
    order = Window.partitionBy(*by).orderBy(x)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    at = F.row_number().over(order) - 1
    h0, h1 = F.lag(x, 1).over(order) - F.lag(x, 2).over(order), F.col(x) - F.lag(x, 1).over(order)
    y0, y1, y2 = F.lag(y, 2).over(order), F.lag(y, 1).over(order), F.col(y)
    both = (h0 + h1) / 6 * ((2 - h1 / h0) * y0 + (h0 + h1) * (h0 + h1) / (h0 * h1) * y1 + (2 - h0 / h1) * y2)
    last = h1 * ((2 * h1 * h1 + 3 * h0 * h1) / (6 * (h0 + h1)) * y2 / h1 + (h1 * h1 + 3 * h0 * h1) / (6 * h0) * y1 / h1 - h1 * h1 * h1 / (6 * h0 * (h0 + h1)) * y0 / h1)
    line = F.when((at == 1) & (n == 2), (y1 + y2) / 2 * h1)
    piece = F.when((at >= 2) & (at % 2 == 0), both).when((at >= 2) & (at == n - 1), last).otherwise(line)
    return df.withColumn("_piece", piece).groupBy(*by).agg(F.coalesce(F.sum("_piece"), F.lit(0.0)).alias("integral"))
