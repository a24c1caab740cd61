"""Losses and metrics as aggregates over prediction tables, activations as expressions, learning-rate schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-7

ACTIVATIONS = {
    "relu": lambda c: F.greatest(c, F.lit(0.0)), "sigmoid": lambda c: 1 / (1 + F.exp(-c)), "tanh": F.tanh,
    "leaky_relu": lambda c, a=0.01: F.when(c > 0, c).otherwise(a * c), "elu": lambda c, a=1.0: F.when(c > 0, c).otherwise(a * (F.exp(c) - 1)),
    "gelu": lambda c: 0.5 * c * (1 + F.tanh(math.sqrt(2 / math.pi) * (c + 0.044715 * c * c * c))), "swish": lambda c: c / (1 + F.exp(-c)),
}


def _clip(p: Column) -> Column:
    return F.greatest(F.least(p, F.lit(1 - EPS)), F.lit(EPS))


def losses(p: Column, y: Column, delta: float = 1.0) -> dict[str, Column]:
    """Mean losses of predictions against targets, as aggregates."""
    e = F.abs(p - y)
    return {
        "mse": F.avg(e * e), "mae": F.avg(e), "huber": F.avg(F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta))),
        "binary_cross_entropy": F.avg(-(y * F.ln(_clip(p)) + (1 - y) * F.ln(1 - _clip(p)))),
    }


def binary_metrics(p: Column, y: Column, threshold: float = 0.5) -> dict[str, Column]:
    hit, real = p >= threshold, y >= 0.5
    tp, fp, fn = F.count_if(hit & real), F.count_if(hit & ~real), F.count_if(~hit & real)
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return {"accuracy": F.avg((hit == real).cast("double")), "precision": zero(tp, tp + fp), "recall": zero(tp, tp + fn), "f1": zero(2 * tp, 2 * tp + fp + fn)}


def auc(df: DataFrame, p: str, y: str) -> DataFrame:
    """Area under the curve by average ranks of distinct scores."""
    from tessera.operators.ranks import running

    v = df.groupBy(p).agg(F.count_if(F.col(y) >= 0.5).alias("pos"), F.count_if(F.col(y) < 0.5).alias("neg"))
    v, _ = running(v, [p], ["neg"])
    return v.select((F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)).alias("u"), "pos", "neg").agg(F.try_divide(F.sum("u"), F.sum("pos") * F.sum("neg")).alias("auc"))


def exponential_decay(lr: float, step: int, every: int, rate: float, staircase: bool = False) -> float:
    x = step / every
    return lr * rate ** (math.floor(x) if staircase else x)


def cosine_decay(lr: float, step: int, total: int, alpha: float = 0.0) -> float:
    x = 0.5 * (1 + math.cos(math.pi * min(step, total) / total))
    return lr * ((1 - alpha) * x + alpha)


def warmup(lr: float, step: int, steps: int) -> float:
    return lr * min(1.0, (step + 1) / steps)


def penalty(c: Column, l1: float = 0.0, l2: float = 0.0) -> Column:
    return F.sum(l1 * F.abs(c) + l2 * c * c)
