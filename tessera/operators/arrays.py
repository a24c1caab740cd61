"""Arrays as tables: an n-d array is a frame (i0, i1, ..., v), a vector column an array column.

Contractions are joins on the shared index followed by a sum, reductions are
group-bys, so large arrays stay distributed. Small dense blocks use NumPy.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def axes(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "v"]


def from_numpy(spark: SparkSession, a: np.ndarray) -> DataFrame:
    a = np.asarray(a, float)
    rows = [(*map(int, i), float(a[i])) for i in np.ndindex(*a.shape)]
    return spark.createDataFrame(rows, ", ".join([*[f"i{k} long" for k in range(a.ndim)], "v double"]))


def to_numpy(df: DataFrame, shape: Sequence[int]) -> np.ndarray:
    out = np.zeros(tuple(shape))
    for r in df.collect():
        out[tuple(r[:-1])] = r[-1]
    return out


def arange(spark: SparkSession, start: float, stop: float, step: float) -> DataFrame:
    n = max(0, int(np.ceil((stop - start) / step)))
    return spark.range(n).select(F.col("id").alias("i0"), (F.lit(float(start)) + F.col("id") * float(step)).alias("v"))


def linspace(spark: SparkSession, start: float, stop: float, n: int) -> DataFrame:
    step = (stop - start) / (n - 1) if n > 1 else 0.0
    return spark.range(n).select(F.col("id").alias("i0"), (F.lit(float(start)) + F.col("id") * step).alias("v"))


def logspace(spark: SparkSession, start: float, stop: float, n: int) -> DataFrame:
    return linspace(spark, start, stop, n).withColumn("v", F.pow(F.lit(10.0), "v"))


def eye(spark: SparkSession, n: int) -> DataFrame:
    """The identity's non-zero cells."""
    return spark.range(n).select(F.col("id").alias("i0"), F.col("id").alias("i1"), F.lit(1.0).alias("v"))


def full(spark: SparkSession, value: float, *shape: int) -> DataFrame:
    n = int(np.prod(shape))
    cols, rest = [], F.col("id")
    for k in range(len(shape) - 1, -1, -1):
        cols.insert(0, (rest % shape[k]).alias(f"i{k}"))
        rest = F.floor(rest / shape[k])
    return spark.range(n).select(*cols, F.lit(float(value)).alias("v"))


REDUCTIONS = {
    "sum": F.sum, "prod": F.product, "min": F.min, "max": F.max, "mean": F.avg, "var": F.var_pop, "std": F.stddev_pop,
    "median": F.median, "count_nonzero": lambda c: F.count_if(c != 0), "all": lambda c: F.bool_and(c != 0), "any": lambda c: F.bool_or(c != 0),
}


def reduce_axes(df: DataFrame, how: str, *over: str, skip_nan: bool = False) -> DataFrame:
    """Reduction over the named axes (all if none); variance is the population's. ``skip_nan`` leaves NaN out."""
    v = F.when(~F.isnan("v"), F.col("v")) if skip_nan else F.col("v")
    keep = [a for a in axes(df) if over and a not in over]
    return df.groupBy(*keep).agg(REDUCTIONS[how](v).alias("v"))


def quantile(df: DataFrame, q: float, *over: str) -> DataFrame:
    if not 0 <= q <= 1:
        raise ValueError("q outside [0, 1]")
    keep = [a for a in axes(df) if over and a not in over]
    return df.groupBy(*keep).agg(F.percentile("v", q).alias("v"))


def average(df: DataFrame, weights: DataFrame, *over: str) -> DataFrame:
    shared = axes(weights)
    keep = [a for a in axes(df) if over and a not in over]
    both = df.join(weights.withColumnRenamed("v", "w"), shared)
    return both.groupBy(*keep).agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))


def arg_extreme(df: DataFrame, axis: str, largest: bool = True) -> DataFrame:
    """The first index along an axis of the largest (smallest) value."""
    keep = [a for a in axes(df) if a != axis]
    key = F.struct(F.col("v") if largest else -F.col("v"), -F.col(axis))
    return df.groupBy(*keep).agg(F.max_by(axis, key).alias(axis))


def cumulative(df: DataFrame, axis: str, how: str = "sum") -> DataFrame:
    w = Window.partitionBy(*[a for a in axes(df) if a != axis]).orderBy(axis)
    f = {"sum": F.sum, "prod": F.product}[how]
    return df.withColumn("v", f("v").over(w))


def contract(a: DataFrame, b: DataFrame, on: Sequence[tuple[str, str]], keep_a: Sequence[str], keep_b: Sequence[str]) -> DataFrame:
    """Sum of products over paired axes; the kept axes are renamed i0, i1, ..."""
    l = a.select(*[F.col(c).alias(f"a_{c}") for c in axes(a)], F.col("v").alias("x"))
    r = b.select(*[F.col(c).alias(f"b_{c}") for c in axes(b)], F.col("v").alias("y"))
    cond = reduce(lambda p, q: p & q, [F.col(f"a_{p}") == F.col(f"b_{q}") for p, q in on])
    keep = [f"a_{c}" for c in keep_a] + [f"b_{c}" for c in keep_b]
    out = l.join(r, cond).groupBy(*keep).agg(F.sum(F.col("x") * F.col("y")).alias("v"))
    return out.select(*[F.col(c).alias(f"i{k}") for k, c in enumerate(keep)], "v")


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    return contract(a, b, [("i1", "i0")], ["i0"], ["i1"])


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner product of vectors, matrix-vector or matrix-matrix product, by the last and first axes."""
    return contract(a, b, [(axes(a)[-1], axes(b)[0])], axes(a)[:-1], axes(b)[1:])


def transpose(df: DataFrame) -> DataFrame:
    return df.select(F.col("i1").alias("i0"), F.col("i0").alias("i1"), "v")


def trace(df: DataFrame) -> DataFrame:
    return df.filter("i0 = i1").agg(F.sum("v").alias("v"))


def einsum(notation: str, *operands: DataFrame) -> DataFrame:
    """Einstein notation: one join per operand, one sum at the end."""
    left, out = notation.replace(" ", "").split("->")
    joined, seen = None, set()
    for k, (term, df) in enumerate(zip(left.split(","), operands, strict=True)):
        x = df
        for i, c in enumerate(term):
            first = term.index(c)
            if first != i:
                x = x.filter(F.col(f"i{first}") == F.col(f"i{i}"))
        x = x.select(*[F.col(f"i{term.index(c)}").alias(f"x_{c}") for c in dict.fromkeys(term)], F.col("v").alias(f"v{k}"))
        shared = [f"x_{c}" for c in dict.fromkeys(term) if c in seen]
        joined = x if joined is None else (joined.join(x, shared) if shared else joined.crossJoin(F.broadcast(x)))
        seen |= set(term)
    product = reduce(lambda p, q: p * q, [F.col(f"v{k}") for k in range(len(operands))])
    got = joined.groupBy(*[f"x_{c}" for c in out]).agg(F.sum(product).alias("v"))
    return got.select(*[F.col(f"x_{c}").alias(f"i{k}") for k, c in enumerate(out)], "v")


def sort_axis(df: DataFrame, axis: str) -> DataFrame:
    keep = [a for a in axes(df) if a != axis]
    return df.select(*keep, (F.row_number().over(Window.partitionBy(*keep).orderBy("v")) - 1).alias(axis), "v")


def search_sorted(values: Column, at: Column) -> Column:
    """The first place in a sorted array column where a value fits."""
    return F.size(F.filter(values, lambda x: x < at))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, low, high, n): equal widths from minimum to maximum, the last bin closed; constants are widened by 1."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    high = high if high > low else low + 1.0
    width = (high - low) / bins
    at = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    out = df.filter(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("bin", (F.lit(low) + F.col("bin") * width).alias("low"), (F.lit(low) + (F.col("bin") + 1) * width).alias("high"), "n")


def bincount(df: DataFrame, column: str) -> DataFrame:
    """(bin, n) for 0 to the largest truncated value."""
    spark = df.sparkSession
    got = df.groupBy(F.col(column).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    top = df.agg(F.max(F.col(column).cast("long"))).first()[0]
    return spark.range(0, (top if top is not None else -1) + 1).withColumnRenamed("id", "bin").join(got, "bin", "left").fillna(0, ["n"])


def convolve(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full discrete convolution of two vectors; the kernel is the bounded side and is sent to the tasks."""
    k = b.select(F.col("i0").alias("j"), F.col("v").alias("u"))
    return a.crossJoin(F.broadcast(k)).groupBy((F.col("i0") + F.col("j")).alias("i0")).agg(F.sum(F.col("v") * F.col("u")).alias("v"))
