"""N-d arrays with a shape over long-form cells (i0, i1, ..., v): creation, broadcasting, indexing, rearrangement.

Every cell is a row, so an operation on places is arithmetic on index columns and
one that pairs arrays is a join on them; nothing is gathered. The shape is known
to the driver and checked there.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import arrays

C = F.col


def _axes(n: int) -> list[str]:
    return [f"i{k}" for k in range(n)]


def broadcast_shapes(a: Sequence[int], b: Sequence[int]) -> tuple[int, ...]:
    """The shape that both stretch to: axes are paired from the last, size 1 stretches."""
    n = max(len(a), len(b))
    a, b = (1,) * (n - len(a)) + tuple(a), (1,) * (n - len(b)) + tuple(b)
    if any(x != y and 1 not in (x, y) for x, y in zip(a, b, strict=True)):
        raise ValueError(f"shapes {a} and {b} do not fit")
    return tuple(y if x == 1 else x for x, y in zip(a, b, strict=True))


@dataclass(frozen=True)
class NDArray:
    """Cells and shape; ``cells`` has a row for every place."""

    cells: DataFrame
    shape: tuple[int, ...]

    def __post_init__(self):
        if any(n < 0 for n in self.shape):
            raise ValueError("negative size")

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def spark(self) -> SparkSession:
        return self.cells.sparkSession

    def axis(self, k: int) -> int:
        if not -self.ndim <= k < self.ndim:
            raise ValueError(f"no axis {k}")
        return k % self.ndim

    def numpy(self) -> np.ndarray:
        return arrays.to_numpy(self.cells.select(*_axes(self.ndim), "v"), self.shape)

    def with_indices(self, shape: Sequence[int], *index: Column, v: Column | None = None) -> NDArray:
        """New places and values for the same rows."""
        return NDArray(self.cells.select(*[x.cast("long").alias(f"i{k}") for k, x in enumerate(index)], (C("v") if v is None else v).cast("double").alias("v")), tuple(shape))

    def flat(self) -> Column:
        """A cell's place in row-major order."""
        out = F.lit(0).cast("long")
        for k, n in enumerate(self.shape):
            out = out * n + C(f"i{k}")
        return out

    def get(self, *index: int) -> float:
        return self.cells.filter(reduce(lambda p, q: p & q, [C(f"i{k}") == i for k, i in enumerate(index)])).first().v

    def set(self, value: float, *index: int) -> NDArray:
        here = reduce(lambda p, q: p & q, [C(f"i{k}") == i for k, i in enumerate(index)])
        return NDArray(self.cells.withColumn("v", F.when(here, F.lit(float(value))).otherwise(C("v"))), self.shape)

    def map(self, f: Callable[[Column], Column]) -> NDArray:
        return NDArray(self.cells.withColumn("v", f(C("v")).cast("double")), self.shape)

    def reshape(self, *shape: int) -> NDArray:
        if shape.count(-1) == 1:
            rest = math.prod(n for n in shape if n != -1)
            shape = tuple(self.size // rest if n == -1 else n for n in shape)
        if math.prod(shape) != self.size:
            raise ValueError("sizes differ")
        return self.with_indices(shape, *_unflatten(self.flat(), shape))


def _unflatten(flat: Column, shape: Sequence[int]) -> list[Column]:
    out, rest = [], flat
    for n in reversed(shape):
        out.insert(0, F.pmod(rest, F.lit(max(n, 1))))
        rest = F.floor(rest / max(n, 1))
    return out


# creation


def from_function(spark: SparkSession, f: Callable[..., Column], *shape: int) -> NDArray:
    """``f`` of the index columns."""
    rows = spark.range(math.prod(shape)).select(*[x.cast("long").alias(f"i{k}") for k, x in enumerate(_unflatten(C("id"), shape))])
    return NDArray(rows.withColumn("v", f(*[C(a) for a in _axes(len(shape))]).cast("double")), tuple(shape))


def from_slice(spark: SparkSession, values: Sequence) -> NDArray:
    """From a list, or a list of rows."""
    a = np.asarray(values, float)
    return NDArray(arrays.from_numpy(spark, a), a.shape)


def from_iter(spark: SparkSession, values: Iterable[float], n: int = -1) -> NDArray:
    return from_slice(spark, np.fromiter(values, float, n))


def from_column(df: DataFrame, order: str, vector: str) -> NDArray:
    """A matrix whose rows are the array column, placed by the dense key ``order`` (0, 1, ...); sizes are counted."""
    n, m = df.agg(F.max(order), F.max(F.size(vector))).first()
    cells = df.select(C(order).cast("long").alias("i0"), F.posexplode(vector).alias("i1", "v"))
    return NDArray(cells.select("i0", C("i1").cast("long").alias("i1"), C("v").cast("double").alias("v")), (n + 1, m))


def full(spark: SparkSession, value: float, *shape: int) -> NDArray:
    return from_function(spark, lambda *i: F.lit(float(value)), *shape)


def zeros(spark: SparkSession, *shape: int) -> NDArray:
    return full(spark, 0.0, *shape)


def ones(spark: SparkSession, *shape: int) -> NDArray:
    return full(spark, 1.0, *shape)


empty = zeros


def eye(spark: SparkSession, n: int, m: int | None = None, k: int = 0) -> NDArray:
    return from_function(spark, lambda i, j: F.when(j - i == k, 1.0).otherwise(0.0), n, n if m is None else m)


identity = eye


def tri(spark: SparkSession, n: int, m: int | None = None, k: int = 0) -> NDArray:
    """Ones on and below the k-th diagonal."""
    return from_function(spark, lambda i, j: F.when(j - i <= k, 1.0).otherwise(0.0), n, n if m is None else m)


def geomspace(spark: SparkSession, start: float, stop: float, n: int) -> NDArray:
    """Numbers of equal ratio, both ends included."""
    if start * stop <= 0:
        raise ValueError("both ends need one sign and may not be 0")
    step = math.log(stop / start) / max(n - 1, 1)
    return from_function(spark, lambda i: F.lit(float(start)) * F.exp(i * step), n)


def meshgrid(x: NDArray, y: NDArray) -> tuple[NDArray, NDArray]:
    """The x of each place of the grid (y's size by x's size), and the y."""
    shape = (y.shape[0], x.shape[0])
    return broadcast_to(x, shape), broadcast_to(y.reshape(-1, 1), shape)


def vander(x: NDArray, n: int | None = None) -> NDArray:
    """Powers n-1, ..., 0 of each value."""
    n = x.shape[0] if n is None else n
    wide = broadcast_to(x.reshape(-1, 1), (x.shape[0], n))
    return NDArray(wide.cells.withColumn("v", F.pow("v", F.lit(n - 1) - C("i1"))), wide.shape)


def diag(a: NDArray, k: int = 0) -> NDArray:
    """The k-th diagonal of a matrix, or the matrix with a vector on its k-th diagonal."""
    if a.ndim == 2:
        return diagonal(a, k)
    n = a.shape[0] + abs(k)
    place = eye(a.spark, n, k=k).cells
    i = C("i0") if k >= 0 else C("i1")
    vector = a.cells.select(C("i0").alias("p"), C("v").alias("x"))
    return NDArray(place.withColumn("p", i).join(vector, "p", "left").select("i0", "i1", F.when(C("v") != 0, C("x")).otherwise(0.0).alias("v")), (n, n))


def diagflat(a: NDArray, k: int = 0) -> NDArray:
    return diag(ravel(a), k)


def tril(a: NDArray, k: int = 0) -> NDArray:
    return NDArray(a.cells.withColumn("v", F.when(C("i1") - C("i0") <= k, C("v")).otherwise(0.0)), a.shape)


def triu(a: NDArray, k: int = 0) -> NDArray:
    return NDArray(a.cells.withColumn("v", F.when(C("i1") - C("i0") >= k, C("v")).otherwise(0.0)), a.shape)


# broadcasting


def broadcast_to(a: NDArray, shape: Sequence[int]) -> NDArray:
    """Repeats axes of size 1, and new axes in front, as rows."""
    shape = tuple(shape)
    if broadcast_shapes(a.shape, shape) != shape:
        raise ValueError(f"{a.shape} does not stretch to {shape}")
    new = len(shape) - a.ndim
    rows = a.cells.select(*[C(f"i{k}").alias(f"i{k + new}") for k in range(a.ndim)], "v")
    for k, n in enumerate(shape):
        if k < new or a.shape[k - new] != n:
            rows = rows.withColumn(f"i{k}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))) if n else rows.filter("false").withColumn(f"i{k}", F.lit(0).cast("long"))
    return NDArray(rows.select(*_axes(len(shape)), "v"), shape)


def binary(a: NDArray, b: NDArray, f: Callable[[Column, Column], Column]) -> NDArray:
    """``f`` of two arrays, cell by cell; axes of size 1 stretch without repeating the smaller array's rows."""
    shape = broadcast_shapes(a.shape, b.shape)
    wide = broadcast_to(a, shape)
    lead = len(shape) - b.ndim
    on = [f"i{k + lead}" for k, n in enumerate(b.shape) if n == shape[k + lead] and n != 1]
    other = b.cells.select(*[C(f"i{k}").alias(f"i{k + lead}") for k in range(b.ndim) if f"i{k + lead}" in on], C("v").alias("_b"))
    both = wide.cells.join(other, on) if on else wide.cells.join(F.broadcast(other))  # a single cell
    return NDArray(both.select(*_axes(len(shape)), f(C("v"), C("_b")).cast("double").alias("v")), shape)


def where(condition: NDArray, a: NDArray, b: NDArray) -> NDArray:
    """a where the condition is not 0, else b."""
    first = binary(condition, a, lambda c, x: F.when(c != 0, x))
    return binary(first, b, lambda x, y: F.coalesce(x, y))


# indexing


def take(a: NDArray, index: Sequence[int], axis: int = 0) -> NDArray:
    """Slices at places of an axis, repeats allowed."""
    k = a.axis(axis)
    n = a.shape[k]
    if any(not -n <= i < n for i in index):
        raise IndexError("out of range")
    places = a.spark.createDataFrame([(i % n, j) for j, i in enumerate(index)], "p long, q long")
    rows = a.cells.withColumnRenamed(f"i{k}", "p").join(F.broadcast(places), "p")
    return NDArray(rows.select(*[C("q" if j == k else f"i{j}").alias(f"i{j}") for j in range(a.ndim)], "v"), (*a.shape[:k], len(index), *a.shape[k + 1 :]))


def take_along_axis(a: NDArray, index: NDArray, axis: int) -> NDArray:
    """For each cell of ``index`` the cell of ``a`` at that place of the axis."""
    k = a.axis(axis)
    places = index.cells.withColumn("p", C("v").cast("long")).drop("v")
    source = a.cells.withColumnRenamed(f"i{k}", "p")
    return NDArray(places.join(source, [c for c in _axes(a.ndim) if c != f"i{k}"] + ["p"]).select(*_axes(a.ndim), "v"), index.shape)


def choose(index: NDArray, choices: Sequence[NDArray]) -> NDArray:
    """For each cell the value of the array that its number names."""
    stacked = reduce(lambda p, q: p.unionByName(q), [x.cells.withColumn("_n", F.lit(n).cast("long")) for n, x in enumerate(choices)])
    rows = index.cells.withColumn("_n", C("v").cast("long")).drop("v").join(stacked, [*_axes(index.ndim), "_n"])
    return NDArray(rows.select(*_axes(index.ndim), "v"), index.shape)


def compress(keep: Sequence[bool], a: NDArray, axis: int = 0) -> NDArray:
    """The slices of an axis whose condition holds."""
    return take(a, [i for i, x in enumerate(keep) if x], axis)


def diagonal(a: NDArray, k: int = 0) -> NDArray:
    n = max(0, min(a.shape[0] - max(-k, 0), a.shape[1] - max(k, 0)))
    rows = a.cells.filter(C("i1") - C("i0") == k).select(F.least("i0", "i1").alias("i0"), "v")
    return NDArray(rows, (n,))


def select(conditions: Sequence[NDArray], choices: Sequence[NDArray], default: float = 0.0) -> NDArray:
    """The choice of the first condition that is not 0, else the default."""
    out = full(choices[0].spark, default, *choices[0].shape)
    for c, x in zip(reversed(conditions), reversed(choices), strict=True):
        out = where(c, x, out)
    return out


def as_strided(a: NDArray, shape: Sequence[int], strides: Sequence[int]) -> NDArray:
    """A view by steps in the flat array; places may overlap."""
    flat = a.cells.select(a.flat().alias("p"), "v")
    places = from_function(a.spark, lambda *i: reduce(lambda p, q: p + q, [x * s for x, s in zip(i, strides, strict=True)]), *shape)
    return NDArray(places.cells.withColumn("p", C("v").cast("long")).drop("v").join(flat, "p").select(*_axes(len(shape)), "v"), tuple(shape))


def argwhere(a: NDArray) -> DataFrame:
    """Places of cells that are not 0."""
    return a.cells.filter("v != 0").select(*_axes(a.ndim))


nonzero = argwhere


def flatnonzero(a: NDArray) -> DataFrame:
    return a.cells.filter("v != 0").select(a.flat().alias("i0"))


def extract(condition: NDArray, a: NDArray) -> DataFrame:
    """(i0: flat place, v) of cells whose condition is not 0; order by i0."""
    kept = condition.cells.filter("v != 0").select(*_axes(a.ndim))
    return a.cells.join(kept, _axes(a.ndim), "left_semi").select(a.flat().alias("i0"), "v")


def count_nonzero(a: NDArray) -> DataFrame:
    return a.cells.agg(F.count_if(C("v") != 0).alias("v"))


# rearrangement


def ravel(a: NDArray) -> NDArray:
    return a.with_indices((a.size,), a.flat())


flatten = ravel


def transpose(a: NDArray, order: Sequence[int] | None = None) -> NDArray:
    order = list(range(a.ndim))[::-1] if order is None else [a.axis(k) for k in order]
    return a.with_indices([a.shape[k] for k in order], *[C(f"i{k}") for k in order])


def swapaxes(a: NDArray, x: int, y: int) -> NDArray:
    order = list(range(a.ndim))
    order[x], order[y] = order[y], order[x]
    return transpose(a, order)


def moveaxis(a: NDArray, source: int, target: int) -> NDArray:
    order = [k for k in range(a.ndim) if k != a.axis(source)]
    order.insert(a.axis(target), a.axis(source))
    return transpose(a, order)


def rollaxis(a: NDArray, axis: int, start: int = 0) -> NDArray:
    """The axis moved before the one that stands at ``start``."""
    k = a.axis(axis)
    return moveaxis(a, k, start - 1 if k < start else start)


def expand_dims(a: NDArray, axis: int) -> NDArray:
    k = axis % (a.ndim + 1)
    index = [C(f"i{j}") for j in range(a.ndim)]
    return a.with_indices((*a.shape[:k], 1, *a.shape[k:]), *index[:k], F.lit(0), *index[k:])


def squeeze(a: NDArray) -> NDArray:
    keep = [k for k, n in enumerate(a.shape) if n != 1]
    return a.with_indices([a.shape[k] for k in keep], *[C(f"i{k}") for k in keep])


def _placed(a: NDArray, axis: int, place: Callable[[Column, int], Column], size: int | None = None) -> NDArray:
    k = a.axis(axis)
    n = a.shape[k]
    index = [place(C(f"i{j}"), n) if j == k else C(f"i{j}") for j in range(a.ndim)]
    return a.with_indices((*a.shape[:k], n if size is None else size, *a.shape[k + 1 :]), *index)


def flip(a: NDArray, axis: int = 0) -> NDArray:
    return _placed(a, axis, lambda i, n: F.lit(n - 1) - i)


def fliplr(a: NDArray) -> NDArray:
    return flip(a, 1)


def flipud(a: NDArray) -> NDArray:
    return flip(a, 0)


def rot90(a: NDArray, k: int = 1) -> NDArray:
    """Quarter turns, the first axis towards the second backwards."""
    for _ in range(k % 4):
        a = flip(swapaxes(a, 0, 1), 0)
    return a


def roll(a: NDArray, shift: int, axis: int | None = None) -> NDArray:
    if axis is None:
        return roll(ravel(a), shift, 0).reshape(*a.shape)
    return _placed(a, axis, lambda i, n: F.pmod(i + shift, F.lit(max(n, 1))))


# joining and cutting


def concatenate(parts: Sequence[NDArray], axis: int = 0) -> NDArray:
    k = parts[0].axis(axis)
    if len({(*p.shape[:k], *p.shape[k + 1 :]) for p in parts}) != 1:
        raise ValueError("other axes differ")
    rows, at = None, 0
    for p in parts:
        moved = p.cells.withColumn(f"i{k}", C(f"i{k}") + at)
        rows = moved if rows is None else rows.unionByName(moved)
        at += p.shape[k]
    return NDArray(rows, (*parts[0].shape[:k], at, *parts[0].shape[k + 1 :]))


def stack(parts: Sequence[NDArray], axis: int = 0) -> NDArray:
    return concatenate([expand_dims(p, axis) for p in parts], axis)


def vstack(parts: Sequence[NDArray]) -> NDArray:
    return concatenate([expand_dims(p, 0) if p.ndim == 1 else p for p in parts], 0)


def hstack(parts: Sequence[NDArray]) -> NDArray:
    return concatenate(parts, 0 if parts[0].ndim == 1 else 1)


def dstack(parts: Sequence[NDArray]) -> NDArray:
    def deep(p: NDArray) -> NDArray:
        p = expand_dims(p, 0) if p.ndim == 1 else p
        return expand_dims(p, 2) if p.ndim == 2 else p

    return concatenate([deep(p) for p in parts], 2)


def append(a: NDArray, b: NDArray, axis: int | None = None) -> NDArray:
    return concatenate([ravel(a), ravel(b)]) if axis is None else concatenate([a, b], axis)


def cut(a: NDArray, start: int, stop: int, axis: int = 0) -> NDArray:
    """The slices from ``start`` to before ``stop``."""
    k = a.axis(axis)
    kept = NDArray(a.cells.filter((C(f"i{k}") >= start) & (C(f"i{k}") < stop)), a.shape)
    return _placed(kept, k, lambda i, n: i - start, max(0, min(stop, a.shape[k]) - start))


def split(a: NDArray, parts: int | Sequence[int], axis: int = 0) -> list[NDArray]:
    """Equal parts, or parts that begin at the given places."""
    n = a.shape[a.axis(axis)]
    if isinstance(parts, int):
        if n % parts:
            raise ValueError("no equal parts")
        parts = [n // parts * k for k in range(1, parts)]
    edges = [0, *parts, n]
    return [cut(a, x, y, axis) for x, y in zip(edges, edges[1:], strict=False)]


def hsplit(a: NDArray, parts: int | Sequence[int]) -> list[NDArray]:
    return split(a, parts, 0 if a.ndim == 1 else 1)


def vsplit(a: NDArray, parts: int | Sequence[int]) -> list[NDArray]:
    return split(a, parts, 0)


def dsplit(a: NDArray, parts: int | Sequence[int]) -> list[NDArray]:
    return split(a, parts, 2)


def tile(a: NDArray, *times: int) -> NDArray:
    """The array side by side ``times`` along each axis; missing axes stand in front."""
    n = max(a.ndim, len(times))
    times = (1,) * (n - len(times)) + tuple(times)
    while a.ndim < n:
        a = expand_dims(a, 0)
    for k, t in enumerate(times):
        rows = a.cells.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(t - 1)))).withColumn(f"i{k}", C(f"i{k}") + C("_r") * a.shape[k]).drop("_r")
        a = NDArray(rows, (*a.shape[:k], a.shape[k] * t, *a.shape[k + 1 :]))
    return a


def repeat(a: NDArray, times: int, axis: int | None = None) -> NDArray:
    """Each slice ``times`` in a row."""
    if axis is None:
        return repeat(ravel(a), times, 0)
    k = a.axis(axis)
    rows = a.cells.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn(f"i{k}", C(f"i{k}") * times + C("_r")).drop("_r")
    return NDArray(rows, (*a.shape[:k], a.shape[k] * times, *a.shape[k + 1 :]))


def delete(a: NDArray, index: int | Sequence[int], axis: int = 0) -> NDArray:
    k = a.axis(axis)
    gone = {i % a.shape[k] for i in ([index] if isinstance(index, int) else index)}
    return take(a, [i for i in range(a.shape[k]) if i not in gone], k)


def insert(a: NDArray, index: int, values: NDArray, axis: int = 0) -> NDArray:
    """``values`` (slices along the axis) put before the place ``index``."""
    k = a.axis(axis)
    return concatenate([cut(a, 0, index, k), values, cut(a, index, a.shape[k], k)], k)


# order and sets


def argsort(a: NDArray, axis: int = -1) -> NDArray:
    """Places that sort an axis; equal values keep their order."""
    k = a.axis(axis)
    w = Window.partitionBy(*[c for c in _axes(a.ndim) if c != f"i{k}"]).orderBy("v", f"i{k}")
    rows = a.cells.withColumn("_r", F.row_number().over(w) - 1)
    return NDArray(rows.select(*[C("_r").cast("long").alias(c) if c == f"i{k}" else C(c) for c in _axes(a.ndim)], C(f"i{k}").cast("double").alias("v")), a.shape)


def sort(a: NDArray, axis: int = -1) -> NDArray:
    k = a.axis(axis)
    w = Window.partitionBy(*[c for c in _axes(a.ndim) if c != f"i{k}"]).orderBy("v", f"i{k}")
    return NDArray(a.cells.withColumn(f"i{k}", (F.row_number().over(w) - 1).cast("long")).select(*_axes(a.ndim), "v"), a.shape)


#: A full sort is a valid partition: what stands before the k-th place is not larger.
partition, argpartition = (lambda a, kth, axis=-1: sort(a, axis)), (lambda a, kth, axis=-1: argsort(a, axis))


def lexsort(keys: Sequence[str], df: DataFrame, position: str) -> DataFrame:
    """Rows in the order of several columns, the last the primary one; (rank, position)."""
    from tessera.operators.ranks import numbered

    return numbered(df.select(position, *keys), [*reversed(keys), position], "rank").select("rank", position)


def unique(a: NDArray) -> DataFrame:
    return a.cells.select("v").distinct()


def intersect1d(a: NDArray, b: NDArray) -> DataFrame:
    return unique(a).join(unique(b), "v", "left_semi")


def union1d(a: NDArray, b: NDArray) -> DataFrame:
    return a.cells.select("v").union(b.cells.select("v")).distinct()


def setdiff1d(a: NDArray, b: NDArray) -> DataFrame:
    return unique(a).join(unique(b), "v", "left_anti")


def setxor1d(a: NDArray, b: NDArray) -> DataFrame:
    return setdiff1d(a, b).union(setdiff1d(b, a))


def in1d(a: NDArray, b: NDArray) -> NDArray:
    """1 where the value is among those of ``b``."""
    known = unique(b).withColumn("_in", F.lit(1.0))
    rows = a.cells.join(known, "v", "left")
    return NDArray(rows.select(*_axes(a.ndim), F.coalesce("_in", F.lit(0.0)).alias("v")), a.shape)


# statistics of rows as variables


def cov(a: NDArray) -> NDArray:
    """Covariance of rows, with n - 1: one product of the centred matrix with itself."""
    mean = a.cells.groupBy("i0").agg(F.avg("v").alias("_m"))
    centred = a.cells.join(mean, "i0").select("i0", "i1", (C("v") - C("_m")).alias("v"))
    got = arrays.matmul(centred, arrays.transpose(centred))
    return NDArray(got.withColumn("v", C("v") / (a.shape[1] - 1)), (a.shape[0], a.shape[0]))


def corrcoef(a: NDArray) -> NDArray:
    c = cov(a)
    s = c.cells.filter("i0 = i1").select(C("i0").alias("p"), F.sqrt("v").alias("s"))
    both = c.cells.join(s.toDF("i0", "s0"), "i0").join(s.toDF("i1", "s1"), "i1")
    return NDArray(both.select("i0", "i1", (C("v") / (C("s0") * C("s1"))).alias("v")), c.shape)


def correlate(a: NDArray, kernel: NDArray, mode: str = "valid") -> NDArray:
    """Sliding products: out[k] = sum of a[k + j] kernel[j]; the kernel is the bounded side."""
    n, m = a.shape[0], kernel.shape[0]
    k = kernel.cells.select(C("i0").alias("j"), C("v").alias("u"))
    rows = a.cells.join(F.broadcast(k)).groupBy((C("i0") - C("j")).alias("i0")).agg(F.sum(C("v") * C("u")).alias("v"))
    low, high = {"valid": (0, n - m), "full": (1 - m, n - 1), "same": (-((m - 1) // 2), n - 1 - (m - 1) // 2)}[mode]
    rows = rows.filter((C("i0") >= low) & (C("i0") <= high)).select((C("i0") - low).alias("i0"), "v")
    return NDArray(rows, (high - low + 1,))


# products


def outer(a: NDArray, b: NDArray) -> NDArray:
    """All products of two vectors."""
    return binary(a.reshape(-1, 1), b.reshape(1, -1), lambda x, y: x * y)


def inner(a: NDArray, b: NDArray) -> NDArray:
    """Sums of products over the last axes."""
    keep_a, keep_b = _axes(a.ndim)[:-1], _axes(b.ndim)[:-1]
    return NDArray(arrays.contract(a.cells, b.cells, [(_axes(a.ndim)[-1], _axes(b.ndim)[-1])], keep_a, keep_b), (*a.shape[:-1], *b.shape[:-1]))


def tensordot(a: NDArray, b: NDArray, n: int = 2) -> NDArray:
    """Sums of products over the last n axes of a and the first n of b."""
    pairs = list(zip(_axes(a.ndim)[a.ndim - n :], _axes(b.ndim)[:n], strict=True))
    return NDArray(arrays.contract(a.cells, b.cells, pairs, _axes(a.ndim)[: a.ndim - n], _axes(b.ndim)[n:]), (*a.shape[: a.ndim - n], *b.shape[n:]))


def cross(a: Column, b: Column) -> Column:
    """The vector product of array columns of three."""
    at = lambda x, i: F.get(x, F.lit(i))
    return F.array(*[at(a, (k + 1) % 3) * at(b, (k + 2) % 3) - at(a, (k + 2) % 3) * at(b, (k + 1) % 3) for k in range(3)])


# kernels on array columns


def ddot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)


def daxpy(alpha: float, x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda p, q: F.lit(float(alpha)) * p + q)


def dscal(alpha: float, x: Column) -> Column:
    return F.transform(x, lambda p: F.lit(float(alpha)) * p)


def dnrm2(x: Column) -> Column:
    """The length, scaled by the largest component so that squares do not overflow."""
    top = F.array_max(F.transform(x, F.abs))
    return F.when(top == 0, 0.0).otherwise(top * F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, p: s + (p / top) * (p / top))))


def dasum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, p: s + F.abs(p))


def idamax(x: Column) -> Column:
    """The first place of the largest absolute value; -1 for an empty array."""
    size = F.transform(x, F.abs)
    return F.array_position(size, F.array_max(size)).cast("int") - 1


def dgemv(alpha: float, a: NDArray, x: NDArray, beta: float, y: NDArray) -> NDArray:
    product = NDArray(arrays.contract(a.cells, x.cells, [("i1", "i0")], ["i0"], []), (a.shape[0],))
    return binary(product, y, lambda p, q: F.lit(float(alpha)) * p + F.lit(float(beta)) * q)


def dgemm(alpha: float, a: NDArray, b: NDArray, beta: float, c: NDArray) -> NDArray:
    product = NDArray(arrays.matmul(a.cells, b.cells), (a.shape[0], b.shape[1]))
    return binary(product, c, lambda p, q: F.lit(float(alpha)) * p + F.lit(float(beta)) * q)
