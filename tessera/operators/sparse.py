"""Sparse matrices as (i0, i1, v) rows of their entries: a COO table. Compressed rows or columns are arrays grouped by one index."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import arrays
from tessera.operators.ndarray import NDArray

C = F.col


@dataclass(frozen=True)
class COO:
    """Entries and shape; equal places add up when the matrix is built."""

    entries: DataFrame
    shape: tuple[int, int]

    def nnz(self) -> int:
        return self.entries.count()

    def get(self, i: int, j: int) -> float:
        return self.entries.filter((C("i0") == i) & (C("i1") == j)).agg(F.coalesce(F.sum("v"), F.lit(0.0))).first()[0]

    def transpose(self) -> COO:
        return COO(arrays.transpose(self.entries), self.shape[::-1])

    def scale(self, by: float) -> COO:
        return COO(self.entries.withColumn("v", C("v") * float(by)), self.shape)

    def add(self, other: COO) -> COO:
        return coo(self.entries.unionByName(other.entries), self.shape)

    def matvec(self, x: DataFrame) -> DataFrame:
        """(i0, v): the product with a vector (i0, v); rows without an entry are left out, as zeros are."""
        return arrays.contract(self.entries, x, [("i1", "i0")], ["i0"], [])

    def matmul(self, other: COO) -> COO:
        return COO(arrays.matmul(self.entries, other.entries), (self.shape[0], other.shape[1]))

    def to_dense(self) -> NDArray:
        """All cells; absent ones are 0."""
        from tessera.operators.ndarray import zeros

        cells = zeros(self.entries.sparkSession, *self.shape).cells.drop("v").join(self.entries, ["i0", "i1"], "left")
        return NDArray(cells.select("i0", "i1", F.coalesce("v", F.lit(0.0)).alias("v")), self.shape)

    def to_csr(self) -> DataFrame:
        """(i0, columns, values): each row's entries in the order of columns."""
        return _compressed(self.entries, "i0", "i1", "columns")

    def to_csc(self) -> DataFrame:
        """(i1, rows, values): each column's entries in the order of rows."""
        return _compressed(self.entries, "i1", "i0", "rows")


def _compressed(entries: DataFrame, major: str, minor: str, name: str) -> DataFrame:
    rows = entries.groupBy(major).agg(F.array_sort(F.collect_list(F.struct(minor, "v"))).alias("e"))
    return rows.select(major, C(f"e.{minor}").alias(name), C("e.v").alias("values"))


def coo(entries: DataFrame, shape: tuple[int, int]) -> COO:
    """From rows (i0, i1, v); repeated places are summed, zeros dropped."""
    return COO(entries.groupBy("i0", "i1").agg(F.sum("v").alias("v")).filter("v != 0"), tuple(shape))


def from_arrays(spark: SparkSession, rows: Sequence[int], columns: Sequence[int], values: Sequence[float], shape: tuple[int, int]) -> COO:
    cells = [(int(i), int(j), float(v)) for i, j, v in zip(rows, columns, values, strict=True)]
    return coo(spark.createDataFrame(cells, "i0 long, i1 long, v double"), shape)


def from_csr(spark: SparkSession, starts: Sequence[int], columns: Sequence[int], values: Sequence[float], shape: tuple[int, int]) -> COO:
    """From row starts, columns and values."""
    return from_arrays(spark, np.repeat(np.arange(len(starts) - 1), np.diff(starts)), columns, values, shape)


def from_csc(spark: SparkSession, starts: Sequence[int], rows: Sequence[int], values: Sequence[float], shape: tuple[int, int]) -> COO:
    return from_csr(spark, starts, rows, values, shape[::-1]).transpose()


def expanded(df: DataFrame, shape: tuple[int, int]) -> COO:
    """From compressed rows (i0, columns, values)."""
    cells = df.select("i0", F.explode(F.arrays_zip("columns", "values")).alias("e"))
    return coo(cells.select("i0", C("e.columns").alias("i1"), C("e.values").alias("v")), shape)


def dense_to_coo(a: NDArray) -> COO:
    return COO(a.cells.filter("v != 0"), a.shape)


def dense_to_csr(a: NDArray) -> DataFrame:
    return dense_to_coo(a).to_csr()


def eye_sparse(spark: SparkSession, n: int) -> COO:
    return COO(arrays.eye(spark, n), (n, n))


def diags(spark: SparkSession, diagonals: Sequence[Sequence[float]], offsets: Sequence[int], n: int) -> COO:
    """Values along diagonals."""
    cells = [(i + max(-k, 0), i + max(k, 0), float(v)) for line, k in zip(diagonals, offsets, strict=True) for i, v in enumerate(line)]
    return coo(spark.createDataFrame(cells, "i0 long, i1 long, v double"), (n, n))


def kron(a: COO, b: COO) -> COO:
    """Every entry of ``a`` times the whole of ``b``; as many entries as both have together multiplied, as it is defined."""
    r, c = b.shape
    other = b.entries.select(C("i0").alias("p"), C("i1").alias("q"), C("v").alias("w"))
    cells = a.entries.crossJoin(other)
    return COO(cells.select((C("i0") * r + C("p")).alias("i0"), (C("i1") * c + C("q")).alias("i1"), (C("v") * C("w")).alias("v")), (a.shape[0] * r, a.shape[1] * c))


def hstack(parts: Sequence[COO]) -> COO:
    out, at = None, 0
    for p in parts:
        moved = p.entries.withColumn("i1", C("i1") + at)
        out = moved if out is None else out.unionByName(moved)
        at += p.shape[1]
    return COO(out, (parts[0].shape[0], at))


def vstack(parts: Sequence[COO]) -> COO:
    return hstack([p.transpose() for p in parts]).transpose()


def find(a: COO) -> DataFrame:
    """(i0, i1, v) of the entries that are not 0."""
    return a.entries.filter("v != 0").select("i0", "i1", "v")
