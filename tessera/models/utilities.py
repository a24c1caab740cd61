"""Small helpers: enumeration, checks, state names, settings, convergence, and the kernels behind model code."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.models.tables import Table


def combinations(items: Sequence, k: int) -> Iterator[tuple]:
    return itertools.combinations(items, k)


def permutations(items: Sequence, k: int | None = None) -> Iterator[tuple]:
    return itertools.permutations(items, k)


def cartesian_product(*sets: Sequence) -> Iterator[tuple]:
    return itertools.product(*sets)


class ConvergenceChecker:
    """Whether a value has moved less than the tolerance, or the rounds are used up."""

    def __init__(self, tolerance: float = 1e-6, rounds: int = 100):
        self.tolerance, self.rounds, self.last, self.count = tolerance, rounds, math.inf, 0

    def done(self, value: float) -> bool:
        self.count += 1
        near = abs(value - self.last) < self.tolerance
        self.last = value
        return near or self.count >= self.rounds


def safe_path(path: str) -> str:
    """The path, unless it climbs out of its folder or holds a zero byte."""
    if "\0" in path or ".." in path.replace("\\", "/").split("/"):
        raise ValueError("unsafe path")
    return path


def state_names(variable: str, n: int) -> list[str]:
    return [f"{variable}_{k}" for k in range(n)]


def check_state_names(names: Mapping[str, Sequence[str]], sizes: Mapping[str, int]) -> None:
    for v, n in sizes.items():
        if len(names.get(v, ())) != n or len(set(names[v])) != n:
            raise ValueError(f"{v} needs {n} different names")


def state_index(names: Mapping[str, Sequence[str]], variable: str, state: str) -> int:
    return list(names[variable]).index(state)


def coded(df: DataFrame, names: Mapping[str, Sequence[str]]) -> DataFrame:
    """Columns of state names as numbers; unknown ones are null."""
    place = lambda v: F.nullif(F.array_position(F.array(*[F.lit(s) for s in names[v]]), F.col(v)), F.lit(0)).cast("int") - 1
    return df.withColumns({v: place(v) for v in names if v in df.columns})


def positive_int(x: int) -> int:
    if x <= 0:
        raise ValueError("not positive")
    return x


def non_negative(x: float) -> float:
    if not x >= 0:
        raise ValueError("negative")
    return x


def probability(x: float) -> float:
    if not 0 <= x <= 1:
        raise ValueError("outside [0, 1]")
    return x


def distribution(p: Sequence[float], tolerance: float = 1e-6) -> Sequence[float]:
    if any(not 0 <= x <= 1 for x in p) or abs(sum(p) - 1) > tolerance:
        raise ValueError("does not sum to 1")
    return p


def finite(df: DataFrame, *columns: str) -> DataFrame:
    """One row: whether each column is free of NaN and of infinite numbers."""
    c = [F.col(x).cast("double") for x in columns]
    return df.agg(*[(~F.coalesce(F.bool_or(F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))).alias(n) for n, x in zip(columns, c, strict=True)])


@dataclass
class Settings:
    """Defaults that calls may leave out."""

    inference: str = "variable_elimination"
    alpha: float = 0.05
    seed: int = 0


_settings = Settings()


def get_default() -> Settings:
    return _settings


def set_default(**changes) -> Settings:
    global _settings
    _settings = Settings(**{**_settings.__dict__, **changes})
    return _settings


class Backend:
    """The kernels that tables need, in NumPy; rows of data are Spark's."""

    name = "cpu"

    def matmul(self, a, b):
        return np.asarray(a) @ np.asarray(b)

    def elementwise(self, f, *arrays):
        return f(*map(np.asarray, arrays))

    def product(self, a: Table, b: Table) -> Table:
        return a * b

    def marginalize(self, t: Table, away: Sequence[str]) -> Table:
        return t.marginalize(away)

    def maximize(self, t: Table, away: Sequence[str]) -> Table:
        return t.maximize(away)

    def batch_matmul(self, a, b):
        return np.matmul(a, b)

    def memory(self) -> int:
        """Bytes that this machine has free."""
        import os

        return os.sysconf("SC_AVPHYS_PAGES") * os.sysconf("SC_PAGE_SIZE")


@dataclass
class Tensor:
    """Numbers and the backend they belong to."""

    data: np.ndarray
    backend: Backend

    @property
    def shape(self) -> tuple[int, ...]:
        return self.data.shape


_backend = Backend()


def devices(spark: SparkSession) -> list[dict[str, object]]:
    """What Spark runs on: its task slots."""
    return [{"type": "cpu", "slots": spark.sparkContext.defaultParallelism, "master": spark.sparkContext.master}]


def select_backend(kind: str = "cpu") -> Backend:
    if kind != "cpu":
        raise ValueError("only cpu")
    return Backend()


def get_backend() -> Backend:
    return _backend


def set_backend(backend: Backend) -> None:
    global _backend
    _backend = backend


def reset_backend() -> None:
    set_backend(Backend())
