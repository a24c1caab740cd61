"""Distances, exact nearest neighbours of stated queries, and plane geometry."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries and points that meet at once.
BLOCK = 64, 1024
#: Bytes of queries that are sent to a worker at once.
SENT = 16 << 20


def distance(x: Column, y: Column, metric: str = "euclidean", p: float = 3.0) -> Column:
    """Between array columns, in the JVM."""
    total = lambda pairs: F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)
    gap = F.zip_with(x, y, lambda a, b: F.abs(a - b))
    dot = lambda a, b: total(F.zip_with(a, b, lambda u, v: u * v))
    return {
        "euclidean": lambda: F.sqrt(total(F.transform(gap, lambda v: v * v))), "sqeuclidean": lambda: total(F.transform(gap, lambda v: v * v)),
        "cityblock": lambda: total(gap), "chebyshev": lambda: F.array_max(gap), "minkowski": lambda: F.pow(total(F.transform(gap, lambda v: F.pow(v, F.lit(p)))), F.lit(1 / p)),
        "cosine": lambda: 1 - dot(x, y) / F.sqrt(dot(x, x) * dot(y, y)), "hamming": lambda: total(F.transform(gap, lambda v: (v != 0).cast("double"))) / F.size(x),
    }[metric]()


def cdist(a: DataFrame, b: DataFrame, key: str, vector: str, metric: str = "euclidean") -> DataFrame:
    """(a, b, distance) of every row of ``a`` with every row of ``b``, a stated set that its caller knows to be small."""
    other = b.select(F.col(key).alias("b"), F.col(vector).cast("array<double>").alias("_y"))
    rows = a.select(F.col(key).alias("a"), F.col(vector).cast("array<double>").alias("_x")).join(F.broadcast(other))
    return rows.select("a", "b", distance(F.col("_x"), F.col("_y"), metric).alias("distance"))


def pdist(a: DataFrame, key: str, vector: str, metric: str = "euclidean") -> DataFrame:
    """(a, b, distance) of the pairs a < b of a small set."""
    return cdist(a, a, key, vector, metric).filter("a < b")


def squareform(pairs: DataFrame) -> DataFrame:
    """Both directions of pairs, and the zero diagonal."""
    back = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance")
    keys = pairs.select("a").union(pairs.select("b")).distinct().select("a", F.col("a").alias("b"), F.lit(0.0).alias("distance"))
    return pairs.unionByName(back).unionByName(keys)


class KDTree:
    """An exact tree over points in memory: ``query`` gives distances and places of the k nearest, nearest first."""

    def __init__(self, points: np.ndarray, leaf: int = 16):
        self.points, self.leaf = np.asarray(points, float), leaf
        self.root = self._split(np.arange(len(self.points)))

    def _split(self, rows: np.ndarray):
        p = self.points[rows]
        if len(rows) <= self.leaf:
            return rows
        d = int(np.argmax(np.ptp(p, 0)))
        order = np.argsort(p[:, d], kind="stable")
        half = len(rows) // 2
        return d, float(p[order[half], d]), self._split(rows[order[:half]]), self._split(rows[order[half:]])

    def query(self, at: Sequence[float], k: int = 1) -> tuple[np.ndarray, np.ndarray]:
        at = np.asarray(at, float)
        best, rows = np.full(k, np.inf), np.full(k, -1)
        todo = [(0.0, self.root)]
        while todo:
            off, node = todo.pop()
            if off > best[-1]:
                continue
            if isinstance(node, np.ndarray):
                far = ((self.points[node] - at) ** 2).sum(1)
                both, places = np.concatenate([best, far]), np.concatenate([rows, node])
                order = np.lexsort([places, both])[:k]
                best, rows = both[order], places[order]
                continue
            d, border, left, right = node
            gap = at[d] - border
            near, away = (left, right) if gap < 0 else (right, left)
            todo += [(max(off, gap * gap), away), (off, near)]
        return np.sqrt(best), rows


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, without Python objects."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    sizes = np.diff(vectors.offsets.to_numpy())
    if vectors.null_count or (sizes != sizes[:1]).any():
        raise ValueError("vectors are null or differ in length")
    return flat.reshape(len(vectors), sizes[0] if len(sizes) else 0)


def _join(kept: tuple[np.ndarray, ...] | None, q: np.ndarray, x: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Places in q, distances and keys of the k nearest among those kept and the points x, in order; and the k-th distance of each place."""
    far, gap, columns = np.zeros((len(q), len(x))), np.empty((len(q), len(x))), np.ascontiguousarray(x.T)
    for d in range(q.shape[1]):
        np.subtract(q[:, d, None], columns[d], out=gap)
        np.multiply(gap, gap, out=gap)
        far += gap
    np.sqrt(far, out=far)
    limit = kept[3] if kept else np.full(len(q), np.inf)
    if len(x) > k and np.isinf(limit).any():
        limit = np.fmin(limit, np.partition(far, k - 1, axis=1)[:, k - 1])
    row, at = np.nonzero(~(far > limit[:, None]))
    far, key = far[row, at], own[at]
    if kept:
        row, far, key = (np.concatenate(two) for two in zip(kept, (row, far, key), strict=False))
    order = np.lexsort([key, far, row])
    place = np.arange(len(row)) - np.searchsorted(row[order], row[order])
    order, place = order[place < k], place[place < k]
    row, far, key = row[order], far[order], key[order]
    last = np.full(len(q), np.inf)
    last[row[place == k - 1]] = far[place == k - 1]
    return row, far, key, last


def nearest(points: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query, rank, key, distance): the exact k nearest points of each query (ties to the smaller key).

    Queries are counted and sent in parts of at most ``SENT`` bytes. A task meets
    its points with a part a block of both at a time and keeps k for a query; a
    window merges the tasks' rows.
    """
    asked = queries.select(key, F.col(vector).cast("array<double>").alias("v"))
    n, dim = asked.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    parts = max(1, math.ceil(n * 8 * (max(dim or 0, 0) + 1) / SENT))
    rows = points.filter(F.col(key).isNotNull()).select(F.col(key).cast("long"), F.col(vector))
    rows = rows.repartition(points.sparkSession.sparkContext.defaultParallelism)  # the work is far larger than the points
    rows, found = rows.withColumn(vector, F.col(vector).cast("array<double>")), None
    for part in range(parts):
        own = _nearest(rows, asked if parts == 1 else asked.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == part), k)
        found = own if found is None else found.union(own)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "key"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "rank", "key", "distance")


def _nearest(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query, key, distance): each task's k nearest of each query."""
    table = asked.toArrow()
    sent = rows.sparkSession.sparkContext.broadcast((table.column(0).to_numpy(), _matrix(table.column(1).combine_chunks())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        starts = range(0, len(q), BLOCK[0])
        kept: dict[int, tuple[np.ndarray, ...]] = {}
        for batch in batches:
            own, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            if len(x) and len(q) and x.shape[1] != q.shape[1]:
                raise ValueError("queries and points differ in length")
            for b in range(0, len(x), BLOCK[1]):
                for a in starts:
                    kept[a] = _join(kept.get(a), q[a : a + BLOCK[0]], x[b : b + BLOCK[1]], own[b : b + BLOCK[1]], k)
        for a, (row, far, key, _) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array(ids[a + row]), pa.array(key), pa.array(far)], ["query", "key", "distance"])

    return rows.mapInArrow(run, "query long, key long, distance double")


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Places of the hull's corners, counter-clockwise from the leftmost lowest."""
    p = np.asarray(points, float)
    order = np.lexsort([p[:, 1], p[:, 0]])

    def half(rows) -> list[int]:
        out: list[int] = []
        for k in rows:
            while len(out) > 1 and _turn(p[out[-2]], p[out[-1]], p[k]) <= 0:
                out.pop()
            out.append(int(k))
        return out[:-1]

    return np.array(half(order) + half(order[::-1]))


def _turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> float:
    return float((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))


def _circle(p: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre and squared radius through three points."""
    m = 2 * (p[1:] - p[0])
    centre = np.linalg.solve(m, (p[1:] ** 2).sum(1) - (p[0] ** 2).sum())
    return centre, float(((centre - p[0]) ** 2).sum())


def delaunay(points: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles whose circles hold no other point, by inserting points one at a time."""
    p = np.asarray(points, float)
    span = float(np.ptp(p, 0).max()) or 1.0
    middle = p.mean(0)
    every = np.vstack([p, middle + span * np.array([[-60, -40], [60, -40], [0, 70]])])
    n = len(p)
    triangles = {(n, n + 1, n + 2): _circle(every[n:])}
    for k in range(n):
        bad = [t for t, (c, r) in triangles.items() if ((every[k] - c) ** 2).sum() < r * (1 - 1e-12)]
        edges: dict[tuple[int, int], int] = {}
        for t in bad:
            for e in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2])):
                edges[tuple(sorted(e))] = edges.get(tuple(sorted(e)), 0) + 1
            del triangles[t]
        for (a, b), times in edges.items():
            if times == 1 and abs(_turn(every[a], every[b], every[k])) > 1e-14 * span * span:
                triangles[tuple(sorted((a, b, k)))] = _circle(every[[a, b, k]])
    return sorted(t for t in triangles if t[2] < n)


def voronoi(points: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """Corners (circle centres of triangles) and ridges (point, point, corner, corner; -1: to infinity)."""
    p, triangles = np.asarray(points, float), delaunay(points)
    corners = np.array([_circle(p[list(t)])[0] for t in triangles]).reshape(-1, 2)
    sides: dict[tuple[int, int], list[int]] = {}
    for k, t in enumerate(triangles):
        for e in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2])):
            sides.setdefault(e, []).append(k)
    return corners, [(a, b, ks[0], ks[1] if len(ks) > 1 else -1) for (a, b), ks in sorted(sides.items())]


def hull_per_group(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, place, x, y): hull corners of each group of points.

    The hull of a union is the hull of the hulls: tasks reduce their own points
    first, so one group's corners are all that one task gathers.
    """
    kind = dict(df.dtypes)[by]

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.dropna().groupby(by, group_keys=False)[[by, "x", "y"]].apply(corners)

    def corners(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["x", "y"])
        return rows.iloc[convex_hull(rows[["x", "y"]].to_numpy())] if len(rows) > 2 else rows.sort_values(["x", "y"])

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        out = corners(rows).reset_index(drop=True)
        out.insert(1, "place", np.arange(len(out)))
        return out

    points = df.select(by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return points.mapInPandas(local, f"{by} {kind}, x double, y double").groupBy(by).applyInPandas(whole, f"{by} {kind}, place long, x double, y double")
