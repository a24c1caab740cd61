"""Approximate nearest neighbours by inner product, on a tiny kd-tree index.

Largest inner product becomes smallest distance by one more coordinate that
brings every vector to the longest one's length. Vectors of ``d + 1`` dimensions
are projected onto a few Gaussian (2-stable) directions: the squared distance of
two projections over the squared distance of the vectors follows a chi-square
law. The projections are indexed by a kd-tree, whose upper levels are split at
medians of a sample (``SAMPLE`` vectors); below each of their leaves lie parts of
about ``PART`` vectors, one row each, with the lower levels. Every vector is in
one part; equal vectors share an entry.

A query first goes down to its own leaf. With the k-th score found there it goes
to each other part whose box is near enough, and in a part to the boxes of the
tree in the order of their distances; a point whose projection passes the test is
verified with the original vectors. The test: a neighbour nearer than the k-th
found has its projection within a certain distance with probability ``sure``.
The search ends when the next box is farther. Queries go out in waves of at most
``WAVE_MB``; each part returns its best of each query that came, all ties
included until they are scored in double precision, and a window over a query's
rows merges them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import cut
from tessera.sources.tables import table

PART, LEAF, DIRECTIONS = 8192, 128, 8
#: Vectors that the upper levels are fitted on, and how many of them make a leaf at least.
SAMPLE, PER_LEAF = 32_768, 64
WAVE_MB = 64
SURE = 0.99
#: Scores of block products differ from exact ones by less than this, relative to the lengths.
ROUNDING = 1e-11
INDEX = "dim int, leaf int, part int, n long, ids binary, owner binary, vectors binary, projected binary, longest double"


def valid(v: Column) -> Column:
    """Vectors that take part: not null or zero, no null or non-finite component."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def chi_square_quantile(p: float, m: int) -> float:
    """The chi-square quantile for an even number of degrees of freedom, by bisection."""
    cdf = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(m // 2))
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def directions(dim: int) -> np.ndarray:
    """Gaussian directions, fixed for each dimension."""
    return np.random.default_rng(20_011 + dim).standard_normal((dim + 1, DIRECTIONS))


def project(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Projections; queries are scaled to the longest length, the others get the coordinate that they lack."""
    square = (x * x).sum(1)
    if query:
        return (x * (longest / np.sqrt(square))[:, None]) @ directions(x.shape[1])[:-1]
    lacks = np.sqrt(np.maximum(longest * longest - square, 0))
    return np.hstack([x, lacks[:, None]]) @ directions(x.shape[1])


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def tree_order(points: np.ndarray) -> list[np.ndarray]:
    """Rows of each leaf: nodes are split at the median of their widest direction."""
    nodes = [np.arange(len(points))]
    while len(nodes[0]) > LEAF:
        halves = []
        for rows in nodes:
            p = points[rows]
            d = int(np.argmax(p.max(0) - p.min(0)))
            at = np.argpartition(p[:, d], len(rows) // 2)
            halves += [rows[at[: len(rows) // 2]], rows[at[len(rows) // 2 :]]]
        nodes = halves
    return nodes


class Upper:
    """The upper levels of a tree: a direction and a border for each inner node, level by level."""

    def __init__(self, points: np.ndarray, depth: int):
        self.direction, self.border = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
        nodes = [np.arange(len(points))]
        for k in range(2**depth - 1):
            p = points[nodes[k]]
            d = int(np.argmax(p.max(0) - p.min(0))) if len(p) else 0
            m = float(np.median(p[:, d])) if len(p) else 0.0
            self.direction[k], self.border[k] = d, m
            right = p[:, d] >= m if len(p) else np.zeros(0, bool)
            nodes += [nodes[k][~right], nodes[k][right]]

    def leaves(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        rows = np.arange(len(points))
        for _ in range(len(self.border).bit_length()):  # all leaves are equally deep
            node = 2 * node + 1 + (points[rows, self.direction[node]] >= self.border[node])
        return node - len(self.border)


@dataclass
class Index:
    """Rows of parts, and by dimension the upper levels and the longest vector's length."""

    parts: DataFrame
    upper: dict[int, Upper]
    longest: dict[int, float]


def build_index(vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> Index:
    """The index of all valid rows with an id; ``k`` bounds the ids that an entry of equal vectors need keep (the k + 1 smallest)."""
    spark = vectors.sparkSession
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & valid(v))
    rows = rows.withColumns({"dim": F.size("v"), "nth": F.row_number().over(Window.partitionBy("v").orderBy("id"))}).filter(F.col("nth") <= k + 1)
    rows = cut(rows, "ann-rows")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    facts = {r.dim: (r.n, r.m) for r in rows.groupBy("dim").agg(F.count_if(F.col("nth") == 1).alias("n"), F.max(norm).alias("m")).collect()}
    longest = {dim: m for dim, (_, m) in facts.items()}
    upper = {}
    for dim, (n, m) in facts.items():
        some = rows.filter((F.col("dim") == dim) & (F.col("nth") == 1) & (F.pmod(F.xxhash64("v"), F.lit(2**31)) < int(min(1, SAMPLE / n) * 2**31)))
        depth = min(math.ceil(math.log2(max(1, n / PART))), int(math.log2(SAMPLE / PER_LEAF)))
        upper[dim] = Upper(project(matrix(some.select("v").toArrow().column("v").combine_chunks(), dim), m, query=False) if depth else np.empty((0, DIRECTIONS)), depth)
    sent = spark.sparkContext.broadcast((upper, longest))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper, longest = sent.value
        for batch in batches:
            dims = batch.column(0).to_numpy()
            leaf = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                leaf[own] = upper[dim].leaves(project(matrix(batch.column(2).take(pa.array(own)), dim), longest[dim], query=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], ["dim", "id", "v", "leaf"])

    rows = cut(rows.select("dim", "id", "v").mapInArrow(placed, "dim int, id long, v array<double>, leaf int"), "ann-placed")
    sizes = rows.groupBy("dim", "leaf").agg(F.ceil(F.count(F.lit(1)) / PART).alias("many"))  # SAMPLE / PER_LEAF rows a dimension at most
    rows = rows.join(F.broadcast(sizes), ["dim", "leaf"]).withColumn("part", F.pmod(F.xxhash64("v"), F.col("many")).cast("int"))

    def build(key: tuple, group: pa.Table) -> pa.Table:
        dim, leaf, part = (x.as_py() for x in key)
        ids, x = group.column("id").to_numpy(), matrix(group.column("v").combine_chunks(), dim)
        order = np.lexsort([ids, *x.T[::-1]])
        ids, x = ids[order], x[order]
        new = np.concatenate([[True], (x[1:] != x[:-1]).any(1)])
        owner = np.cumsum(new) - 1
        place = np.arange(len(ids)) - np.flatnonzero(new)[owner]
        ids, owner, x = ids[place <= k], owner[place <= k], x[new]
        p = project(x, longest[dim], query=False)
        leaves = np.concatenate(tree_order(p))
        back = np.empty(len(leaves), np.int64)
        back[leaves] = np.arange(len(leaves))
        owner = back[owner]
        by = np.lexsort([ids, owner])
        row = [dim, leaf, part, len(leaves), ids[by].astype(np.int64).tobytes(), owner[by].astype(np.int32).tobytes(), x[leaves].tobytes(), p[leaves].tobytes(), longest[dim]]
        names = [c.split()[0] for c in INDEX.split(", ")]
        return pa.Table.from_pydict({c: pa.array([v], t) for c, v, t in zip(names, row, [*[pa.int32()] * 3, pa.int64(), *[pa.binary()] * 4, pa.float64()], strict=True)})

    return Index(cut(rows.select("dim", "leaf", "part", "id", "v").groupBy("dim", "leaf", "part").applyInArrow(build, INDEX), "ann-index"), upper, longest)


def leaf_bounds(n: int) -> np.ndarray:
    """Where the leaves of ``tree_order`` begin and end in its row order."""
    sizes = [n]
    while sizes[0] > LEAF:
        sizes = [h for s in sizes for h in (s // 2, s - s // 2)]
    return np.concatenate([[0], np.cumsum(sizes)])


def box_distance(low: np.ndarray, high: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of points ``y`` from boxes, one row a point."""
    off = np.zeros((len(y), len(low)))
    for d in range(y.shape[1]):
        gap = np.maximum(low[:, d] - y[:, d, None], y[:, d, None] - high[:, d])
        off += np.where(gap > 0, gap, 0) ** 2
    return off


def search_part(x: np.ndarray, p: np.ndarray, longest: float, q: np.ndarray, k: int, sure: float, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, row of ``x``): all that may be among the best ``k`` of a query, whose k-th score so far is ``known``."""
    bounds = leaf_bounds(len(x))
    low = np.stack([p[a:b].min(0) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    high = np.stack([p[a:b].max(0) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    y = project(q, longest, query=True)
    norm, reach = np.sqrt((q * q).sum(1)), chi_square_quantile(sure, p.shape[1])
    slack = ROUNDING * norm * longest
    best = np.full((len(q), k + 1), -np.inf)  # one more, as the query may meet itself
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def least(who: np.ndarray) -> np.ndarray:
        return np.maximum(best[who].min(1), known[who])

    def radius(who: np.ndarray) -> np.ndarray:
        """A nearer neighbour than the k-th has its projection within this squared distance, with probability ``sure``."""
        kth = least(who)
        return np.where(np.isfinite(kth), np.maximum(2 * longest * (longest - kth / norm[who]), 0) * reach, np.inf)

    off = box_distance(p.min(0)[None], p.max(0)[None], y)[:, 0]
    active = np.flatnonzero(off <= radius(np.arange(len(q))))
    off = box_distance(low, high, y[active])
    order = np.argsort(off, axis=1, kind="stable")
    off = np.take_along_axis(off, order, 1)
    row = np.arange(len(active))
    for step in range(len(low)):
        stay = np.flatnonzero(off[row, step] <= radius(active))
        active, row = active[stay], row[stay]
        if not len(active):
            break
        leaf = order[row, step]
        by = np.argsort(leaf, kind="stable")
        for own in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
            who, a, b = active[own], bounds[leaf[own[0]]], bounds[leaf[own[0]] + 1]
            near = (y[who] ** 2).sum(1)[:, None] + (p[a:b] ** 2).sum(1) - 2 * y[who] @ p[a:b].T
            scores = q[who] @ x[a:b].T
            scores[near > (radius(who) * (1 + 1e-9))[:, None] + 1e-9] = -np.inf
            at, col = np.nonzero(scores >= (least(who) - slack[who])[:, None])
            some = np.isfinite(scores[at, col])
            at, col = at[some], col[some]
            found.append((who[at], a + col, scores[at, col]))
            better = np.unique(at)
            both = np.hstack([best[who[better]], scores[better]])
            best[who[better]] = -np.partition(-both, k, axis=1)[:, : k + 1]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ask, entry, score = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = score >= (least(np.arange(len(q))) - slack)[ask]
    return ask[keep], entry[keep]


def search(index: Index, queries: DataFrame, k: int = 20, sure: float = SURE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, its own id left out.

    Queries need an id and a valid vector; of rows with one id the smallest
    vector asks. Vectors of other dimensions than the query's are no candidates.
    Candidates that repeat an id stay as rows of their own. Equal scores go by
    the smaller id. With fewer candidates than k all are returned; an empty table
    gives no row. Other columns play no part.
    """
    spark = queries.sparkSession
    v = F.col("v")
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & valid(v))
    asked = asked.groupBy("id").agg(F.min("v").alias("v"))
    mb = (asked.agg(F.sum(F.size("v") * 8 + 8)).first()[0] or 0) / 1e6
    waves = math.ceil(mb / WAVE_MB) or 1
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = None
    for wave in range(waves):
        block = asked if waves == 1 else asked.filter(F.pmod(F.xxhash64("id"), F.lit(waves)) == wave)
        by_dim = {}
        got = block.withColumn("dim", F.size("v")).orderBy("id").toArrow()
        for dim in set(got.column("dim").to_pylist()) & set(index.upper):
            own = got.filter(pa.compute.equal(got.column("dim"), dim))
            q = matrix(own.column("v").combine_chunks(), dim)
            by_dim[dim] = own.column("id").to_numpy(), q, index.upper[dim].leaves(project(q, index.longest[dim], query=True)), np.full(len(q), -np.inf)
        home = cut(index.parts.mapInArrow(_searcher(spark.sparkContext.broadcast(by_dim), k, sure, at_home=True), ANSWER), "ann-home")
        kth = home.withColumn("rank", rank).filter(F.col("rank") == k).select("query_id", "score").toArrow()
        order = np.argsort(kth.column("query_id").to_numpy())
        ids, scores = kth.column("query_id").to_numpy()[order], kth.column("score").to_numpy()[order]
        for who, _, _, known in by_dim.values():
            if len(ids):
                at = np.minimum(np.searchsorted(ids, who), len(ids) - 1)
                known[:] = np.where(ids[at] == who, scores[at], -np.inf)
        part = index.parts.mapInArrow(_searcher(spark.sparkContext.broadcast(by_dim), k, sure, at_home=False), ANSWER).unionByName(home)
        part = part if waves == 1 else cut(part.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank"), "ann-wave")
        found = part if found is None else found.unionByName(part)
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ANSWER = "query_id long, vec_id long, score double"


def _searcher(sent, k: int, sure: float, at_home: bool):
    """Searches parts for the queries that belong to their leaf, or for all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["dim"] not in sent.value:
                    continue
                who, q, leaf, known = sent.value[r["dim"]]
                own = np.flatnonzero((leaf == r["leaf"]) == at_home)
                x = np.frombuffer(r["vectors"]).reshape(r["n"], -1)
                p = np.frombuffer(r["projected"]).reshape(r["n"], -1)
                ids, owner = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["owner"], np.int32)
                first = np.searchsorted(owner, np.arange(r["n"] + 1))
                for a in range(0, len(own), 2048):
                    block = own[a : a + 2048]
                    ask, entry = search_part(x, p, r["longest"], q[block], k, sure, known[block])
                    yield answer(who[block], q[block], ask, entry, x, ids, first, k)

    return run


def answer(who: np.ndarray, q: np.ndarray, ask: np.ndarray, entry: np.ndarray, x: np.ndarray, ids: np.ndarray, first: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best ids of each query among its entries, scored one by one in double precision."""
    score = np.empty(len(entry))
    for a in range(0, len(entry), 65_536):
        score[a : a + 65_536] = (q[ask[a : a + 65_536]] * x[entry[a : a + 65_536]]).sum(1)
    n = first[entry + 1] - first[entry]
    at = np.arange(n.sum()) + np.repeat(first[entry] - (np.cumsum(n) - n), n)
    ask, score, vec = np.repeat(ask, n), np.repeat(score, n), ids[at]
    other = vec != who[ask]
    ask, score, vec = ask[other], score[other], vec[other]
    order = np.lexsort([vec, -score, ask])
    ask, score, vec = ask[order], score[order], vec[order]
    place = np.arange(len(ask)) - np.searchsorted(ask, ask)
    keep = place < k
    return pa.RecordBatch.from_arrays([pa.array(who[ask[keep]]), pa.array(vec[keep]), pa.array(score[keep])], ["query_id", "vec_id", "score"])


def op3_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th vector of ``embeddings`` among all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(build_index(vectors), vectors.filter("vec_id % 20 = 0"))
