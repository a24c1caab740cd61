import itertools
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tessera.functions import optimise as o
from tessera.operators import ndarray as nd
from tessera.operators import sparse as sp
from tessera.operators import spatial as x


def valley(p):
    return (1 - p[0]) ** 2 + 100 * (p[1] - p[0] ** 2) ** 2


def waves(p):
    return 20 + sum(v * v - 10 * np.cos(2 * np.pi * v) for v in p)


@pytest.mark.parametrize("method", ["bfgs", "cg", "nelder-mead"])
def test_minimize(method):
    got = o.minimize(valley, [-1.2, 1.0], method, steps=20_000 if method == "cg" else 2000)
    np.testing.assert_allclose(got.x, [1, 1], atol=1e-3)


@pytest.mark.parametrize("f", [o.differential_evolution, o.dual_annealing, o.direct, lambda f, b: o.shgo(f, b, 400), lambda f, b: o.brute(f, b, 42)])
def test_global(f):
    got = f(waves, [(-5.12, 5.0), (-5.12, 5.0)])
    assert got.fun < 1e-4


def test_hopping():
    assert o.basin_hopping(lambda p: float(np.cos(14.5 * p[0] - 0.3) + (p[0] + 0.2) * p[0]), [1.0]).x[0] == pytest.approx(-0.195, abs=1e-2)


def test_scalars_and_fits():
    assert o.minimize_scalar(lambda v: (v - 2) ** 2, -10, 10).x[0] == pytest.approx(2, abs=1e-6)
    assert o.root_scalar(lambda v: v**3 - 2, 0, 2) == pytest.approx(2 ** (1 / 3))
    at = np.linspace(0, 4, 50)
    p, cov = o.curve_fit(lambda t, a, b, c: a * np.exp(-b * t) + c, at, 2.5 * np.exp(-1.3 * at) + 0.5, [1, 1, 1])
    np.testing.assert_allclose(p, [2.5, 1.3, 0.5], atol=1e-5)
    assert cov.shape == (3, 3)


def test_programs():
    g = np.random.default_rng(1)
    for shape in ((4, 4), (3, 5), (5, 3)):
        cost = g.integers(0, 20, shape)
        rows, cols = o.linear_sum_assignment(cost)
        n, m = shape
        small = cost if n <= m else cost.T
        best = min(sum(small[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(max(n, m)), min(n, m)))
        assert cost[rows, cols].sum() == best and len(rows) == min(n, m)
    got = o.linprog([-3, -5], [[1, 0], [0, 2], [3, 2]], [4, 12, 18])
    np.testing.assert_allclose(got.x, [2, 6])
    got = o.linprog([1, 1], a_eq=[[1, -1]], b_eq=[3], bounds=[(None, None), (-2, 5)])
    np.testing.assert_allclose(got.x, [1, -2])
    assert not o.linprog([1], [[1], [-1]], [1, -2]).success
    assert not o.linprog([-1]).success
    got = o.milp([-5, -4], [True, True], [[6, 4], [1, 2]], [24, 6])
    assert got.x.tolist() == [4, 0] and got.fun == -20
    got = o.qp_solve([[2, 0], [0, 2]], [-2, -5], a_ub=[[-1, 2], [1, 2], [1, -2], [-1, 0], [0, -1]], b_ub=[2, 6, 2, 0, 0])
    np.testing.assert_allclose(got.x, [1.4, 1.7], atol=1e-8)
    got = o.qp_solve(np.eye(3), np.zeros(3), a_eq=[[1, 1, 1]], b_eq=[1])
    np.testing.assert_allclose(got.x, [1 / 3] * 3)


def test_per_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, v double")
    got = o.per_group(df, ["g"], lambda rows: o.minimize(lambda p: float(((rows.v - p[0]) ** 2).sum()), [0.0]), ["x"]).collect()
    assert {r.g: round(r.x, 4) for r in got} == {"a": 2.0, "b": 5.0} and all(r.success for r in got)


def test_spatial(spark):
    g = np.random.default_rng(2)
    p = g.standard_normal((300, 2))
    tree = x.KDTree(p)
    for q in g.standard_normal((20, 2)):
        far = np.sqrt(((p - q) ** 2).sum(1))
        d, rows = tree.query(q, 5)
        np.testing.assert_allclose(d, np.sort(far)[:5])
        assert rows.tolist() == np.argsort(far)[:5].tolist()
    hull = x.convex_hull(p)
    assert all(x._turn(p[a], p[b], q) >= -1e-12 for a, b in zip(hull, np.roll(hull, -1), strict=True) for q in p)
    few = p[:40]
    triangles = x.delaunay(few)
    for t in triangles:
        c, r = x._circle(few[list(t)])
        assert all(((few[k] - c) ** 2).sum() > r * (1 - 1e-9) for k in range(40) if k not in t)
    assert len(triangles) == 2 * 40 - 2 - len(x.convex_hull(few))
    corners, ridges = x.voronoi(few)
    assert all(abs(np.linalg.norm(corners[i] - few[a]) - np.linalg.norm(corners[i] - few[b])) < 1e-6 for a, b, i, _ in ridges)
    df = spark.createDataFrame([(i, v.tolist(), "ab"[i % 2], float(v[0]), float(v[1])) for i, v in enumerate(p)], "id long, v array<double>, g string, x double, y double")
    got = x.nearest(df.repartition(3), df.filter("id < 7"), "id", "v", 4).collect()
    for i in range(7):
        far = ((p - p[i]) ** 2).sum(1)
        assert [r.key for r in sorted(got, key=lambda r: r["rank"]) if r["query"] == i] == np.argsort(far)[:4].tolist()
    pairs = x.pdist(df.filter("id < 5"), "id", "v", "cityblock").collect()
    assert len(pairs) == 10 and all(r.distance == pytest.approx(np.abs(p[r.a] - p[r.b]).sum()) for r in pairs)
    assert x.squareform(x.pdist(df.filter("id < 5"), "id", "v")).count() == 25
    for metric, want in (("cosine", 1 - p[0] @ p[1] / np.linalg.norm(p[0]) / np.linalg.norm(p[1])), ("chebyshev", abs(p[0] - p[1]).max()), ("minkowski", (abs(p[0] - p[1]) ** 3).sum() ** (1 / 3)), ("hamming", 1.0), ("sqeuclidean", ((p[0] - p[1]) ** 2).sum())):
        assert x.cdist(df.filter("id = 0"), df.filter("id = 1"), "id", "v", metric).first().distance == pytest.approx(want)
    hulls = {}
    for r in x.hull_per_group(df.repartition(4), "g", "x", "y").orderBy("place").collect():
        hulls.setdefault(r.g, []).append((r.x, r.y))
    assert hulls["a"] == [tuple(q) for q in p[::2][x.convex_hull(p[::2])]]


def test_sparse(spark):
    a = sp.from_arrays(spark, [0, 1, 1, 2, 0], [1, 0, 2, 2, 1], [1, 2, 3, 4, 0.5], (3, 3))
    dense = np.array([[0, 1.5, 0], [2, 0, 3], [0, 0, 4]])
    np.testing.assert_allclose(a.to_dense().numpy(), dense)
    assert a.nnz() == 4 and a.get(0, 1) == 1.5 and a.get(2, 0) == 0
    rows = {r.i0: (r.columns, r["values"]) for r in a.to_csr().collect()}
    assert rows[1] == ([0, 2], [2.0, 3.0])
    assert {r.i1: r["rows"] for r in a.to_csc().collect()}[2] == [1, 2]
    np.testing.assert_allclose(sp.expanded(a.to_csr(), (3, 3)).to_dense().numpy(), dense)
    np.testing.assert_allclose(a.matmul(a.transpose()).to_dense().numpy(), dense @ dense.T)
    np.testing.assert_allclose(a.add(a.scale(2)).to_dense().numpy(), 3 * dense)
    x_ = nd.from_slice(spark, [1.0, 2, 3])
    assert {r.i0: r.v for r in a.matvec(x_.cells).collect()} == dict(enumerate(dense @ [1, 2, 3]))
    np.testing.assert_allclose(sp.kron(a, sp.eye_sparse(spark, 2)).to_dense().numpy(), np.kron(dense, np.eye(2)))
    np.testing.assert_allclose(sp.hstack([a, a]).to_dense().numpy(), np.hstack([dense, dense]))
    np.testing.assert_allclose(sp.vstack([a, a]).to_dense().numpy(), np.vstack([dense, dense]))
    np.testing.assert_allclose(sp.diags(spark, [[1, 2], [3, 4, 5]], [1, 0], 3).to_dense().numpy(), np.diag([3, 4, 5.0]) + np.diag([1, 2.0], 1))
    np.testing.assert_allclose(sp.from_csr(spark, [0, 1, 3, 4], [1, 0, 2, 2], [1.5, 2, 3, 4], (3, 3)).to_dense().numpy(), dense)
    np.testing.assert_allclose(sp.from_csc(spark, [0, 1, 2, 4], [1, 0, 1, 2], [2, 1.5, 3, 4], (3, 3)).to_dense().numpy(), dense)
    assert sp.find(sp.dense_to_coo(a.to_dense())).count() == 4 and sp.dense_to_csr(a.to_dense()).count() == 3


def vectors(spark, n, dim, seed=3):
    v = np.random.default_rng(seed).integers(0, 4, (n, dim)).astype(float)
    return v, spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id long, v array<double>")


def test_nearest_holds_few_distances_at_once(spark, monkeypatch):
    v, df = vectors(spark, 2000, 64)
    run, real = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *a, **b: run.append(f) or real(self, f, *a, **b))
    x.nearest(df, df.filter("id < 200"), "id", "v", 5)
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(v.tolist())], ["id", "v"])
    tracemalloc.start()
    rows = sum(len(b) for b in run[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 1000 and peak < 64e6, peak  # all differences at once are 205 MB


def test_nearest_in_parts_with_ties(spark, monkeypatch):
    v, df = vectors(spark, 300, 3)
    monkeypatch.setattr(x, "SENT", 400, raising=False)
    monkeypatch.setattr(x, "BLOCK", (4, 16))
    got = sorted(map(tuple, x.nearest(df.repartition(5), df.filter("id % 7 = 0"), "id", "v", 4).collect()))
    far = np.sqrt(((v[::7, None] - v[None]) ** 2).sum(-1))
    assert got == [(7 * i, r + 1, int(key), far[i, key]) for i in range(len(far)) for r, key in enumerate(np.lexsort([np.arange(300), far[i]])[:4])]
    assert x.nearest(df, df.filter("id < 0"), "id", "v", 4).count() == 0
    assert x.nearest(df.filter("id < 3"), df.filter("id < 2"), "id", "v", 4).count() == 6
