import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ndarray as nd
from tessera.operators import ranks

A = np.arange(12.0).reshape(3, 4) % 7
B = np.arange(24.0).reshape(2, 3, 4)
V = np.array([3.0, 1.0, 2.0, 1.0])
CASES = {
    "broadcast_to": (lambda s: nd.broadcast_to(s["v"], (2, 3, 4)), lambda: np.broadcast_to(V, (2, 3, 4))),
    "binary": (lambda s: nd.binary(s["b"], s["a"], lambda x, y: x + y), lambda: B + A),
    "binary_cell": (lambda s: nd.binary(s["a"], nd.full(s["spark"], 2, 1, 1), lambda x, y: x * y), lambda: A * 2),
    "where": (lambda s: nd.where(s["a"], s["a"], nd.full(s["spark"], 9, 3, 4)), lambda: np.where(A, A, 9)),
    "reshape": (lambda s: s["b"].reshape(4, -1), lambda: B.reshape(4, -1)),
    "ravel": (lambda s: nd.ravel(s["b"]), B.ravel),
    "eye": (lambda s: nd.eye(s["spark"], 3, 4, 1), lambda: np.eye(3, 4, 1)),
    "tri": (lambda s: nd.tri(s["spark"], 3, 4, -1), lambda: np.tri(3, 4, -1)),
    "geomspace": (lambda s: nd.geomspace(s["spark"], 1, 1000, 4), lambda: np.geomspace(1, 1000, 4)),
    "from_function": (lambda s: nd.from_function(s["spark"], lambda i, j: i * 10 + j, 2, 3), lambda: np.fromfunction(lambda i, j: i * 10 + j, (2, 3))),
    "from_iter": (lambda s: nd.from_iter(s["spark"], iter([1, 2, 4])), lambda: np.array([1, 2, 4.0])),
    "meshgrid": (lambda s: nd.meshgrid(s["v"], nd.from_slice(s["spark"], [5, 6]))[1], lambda: np.meshgrid(V, [5, 6])[1]),
    "vander": (lambda s: nd.vander(s["v"], 3), lambda: np.vander(V, 3)),
    "diag_vector": (lambda s: nd.diag(s["v"], -1), lambda: np.diag(V, -1)),
    "diagonal": (lambda s: nd.diagonal(s["a"], 1), lambda: np.diagonal(A, 1)),
    "diagflat": (lambda s: nd.diagflat(s["v"].reshape(2, 2), 1), lambda: np.diagflat(V, 1)),
    "tril": (lambda s: nd.tril(s["a"], 1), lambda: np.tril(A, 1)),
    "triu": (lambda s: nd.triu(s["a"]), lambda: np.triu(A)),
    "take": (lambda s: nd.take(s["b"], [2, 0, 2, -1], 1), lambda: B.take([2, 0, 2, -1], 1)),
    "take_along_axis": (lambda s: nd.take_along_axis(s["a"], nd.argsort(s["a"], 1), 1), lambda: np.sort(A, 1)),
    "choose": (lambda s: nd.choose(nd.from_slice(s["spark"], [0, 1, 1, 0]), [s["v"], s["v"].map(lambda x: -x)]), lambda: np.choose([0, 1, 1, 0], [V, -V])),
    "compress": (lambda s: nd.compress([True, False, True], s["a"]), lambda: A[[0, 2]]),
    "select": (lambda s: nd.select([s["a"].map(lambda x: (x > 4).cast("int")), s["a"].map(lambda x: (x > 2).cast("int"))], [s["a"], s["a"].map(lambda x: -x)], 0.5), lambda: np.select([A > 4, A > 2], [A, -A], 0.5)),
    "as_strided": (lambda s: nd.as_strided(s["v"], (2, 3), (1, 1)), lambda: np.lib.stride_tricks.sliding_window_view(V, 3)),
    "swapaxes": (lambda s: nd.swapaxes(s["b"], 0, 2), lambda: B.swapaxes(0, 2)),
    "moveaxis": (lambda s: nd.moveaxis(s["b"], 0, -1), lambda: np.moveaxis(B, 0, -1)),
    "rollaxis": (lambda s: nd.rollaxis(s["b"], 2, 0), lambda: np.rollaxis(B, 2, 0)),
    "rollaxis_on": (lambda s: nd.rollaxis(s["b"], 0, 2), lambda: np.rollaxis(B, 0, 2)),
    "expand_squeeze": (lambda s: nd.squeeze(nd.expand_dims(s["a"], 1)), lambda: A),
    "flip": (lambda s: nd.fliplr(nd.flipud(s["a"])), lambda: A[::-1, ::-1]),
    "rot90": (lambda s: nd.rot90(s["a"], 3), lambda: np.rot90(A, 3)),
    "roll": (lambda s: nd.roll(s["a"], -2, 1), lambda: np.roll(A, -2, 1)),
    "roll_flat": (lambda s: nd.roll(s["a"], 5), lambda: np.roll(A, 5)),
    "vstack": (lambda s: nd.vstack([s["v"], s["a"]]), lambda: np.vstack([V, A])),
    "hstack": (lambda s: nd.hstack([s["a"], s["a"]]), lambda: np.hstack([A, A])),
    "dstack": (lambda s: nd.dstack([s["a"], s["a"]]), lambda: np.dstack([A, A])),
    "stack": (lambda s: nd.stack([s["a"], s["a"]], 1), lambda: np.stack([A, A], 1)),
    "append": (lambda s: nd.append(s["a"], s["v"]), lambda: np.append(A, V)),
    "split": (lambda s: nd.hsplit(s["a"], [1, 3])[1], lambda: np.hsplit(A, [1, 3])[1]),
    "dsplit": (lambda s: nd.dsplit(s["b"], 2)[1], lambda: np.dsplit(B, 2)[1]),
    "tile": (lambda s: nd.tile(s["a"], 2, 1, 3), lambda: np.tile(A, (2, 1, 3))),
    "repeat": (lambda s: nd.repeat(s["a"], 2, 1), lambda: np.repeat(A, 2, 1)),
    "delete": (lambda s: nd.delete(s["a"], [0, -1], 1), lambda: np.delete(A, [0, -1], 1)),
    "insert": (lambda s: nd.insert(s["a"], 1, nd.zeros(s["spark"], 1, 4)), lambda: np.insert(A, 1, 0, 0)),
    "argsort": (lambda s: nd.argsort(s["a"]), lambda: np.argsort(A, kind="stable")),
    "partition": (lambda s: nd.partition(s["a"], 1), lambda: np.sort(A)),
    "in1d": (lambda s: nd.in1d(s["a"], s["v"]), lambda: np.isin(A, V)),
    "cov": (lambda s: nd.cov(s["a"]), lambda: np.cov(A)),
    "corrcoef": (lambda s: nd.corrcoef(s["a"]), lambda: np.corrcoef(A)),
    "correlate": (lambda s: nd.correlate(nd.ravel(s["a"]), s["v"]), lambda: np.correlate(A.ravel(), V)),
    "correlate_full": (lambda s: nd.correlate(nd.ravel(s["a"]), s["v"], "full"), lambda: np.correlate(A.ravel(), V, "full")),
    "correlate_same": (lambda s: nd.correlate(nd.ravel(s["a"]), nd.from_slice(s["spark"], V[:3]), "same"), lambda: np.correlate(A.ravel(), V[:3], "same")),
    "outer": (lambda s: nd.outer(s["v"], s["v"]), lambda: np.outer(V, V)),
    "inner": (lambda s: nd.inner(s["a"], s["a"]), lambda: np.inner(A, A)),
    "tensordot": (lambda s: nd.tensordot(s["b"], nd.swapaxes(s["a"], 0, 1).reshape(3, 4), 2), lambda: np.tensordot(B, A.T.reshape(3, 4), 2)),
    "dgemv": (lambda s: nd.dgemv(2, s["a"], s["v"], 3, nd.ones(s["spark"], 3)), lambda: 2 * A @ V + 3),
    "dgemm": (lambda s: nd.dgemm(2, s["a"], nd.swapaxes(s["a"], 0, 1), 1, nd.eye(s["spark"], 3)), lambda: 2 * A @ A.T + np.eye(3)),
    "set": (lambda s: s["a"].set(5, 1, 2), lambda: np.where((np.indices(A.shape)[0] == 1) & (np.indices(A.shape)[1] == 2), 5, A)),
}


@pytest.fixture(scope="module")
def given(spark):
    return {"spark": spark, "a": nd.from_slice(spark, A), "b": nd.from_slice(spark, B), "v": nd.from_slice(spark, V)}


@pytest.mark.parametrize("name", CASES)
def test_as_numpy(given, name):
    got, want = CASES[name][0](given), np.asarray(CASES[name][1](), float)
    assert got.shape == want.shape
    assert got.cells.count() == got.size
    np.testing.assert_allclose(got.numpy(), want, atol=1e-12)


def test_places_and_sets(given):
    a, v = given["a"], given["v"]
    assert sorted(map(tuple, nd.argwhere(a).collect())) == [tuple(x) for x in np.argwhere(A)]
    assert sorted(r[0] for r in nd.flatnonzero(a).collect()) == np.flatnonzero(A).tolist()
    assert [r.v for r in nd.extract(a.map(lambda x: (x > 3).cast("int")), a).orderBy("i0").collect()] == A[A > 3].tolist()
    assert nd.count_nonzero(a).first().v == np.count_nonzero(A)
    values = lambda df: sorted(r.v for r in df.collect())
    assert values(nd.setdiff1d(a, v)) == np.setdiff1d(A, V).tolist()
    assert values(nd.setxor1d(a, v)) == np.setxor1d(A, V).tolist()
    assert values(nd.union1d(a, v)) == np.union1d(A, V).tolist()
    assert values(nd.intersect1d(a, v)) == np.intersect1d(A, V).tolist()
    with pytest.raises(ValueError):
        nd.broadcast_shapes((2, 3), (4, 3))
    assert nd.broadcast_shapes((2, 1, 3), (4, 1)) == (2, 4, 3)


def test_kernels(spark):
    row = spark.createDataFrame([([3.0, -4.0, 1.0], [1.0, 2.0, 2.0])], "x array<double>, y array<double>")
    x, y = F.col("x"), F.col("y")
    got = row.select(nd.ddot(x, y), nd.daxpy(2, x, y), nd.dscal(3, x), nd.dnrm2(x), nd.dasum(x), nd.idamax(x), nd.cross(x, y)).first()
    p, q = np.array([3.0, -4, 1]), np.array([1.0, 2, 2])
    assert got[0] == p @ q and got[1] == (2 * p + q).tolist() and got[2] == (3 * p).tolist()
    assert got[3] == pytest.approx(np.linalg.norm(p)) and got[4] == 8 and got[5] == 1 and got[6] == np.cross(p, q).tolist()


def test_ranks(spark):
    g = np.random.default_rng(4)
    x = g.integers(0, 30, 400) / 4
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(1000, None)], "id long, x double").repartition(5)
    got = {r.id: r.rank for r in ranks.average_ranks(df, "x").collect()}
    want = [(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x]
    assert got.pop(1000) is None and [got[i] for i in range(400)] == want
    assert ranks.quantiles(df, "x", [0, 0.1, 0.37, 0.5, 1]) == pytest.approx(np.quantile(x, [0, 0.1, 0.37, 0.5, 1]))
    numbers = {r.id: r.n for r in ranks.numbered(df.filter("x is not null"), ["x", "id"], "n").collect()}
    assert [numbers[i] for i in np.lexsort([np.arange(400), x])] == list(range(400))
    order = [r.id for r in nd.lexsort(["k", "x"], df.filter("x is not null").withColumn("k", F.col("id") % 7), "id").orderBy("rank").collect()]
    assert order == np.lexsort([np.arange(400), np.arange(400) % 7, x]).tolist()
    assert ranks.quantiles(df.limit(0), "x", [0.5]) == [None]
