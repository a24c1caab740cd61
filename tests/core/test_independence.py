import numpy as np
import pytest

from tessera.operators.independence import Dag, partial_correlation, pc, stratified, structural_distance
from tessera.operators.structure import hill_climb


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(4)
    a, b = r.integers(0, 2, 3000), r.integers(0, 3, 3000)
    c = np.where(r.random(3000) < 0.85, (a + (b > 0)) % 3, r.integers(0, 3, 3000))
    d = np.where(r.random(3000) < 0.85, c, r.integers(0, 3, 3000))
    return spark.createDataFrame([tuple(map(int, x)) for x in zip(a, b, c, d, strict=True)], "a int, b int, c int, d int").cache()


def test_stratified_is_brute_force(data):
    p = data.toPandas()
    chi = g = dof = 0.0
    for _, s in p.groupby("c"):
        o = np.array([[((s.a == i) & (s.d == j)).sum() for j in range(3)] for i in range(2)], float)
        e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
        chi += ((o - e)[e > 0] ** 2 / e[e > 0]).sum()
        g += (2 * o[o > 0] * np.log(o[o > 0] / e[o > 0])).sum()
        dof += 2
    got = stratified(data, "a", "d", ["c"])
    assert got["statistic"] == pytest.approx(chi) and got["dof"] == dof
    assert stratified(data, "a", "d", ["c"], 0.0)["statistic"] == pytest.approx(g)
    assert got["pvalue"] > 0.01 > stratified(data, "a", "d")["pvalue"]


def test_partial_correlation(spark):
    r = np.random.default_rng(5)
    z = r.normal(size=800)
    x, y = z + r.normal(size=800), z + r.normal(size=800)
    df = spark.createDataFrame([tuple(map(float, v)) for v in zip(x, y, z, strict=True)], "x double, y double, z double")
    one = np.column_stack([z, np.ones(800)])
    rest = lambda v: v - one @ np.linalg.lstsq(one, v, rcond=None)[0]
    got = partial_correlation(df, "x", "y", ["z"])
    assert got["statistic"] == pytest.approx(np.corrcoef(rest(x), rest(y))[0, 1], abs=1e-9)
    assert got["pvalue"] == pytest.approx(got["fisher_p"], abs=0.02) and partial_correlation(df, "x", "y")["pvalue"] < 1e-6


def test_graph_criteria():
    g = Dag([("u", "x"), ("u", "y"), ("x", "m"), ("m", "y"), ("y", "k")])
    assert not g.d_separated({"x"}, {"y"}, set()) and g.d_separated({"x"}, {"y"}, {"u", "m"})
    assert g.backdoor_sets("x", "y") == [{"u"}] and g.markov_blanket("x") == {"u", "m"}
    c = Dag([("a", "c"), ("b", "c"), ("c", "d")])
    assert c.d_separated({"a"}, {"b"}, set()) and not c.d_separated({"a"}, {"b"}, {"d"})
    assert structural_distance(c, Dag([("c", "a"), ("b", "c")])) == 2


def test_pc_finds_the_collider(data):
    arrows, open_ = pc(data, ["a", "b", "c", "d"], alpha=0.01)
    assert {("a", "c"), ("b", "c"), ("c", "d")} == arrows and not open_


@pytest.fixture(scope="module")
def causes(spark):
    """Four independent coins; x and y hear the first three, w all four."""
    r = np.random.default_rng(6)
    z = r.integers(0, 2, (6000, 4))
    heard = lambda s, top: (r.random(6000) < 0.04 + 0.92 * s / top).astype(int)
    rows = np.column_stack([z, heard(z[:, :3].sum(1), 3), heard(z[:, :3].sum(1), 3), heard(z.sum(1), 4)])
    return spark.createDataFrame([tuple(map(int, v)) for v in rows], "a int, b int, c int, d int, x int, y int, w int").coalesce(1).cache()


def test_pc_separates_by_three(causes):
    arrows, open_ = pc(causes, ["a", "b", "c", "x", "y"], alpha=0.001)
    assert arrows == {(p, v) for p in "abc" for v in "xy"} and not open_
    short, more = pc(causes, ["a", "b", "c", "x", "y"], alpha=0.001, max_given=2)
    assert frozenset("xy") in {frozenset(e) for e in short | more}


def test_hill_climb_finds_four_parents(causes):
    assert hill_climb(causes, ["a", "b", "c", "d", "w"]) == [(p, "w") for p in "abcd"]
