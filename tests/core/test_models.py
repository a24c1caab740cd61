import itertools
import math

import numpy as np
import pandas as pd
import pytest

from tessera.models import graphs as g
from tessera.models import learning as le
from tessera.models import networks as n
from tessera.models.tables import CPD, FactorSet, FunctionalCPD, Joint, LinearGaussianCPD, Table, from_frame, from_table, identity, product, random_cpd, uniform_cpd


def student():
    """The five-variable teaching network."""
    return n.BayesianNetwork([
        CPD("D", 2, [0.6, 0.4]), CPD("I", 2, [0.7, 0.3]),
        CPD("G", 3, [[0.3, 0.05, 0.9, 0.5], [0.4, 0.25, 0.08, 0.3], [0.3, 0.7, 0.02, 0.2]], ["I", "D"], [2, 2]),
        CPD("L", 2, [[0.1, 0.4, 0.99], [0.9, 0.6, 0.01]], ["G"], [3]), CPD("S", 2, [[0.95, 0.2], [0.05, 0.8]], ["I"], [2]),
    ])


def whole(net):
    return product([c.table() for c in net.cpds.values()])


def test_tables(spark):
    r = np.random.default_rng(1)
    a, b = Table(["x", "y"], [2, 3], r.random(6)), Table(["y", "z"], [3, 2], r.random(6))
    np.testing.assert_allclose((a * b).keep(["x", "z"]).values, a.values @ b.values)
    np.testing.assert_allclose((a * b / b).maximize(["z"]).keep(["x", "y"]).values, a.values)
    assert (a / Table(["y"], [3], [0, 1, 1])).values[:, 0].tolist() == [0, 0]
    assert a.reduce({"x": 1}).values.tolist() == a.values[1].tolist()
    assert a.best() == dict(zip("xy", np.unravel_index(a.values.argmax(), (2, 3)), strict=True))
    np.testing.assert_allclose(from_frame(a.frame(spark)).values, a.values)
    assert abs(a.sample(4000, 1)[:, 0].mean() - a.values[1].sum() / a.values.sum()) < 0.05
    both = FactorSet([a, b])
    np.testing.assert_allclose(both.marginalize(["y"]).whole().keep(["x", "z"]).values, a.values @ b.values)
    assert both.variables() == {"x", "y", "z"} and len(both.holding("y")) == 2
    assert identity(["x"], [2]).values.tolist() == [1, 1]
    with pytest.raises(ValueError):
        CPD("x", 2, [0.5, 0.6])
    c = random_cpd("x", 2, ["p", "q"], [2, 3])
    np.testing.assert_allclose(c.reordered(["q", "p"]).table().aligned(["x", "p", "q"]), c.table().values)
    assert c.reduce({"q": 1}).parents == ["p"] and c.marginalize(["q"]).values.shape == (2, 2)
    assert uniform_cpd("x", 4).values.ravel().tolist() == [0.25] * 4
    j = whole(student())
    j = Joint(j.variables, j.values.shape, j.values)
    assert j.independent(["S"], ["G"], ["I"]) and not j.independent(["S"], ["G"]) and j.independent(["D"], ["I"])
    assert j.is_imap(student().edges()) and not j.is_imap([("D", "G"), ("I", "S"), ("G", "L")])
    np.testing.assert_allclose(j.conditional(["G"], {"D": 0, "I": 1}).values, [0.9, 0.08, 0.02])
    np.testing.assert_allclose(from_table(j.keep(["I", "S"]), "S").values, student().cpds["S"].values)


def test_exact_inference():
    net, j = student(), whole(student())
    for names, known in ((["G"], {"S": 1}), (["I", "L"], {"D": 1}), (["D"], {"L": 0, "S": 1})):
        want = j.reduce(known).keep(names).normalize().values
        np.testing.assert_allclose(net.query(names, known).values, want)
        np.testing.assert_allclose(n.JunctionTree(net.markov().tables).query(names, known).values, want)
    tree = n.JunctionTree(net.markov().tables).calibrate()
    assert tree.is_calibrated() and tree.running_intersection()
    assert all(np.isfinite(t.values).all() for t in tree.separator_beliefs().values())
    assert tree.map_query({"L": 0}) == j.reduce({"L": 0}).best()
    assert net.map_query(evidence={"L": 0}) == j.reduce({"L": 0}).best()
    np.testing.assert_allclose(net.markov().partition(), 1)
    np.testing.assert_allclose(net.markov().max_marginal(["G"]).values, j.maximize(["D", "I", "L", "S"]).values)
    np.testing.assert_allclose(net.query(["G"], virtual={"S": [1, 3]}).values, (j * Table(["S"], [2], [1, 3])).keep(["G"]).normalize().values)
    mplp = n.MPLP(net.markov().tables)
    assert mplp.run() == j.best() and abs(mplp.gap) < 1e-6
    np.testing.assert_allclose(net.do({"D": 0}).query(["G"]).values, 0.7 * np.array([0.3, 0.4, 0.3]) + 0.3 * np.array([0.9, 0.08, 0.02]))
    back = net.markov().to_bayesian()
    np.testing.assert_allclose(whole(back).aligned(j.variables), j.values)
    assert n.FactorGraph(net.markov().tables).edges()[0] == ("D", 0)
    for h in ("min_fill", "min_neighbors", "min_weight", "weighted_min_fill"):
        assert sorted(n.elimination_order(net.markov().tables, h)) == sorted(net.cpds)
    assert net.check() and net.is_imap(j) and net.markov().markov_blanket("S") == {"I"}


def test_sampling_and_prediction(spark):
    net, j = student(), whole(student())
    rows = net.simulate(spark, 20_000, 5)
    assert rows.columns == net.order
    got = {r.G: r["count"] / 20_000 for r in rows.groupBy("G").count().collect()}
    np.testing.assert_allclose([got[k] for k in range(3)], j.keep(["G"]).values, atol=0.02)
    want = j.reduce({"S": 1}).keep(["G"]).normalize().values
    for method, size in (("weighted", 20_000), ("rejection", 4000), ("gibbs", 4000)):
        p = {r.G: r.v for r in n.Sampling(net).query(spark, ["G"], {"S": 1}, size, 3, method).collect()}
        np.testing.assert_allclose([p[k] for k in range(3)], want, atol=0.04)
    data = spark.createDataFrame([(1, 0, 1), (2, None, 0), (3, 1, 1)], "id long, D int, S int")
    best = {r.id: r.I for r in net.predict(data, "I").collect()}
    assert best == {i: net.query(["I"], {k: v for k, v in (("D", d), ("S", s)) if v is not None}).best()["I"] for i, d, s in ((1, 0, 1), (2, None, 0), (3, 1, 1))}
    total = rows.limit(50).withColumn("p", net.log_probability(rows)).collect()
    assert all(r.p == pytest.approx(math.log(j.reduce({v: r[v] for v in net.order}).values)) for r in total)
    fresh = net.updated(rows, 10)
    np.testing.assert_allclose(fresh.cpds["G"].values, net.cpds["G"].values, atol=0.05)
    assert sorted(n.random_network(6, 0.4, 2, 3).cpds) == [f"X{k}" for k in range(6)]


def test_temporal(spark):
    first = [CPD("H", 2, [0.5, 0.5]), CPD("O", 2, [[0.9, 0.2], [0.1, 0.8]], ["H"], [2])]
    step = [CPD("H", 2, [[0.7, 0.3], [0.3, 0.7]], ["H-"], [2]), CPD("O", 2, [[0.9, 0.2], [0.1, 0.8]], ["H"], [2])]
    dbn = n.DynamicNetwork(first, step)
    seen = [{"O": 1}, {"O": 1}, {"O": 0}]
    flat = dbn.unrolled(3)
    known = {f"O@{t}": e["O"] for t, e in enumerate(seen)}
    for t, table in enumerate(dbn.smoothed(seen)):
        np.testing.assert_allclose(table.keep(["H"]).values, flat.query([f"H@{t}"], known).values)
    for t, table in enumerate(dbn.filtered(seen)):
        np.testing.assert_allclose(table.keep(["H"]).values, flat.query([f"H@{t}"], {k: v for k, v in known.items() if int(k[-1]) <= t}).values)
    rows = dbn.simulate(spark, 4000, 4, 2)
    again = n.DynamicNetwork.fit(rows, "sequence", "t", {"H": [], "O": ["H"]}, {"H": ["H-"], "O": ["H"]}, {"H": 2, "O": 2})
    np.testing.assert_allclose(again.transition[0].values, [[0.7, 0.3], [0.3, 0.7]], atol=0.03)
    chain = n.MarkovChain([[0.9, 0.1], [0.5, 0.5]])
    np.testing.assert_allclose(chain.stationary(), [5 / 6, 1 / 6])
    assert chain.is_ergodic() and chain.is_irreducible() and n.MarkovChain([[1, 0], [0.5, 0.5]]).absorbing() == [0]
    assert not n.MarkovChain([[0, 1], [1, 0]]).is_ergodic()
    paths = chain.sample(spark, 500, 40, 7).selectExpr("sequence", "posexplode(path) as (t, s)")
    np.testing.assert_allclose(n.MarkovChain.fit(paths, "sequence", "t", "s", 3).p[:2, :2], chain.p, atol=0.03)
    np.testing.assert_allclose(n.MarkovChain.fit(paths, "sequence", "t", "s", 3).p[2], [1 / 3] * 3)


def test_gaussian(spark):
    net = n.LinearGaussianNetwork([LinearGaussianCPD("a", 1, 2), LinearGaussianCPD("b", 0, 1, ["a"], [2]), LinearGaussianCPD("c", -1, 0.5, ["a", "b"], [1, -1])])
    mean, cov = net.joint()
    np.testing.assert_allclose(mean, [1, 2, -2])
    np.testing.assert_allclose(cov, [[2, 4, -2], [4, 9, -5], [-2, -5, 3.5]])
    rows = net.simulate(spark, 30_000, 3)
    fit = le.linear_gaussian_mle(rows, [("a", "b"), ("a", "c"), ("b", "c")], ["a", "b", "c"])
    np.testing.assert_allclose(fit.cpds["c"].weights, [1, -1], atol=0.05)
    names, m, v = net.predict({"b": 4})
    assert names == ["a", "c"]
    np.testing.assert_allclose(m, [1 + 4 / 9 * 2, -2 - 5 / 9 * 2])
    x = rows.limit(20).toPandas()
    low = spark.createDataFrame(x)
    z = x[["a", "b", "c"]].to_numpy() - mean
    want = -0.5 * ((z @ np.linalg.inv(cov) * z).sum() + 20 * np.linalg.slogdet(2 * np.pi * cov)[1])
    assert net.log_likelihood(low).first()[0] == pytest.approx(want)
    sem = n.SEM.from_lavaan("b ~ a\nc ~ 1*a + b # comment\na ~~ a").fit(rows)
    assert sem.coefficients["a", "b"] == pytest.approx(2, abs=0.05)
    np.testing.assert_allclose(sem.covariance(), cov, atol=0.3)
    ram = n.SEM.from_ram(["a", "b"], [[0, 0], [2, 0]], [[1, 0], [0, 3]])
    np.testing.assert_allclose(ram.covariance(), [[1, 2], [2, 7]])
    lisrel = n.SEM.from_lisrel(["x"], ["y"], [[0]], [[2]], [[3]], [[1]])
    assert lisrel.coefficients == {("x", "y"): 2.0} and ram.simulate(spark, 10, 1).count() == 10
    f = n.FunctionalNetwork([FunctionalCPD("u", lambda p, r: r.random(p["size"])), FunctionalCPD("v", lambda p, r: p["u"] ** 2, ["u"])])
    pair = f.simulate(spark, 200, 1).toPandas()
    np.testing.assert_allclose(pair.v, pair.u**2)
    assert set(f.simulate(spark, 5, 1, {"u": 3.0}).toPandas().v) == {9.0}
    scm = n.SimpleCausalModel({"a": ([], lambda p, e: e), "b": (["a"], lambda p, e: 2 * p["a"] + e)})
    assert scm.evaluate({"a": 1, "b": 0.5}) == {"a": 1, "b": 2.5} and scm.evaluate({"b": 0.5}, {"a": 3})["b"] == 6.5
    assert len(n.random_linear_gaussian_network(5, 0.5, 1).order) == 5


def test_effects(spark):
    r = np.random.default_rng(5)
    z, u, i = r.normal(size=(3, 4000))
    t = 0.8 * z + u + i + r.normal(size=4000)
    y = 1.5 * t + z - 2 * u + r.normal(size=4000)
    seen = 2 * t + 3 * z + r.normal(size=4000)
    df = spark.createDataFrame(pd.DataFrame({"k": range(4000), "z": z, "i": i, "t": t, "y": y, "s": seen}))
    iv = n.two_stage(df, "y", "t", ["i"], ["z"])
    assert iv["effect"] == pytest.approx(1.5, abs=0.15) and iv["first_stage_f"] > 100
    assert n.adjusted(df, "s", "t", ["z"])["effect"] == pytest.approx(2, abs=0.05)
    ml = n.double_ml(df, "s", "t", ["z"], "k", 4)
    assert ml["low"] < 2 < ml["high"] and ml["rows"] == 4000
    folds = np.minimum(np.arange(4000) // 1000, 3)
    a = np.stack([np.ones(4000), z], 1)
    rt, ry = np.empty(4000), np.empty(4000)
    for k in range(4):
        for out, v in ((rt, t), (ry, seen)):
            beta = np.linalg.lstsq(a[folds != k], v[folds != k], rcond=None)[0]
            out[folds == k] = (v - a @ beta)[folds == k]
    assert ml["effect"] == pytest.approx(rt @ ry / (rt @ rt))


def test_graphs():
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")]
    assert sorted(map(sorted, g.strong_components(edges))) == [["a", "b", "c"], ["d"], ["e"]]
    assert g.dfs(edges, "a") == ["a", "b", "c", "d", "e"]
    assert g.topological_order(["z"], [("b", "c"), ("a", "c")]) == ["a", "b", "c", "z"]
    with pytest.raises(ValueError):
        g.topological_order([], edges)
    assert g.all_shortest_paths([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "e"), ("e", "f"), ("f", "d")], "a", "d") == [["a", "b", "d"], ["a", "c", "d"]]
    assert g.is_tree("abc", [("a", "b"), ("a", "c")]) and g.is_forest("abcd", [("a", "b"), ("c", "d")]) and not g.is_forest("abc", [("a", "c"), ("b", "c")])
    square = g.Undirected([("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")])
    assert not square.is_chordal() and square.triangulate().is_chordal() and square.is_connected()
    assert [sorted(c) for c in square.cliques()] == [["a", "b"], ["a", "d"], ["b", "c"], ["c", "d"]]
    cliques, tree = square.junction_tree()
    assert len(cliques) == 2 and len(tree) == 1 and square.induced_width(["a", "b", "c", "d"]) == 2
    p = g.dag_to_pdag([("a", "c"), ("b", "c"), ("c", "d")])
    assert p.directed == {("a", "c"), ("b", "c"), ("c", "d")}
    assert g.dag_to_pdag([("a", "b"), ("b", "c")]).undirected == {frozenset("ab"), frozenset("bc")}
    assert g.equivalent(g.PDAG([], [("a", "b"), ("b", "c"), ("a", "c")]).to_dag(), [("a", "b"), ("b", "c"), ("a", "c")])
    hidden = g.latent_projection([("u", "x"), ("u", "y"), ("x", "y")], ["u"])
    assert hidden.directed == {("x", "y")} and hidden.bidirected == {frozenset("xy")}
    m = g.ADMG([("a", "b"), ("c", "d")], [("b", "c")])
    assert m.m_separated("a", "d") and not m.m_separated("a", "d", ["b"])
    assert not m.m_separated("a", "c", ["b"]) and m.districts() == [{"a"}, {"b", "c"}, {"d"}]
    assert g.mag_from_admg(m).is_ancestral()
    text = "dag { a [pos=\"0,0\"]\n a -> b; b <-> c\n c <- d -> e }"
    back = g.from_dagitty(text)
    assert back.directed == {("a", "b"), ("d", "c"), ("d", "e")} and back.bidirected == {frozenset("bc")}
    assert g.from_dagitty(g.to_dagitty(back)).directed == back.directed
    assert g.confusion("abc", [("a", "b"), ("b", "c")], [("b", "a"), ("a", "c")]) == {"tp": 1, "fp": 1, "fn": 1, "tn": 0}
    assert g.confusion("abc", [("a", "b")], [("b", "a")], True) == {"tp": 0, "fp": 1, "fn": 1, "tn": 0}


def test_separation_is_that_of_distributions():
    """Every separation of random small networks holds in their tables."""
    for seed in range(3):
        net = n.random_network(5, 0.45, 2, seed)
        j = whole(net)
        joint = Joint(j.variables, j.values.shape, j.values)
        graph = g.ADMG(net.edges(), (), net.cpds)
        for a, b in itertools.combinations(sorted(net.cpds), 2):
            rest = sorted(set(net.cpds) - {a, b})
            for k in range(len(rest) + 1):
                for z in itertools.combinations(rest, k):
                    assert graph.m_separated(a, b, z) == joint.independent([a], [b], z, 1e-12)


def test_identification():
    m = [("u", "x"), ("u", "y"), ("x", "m"), ("m", "y")]
    assert g.is_frontdoor(m, "x", "y", ["m"]) and g.frontdoor_sets(m, "x", "y") == [{"m"}]
    assert not g.is_frontdoor(m, "x", "y", ["u"]) and g.minimal_backdoor(m, "x", "y") == {"u"}
    z = [("z", "x"), ("x", "y"), ("u", "x"), ("u", "y")]
    assert g.instruments(z, "x", "y") == ["z"]
    assert g.proper_backdoor_graph(z, "x", "y") == [("z", "x"), ("u", "x"), ("u", "y")]
    assert {"u"} in g.backdoor_sets(z, "x", "y")
    assert g.minimal_separator([("a", "b"), ("b", "c")], "a", "c") == {"b"} and g.minimal_separator([("a", "b")], "a", "b") is None
    i = g.Independences([g.Independence("a", "bc")])
    assert i.entails(g.Independence("a", "b")) and i.entails(g.Independence("b", "a", "c")) and not i.entails(g.Independence("b", "c"))
    assert i.reduced() == {g.Independence("a", "bc")} and i.equivalent(g.Independences([g.Independence("a", "b"), g.Independence("a", "c", "b")]))
    assert g.Independence("c", "a", "b") in g.local_independences("abc", [("a", "b"), ("b", "c")])
    assert repr(g.Independence("a", "b", "c")) == "(a _|_ b | c)"


@pytest.fixture(scope="module")
def rows(spark):
    return student().simulate(spark, 6000, 11).repartition(4).cache()


def test_scores_and_searches(rows):
    bic = le.DiscreteScore(rows, "bic")
    from tessera.operators.structure import local_scores

    old = local_scores(rows, "G", ["D", "I"]).first()
    for kind in ("loglik", "aic", "bic", "k2", "bdeu"):
        assert le.DiscreteScore(rows, kind).local("G", ["D", "I"]) == pytest.approx(old[{"loglik": "log_likelihood"}.get(kind, kind)])
    assert le.DiscreteScore(rows, "bds").local("G", []) == pytest.approx(le.DiscreteScore(rows, "bdeu").local("G", []))
    true = set(student().edges())
    names = sorted(student().cpds)
    best = le.exhaustive_search(bic, names)
    assert g.equivalent(best, true)
    assert bic.score(le.hill_climb(bic, names)) <= bic.score(best) + 1e-6
    assert {frozenset(e) for e in le.hill_climb(bic, names, tabu=3, max_parents=2)} >= {frozenset("GL"), frozenset("IS")}
    know = le.Knowledge(required={("S", "I")}, forbidden={("G", "L")}, tiers=[{"L"}, {"G"}])
    found = le.hill_climb(bic, names, knowledge=know)
    assert ("S", "I") in found and ("G", "L") not in found
    p = le.ges(bic, names)
    assert {frozenset(e) for e in p.directed} | p.undirected >= {frozenset("GL"), frozenset("IS")}
    assert {frozenset(e) for e in le.mmhc(rows, bic, names)} <= {frozenset(e) for e in itertools.combinations(names, 2)}
    order = {v: k for k, v in enumerate(student().order)}
    asked = le.expert_in_loop(rows, names, lambda a, b: 1 if order[a] < order[b] else -1)
    assert ("G", "L") in asked and ("I", "S") in asked
    fit = le.fit_network(rows, list(true), {"D": 2, "I": 2, "G": 3, "L": 2, "S": 2}, "k2")
    np.testing.assert_allclose(fit.cpds["S"].values, student().cpds["S"].values, atol=0.05)
    assert le.fisher_c(rows, names, list(true))["pvalue"] > 0.001 and le.fisher_c(rows, names, [("D", "G")])["pvalue"] < 1e-6
    assert le.correlation_score(rows, names, list(true)) > 0.9


def test_gaussian_scores_and_tests(spark):
    r = np.random.default_rng(8)
    z = r.normal(size=3000)
    x, y = z + r.normal(size=3000), 2 * z + r.normal(size=3000)
    w = x + y + r.normal(size=3000)
    k = (z > 0).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "z": z, "w": w, "k": k}))
    flat = df.drop("k")
    s = le.GaussianScore(flat, "loglik")
    rest = y - np.poly1d(np.polyfit(z, y, 1))(z)
    assert s.local("y", ["z"]) == pytest.approx(-1500 * (math.log(2 * math.pi * (rest**2).mean()) + 1))
    assert ("z", "y") in le.hill_climb(le.GaussianScore(flat), ["x", "y", "z", "w"]) or ("y", "z") in le.hill_climb(le.GaussianScore(flat), ["x", "y", "z", "w"])
    mixed = le.ConditionalGaussianScore(df, ["k"], "loglik")
    want = sum(-0.5 * (k == c).sum() * (math.log(2 * math.pi * (z[k == c].var() + 1e-9)) + 1) for c in (0, 1))
    assert mixed.local("z", ["k"]) == pytest.approx(want) and mixed.local("k", []) == pytest.approx(sum((k == c).sum() * math.log((k == c).mean()) for c in (0, 1)))
    assert le.gcm(df, "x", "y", ["z"])["pvalue"] > 0.01 > le.gcm(df, "x", "y")["pvalue"]
    assert le.pearson_equivalence(df, "x", "y", ["z"])["pvalue"] < 0.05 < le.pearson_equivalence(df, "x", "y")["pvalue"]
    for kind in ("wilks", "pillai", "hotelling", "roy"):
        assert le.manova(df, ["x"], ["y", "w"], ["z"], kind)["pvalue"] < 1e-6
        assert le.manova(df, ["x"], ["y"], ["z"], kind)["pvalue"] > 0.01
    assert le.tree_ci(df, "x", "w", ["z"])["pvalue"] < 0.01 < le.tree_ci(df, "x", "y", ["z"])["pvalue"]
    t, p = le.coefficient_test(df, "w", "x", "y")["x"]
    assert t > 10 and p < 1e-6


def test_estimators(spark):
    true = n.BayesianNetwork([CPD("H", 2, [0.4, 0.6]), *[CPD(v, 2, [[0.9, 0.2], [0.1, 0.8]], ["H"], [2]) for v in "ABC"]])
    data = true.simulate(spark, 4000, 2).drop("H")
    start = n.BayesianNetwork([CPD("H", 2, [0.5, 0.5]), *[CPD(v, 2, [[0.6, 0.4], [0.4, 0.6]], ["H"], [2]) for v in "ABC"]])
    net, value = le.em(data, start, 60)
    np.testing.assert_allclose(net.cpds["A"].values, [[0.9, 0.2], [0.1, 0.8]], atol=0.06)
    assert value < 0
    a, b = Table(["x", "y"], [2, 2], [0.3, 0.2, 0.1, 0.4]), Table(["y", "z"], [2, 2], [0.25, 0.15, 0.2, 0.4])
    start = [identity(["x", "y"], [2, 2]), identity(["y", "z"], [2, 2])]
    for f in (le.marginal_estimate, le.mirror_descent):
        got = n.MarkovNetwork(f(start, [a, b]))
        np.testing.assert_allclose(got.query(["x", "y"]).values, a.values, atol=1e-5)
        np.testing.assert_allclose(got.query(["y", "z"]).values, b.values, atol=1e-5)


def test_discrete_tests(rows):
    known = [g.Independence("S", "GDL", "I")]
    assert le.independence_match(known, "S", "G", ["I"]) and not le.independence_match(known, "S", "I")
    a = le.modified_log_likelihood(rows, "S", "G", ["I"])
    assert a["pvalue"] > 0.001 and le.modified_log_likelihood(rows, "S", "G")["pvalue"] < 1e-6 and a["dof"] == 4
