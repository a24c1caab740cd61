"""Queries for statistics, arrays, graphs and factors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import arrays as a
from tessera.operators import factors as fa
from tessera.operators import graph as g
from tessera.operators import independence as ind
from tessera.operators import stats as s
from tessera.operators import structure as st
from tessera.plans.registry import Tables, query

C = F.col


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else C(c) for c, k in df.dtypes])


@query("""WITH m AS (SELECT avg(value) AS mean FROM events), p AS (SELECT avg((value - mean) ** 2) m2, avg((value - mean) ** 3) m3, avg((value - mean) ** 4) m4 FROM events, m)
SELECT count(value) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS variance,
       (SELECT round(m3 / m2 ** 1.5, 6) FROM p) AS skewness, (SELECT round(m4 / m2 ** 2 - 3, 6) FROM p) AS kurtosis FROM events""")
def stat_describe(x: Tables) -> DataFrame:
    return rounded(s.describe(x.events, "value"))


@query("SELECT round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 4) AS iqr FROM orders")
def stat_iqr(x: Tables) -> DataFrame:
    return rounded(s.iqr(x.orders, "o_totalprice"), 4)


@query("SELECT round(stddev_samp(value) / sqrt(count(value)), 6) AS sem FROM events")
def stat_sem(x: Tables) -> DataFrame:
    return rounded(s.sem(x.events, "value"))


@query("SELECT round(avg(value), 6) AS trim_mean FROM (SELECT value, row_number() OVER (ORDER BY value) AS r, count(*) OVER () AS n FROM events) WHERE r > floor(n * 0.1) AND r <= n - floor(n * 0.1)")
def stat_trim_mean(x: Tables) -> DataFrame:
    return rounded(s.trim_mean(x.events, "value", 0.1))


@query("SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_samp(value) FROM events), 6) AS z FROM events")
def stat_zscore(x: Tables) -> DataFrame:
    return rounded(s.zscore(x.events.select("event_id", "value"), "value").select("event_id", "z"))


@query("SELECT round(-sum(p * ln(p)), 6) AS entropy FROM (SELECT count(*) / (SELECT count(*) FROM events)::DOUBLE AS p FROM events GROUP BY event_type)")
def stat_entropy(x: Tables) -> DataFrame:
    n = x.events.agg(F.count(F.lit(1)).alias("n"))
    p = x.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("k")).crossJoin(F.broadcast(n)).select((C("k") / C("n")).alias("p"))
    return rounded(s.entropy(p, "p"))


@query("""WITH g AS (SELECT o_orderstatus AS s, count(*) n, avg(o_totalprice) m, var_samp(o_totalprice) v FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1)
SELECT round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS statistic FROM g a, g b WHERE a.s = 'F' AND b.s = 'O'""")
def test_welch(x: Tables) -> DataFrame:
    return rounded(s.as_frame(x.orders, s.ttest_ind(x.orders, "o_totalprice", "o_orderstatus", "F", "O"))).select("statistic")


@query("""WITH r AS (SELECT event_type, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS rk FROM events),
g AS (SELECT event_type, count(*) n, sum(rk) r FROM r GROUP BY 1), t AS (SELECT sum(n) AS n FROM g)
SELECT round(12.0 / (t.n * (t.n + 1)) * sum(g.r * g.r / g.n) - 3 * (t.n + 1), 4) AS statistic FROM g, t GROUP BY t.n""")
def test_kruskal(x: Tables) -> DataFrame:
    return rounded(s.as_frame(x.events, s.kruskal(x.events, "value", "event_type")), 4).select("statistic")


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS statistic FROM lineitem")
def test_pearson(x: Tables) -> DataFrame:
    return rounded(s.as_frame(x.lineitem, s.pearson(x.lineitem, "l_quantity", "l_extendedprice"))).select("statistic")


@query("""WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part)
SELECT round(corr(a, b), 6) AS statistic FROM r""")
def test_spearman(x: Tables) -> DataFrame:
    return rounded(s.as_frame(x.part, s.spearman(x.part, "p_size", "p_retailprice"))).select("statistic")


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(corr(l_extendedprice, l_quantity), 6) AS r FROM lineitem")
def linear_regression(x: Tables) -> DataFrame:
    out = s.as_frame(x.lineitem, s.linregress(x.lineitem, "l_quantity", "l_extendedprice"))
    return out.select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r", 6).alias("r"))


CELLS = """WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS o FROM orders GROUP BY ALL), n AS (SELECT sum(o) AS n FROM c),
f AS (SELECT r.a, k.b, coalesce(c.o, 0) AS o, r.n * k.n / (SELECT n FROM n)::DOUBLE AS e FROM (SELECT a, sum(o) n FROM c GROUP BY a) r CROSS JOIN (SELECT b, sum(o) n FROM c GROUP BY b) k LEFT JOIN c ON c.a = r.a AND c.b = k.b)"""


@query(CELLS + " SELECT round(sum((o - e) ** 2 / e), 6) AS statistic, ((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1))::DOUBLE AS dof FROM f")
def test_chi_square(x: Tables) -> DataFrame:
    return rounded(s.as_frame(x.orders, s.chi2_contingency(x.orders, "o_orderpriority", "o_orderstatus"))).select("statistic", "dof")


@query(CELLS + " SELECT round(sum(CASE WHEN o > 0 THEN 2 * o * ln(o / e) ELSE 0 END), 6) AS statistic FROM f")
def test_g(x: Tables) -> DataFrame:
    return rounded(s.as_frame(x.orders, s.chi2_contingency(x.orders, "o_orderpriority", "o_orderstatus", 0.0))).select("statistic")


@query(CELLS + " SELECT a, b, o AS observed, round(e, 6) AS expected FROM f")
def contingency_table(x: Tables) -> DataFrame:
    return rounded(s.contingency(x.orders.select(C("o_orderpriority").alias("a"), C("o_orderstatus").alias("b")), "a", "b"))


@query()
def hypothesis_tests(x: Tables) -> DataFrame:
    """p-values of the other tests, as (test, statistic, pvalue)."""
    e, o = x.events, x.orders
    found = {
        "mann_whitney": s.mann_whitney(o, "o_totalprice", "o_orderstatus", "F", "O"), "bartlett": s.bartlett(e, "value", "event_type"),
        "levene": s.levene(e, "value", "event_type"), "jarque_bera": s.jarque_bera(e, "value"), "ks": s.ks_2samp(o, "o_totalprice", "o_orderstatus", "F", "O"),
        "wilcoxon": s.wilcoxon(x.customer, "c_acctbal"), "one_sample": s.ttest_1samp(e, "value", 50.0),
    }
    return x.spark.createDataFrame([(k, float(v["statistic"]), float(v["pvalue"])) for k, v in found.items()], "test string, statistic double, pvalue double")


# arrays


@query("""WITH m AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings)
SELECT a.k::INT AS i0, b.k::INT AS i1, round(sum(a.x * b.x), 5) AS v FROM m a JOIN m b USING (vec_id) GROUP BY 1, 2""")
def gram_matrix_columns(x: Tables) -> DataFrame:
    """The product of the transpose and the matrix over all rows: dim x dim cells, whatever the number of rows."""
    m = x.embeddings.select(C("vec_id").alias("i0"), F.posexplode("embedding").alias("i1", "v")).withColumn("v", C("v").cast("double"))
    return rounded(a.matmul(a.transpose(m), m), 5)


@query("SELECT (k - 1)::INT AS i1, round(avg(v), 6) AS v FROM (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS k FROM embeddings) GROUP BY 1")
def array_column_means(x: Tables) -> DataFrame:
    m = x.embeddings.select(C("vec_id").alias("i0"), F.posexplode("embedding").alias("i1", "v")).withColumn("v", C("v").cast("double"))
    return rounded(a.reduce_axes(m, "mean", "i0"))


@query("SELECT vec_id AS i0, (list_position(embedding, list_max(embedding)) - 1)::INT AS i1 FROM embeddings")
def array_argmax(x: Tables) -> DataFrame:
    m = x.embeddings.select(C("vec_id").alias("i0"), F.posexplode("embedding").alias("i1", "v"))
    return a.arg_extreme(m, "i1")


# graphs: who buys from whom, by nation

EDGES = "(SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey)"


def trade(x: Tables) -> DataFrame:
    line = x.lineitem.select("l_orderkey", "l_suppkey")
    sold = line.join(x.orders, C("l_orderkey") == C("o_orderkey")).join(x.supplier, C("s_suppkey") == C("l_suppkey"))
    return sold.join(x.customer, C("o_custkey") == C("c_custkey")).select(C("c_nationkey").alias("src"), C("s_nationkey").alias("dst")).distinct()


@query(f"SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT src AS node, 0 AS i, 1 AS o FROM {EDGES} UNION ALL SELECT dst, 1, 0 FROM {EDGES}) GROUP BY 1")
def graph_degrees(x: Tables) -> DataFrame:
    return g.degrees(trade(x))


@query(f"WITH RECURSIVE e AS {EDGES}, r AS (SELECT 0 AS node, 0 AS distance UNION SELECT dst, distance + 1 FROM r JOIN e ON src = node WHERE distance < 25) SELECT node, min(distance) AS distance FROM r GROUP BY 1")
def graph_distances(x: Tables) -> DataFrame:
    return g.distances(trade(x), 0)


@query(f"WITH RECURSIVE e AS {EDGES}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT src AS node, src AS other FROM u UNION SELECT node, dst FROM r JOIN u ON src = other) SELECT node, min(other) AS component FROM r GROUP BY 1")
def graph_components(x: Tables) -> DataFrame:
    return g.weak_components(trade(x))


@query(f"WITH e AS {EDGES} SELECT DISTINCT a, b FROM (SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src != dst UNION SELECT p.src, q.src FROM e p JOIN e q ON p.dst = q.dst AND p.src < q.src)")
def graph_moral(x: Tables) -> DataFrame:
    return g.moralize(trade(x))


@query()
def graph_pagerank(x: Tables) -> DataFrame:
    return rounded(g.pagerank(trade(x)))


@query(f"WITH e AS {EDGES} SELECT round(count(*) / (n * (n - 1))::DOUBLE, 6) AS density FROM e, (SELECT count(*) AS n FROM (SELECT src FROM e UNION SELECT dst FROM e)) GROUP BY n")
def graph_density(x: Tables) -> DataFrame:
    return rounded(g.density(trade(x)))


# the same over every row of lineitem: goods go from parts (3k) to suppliers (3k + 1) to customers (3k + 2)

FLOW = "(SELECT 3 * l_partkey AS src, 3 * l_suppkey + 1 AS dst FROM lineitem UNION SELECT 3 * l_suppkey + 1, 3 * o_custkey + 2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
NATIONS = "(SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey)"


def links(x: Tables) -> DataFrame:
    """The flow with its repeats."""
    part, supplier, customer = C("l_partkey") * 3, C("l_suppkey") * 3 + 1, C("o_custkey") * 3 + 2
    sold = x.lineitem.join(x.orders, C("l_orderkey") == C("o_orderkey")).select(supplier.alias("src"), customer.alias("dst"))
    return x.lineitem.select(part.alias("src"), supplier.alias("dst")).union(sold)


def flow(x: Tables) -> DataFrame:
    return links(x).distinct()


@query(f"SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT src AS node, 0 AS i, 1 AS o FROM {FLOW} UNION ALL SELECT dst, 1, 0 FROM {FLOW}) GROUP BY 1")
def graph_degrees_whole(x: Tables) -> DataFrame:
    return g.degrees(flow(x))


@query(f"WITH RECURSIVE e AS MATERIALIZED {FLOW}, r AS (SELECT (SELECT min(src) FROM e WHERE src % 3 = 0) AS node, 0 AS distance UNION SELECT dst, distance + 1 FROM r JOIN e ON src = node) SELECT node, min(distance) AS distance FROM r GROUP BY 1")
def graph_distances_whole(x: Tables) -> DataFrame:
    return g.distances(flow(x), 3 * x.lineitem.agg(F.min("l_partkey")).first()[0])


@query()
def graph_components_whole(x: Tables) -> DataFrame:
    return g.weak_components(links(x))


@query(f"WITH e AS {NATIONS} SELECT DISTINCT a, b FROM (SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src != dst UNION SELECT p.src, q.src FROM e p JOIN e q ON p.dst = q.dst AND p.src < q.src)")
def graph_moral_whole(x: Tables) -> DataFrame:
    """Of the nations, as the flow's pairs of parts with one supplier grow with the square of the parts."""
    sold = x.lineitem.join(x.orders, C("l_orderkey") == C("o_orderkey")).join(x.supplier, C("s_suppkey") == C("l_suppkey"))
    return g.moralize(sold.join(x.customer, C("o_custkey") == C("c_custkey")).select(C("c_nationkey").alias("src"), C("s_nationkey").alias("dst")).distinct())


@query()
def graph_pagerank_whole(x: Tables) -> DataFrame:
    return rounded(g.pagerank(links(x), once=True), 9)


@query(f"WITH e AS {FLOW} SELECT round(count(*) / (n * (n - 1))::DOUBLE, 6) AS density FROM e, (SELECT count(*) AS n FROM (SELECT src FROM e UNION SELECT dst FROM e)) GROUP BY n")
def graph_density_whole(x: Tables) -> DataFrame:
    return rounded(g.density(flow(x)))


# factors and learning on the order tables


def discrete(x: Tables) -> DataFrame:
    """Status, priority and size class of orders as one table of categories."""
    return x.orders.select(C("o_orderstatus").alias("s"), C("o_orderpriority").alias("p"), F.when(C("o_totalprice") > 200000, "big").otherwise("small").alias("z"))


D = "(SELECT o_orderstatus AS s, o_orderpriority AS p, CASE WHEN o_totalprice > 200000 THEN 'big' ELSE 'small' END AS z FROM orders)"


@query(f"SELECT s, p, round(count(*) / sum(count(*)) OVER (PARTITION BY p)::DOUBLE, 6) AS v FROM {D} GROUP BY s, p")
def cpd_maximum_likelihood(x: Tables) -> DataFrame:
    return rounded(fa.fit_cpd(discrete(x), "s", ["p"]))


@query(f"WITH c AS (SELECT s, p, count(*) AS n FROM {D} GROUP BY ALL), f AS (SELECT a.s, b.p, coalesce(c.n, 0) + 10.0 / (3 * 5) AS n FROM (SELECT DISTINCT s FROM c) a CROSS JOIN (SELECT DISTINCT p FROM c) b LEFT JOIN c ON c.s = a.s AND c.p = b.p) SELECT s, p, round(n / sum(n) OVER (PARTITION BY p), 6) AS v FROM f")
def cpd_bdeu(x: Tables) -> DataFrame:
    return rounded(fa.fit_cpd(discrete(x), "s", ["p"], "bdeu", 10.0))


@query(f"SELECT p, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS v FROM {D} WHERE z = 'big' GROUP BY p")
def posterior_by_elimination(x: Tables) -> DataFrame:
    d = discrete(x)
    factors = [fa.fit_cpd(d, "p", []), fa.fit_cpd(d, "s", ["p"]), fa.fit_cpd(d, "z", ["p", "s"])]
    return rounded(fa.query(factors, ["p"], {"z": "big"}))


@query(f"SELECT s, round(sum(v), 6) AS v FROM (SELECT s, p, count(*) / (SELECT count(*) FROM {D})::DOUBLE AS v FROM {D} GROUP BY s, p) GROUP BY s")
def factor_marginal(x: Tables) -> DataFrame:
    return rounded(fa.marginalize(fa.joint(discrete(x), ["s", "p"]), ["p"]))


@query(f"""WITH d AS {D}, n AS (SELECT s, p, count(*) c FROM d GROUP BY ALL), m AS (SELECT p, sum(c) c FROM n GROUP BY p)
SELECT round(sum(n.c * ln(n.c / m.c)), 4) AS log_likelihood, round(sum(n.c * ln(n.c / m.c)) - 0.5 * ln((SELECT count(*) FROM d)) * 2 * 5, 4) AS bic, round(sum(n.c * ln(n.c / m.c)) - 2 * 5, 4) AS aic FROM n JOIN m USING (p)""")
def structure_scores(x: Tables) -> DataFrame:
    return rounded(st.local_scores(discrete(x), "s", ["p"]), 4).select("log_likelihood", "bic", "aic")


@query(f"""WITH d AS {D}, n AS (SELECT count(*)::DOUBLE AS n FROM d),
sp AS (SELECT 's' AS a, 'p' AS b, s AS x, p AS y, count(*) c FROM d GROUP BY ALL UNION ALL SELECT 's', 'z', s, z, count(*) FROM d GROUP BY ALL UNION ALL SELECT 'p', 'z', p, z, count(*) FROM d GROUP BY ALL)
SELECT a, b, round(sum(c / n * ln(c * n / (cx * cy))), 6) AS mi FROM (SELECT *, sum(c) OVER (PARTITION BY a, b, x) cx, sum(c) OVER (PARTITION BY a, b, y) cy FROM sp), n GROUP BY a, b""")
def mutual_information(x: Tables) -> DataFrame:
    return rounded(st.mutual_information(discrete(x), ["s", "p", "z"]))


@query()
def chow_liu_tree(x: Tables) -> DataFrame:
    return x.spark.createDataFrame(st.chow_liu(discrete(x), ["s", "p", "z"]), "src string, dst string")


@query(f"""WITH d AS (SELECT s, p, CASE z WHEN 'big' THEN 1.0 ELSE 0.0 END AS y FROM {D}), w AS (SELECT p, count(*) / (SELECT count(*) FROM d)::DOUBLE AS w FROM d GROUP BY p)
SELECT s, round(sum(m * w), 6) AS effect FROM (SELECT s, p, avg(y) AS m FROM d GROUP BY s, p) JOIN w USING (p) GROUP BY s""")
def backdoor_adjustment(x: Tables) -> DataFrame:
    d = discrete(x).withColumn("y", F.when(C("z") == "big", 1.0).otherwise(0.0))
    return rounded(st.backdoor(d, "s", "y", ["p"]))


@query(f"SELECT s, p, round(count(*) / (SELECT count(*) FROM {D})::DOUBLE, 6) AS v FROM {D} GROUP BY s, p")
def joint_distribution(x: Tables) -> DataFrame:
    return rounded(fa.joint(discrete(x), ["s", "p"]))


@query(f"WITH d AS {D}, n AS (SELECT s, z, p, count(*) AS o FROM d GROUP BY ALL), f AS (SELECT o, sum(o) OVER (PARTITION BY p) AS n, sum(o) OVER (PARTITION BY s, p) AS rs, sum(o) OVER (PARTITION BY z, p) AS cz FROM n) SELECT round(sum(o * o * n / (rs * cz)::DOUBLE) - (SELECT count(*) FROM d), 6) AS statistic FROM f")
def test_conditional_chi_square(x: Tables) -> DataFrame:
    return rounded(s.as_frame(x.orders, ind.stratified(discrete(x), "s", "z", ["p"]))).select("statistic")
