"""Queries for arrays, matrices, distributions, tests, learning and models, with SQL over the same tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import calculus, finance, layers, learning, matrices, signals
from tessera.functions import distributions as d
from tessera.functions import mathematics as ma
from tessera.functions import special as sp
from tessera.models import networks
from tessera.models.learning import GaussianScore, counts
from tessera.operators import ndarray as nd
from tessera.operators import sparse, spatial
from tessera.operators import stats as s
from tessera.plans.analysis import rounded
from tessera.plans.registry import Tables, query

C = F.col


def _matrix(x: Tables) -> nd.NDArray:
    return nd.from_column(x.embeddings, "vec_id", "embedding")


def _named(x: Tables, values: dict[str, float], digits: int = 5) -> DataFrame:
    return x.spark.createDataFrame([(k, round(float(v), digits) + 0.0) for k, v in values.items()], "name string, value double")


M = "WITH m AS (SELECT vec_id AS i, generate_subscripts(embedding, 1) - 1 AS j, unnest(embedding)::DOUBLE AS v FROM embeddings), z AS (SELECT max(i) + 1 AS n, max(j) + 1 AS d FROM m)"
PLACES = {
    "flipud": "n - 1 - i, j", "fliplr": "i, d - 1 - j", "rot90": "d - 1 - j, i", "swapaxes": "j, i", "roll": "i, (j + 5) % d", "roll_flat": "((i * d + j + 7) % (n * d)) // d, ((i * d + j + 7) % (n * d)) % d",
    "ravel": "i * d + j, 0", "reshape": "(i * d + j) // n, (i * d + j) % n", "moveaxis": "j, i", "expand": "i, 0",
}


@query(M + " " + " UNION ALL ".join(f"SELECT '{k}' AS name, round(sum(v * (3 * p + 7 * q + 1)), 3) AS value FROM (SELECT {e.rsplit(', ', 1)[0]} AS p, {e.rsplit(', ', 1)[1]} AS q, v FROM m, z)" for k, e in PLACES.items()))
def array_rearranged(x: Tables) -> DataFrame:
    """Checksums over places of all cells after each rearrangement."""
    a = _matrix(x)
    done = {
        "flipud": nd.flipud(a), "fliplr": nd.fliplr(a), "rot90": nd.rot90(a), "swapaxes": nd.swapaxes(a, 0, 1), "roll": nd.roll(a, 5, 1), "roll_flat": nd.roll(a, 7),
        "ravel": nd.ravel(a), "reshape": a.reshape(a.shape[1], a.shape[0]), "moveaxis": nd.moveaxis(a, 0, 1), "expand": nd.expand_dims(a, 1),
    }
    rows = [y.cells.select(F.lit(k).alias("name"), (C("v") * (3 * C("i0") + 7 * (C("i1") if y.ndim > 1 else F.lit(0)) + 1)).alias("x")) for k, y in done.items()]
    return reduce(DataFrame.unionByName, rows).groupBy("name").agg(F.round(F.sum("x"), 3).alias("value"))


@query(M + """, p AS (
SELECT 'tril' AS name, i AS p, j AS q, v FROM m WHERE j <= i UNION ALL SELECT 'triu', i, j, v FROM m WHERE j - i >= 2 UNION ALL SELECT 'diagonal', i, 0, v FROM m WHERE j = i + 1
UNION ALL SELECT 'take', i, q, v FROM m JOIN (VALUES (3, 0), (0, 1), (3, 2)) t(k, q) ON j = k UNION ALL SELECT 'compress', i, j // 2, v FROM m WHERE j % 2 = 0
UNION ALL SELECT 'concatenate', i + o * n, j, v FROM m, z, (VALUES (0), (1)) t(o) UNION ALL SELECT 'tile', i, j + o * d, v FROM m, z, (VALUES (0), (1), (2)) t(o)
UNION ALL SELECT 'repeat', i, 2 * j + o, v FROM m, (VALUES (0), (1)) t(o) UNION ALL SELECT 'delete', i, j - 1, v FROM m WHERE j > 0 UNION ALL SELECT 'split', i, j - 4, v FROM m WHERE j >= 4 AND j < 9
UNION ALL SELECT 'insert', i, CASE WHEN j >= 2 THEN j + 1 ELSE j END, v FROM m UNION ALL SELECT 'insert', i, 2, 1.0 FROM m WHERE j = 0
UNION ALL SELECT 'stack', j, 2 * i + o, v FROM m, (VALUES (0), (1)) t(o) UNION ALL SELECT 'where', i, j, greatest(v, 0) FROM m UNION ALL SELECT 'argwhere', i, j, 1.0 FROM m WHERE v > 0
UNION ALL SELECT 'broadcast', i, j, v + w FROM m JOIN (SELECT j AS k, avg(v) AS w FROM m GROUP BY j) ON j = k
UNION ALL SELECT 'argsort', i, row_number() OVER (PARTITION BY i ORDER BY v, j) - 1, j FROM m UNION ALL SELECT 'sort', i, row_number() OVER (PARTITION BY i ORDER BY v, j) - 1, v FROM m
UNION ALL SELECT 'select', i, j, CASE WHEN v > 0.5 THEN 1 WHEN v > 0 THEN 2 ELSE -1 END FROM m)
SELECT name, round(sum(v * (3 * p + 7 * q + 1)), 3) AS value FROM p GROUP BY name""")
def array_pieces(x: Tables) -> DataFrame:
    """Checksums of what indexing, cutting, joining and sorting make of all cells."""
    a = _matrix(x)
    n, k = a.shape
    up = a.map(lambda v: (v > 0).cast("int"))
    one = nd.ones(x.spark, n, 1)
    means = nd.NDArray(a.cells.groupBy(C("i1").alias("i0")).agg(F.avg("v").alias("v")), (k,))
    stacked = nd.swapaxes(nd.stack([a, a], 2).reshape(n, 2 * k), 0, 1)
    pairs = nd.stack([a, a], 0)  # (o, i, j)
    done = {
        "tril": nd.tril(a), "triu": nd.triu(a, 2), "take": nd.take(a, [3, 0, 3], 1), "compress": nd.compress([j % 2 == 0 for j in range(k)], a, 1), "concatenate": nd.concatenate([a, a]),
        "tile": nd.tile(a, 1, 3), "repeat": nd.repeat(a, 2, 1), "delete": nd.delete(a, 0, 1), "split": nd.split(a, [4, 9], 1)[1], "insert": nd.insert(a, 2, one, 1),
        "stack": nd.transpose(pairs, (2, 1, 0)).reshape(k, 2 * n), "where": nd.where(up, a, nd.zeros(x.spark, n, k)), "broadcast": nd.binary(a, means, lambda p, q: p + q),
        "argsort": nd.argsort(a, 1), "sort": nd.sort(a, 1), "select": nd.select([a.map(lambda v: (v > 0.5).cast("int")), up], [nd.ones(x.spark, n, k), nd.full(x.spark, 2, n, k)], -1),
    }
    assert stacked.shape == (2 * k, n)
    rows = [y.cells.select(F.lit(name).alias("name"), (C("v") * (3 * C("i0") + 7 * C("i1") + 1)).alias("x")) for name, y in done.items()]
    rows.append(nd.diagonal(a, 1).cells.select(F.lit("diagonal").alias("name"), (C("v") * (3 * C("i0") + 1)).alias("x")))
    rows.append(nd.argwhere(up).select(F.lit("argwhere").alias("name"), (3 * C("i0") + 7 * C("i1") + 1).cast("double").alias("x")))
    return reduce(DataFrame.unionByName, rows).groupBy("name").agg(F.round(F.sum("x"), 3).alias("value"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)
SELECT vec_id, round(list_inner_product(x, x), 5) AS ddot, round(sqrt(list_inner_product(x, x)), 5) AS dnrm2, round(list_sum(list_transform(x, lambda v: abs(v))), 5) AS dasum,
       list_position(list_transform(x, lambda v: abs(v)), list_max(list_transform(x, lambda v: abs(v)))) - 1 AS idamax, round(3 * x[1] + x[1], 5) AS daxpy, round(2 * x[2], 5) AS dscal,
       round(x[2] * x[5] - x[3] * x[4], 5) AS cross_first FROM e""")
def vector_kernels(x: Tables) -> DataFrame:
    v = C("v")
    rows = x.embeddings.select("vec_id", C("embedding").cast("array<double>").alias("v"))
    three = lambda k: F.slice(v, k, 3)
    return rounded(rows.select("vec_id", nd.ddot(v, v).alias("ddot"), nd.dnrm2(v).alias("dnrm2"), nd.dasum(v).alias("dasum"), nd.idamax(v).cast("long").alias("idamax"), nd.daxpy(3, v, v)[0].alias("daxpy"), nd.dscal(2, v)[1].alias("dscal"), nd.cross(three(1), three(3))[0].alias("cross_first")), 5).withColumn(
        "cross_first", C("cross_first"))


@query("""WITH g AS (SELECT l_returnflag, var_samp(l_quantity) AS a, covar_samp(l_quantity, l_discount * 100) AS b, var_samp(l_discount * 100) AS c, avg(l_quantity) AS p, avg(l_discount * 100) AS q FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(a * c - b * b, 4) AS det, round(a + c, 4) AS trace, round(c / (a * c - b * b), 6) AS inverse_first, round((c * p - b * q) / (a * c - b * b), 6) AS solve_first, round(sqrt(a), 6) AS cholesky_first,
       round((a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b), 4) AS largest, round(a + c, 4) AS eigen_sum, round(a * a + 2 * b * b + c * c, 2) AS square_trace, round(sqrt(a * a + 2 * b * b + c * c), 4) AS frobenius FROM g""")
def small_matrices(x: Tables) -> DataFrame:
    """Functions of one covariance matrix a group, as columns."""
    q, k = C("l_quantity"), C("l_discount") * 100
    g = x.lineitem.groupBy("l_returnflag").agg(F.array(F.array(F.var_samp(q), F.covar_samp(q, k)), F.array(F.covar_samp(q, k), F.var_samp(k))).alias("m"), F.array(F.avg(q), F.avg(k)).alias("v"))
    m, number = C("m"), lambda f, name: matrices.column(f, C("m"), kind="double").alias(name)
    return rounded(g.select(
        "l_returnflag", F.round(matrices.column(matrices.det, m, kind="double"), 4).alias("det"), F.round(number(np.trace, "t"), 4).alias("trace"), matrices.column(matrices.inv, m)[0][0].alias("inverse_first"),
        matrices.column(matrices.solve, m, C("v"), kind="array<double>")[0].alias("solve_first"), matrices.column(matrices.cholesky, m)[0][0].alias("cholesky_first"),
        F.round(number(lambda a: matrices.eigh(a)[0][-1], "l"), 4).alias("largest"), F.round(number(lambda a: matrices.svd(a)[1].sum(), "e"), 4).alias("eigen_sum"),
        F.round(number(lambda a: np.trace(matrices.matrix_power(a, 2)), "s"), 2).alias("square_trace"), F.round(number(matrices.norm, "f"), 4).alias("frobenius"),
    ))


@query("""WITH c AS (SELECT var_pop(l_quantity) a, covar_pop(l_quantity, l_discount) b, var_pop(l_discount) c, covar_pop(l_quantity, l_extendedprice) p, covar_pop(l_discount, l_extendedprice) q, avg(l_quantity) mx, avg(l_discount) md, avg(l_extendedprice) my FROM lineitem),
s AS (SELECT *, (c * p - b * q) / (a * c - b * b) AS b1, (a * q - b * p) / (a * c - b * b) AS b2 FROM c)
SELECT 'intercept' AS name, round(my - b1 * mx - b2 * md, 2) AS value FROM s UNION ALL SELECT 'l_quantity', round(b1, 2) FROM s UNION ALL SELECT 'l_discount', round(b2, 2) FROM s""")
def least_squares_fit(x: Tables) -> DataFrame:
    fit = matrices.least_squares(x.lineitem, "l_extendedprice", "l_quantity", "l_discount")
    return _named(x, dict(zip(("intercept", "l_quantity", "l_discount"), fit["coefficients"], strict=True)), 2)


@query("""WITH c AS (SELECT var_samp(l_quantity) a, covar_samp(l_quantity, l_tax) b, var_samp(l_tax) c FROM lineitem)
SELECT 'first' AS name, round((a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b), 5) AS value FROM c UNION ALL SELECT 'second', round((a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b), 5) FROM c""")
def principal_variances(x: Tables) -> DataFrame:
    return _named(x, dict(zip(("first", "second"), matrices.principal_components(x.lineitem, 2, "l_quantity", "l_tax")[0], strict=True)))


@query("""WITH m AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS j, unnest(embedding)::DOUBLE AS v, len(embedding) AS d FROM embeddings)
SELECT vec_id, k, round(sum(v * cos(2 * pi() * j * k / d)), 4) + 0 AS re, round(-sum(v * sin(2 * pi() * j * k / d)), 4) + 0 AS im FROM m, (SELECT unnest(range(0, 5))::INT AS k) GROUP BY 1, 2""")
def fourier_coefficients(x: Tables) -> DataFrame:
    """The first five coefficients of every vector's transform."""
    v = C("embedding").cast("array<double>")
    both = F.arrays_zip(signals.column(signals.fft, v).alias("re"), signals.column(signals.fft, v, parts=np.imag).alias("im"))
    rows = x.embeddings.select("vec_id", F.posexplode(F.slice(both, 1, 5)).alias("k", "c"))
    return rows.select("vec_id", "k", (F.round("c.re", 4) + 0).alias("re"), (F.round("c.im", 4) + 0).alias("im"))


@query("""WITH o AS (SELECT o_custkey, epoch(o_orderdate) / 86400.0 AS t, max(o_totalprice) AS p FROM orders GROUP BY 1, 2),
w AS (SELECT o_custkey, (p + lag(p) OVER w) / 2 * (t - lag(t) OVER w) AS piece FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY t))
SELECT o_custkey, round(coalesce(sum(piece), 0) / 1000, 2) AS integral FROM w GROUP BY 1""")
def trapezoid_by_customer(x: Tables) -> DataFrame:
    o = x.orders.groupBy("o_custkey", (F.unix_timestamp("o_orderdate") / 86400.0).alias("t")).agg(F.max("o_totalprice").alias("p"))
    return signals.trapezoid(o, "t", "p", "o_custkey").select("o_custkey", F.round(C("integral") / 1000, 2).alias("integral"))


@query("""SELECT event_id, round(CASE WHEN value <= 10 THEN 0 WHEN value <= 40 THEN (value - 10) / 30 WHEN value <= 90 THEN 1 + (value - 40) * 3 / 50 ELSE 4 END, 6) AS linear,
       CASE WHEN value < 10 THEN 0.0 WHEN value < 40 THEN 0.0 WHEN value < 90 THEN 1.0 ELSE 4.0 END::DOUBLE AS previous FROM events""")
def interpolated_values(x: Tables) -> DataFrame:
    at, to = [10.0, 40.0, 90.0], [0.0, 1.0, 4.0]
    return x.events.select("event_id", F.round(calculus.interpolate(calculus.Interp1D(at, to), C("value")), 6).alias("linear"), calculus.interpolate(calculus.Interp1D(at, to, "previous"), C("value")).alias("previous"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings), p AS (
SELECT a.vec_id AS query, b.vec_id AS key, list_distance(a.x, b.x) AS distance FROM e a JOIN e b ON a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, key) AS rank FROM p)
SELECT query, rank::INT AS rank, key, round(distance, 6) AS distance FROM r WHERE rank <= 5""")
def exact_neighbours(x: Tables) -> DataFrame:
    """The 5 nearest of every 100th vector among all."""
    return rounded(spatial.nearest(x.embeddings, x.embeddings.filter("vec_id % 100 = 0"), "vec_id", "embedding", 5))


@query("""WITH e AS (SELECT label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings), u AS (SELECT label, unnest(x) AS v, generate_subscripts(x, 1) AS k FROM e),
c AS (SELECT label, k, avg(v) AS v FROM u GROUP BY 1, 2)
SELECT a.label::BIGINT AS a, b.label::BIGINT AS b, round(sqrt(sum((a.v - b.v) * (a.v - b.v))), 6) AS euclidean, round(sum(abs(a.v - b.v)), 6) AS cityblock, round(max(abs(a.v - b.v)), 6) AS chebyshev,
       round(1 - sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)), 6) AS cosine FROM c a JOIN c b ON a.k = b.k AND a.label < b.label GROUP BY 1, 2""")
def centroid_distances(x: Tables) -> DataFrame:
    """Distances between the labels' mean vectors by four metrics."""
    cells = x.embeddings.select(C("label").cast("long").alias("label"), F.posexplode("embedding").alias("k", "v")).groupBy("label", "k").agg(F.avg(C("v").cast("double")).alias("v"))
    mid = cells.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("c")).select("label", C("c.v").alias("x"))
    out = None
    for metric in ("euclidean", "cityblock", "chebyshev", "cosine"):
        got = spatial.pdist(mid, "label", "x", metric).withColumnRenamed("distance", metric)
        out = got if out is None else out.join(got, ["a", "b"])
    return rounded(out)


@query("""WITH a AS (SELECT l_partkey AS i0, l_suppkey AS i1, count(*)::DOUBLE AS v FROM lineitem GROUP BY 1, 2) SELECT i0, round(sum(v * s_acctbal), 2) AS v FROM a JOIN supplier ON s_suppkey = i1 GROUP BY 1""")
def sparse_product(x: Tables) -> DataFrame:
    """The part by supplier matrix of line counts times the suppliers' balances."""
    cells = x.lineitem.select(C("l_partkey").alias("i0"), C("l_suppkey").alias("i1"), F.lit(1.0).alias("v"))
    y = x.supplier.select(C("s_suppkey").alias("i0"), C("s_acctbal").alias("v"))
    return rounded(sparse.coo(cells, (1 << 40, 1 << 40)).matvec(y), 2)


CLOSED = {
    "lognormal_pdf": (d.Lognormal(3, 0.8), "pdf", "exp(-pow((ln(v) - 3) / 0.8, 2) / 2) / (v * 0.8 * sqrt(2 * pi()))"), "weibull_cdf": (d.Weibull(1.5, 40), "cdf", "1 - exp(-((v / 40) ** 1.5))"),
    "weibull_pdf": (d.Weibull(1.5, 40), "pdf", "1.5 / 40 * (v / 40) ** 0.5 * exp(-((v / 40) ** 1.5))"), "pareto_cdf": (d.Pareto(2.0, 5.0), "cdf", "CASE WHEN v >= 5 THEN 1 - (5 / v) ** 2 ELSE 0 END"),
    "cauchy_cdf": (d.Cauchy(30, 9), "cdf", "0.5 + atan((v - 30) / 9) / pi()"), "laplace_cdf": (d.Laplace(40, 12), "cdf", "CASE WHEN v < 40 THEN 0.5 * exp((v - 40) / 12) ELSE 1 - 0.5 * exp(-(v - 40) / 12) END"),
    "logistic_cdf": (d.Logistic(50, 10), "cdf", "1 / (1 + exp(-(v - 50) / 10))"), "gumbel_cdf": (d.Gumbel(40, 15), "cdf", "exp(-exp(-(v - 40) / 15))"), "rayleigh_cdf": (d.Rayleigh(35), "cdf", "1 - exp(-v * v / (2 * 35 * 35))"),
    "exponential_cdf": (d.Exponential(0.03), "cdf", "1 - exp(-0.03 * v)"), "uniform_cdf": (d.Uniform(10, 80), "cdf", "greatest(0, least(1, (v - 10) / 70))"), "normal_pdf": (d.Normal(50, 20), "pdf", "exp(-pow((v - 50) / 20, 2) / 2) / (20 * sqrt(2 * pi()))"),
    "gev_cdf": (d.GeneralizedExtremeValue(30, 20, 0.2), "cdf", "CASE WHEN 1 + 0.2 * (v - 30) / 20 > 0 THEN exp(-((1 + 0.2 * (v - 30) / 20) ** -5)) ELSE 0 END"), "power_law_cdf": (d.PowerLaw(2.5, 3.0), "cdf", "CASE WHEN v >= 3 THEN 1 - (3 / v) ** 1.5 ELSE 0 END"),
    "laplace_ppf": (d.Laplace(0, 1), "ppf", "CASE WHEN v / 1000 < 0.5 THEN ln(2 * v / 1000) ELSE -ln(2 - 2 * least(v / 1000, 0.99)) END"), "t_pdf": (d.StudentT(5), "pdf", "exp(lgamma(3) - lgamma(2.5)) / sqrt(5 * pi()) * (1 + v * v / 5) ** -3"),
    "gamma_pdf": (d.Gamma(2.5, 12), "pdf", "exp(1.5 * ln(v) - v / 12 - 2.5 * ln(12) - lgamma(2.5))"), "chi2_pdf": (d.ChiSquared(30), "pdf", "exp(14 * ln(v) - v / 2 - 15 * ln(2) - lgamma(15))"),
    "wald_pdf": (d.InverseGaussian(40, 90), "pdf", "sqrt(90 / (2 * pi() * v ** 3)) * exp(-90 * pow(v - 40, 2) / (2 * 40 * 40 * v))"), "levy_pdf": (d.Levy(0, 10), "pdf", "sqrt(10 / (2 * pi())) * exp(-10 / (2 * v)) / v ** 1.5"),
    "half_normal_pdf": (d.HalfNormal(30), "pdf", "2 * exp(-v * v / 1800) / (30 * sqrt(2 * pi()))"), "nakagami_pdf": (d.Nakagami(1.5, 2500), "pdf", "2 * (1.5 / 2500) ** 1.5 / gamma(1.5) * v ** 2 * exp(-1.5 * v * v / 2500)"),
}


@query("WITH e AS (SELECT CASE WHEN value > 0 THEN value ELSE 1.0 END AS v FROM events) " + " UNION ALL ".join(f"SELECT '{k}' AS name, round(avg({e}), 6) AS value FROM e" for k, (_, _, e) in CLOSED.items()))
def distribution_columns(x: Tables) -> DataFrame:
    """Means of densities, distribution and quantile functions over all events, by closed forms in SQL."""
    v = F.when(C("value") > 0, C("value")).otherwise(1.0)
    e = x.events.select(v.alias("v"))
    row = e.agg(*[F.round(F.avg(d.column(law, f, F.least(C("v") / 1000, F.lit(0.99)) if f == "ppf" else C("v"))), 6).alias(k) for k, (law, f, _) in CLOSED.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), C(k).alias("value")) for k in CLOSED])).alias("r")).select("r.*")


def _bessel(order: int, z: str) -> str:
    return f"list_sum(list_transform(range(0, 40), lambda k: pow({z} / 2, 2 * k + {order}) / (gamma(k + 1) * gamma(k + 1 + {order}))))"


PHI = "(exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()))"
INTEGRALS = {  # law, upper end, density in x, lower end
    "normal": (d.Normal(1, 2), 2.5, PHI.format(z="(x - 1) / 2") + " / 2", -20), "chi_squared": (d.ChiSquared(5), 4.0, "x ** 1.5 * exp(-x / 2) / (2 ** 2.5 * gamma(2.5))", 0),
    "student_t": (d.StudentT(5), 1.2, "exp(lgamma(3) - lgamma(2.5)) / sqrt(5 * pi()) * (1 + x * x / 5) ** -3", -400), "f": (d.FDist(6, 9), 1.5, "exp(lgamma(7.5) - lgamma(3) - lgamma(4.5)) * (6.0 / 9) ** 3 * x ** 2 * (1 + 6 * x / 9) ** -7.5", 0),
    "lognormal": (d.Lognormal(0.2, 0.7), 2.0, PHI.format(z="(ln(greatest(x, 1e-12)) - 0.2) / 0.7") + " / (0.7 * greatest(x, 1e-12))", 0), "half_normal": (d.HalfNormal(2), 1.5, "2 * " + PHI.format(z="x / 2") + " / 2", 0),
    "skew_normal": (d.SkewNormal(0, 1, 2), 0.7, None, -10), "beta": (d.Beta(2.5, 4), 0.4, "exp(lgamma(6.5) - lgamma(2.5) - lgamma(4)) * x ** 1.5 * (1 - x) ** 3", 0), "gamma": (d.Gamma(2.5, 3), 6.0, "x ** 1.5 * exp(-x / 3) / (3 ** 2.5 * gamma(2.5))", 0),
    "rice": (d.Rice(1.5, 1), 2.0, "x * exp(-(x * x + 2.25) / 2) * " + _bessel(0, "(1.5 * x)"), 0), "nakagami": (d.Nakagami(1.5, 2), 1.2, "2 * (1.5 / 2) ** 1.5 / gamma(1.5) * x ** 2 * exp(-1.5 * x * x / 2)", 0),
    "von_mises": (d.VonMises(0, 2), 0.8, "exp(2 * cos(x)) / (2 * pi() * " + _bessel(0, "2.0") + ")", -np.pi), "wald": (d.InverseGaussian(2, 3), 2.5, "CASE WHEN x > 1e-9 THEN sqrt(3 / (2 * pi() * x ** 3)) * exp(-3 * pow(x - 2, 2) / (8 * x)) ELSE 0 END", 0),
    "levy": (d.Levy(0, 1), 3.0, "CASE WHEN x > 1e-9 THEN sqrt(1 / (2 * pi())) * exp(-1 / (2 * x)) / x ** 1.5 ELSE 0 END", 0), "truncated_normal": (d.TruncatedNormal(0, 1, -1, 2), 0.5, None, -1), "gumbel": (d.Gumbel(1, 2), 2.0, "exp(-(x - 1) / 2 - exp(-(x - 1) / 2)) / 2", -20),
    "erf": (None, 0.9, "2 / sqrt(pi()) * exp(-x * x)", 0), "gammainc": (None, 2.0, "x ** 1.5 * exp(-x) / gamma(2.5)", 0), "betainc": (None, 0.3, "exp(lgamma(6) - lgamma(2) - lgamma(4)) * x * (1 - x) ** 3", 0),
}
_NORMAL = PHI.format(z="t")


def _integral(name: str) -> str:
    _, b, density, a = INTEGRALS[name]
    n = 40000 if name == "student_t" else 4000
    if name == "truncated_normal":
        part = lambda lo, hi: f"(SELECT sum((CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-x * x / 2)) * ({hi} - {lo}) / 12000.0 FROM (SELECT i, {lo} + ({hi} - {lo}) * i / 4000.0 AS x FROM range(0, 4001) r(i)))"
        return f"SELECT '{name}' AS name, round({part(-1.0, b)} / {part(-1.0, 2.0)}, 5) AS value"
    if name == "skew_normal":  # P(X <= b) with the inner normal integral on the same grid
        return f"SELECT '{name}' AS name, round(sum(2 * h * p * c), 4) AS value FROM (SELECT x, h, p, 0.5 * (1 + sign(x) * w) AS c FROM (SELECT x, {b + 10} / 2000.0 AS h, {PHI.format(z='x')} AS p, list_sum(list_transform(range(0, 400), lambda k: 2 / sqrt(pi()) * exp(-pow((k + 0.5) * abs(2 * x) / sqrt(2) / 400, 2)) * abs(2 * x) / sqrt(2) / 400)) AS w FROM (SELECT -10 + {b + 10} * (i + 0.5) / 2000.0 AS x FROM range(0, 2000) r(i))))"
    return f"SELECT '{name}' AS name, round(sum((CASE WHEN i IN (0, {n}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({density})) * ({b} - ({a})) / {3 * n}.0, 5) AS value FROM (SELECT i, {a} + ({b} - ({a})) * i / {n}.0 AS x FROM range(0, {n + 1}) r(i))"


@query(" UNION ALL ".join(_integral(k) for k in INTEGRALS))
def distribution_integrals(x: Tables) -> DataFrame:
    """Distribution functions at a point; SQL integrates the densities."""
    got = {k: law.cdf(b) for k, (law, b, _, _) in INTEGRALS.items() if law is not None}
    got |= {"erf": sp.erf(0.9), "gammainc": sp.gammainc(2.5, 2.0), "betainc": sp.betainc(2.0, 4.0, 0.3)}
    out = _named(x, got)
    return out.withColumn("value", F.when(C("name") == "skew_normal", F.round("value", 4)).otherwise(C("value")))


DISCRETE = {
    "poisson_cdf": (d.Poisson(3.5), "cdf", 4, "SELECT sum(exp(k * ln(3.5) - 3.5 - lgamma(k + 1))) FROM range(0, 5) r(k)"), "binomial_cdf": (d.Binomial(12, 0.3), "cdf", 4, "SELECT sum(exp(lgamma(13) - lgamma(k + 1) - lgamma(13 - k) + k * ln(0.3) + (12 - k) * ln(0.7))) FROM range(0, 5) r(k)"),
    "negative_binomial_cdf": (d.NegativeBinomial(3, 0.4), "cdf", 5, "SELECT sum(exp(lgamma(k + 3) - lgamma(k + 1) - lgamma(3) + 3 * ln(0.4) + k * ln(0.6))) FROM range(0, 6) r(k)"), "geometric_cdf": (d.Geometric(0.2), "cdf", 4, "SELECT 1 - 0.8 ** 4"),
    "hypergeometric_cdf": (d.Hypergeometric(50, 20, 10), "cdf", 4, "SELECT sum(exp(lgamma(21) - lgamma(k + 1) - lgamma(21 - k) + lgamma(31) - lgamma(11 - k) - lgamma(21 + k) - lgamma(51) + lgamma(11) + lgamma(41))) FROM range(0, 5) r(k)"),
    "bernoulli_pdf": (d.Bernoulli(0.3), "pdf", 1, "SELECT 0.3"), "zipf_cdf": (d.Zipf(1.5, 100), "cdf", 10, "SELECT sum(CASE WHEN k <= 10 THEN k ** -1.5 ELSE 0 END) / sum(k ** -1.5) FROM range(1, 101) r(k)"),
    "discrete_uniform_cdf": (d.DiscreteUniform(1, 6), "cdf", 4, "SELECT 4.0 / 6"), "boltzmann_cdf": (d.Boltzmann(0.5, 6), "cdf", 2, "SELECT sum(CASE WHEN k <= 2 THEN exp(-0.5 * k) ELSE 0 END) / sum(exp(-0.5 * k)) FROM range(0, 6) r(k)"),
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS name, round(({e}), 6)::DOUBLE AS value" for k, (*_, e) in DISCRETE.items()))
def discrete_distributions(x: Tables) -> DataFrame:
    return _named(x, {k: getattr(law, f)(at) for k, (law, f, at, _) in DISCRETE.items()}, 6)


@query(f"""SELECT 'gammaln' AS name, round(lgamma(7.3), 6) AS value UNION ALL SELECT 'gamma', round(gamma(3.7), 6) UNION ALL SELECT 'beta', round(exp(lgamma(2.5) + lgamma(1.5) - lgamma(4)), 6) UNION ALL SELECT 'betaln', round(lgamma(2.5) + lgamma(1.5) - lgamma(4), 6)
UNION ALL SELECT 'digamma', round((lgamma(3.001) - lgamma(2.999)) / 0.002, 4) UNION ALL SELECT 'zeta', round(sum(k ** -3.0), 6) FROM range(1, 20001) r(k) UNION ALL SELECT 'i0', round({_bessel(0, '1.7')}, 6) UNION ALL SELECT 'i1', round({_bessel(1, '1.7')}, 6)
UNION ALL SELECT 'comb', 120.0 UNION ALL SELECT 'factorial', gamma(9)""")
def special_values(x: Tables) -> DataFrame:
    got = {"gammaln": sp.gammaln(7.3), "gamma": sp.gamma(3.7), "beta": sp.beta(2.5, 1.5), "betaln": sp.betaln(2.5, 1.5), "zeta": sp.zeta(3.0), "i0": sp.i0(1.7), "i1": sp.i1(1.7), "comb": sp.comb(10, 3), "factorial": np.exp(sp.gammaln(9.0))}
    return _named(x, got, 6).unionByName(_named(x, {"digamma": sp.digamma(3.0)}, 4))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings), s AS (SELECT vec_id, x, list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))) AS l FROM e)
SELECT vec_id, round(l, 6) AS logsumexp, round(exp(x[1] - l), 6) AS softmax_first FROM s""")
def softmax_of_vectors(x: Tables) -> DataFrame:
    v = C("embedding").cast("array<double>")
    return rounded(x.embeddings.select("vec_id", ma.logsumexp(v).alias("logsumexp"), ma.softmax(v)[0].alias("softmax_first")))


@query("""SELECT event_id, isnan(value) AS isnan, isinf(value) AS isinf, round_even(value, 1) AS around, greatest(least(value, 60.0), 20.0) AS clip, abs(value - 50) <= 1e-8 + 0.1 * 50 AS close,
       (value > 30 AND value < 60) AS both, value >= 75 AS greater_equal, CASE WHEN value > 60 THEN 3.0 WHEN value > 30 THEN 2.0 ELSE 1.0 END::DOUBLE AS choice FROM events""")
def predicates_of_values(x: Tables) -> DataFrame:
    v = C("value")
    both = ma.BINARY["logical_and"]((v > 30).cast("int"), (v < 60).cast("int")) != 0
    return x.events.select("event_id", ma.UNARY["isnan"](v).alias("isnan"), ma.UNARY["isinf"](v).alias("isinf"), ma.around(v, 1).alias("around"), ma.clip(v, 20.0, 60.0).alias("clip"), ma.isclose(v, F.lit(50.0), rtol=0.1).alias("close"),
                           both.alias("both"), ma.BINARY["greater_equal"](v, F.lit(75.0)).alias("greater_equal"), ma.select([v > 60, v > 30], [F.lit(3.0), F.lit(2.0)], 1.0).alias("choice"))


RANKED = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query(f"""WITH o AS (SELECT o_totalprice AS v, o_orderstatus AS g FROM orders WHERE o_orderstatus IN ('F', 'O')), r AS (SELECT g, v, {RANKED.format(c='v')} AS k FROM o), n AS (SELECT count(*) AS n, count(*) FILTER (g = 'F') AS a FROM o),
mw AS (SELECT sum(k) FILTER (g = 'F') - max(a) * (max(a) + 1) / 2.0 AS u, max(a) AS a, max(n.n) - max(a) AS b FROM r, n),
f AS (SELECT v, sum(CASE WHEN g = 'F' THEN 1.0 ELSE 0 END) OVER (ORDER BY v) / (SELECT a FROM n) AS x, sum(CASE WHEN g = 'O' THEN 1.0 ELSE 0 END) OVER (ORDER BY v) / (SELECT n - a FROM n) AS y FROM o),
s AS (SELECT DISTINCT v, x, y FROM f), w AS (SELECT abs(x - y) * (lead(v) OVER (ORDER BY v) - v) AS area FROM s),
c AS (SELECT c_acctbal AS v FROM customer WHERE c_acctbal <> 0), wr AS (SELECT v, {RANKED.format(c='abs(v)')} AS k FROM c),
d AS (SELECT event_type AS g, abs(value - avg(value) OVER (PARTITION BY event_type)) AS z FROM events), dg AS (SELECT g, count(*) AS n, avg(z) AS m, var_pop(z) AS v FROM d GROUP BY g),
b AS (SELECT count(*) AS n, var_samp(value) AS v FROM events GROUP BY event_type), p AS (SELECT avg(value) AS m, count(*) AS n FROM events), q AS (SELECT avg((value - m) ** 2) m2, avg((value - m) ** 3) m3, avg((value - m) ** 4) m4, max(n) AS n FROM events, p)
SELECT 'mann_whitney' AS test, round(least(u, a * b - u), 4) AS statistic FROM mw UNION ALL SELECT 'ks_2samp', round(max(abs(x - y)), 6) FROM s UNION ALL SELECT 'wasserstein', round(sum(area), 4) FROM w
UNION ALL SELECT 'mood', round((sum((k - (n.n + 1) / 2.0) ** 2) - max(a) * (max(n.n) * max(n.n) - 1) / 12.0) / sqrt(max(a) * (max(n.n) - max(a)) * (max(n.n) + 1) * (max(n.n) * max(n.n) - 4.0) / 180.0), 4) FROM r, n WHERE g = 'F'
UNION ALL SELECT 'wilcoxon', round(sum(k) FILTER (v > 0), 4) FROM wr
UNION ALL SELECT 'levene', round((sum(n) - count(*)) / (count(*) - 1) * (sum(n * m * m) - sum(n * m) ** 2 / sum(n)) / sum(n * v), 6) FROM dg
UNION ALL SELECT 'bartlett', round(((sum(n) - count(*)) * ln(sum((n - 1) * v) / (sum(n) - count(*))) - sum((n - 1) * ln(v))) / (1 + (sum(1.0 / (n - 1)) - 1.0 / (sum(n) - count(*))) / (3 * (count(*) - 1))), 6) FROM b
UNION ALL SELECT 'jarque_bera', round(n / 6.0 * ((m3 / m2 ** 1.5) ** 2 + (m4 / m2 ** 2 - 3) ** 2 / 4), 4) FROM q UNION ALL SELECT 'one_sample', round((avg(value) - 50) / (stddev_samp(value) / sqrt(count(*))), 6) FROM events
UNION ALL SELECT 'paired', round(avg(l_quantity - 100 * l_discount) / (stddev_samp(l_quantity - 100 * l_discount) / sqrt(count(*))), 4) FROM lineitem UNION ALL SELECT 'point_biserial', round(corr(o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) FROM orders
UNION ALL SELECT 'friedman', round(12.0 / (count(*) * 3 * 4) * ((sum(a) - count(*) * 2) ** 2 + (sum(b) - count(*) * 2) ** 2 + (sum(c) - count(*) * 2) ** 2), 4) FROM (SELECT (l_tax < l_discount)::INT + (l_quantity / 500 < l_discount)::INT + ((l_tax = l_discount)::INT + (l_quantity / 500 = l_discount)::INT) / 2.0 + 1 AS a,
(l_discount < l_tax)::INT + (l_quantity / 500 < l_tax)::INT + ((l_tax = l_discount)::INT + (l_quantity / 500 = l_tax)::INT) / 2.0 + 1 AS b, (l_tax < l_quantity / 500)::INT + (l_discount < l_quantity / 500)::INT + ((l_quantity / 500 = l_tax)::INT + (l_quantity / 500 = l_discount)::INT) / 2.0 + 1 AS c FROM lineitem)""")
def rank_tests(x: Tables) -> DataFrame:
    o, e = x.orders.filter("o_orderstatus IN ('F', 'O')"), x.events
    pair = ("o_totalprice", "o_orderstatus", "F", "O")
    lines = x.lineitem.select("l_discount", "l_tax", (C("l_quantity") / 500).alias("q"), "l_quantity", (C("l_discount") * 100).alias("p"))
    got = {
        "mann_whitney": (s.mann_whitney(o, *pair), 4), "ks_2samp": (s.ks_2samp(o, *pair), 6), "wasserstein": ({"statistic": s.wasserstein(o, *pair).first().distance}, 4), "mood": (s.mood(o, *pair), 4), "wilcoxon": (s.wilcoxon(x.customer, "c_acctbal"), 4),
        "levene": (s.levene(e, "value", "event_type"), 6), "bartlett": (s.bartlett(e, "value", "event_type"), 6), "jarque_bera": (s.jarque_bera(e, "value"), 4), "one_sample": (s.ttest_1samp(e, "value", 50.0), 6),
        "paired": (s.ttest_rel(lines, "l_quantity", "p"), 4), "point_biserial": (s.point_biserial(x.orders.withColumn("f", C("o_orderstatus") == "F"), "o_totalprice", "f"), 6), "friedman": (s.friedman(lines, "l_discount", "l_tax", "q"), 4),
    }
    return x.spark.createDataFrame([(k, round(float(r["statistic"]), n)) for k, (r, n) in got.items()], "test string, statistic double")


@query("""WITH p AS (SELECT row_number() OVER (ORDER BY p_partkey) AS i, p_size::DOUBLE AS x, p_retailprice AS y FROM part), q AS (SELECT sign(a.x - b.x) AS s, sign(a.y - b.y) AS t FROM p a JOIN p b ON a.i < b.i)
SELECT round(sum(s * t) / sqrt(count(*) FILTER (s <> 0)::DOUBLE * count(*) FILTER (t <> 0)), 8) AS statistic FROM q""")
def test_kendall(x: Tables) -> DataFrame:
    return x.spark.createDataFrame([(round(s.kendall(x.part, "p_size", "p_retailprice")["statistic"], 8),)], "statistic double")


@query("""WITH b AS (SELECT event_id, least(greatest(value / 100, 1e-7), 1 - 1e-7) AS c, value / 100 AS p, (event_id % 3 = 0)::INT::DOUBLE AS y FROM events)
SELECT round(avg((p - y) ** 2), 6) AS mse, round(avg(abs(p - y)), 6) AS mae, round(avg(CASE WHEN abs(p - y) <= 1 THEN 0.5 * (p - y) ** 2 ELSE abs(p - y) - 0.5 END), 6) AS huber, round(avg(-(y * ln(c) + (1 - y) * ln(1 - c))), 6) AS binary_cross_entropy,
       round(avg(((p >= 0.5) = (y >= 0.5))::INT), 6) AS accuracy, round(count(*) FILTER (p >= 0.5 AND y >= 0.5) / count(*) FILTER (p >= 0.5), 6) AS precision, round(count(*) FILTER (p >= 0.5 AND y >= 0.5) / count(*) FILTER (y >= 0.5), 6) AS recall,
       round(2.0 * count(*) FILTER (p >= 0.5 AND y >= 0.5) / (count(*) FILTER (p >= 0.5) + count(*) FILTER (y >= 0.5)), 6) AS f1 FROM b""")
def losses_and_scores(x: Tables) -> DataFrame:
    b = x.events.select((C("value") / 100).alias("p"), (C("event_id") % 3 == 0).cast("double").alias("y"))
    scores = {**learning.losses(C("p"), C("y")), **learning.binary_metrics(C("p"), C("y"))}
    return rounded(b.agg(*[f.alias(k) for k, f in scores.items()]))


@query(f"""WITH b AS (SELECT value AS p, (event_id % 3 = 0) AS y FROM events), r AS (SELECT y, {RANKED.format(c='p')} AS k FROM b)
SELECT round((sum(k) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y)::DOUBLE * count(*) FILTER (NOT y)), 6) AS auc FROM r""")
def area_under_curve(x: Tables) -> DataFrame:
    return rounded(learning.auc(x.events.select(C("value").alias("p"), (C("event_id") % 3 == 0).cast("double").alias("y")), "p", "y"))


@query("""WITH e AS (SELECT event_id, value / 50 - 1 AS v FROM events)
SELECT event_id, greatest(v, 0) AS relu, round(1 / (1 + exp(-v)), 6) AS sigmoid, round(tanh(v), 6) AS tanh, round(CASE WHEN v > 0 THEN v ELSE 0.01 * v END, 6) AS leaky_relu, round(CASE WHEN v > 0 THEN v ELSE exp(v) - 1 END, 6) AS elu,
       round(0.5 * v * (1 + tanh(sqrt(2 / pi()) * (v + 0.044715 * v ** 3))), 6) AS gelu, round(v / (1 + exp(-v)), 6) AS swish FROM e""")
def activation_columns(x: Tables) -> DataFrame:
    e = x.events.select("event_id", (C("value") / 50 - 1).alias("v"))
    return e.select("event_id", *[(f(C("v")) if k == "relu" else F.round(f(C("v")), 6)).alias(k) for k, f in learning.ACTIVATIONS.items()])


@query("""SELECT event_id, round(0.1 * 0.9 ** (event_id / 100.0), 8) AS exponential, round(0.1 * 0.9 ** floor(event_id / 100.0), 8) AS staircase, round(0.1 * 0.5 * (1 + cos(pi() * least(event_id, 5000) / 5000.0)), 8) AS cosine,
       CASE WHEN event_id <= 100 THEN 0.1 WHEN event_id <= 1000 THEN 0.05 ELSE 0.01 END::DOUBLE AS piecewise, round(0.1 * least(1, (event_id + 1) / 500.0), 8) AS warmup FROM events""")
def learning_rates(x: Tables) -> DataFrame:
    k = C("event_id")
    rates = {"exponential": layers.exponential_decay(0.1, k, 100, 0.9), "staircase": layers.exponential_decay(0.1, k, 100, 0.9, True), "cosine": layers.cosine_decay(0.1, k, 5000), "piecewise": layers.piecewise_constant(k, [100, 1000], [0.1, 0.05, 0.01]), "warmup": layers.warmup(0.1, k, 500)}
    return rounded(x.events.select(k, *[v.alias(n) for n, v in rates.items()]), 8)


@query("""WITH t AS (SELECT DISTINCT event_type FROM events), c AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS k FROM t), e AS (SELECT user_id, ts, event_id, k FROM events JOIN c USING (event_type)),
n AS (SELECT k AS a, lead(k) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM e), s AS (SELECT a, b, count(*) AS n FROM n WHERE b IS NOT NULL GROUP BY 1, 2)
SELECT a::INT AS a, b::INT AS b, round(n / sum(n) OVER (PARTITION BY a), 6) AS p FROM s""")
def markov_transitions(x: Tables) -> DataFrame:
    """Transition shares between kinds of events of a user."""
    kinds = sorted(r[0] for r in x.events.select("event_type").distinct().collect())
    code = F.array_position(F.array(*[F.lit(k) for k in kinds]), C("event_type")).cast("int") - 1
    e = x.events.select("user_id", F.struct("ts", "event_id").alias("t"), code.alias("k"))
    p = networks.MarkovChain.fit(e, "user_id", "t", "k", len(kinds)).p
    return x.spark.createDataFrame([(int(i), int(j), round(float(p[i, j]), 6)) for i, j in zip(*np.nonzero(p), strict=True)], "a int, b int, p double")


@query("SELECT round(covar_samp(l_tax, l_extendedprice) / covar_samp(l_tax, l_quantity), 4) AS effect, round(regr_slope(l_extendedprice, l_quantity), 4) AS plain FROM lineitem")
def instrument_effect(x: Tables) -> DataFrame:
    got = networks.two_stage(x.lineitem, "l_extendedprice", "l_quantity", ["l_tax"])["effect"]
    return x.spark.createDataFrame([(round(got, 4), round(networks.adjusted(x.lineitem, "l_extendedprice", "l_quantity")["effect"], 4))], "effect double, plain double")


@query("""SELECT 'slope' AS name, round(regr_slope(l_extendedprice, l_quantity), 4) AS value FROM lineitem UNION ALL SELECT 'intercept', round(regr_intercept(l_extendedprice, l_quantity), 2) FROM lineitem
UNION ALL SELECT 'variance', round(regr_syy(l_extendedprice, l_quantity) / count(*) * (1 - corr(l_extendedprice, l_quantity) ** 2), 0) FROM lineitem
UNION ALL SELECT 'log_likelihood', round(-0.5 * count(*) * (ln(2 * pi() * var_pop(l_quantity)) + 1) / 1000, 4) FROM lineitem""")
def linear_gaussian_fit(x: Tables) -> DataFrame:
    data = x.lineitem.select("l_quantity", "l_extendedprice")
    c = networks.LinearGaussianNetwork.fit(data, {"l_quantity": [], "l_extendedprice": ["l_quantity"]}).cpds["l_extendedprice"]
    fit = GaussianScore(data, "loglik").local("l_quantity", [])
    return x.spark.createDataFrame([("slope", round(c.weights[0], 4)), ("intercept", round(c.intercept, 2)), ("variance", float(round(c.variance))), ("log_likelihood", round(fit / 1000, 4))], "name string, value double")


@query("""SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2 UNION ALL SELECT o_orderstatus, NULL, count(*) FROM orders GROUP BY 1 UNION ALL SELECT NULL, o_orderpriority, count(*) FROM orders GROUP BY 2""")
def families_in_one_pass(x: Tables) -> DataFrame:
    """Counts of three families of variables by one pass."""
    got = counts(x.orders, [("o_orderstatus", "o_orderpriority"), ("o_orderstatus",), ("o_orderpriority",)])
    rows = [(k[names.index("o_orderstatus")] if "o_orderstatus" in names else None, k[names.index("o_orderpriority")] if "o_orderpriority" in names else None, n) for names, cells in got.items() for k, n in cells.items()]
    return x.spark.createDataFrame(rows, "a string, b string, n long")


@query("""WITH e AS (SELECT user_id, value - lag(value) OVER w AS dx, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w AS dt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, round(sum(dx * dx), 4) AS quadratic_variation, round(sum(dx * dt), 2) AS covariation FROM e GROUP BY 1""")
def variations_by_user(x: Tables) -> DataFrame:
    e = x.events.select("user_id", F.struct("ts", "event_id").alias("t"), "value", (F.unix_micros(C("ts").cast("timestamp")) / 1e6).alias("at"))
    both = finance.quadratic_variation(e, "user_id", "t", "value").join(finance.covariation(e, "user_id", "t", "value", "at"), "user_id")
    return both.select("user_id", F.round("quadratic_variation", 4).alias("quadratic_variation"), F.round("covariation", 2).alias("covariation"))


def _cdf(z: str) -> str:
    return f"(0.5 + sign({z}) * list_sum(list_transform(range(0, 4000), lambda k: exp(-pow((k + 0.5) * abs({z}) / 4000, 2) / 2) * abs({z}) / 4000)) / sqrt(2 * pi()))"


@query(f"""WITH o AS (SELECT p_brand, p_retailprice AS s, 1000.0 AS k, p_size / 25.0 AS t FROM part), z AS (SELECT *, (ln(s / k) + (0.03 + 0.02) * t) / (0.2 * sqrt(t)) AS a FROM o), n AS (SELECT *, {_cdf('a')} AS na, {_cdf('(a - 0.2 * sqrt(t))')} AS nb FROM z)
SELECT p_brand, round(avg(s * na - k * exp(-0.03 * t) * nb), 2) AS call, round(avg(k * exp(-0.03 * t) * (1 - nb) - s * (1 - na)), 2) AS put FROM n GROUP BY 1""")
def option_prices(x: Tables) -> DataFrame:
    o = x.part.select("p_brand", C("p_retailprice").alias("s"), F.lit(1000.0).alias("k"), (C("p_size") / 25.0).alias("t"))
    given = (C("s"), C("k"), C("t"), F.lit(0.03), F.lit(0.2))
    return o.groupBy("p_brand").agg(F.round(F.avg(finance.black_scholes(*given)), 2).alias("call"), F.round(F.avg(finance.black_scholes(*given, call=False)), 2).alias("put"))


@query("""SELECT 'return' AS name, 0.6 * 0.1 + 0.4 * 0.2 AS value UNION ALL SELECT 'risk', round(sqrt(0.36 * 0.04 + 2 * 0.24 * 0.01 + 0.16 * 0.09), 6) UNION ALL SELECT 'sharpe', round((0.14 - 0.02) / sqrt(0.36 * 0.04 + 2 * 0.24 * 0.01 + 0.16 * 0.09), 6)
UNION ALL SELECT 'var', round(1.6448536269514722 * sqrt(0.36 * 0.04 + 2 * 0.24 * 0.01 + 0.16 * 0.09) - 0.14, 6) UNION ALL SELECT 'cvar', round(exp(-pow(1.6448536269514722, 2) / 2) / sqrt(2 * pi()) / 0.05 * sqrt(0.36 * 0.04 + 2 * 0.24 * 0.01 + 0.16 * 0.09) - 0.14, 6)
UNION ALL SELECT 'min_variance', round((0.09 - 0.01) / (0.04 + 0.09 - 0.02), 6) UNION ALL SELECT 'max_sharpe', round((0.09 * 0.08 - 0.01 * 0.18) / (0.09 * 0.08 - 0.01 * 0.18 + 0.04 * 0.18 - 0.01 * 0.08), 6) UNION ALL SELECT 'target', 0.5
UNION ALL SELECT 'frontier_risk', round(sqrt(0.25 * 0.04 + 0.5 * 0.01 + 0.25 * 0.09), 6)""")
def portfolios(x: Tables) -> DataFrame:
    mean, cov = [0.1, 0.2], [[0.04, 0.01], [0.01, 0.09]]
    got = finance.portfolio([0.6, 0.4], mean, cov, 0.02)
    got |= {"min_variance": finance.min_variance(cov)[0], "max_sharpe": finance.max_sharpe(mean, cov, 0.02)[0], "target": finance.target_return(mean, cov, 0.15)[0], "frontier_risk": finance.efficient_frontier(mean, cov, 3)[1][1]}
    return _named(x, got, 6)
