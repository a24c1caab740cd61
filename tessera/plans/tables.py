"""Queries over the star schema for the table, window, string and date operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import dates, mathematics as m, strings
from tessera.operators import table as t
from tessera.operators import windows as w
from tessera.plans.registry import Tables, query

C = F.col
PER_CUSTOMER = w.Series(("o_custkey",), ("o_orderdate", "o_orderkey"))
ROWS = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
LAST5 = f"OVER ({ROWS} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
SOFAR = f"OVER ({ROWS} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
LAST6 = f"OVER ({ROWS} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"
SEEN5 = f"row_number() OVER ({ROWS}) >= 5"


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, as sums differ in the last places from plan to plan."""
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else C(c) for c, k in df.dtypes])


# projection, filters, nulls


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
          round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def revenue_by_flag_status(x: Tables) -> DataFrame:
    rows = x.lineitem.filter(C("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(C("l_extendedprice") * (1 - C("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"),
    )


@query("SELECT c_name AS name, c_custkey, round(c_acctbal * 2, 4) AS twice FROM customer")
def select_rename_insert_drop(x: Tables) -> DataFrame:
    df = t.rename(t.select(x.customer, "c_custkey", "c_name", "c_acctbal"), {"c_name": "name", "missing": "x"})
    df = t.insert(df, 1, "twice", F.round(C("c_acctbal") * 2, 4))
    return t.drop(df, "c_acctbal", "missing")


@query("SELECT event_id, try_cast(nullif(regexp_extract(props, '([0-9]+)', 1), '') AS DOUBLE) AS a, length(event_type) > 0 AS b, CAST(trunc(value) AS BIGINT) AS v FROM events")
def astype_casts(x: Tables) -> DataFrame:
    df = x.events.select("event_id", F.nullif(F.regexp_extract("props", "([0-9]+)", 1), F.lit("")).alias("a"), C("event_type").alias("b"), C("value").alias("v"))
    return t.astype(t.astype(t.astype(df, "a", "double"), "b", "bool"), "v", "int")


@query("SELECT CASE WHEN o_totalprice > 100000 THEN o_orderstatus ELSE 'x' END AS o_orderstatus, CASE WHEN o_totalprice > 100000 THEN o_orderpriority ELSE 'x' END AS o_orderpriority, CASE WHEN o_totalprice > 100000 THEN o_orderkey::VARCHAR ELSE 'x' END AS row, count(*) AS n FROM orders GROUP BY ALL")
def where_other(x: Tables) -> DataFrame:
    rows = x.orders.select("o_orderstatus", "o_orderpriority", C("o_orderkey").cast("string").alias("row"), C("o_totalprice").cast("string").alias("price"))
    masked = t.where(rows, C("price").cast("double") > 100000, "x")
    return masked.groupBy("o_orderstatus", "o_orderpriority", "row").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM part WHERE p_size BETWEEN 5 AND 12 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13')")
def isin_between(x: Tables) -> DataFrame:
    return x.part.filter(t.isin(C("p_brand"), ["Brand#11", "Brand#12", "Brand#13"]) & t.between(C("p_size"), 5, 12))


@query("SELECT c_custkey, least(greatest(c_acctbal, 0), 5000) AS clipped, abs(c_acctbal) AS magnitude, round(c_acctbal, 1) AS tenth, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' ELSE c_mktsegment END AS seg FROM customer")
def clip_abs_round_replace(x: Tables) -> DataFrame:
    df = t.replace(x.customer.select("c_custkey", "c_acctbal", C("c_mktsegment").alias("seg")), "BUILDING", "B")
    return df.select("c_custkey", t.clip(C("c_acctbal"), 0.0, 5000.0).alias("clipped"), F.abs("c_acctbal").alias("magnitude"), t.round_half_away(C("c_acctbal"), 1).alias("tenth"), "seg")


SPARSE = "(SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v FROM events)"


def sparse(x: Tables) -> DataFrame:
    return x.events.select("event_id", "user_id", F.when(C("event_id") % 3 != 0, C("value")).alias("v"))


@query(f"SELECT * FROM {SPARSE} WHERE event_id IS NOT NULL AND user_id IS NOT NULL AND v IS NOT NULL")
def dropna_any(x: Tables) -> DataFrame:
    return t.dropna(sparse(x))


@query(f"SELECT event_id, user_id, coalesce(v, -1) AS v, v IS NULL AS was FROM {SPARSE}")
def fillna_isna(x: Tables) -> DataFrame:
    return t.fillna(sparse(x).withColumn("was", C("v").isNull()), -1.0, ["v"])


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 1 AS duplicated FROM events")
def duplicated_rows(x: Tables) -> DataFrame:
    return t.duplicated(x.events.select("event_id", "user_id", "event_type"), "event_id").select("event_id", "duplicated")


@query("SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type")
def drop_duplicate_rows(x: Tables) -> DataFrame:
    return t.drop_duplicates(x.events.select("event_id", "user_id", "event_type"), "event_id")


# joins and sets

SIDES = "(SELECT n_nationkey AS k, n_name FROM nation WHERE n_nationkey < 18) a {how} JOIN (SELECT s_nationkey AS k, s_suppkey, s_acctbal FROM supplier WHERE s_nationkey > 5) b ON a.k IS NOT DISTINCT FROM b.k"


def _sides(x: Tables) -> tuple[DataFrame, DataFrame]:
    return (x.nation.filter("n_nationkey < 18").select(C("n_nationkey").alias("k"), "n_name"), x.supplier.filter("s_nationkey > 5").select(C("s_nationkey").alias("k"), "s_suppkey", "s_acctbal"))


@query(f"SELECT coalesce(a.k, b.k) AS k, n_name, s_suppkey, s_acctbal FROM {SIDES.format(how='INNER')}")
def merge_inner(x: Tables) -> DataFrame:
    return t.merge(*_sides(x), ["k"], "inner")


@query(f"SELECT coalesce(a.k, b.k) AS k, n_name, s_suppkey, s_acctbal FROM {SIDES.format(how='LEFT')}")
def merge_left(x: Tables) -> DataFrame:
    return t.merge(*_sides(x), ["k"], "left")


@query(f"SELECT coalesce(a.k, b.k) AS k, n_name, s_suppkey, s_acctbal FROM {SIDES.format(how='RIGHT')}")
def merge_right(x: Tables) -> DataFrame:
    return t.merge(*_sides(x), ["k"], "right")


@query(f"SELECT coalesce(a.k, b.k) AS k, n_name, s_suppkey, s_acctbal FROM {SIDES.format(how='FULL')}")
def merge_outer(x: Tables) -> DataFrame:
    return t.merge(*_sides(x), ["k"], "outer")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join(x: Tables) -> DataFrame:
    big = x.orders.filter("o_totalprice > 300000").select(C("o_custkey").alias("c_custkey"))
    return t.merge(x.customer.select("c_custkey"), big, ["c_custkey"], "semi")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join(x: Tables) -> DataFrame:
    return t.merge(x.customer.select("c_custkey"), x.orders.select(C("o_custkey").alias("c_custkey")), ["c_custkey"], "anti")


@query("SELECT r_regionkey AS k, r_name AS name, n_name AS name_1 FROM region JOIN nation ON r_regionkey = n_nationkey")
def concat_side_by_side(x: Tables) -> DataFrame:
    return t.concat_horizontal([x.region.select(C("r_regionkey").alias("k"), C("r_name").alias("name")), x.nation.select(C("n_nationkey").alias("k"), C("n_name").alias("name"))], "k")


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def concat_rows(x: Tables) -> DataFrame:
    return t.concat([x.customer.select(C("c_nationkey").alias("k")), x.supplier.select(C("s_nationkey").alias("k"))])


@query("SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1")
def value_count(x: Tables) -> DataFrame:
    return t.value_counts(x.orders, "o_orderpriority")


@query(f"SELECT count(DISTINCT event_id) AS event_id, count(DISTINCT user_id) AS user_id, count(DISTINCT v) + 1 AS v FROM {SPARSE}")
def nunique_with_null(x: Tables) -> DataFrame:
    return t.nunique(sparse(x))


@query("SELECT event_type, min(event_id) AS first FROM events GROUP BY 1")
def unique_by_appearance(x: Tables) -> DataFrame:
    return t.unique(x.events, "event_type", "event_id").select("event_type", C("first.event_id").alias("first"))


@query("SELECT n_nationkey AS k FROM nation INTERSECT SELECT s_nationkey FROM supplier")
def intersect1d(x: Tables) -> DataFrame:
    return x.nation.select(C("n_nationkey").alias("k")).intersect(x.supplier.select("s_nationkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def setdiff1d(x: Tables) -> DataFrame:
    return x.customer.select(C("c_custkey").alias("k")).subtract(x.orders.select("o_custkey"))


@query("(SELECT p_size AS k FROM part UNION SELECT s_nationkey FROM supplier) EXCEPT (SELECT p_size FROM part INTERSECT SELECT s_nationkey FROM supplier)")
def setxor1d(x: Tables) -> DataFrame:
    a, b = x.part.select(C("p_size").alias("k")), x.supplier.select(C("s_nationkey").alias("k"))
    return a.union(b).distinct().subtract(a.intersect(b))


# aggregates


@query(f"SELECT count(v) AS count, round(sum(v), 2) AS sum, round(avg(v), 4) AS mean, min(v) AS min, max(v) AS max, round(median(v), 4) AS median, round(stddev_samp(v), 4) AS std, round(var_samp(v), 2) AS var FROM {SPARSE}")
def totals_of_column(x: Tables) -> DataFrame:
    out = t.totals(sparse(x), "v")
    return out.select("count", *[F.round(c, 2 if c in ("sum", "var") else 4).alias(c) for c in out.columns[1:]])


@query("""SELECT stat, round(v, 4) AS o_totalprice FROM (SELECT unnest(['count', 'mean', 'std', 'min', '25%', '50%', '75%', 'max']) AS stat,
          unnest([count(o_totalprice)::DOUBLE, avg(o_totalprice), stddev_samp(o_totalprice), min(o_totalprice), quantile_cont(o_totalprice, 0.25), median(o_totalprice), quantile_cont(o_totalprice, 0.75), max(o_totalprice)]) AS v FROM orders)""")
def describe_column(x: Tables) -> DataFrame:
    return rounded(t.describe(x.orders, "o_totalprice"))


@query("""SELECT 'l_quantity' AS "column", 1.0 AS l_quantity, round(corr(l_quantity, l_extendedprice), 6) AS l_extendedprice FROM lineitem
          UNION ALL SELECT 'l_extendedprice', round(corr(l_quantity, l_extendedprice), 6), 1.0 FROM lineitem""")
def correlation_matrix(x: Tables) -> DataFrame:
    return rounded(t.corr_matrix(x.lineitem, "l_quantity", "l_extendedprice"), 6)


@query("""SELECT 'l_quantity' AS "column", round(var_samp(l_quantity), 4) AS l_quantity, round(covar_samp(l_quantity, l_discount), 4) AS l_discount FROM lineitem
          UNION ALL SELECT 'l_discount', round(covar_samp(l_quantity, l_discount), 4), round(var_samp(l_discount), 4) FROM lineitem""")
def covariance_matrix(x: Tables) -> DataFrame:
    return rounded(t.cov_matrix(x.lineitem, "l_quantity", "l_discount"))


@query(f"SELECT user_id, count(*) AS size, round(sum(coalesce(v, 0)), 3) AS v_sum, round(avg(coalesce(v, 0)), 4) AS v_mean, round(coalesce(stddev_samp(coalesce(v, 0)), 0), 4) AS v_std, min(coalesce(v, 0)) AS v_min, max(coalesce(v, 0)) AS v_max, round(median(coalesce(v, 0)), 4) AS v_median FROM {SPARSE} GROUP BY 1")
def group_nulls_as_zero(x: Tables) -> DataFrame:
    out = t.group_agg(sparse(x), ["user_id"], {"v": ["sum", "mean", "std", "min", "max", "median"]}, compat=True)
    return out.select(*[F.round(c, 3 if c == "v_sum" else 4).alias(c) if c.startswith("v_") and c not in ("v_min", "v_max") else C(c) for c in out.columns])


@query(f"SELECT user_id, count(*) AS size, round(sum(v), 3) AS v_sum, round(avg(v), 4) AS v_mean, round(var_samp(v), 2) AS v_var FROM {SPARSE} GROUP BY 1")
def group_sql_nulls(x: Tables) -> DataFrame:
    out = t.group_agg(sparse(x), ["user_id"], {"v": ["sum", "mean", "var"]})
    return out.select("user_id", "size", F.round("v_sum", 3).alias("v_sum"), F.round("v_mean", 4).alias("v_mean"), F.round("v_var", 2).alias("v_var"))


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def group_first_row(x: Tables) -> DataFrame:
    return t.group_first(x.events.select("user_id", "event_id", "value", "ts"), ["user_id"], "ts", "event_id").drop("ts")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def group_last_row(x: Tables) -> DataFrame:
    return t.group_last(x.events.select("user_id", "event_id", "value", "ts"), ["user_id"], "ts", "event_id").drop("ts")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 12)")
def group_having(x: Tables) -> DataFrame:
    return t.group_filter(x.orders.select("o_orderkey", "o_custkey"), ["o_custkey"], F.count(F.lit(1)) >= 12)


@query("SELECT event_type, count(*) AS n, max(value) - min(value) AS spread FROM events GROUP BY 1")
def group_apply_spread(x: Tables) -> DataFrame:
    def spread(pdf):
        return pdf.groupby("event_type", as_index=False).agg(n=("value", "size"), spread=("value", lambda v: v.max() - v.min()))

    return t.group_apply(x.events.select("event_type", "value"), ["event_type"], spread, "event_type string, n long, spread double")


@query("SELECT o_orderpriority, coalesce(round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2), 0) AS F, coalesce(round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2), 0) AS O, coalesce(round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2), 0) AS P FROM orders GROUP BY 1")
def pivot_sum(x: Tables) -> DataFrame:
    return rounded(t.pivot_table(x.orders, "o_orderpriority", "o_orderstatus", "o_totalprice", "sum", ["F", "O", "P"]), 2)


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY 1")
def crosstab_counts(x: Tables) -> DataFrame:
    return t.crosstab(x.lineitem, "l_returnflag", "l_linestatus", ["F", "O"])


@query("SELECT p_partkey, 'p_size' AS variable, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def melt_columns(x: Tables) -> DataFrame:
    return t.melt(x.part.select("p_partkey", C("p_size").cast("double"), "p_retailprice"), ["p_partkey"], ["p_size", "p_retailprice"])


# order


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_orders(x: Tables) -> DataFrame:
    return t.nlargest(x.orders.select("o_orderkey", "o_totalprice"), 25, "o_totalprice", "o_orderkey")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 25")
def cheapest_parts(x: Tables) -> DataFrame:
    return t.nsmallest(x.part.select("p_partkey", "p_retailprice"), 25, "p_retailprice", "p_partkey")


@query("(SELECT event_id, 'head' AS side FROM events ORDER BY event_id LIMIT 7) UNION ALL (SELECT event_id, 'tail' FROM events ORDER BY event_id DESC LIMIT 7)")
def head_and_tail(x: Tables) -> DataFrame:
    e = x.events.select("event_id")
    return t.head(e, 7, "event_id").withColumn("side", F.lit("head")).union(t.tail(e, 7, "event_id").withColumn("side", F.lit("tail")))


@query()
def sample_exact(x: Tables) -> DataFrame:
    return t.sample(x.orders, 100, 7, "o_orderkey")


@query("SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_name, n_nationkey) AS place FROM nation")
def sorted_places(x: Tables) -> DataFrame:
    return t.with_position(x.nation, "n_name", "n_nationkey").select("n_nationkey", "n_name", (C(t.POSITION) + 1).alias("place"))


@query("SELECT i AS _pos, p AS n_name FROM (SELECT n_name AS p, row_number() OVER (ORDER BY n_nationkey) - 1 AS r FROM nation) JOIN (SELECT * FROM (VALUES (3, 0), (3, 1), (0, 2), (24, 3)) v(r, i)) USING (r)")
def iloc_rows(x: Tables) -> DataFrame:
    return t.iloc(x.nation, [3, 3, 0, 24], [1], "n_nationkey")


# windows


def _orders(x: Tables) -> DataFrame:
    return x.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")


def _with(x: Tables, **columns) -> DataFrame:
    return rounded(_orders(x).select("o_orderkey", *[v.alias(k) for k, v in columns.items()]))


def P():
    return C("o_totalprice")


@query(f"""SELECT o_orderkey, CASE WHEN {SEEN5} THEN round(avg(o_totalprice) {LAST5}, 4) END AS mean, CASE WHEN {SEEN5} THEN round(sum(o_totalprice) {LAST5}, 4) END AS sum,
           CASE WHEN {SEEN5} THEN round(stddev_samp(o_totalprice) {LAST5}, 4) END AS std, CASE WHEN {SEEN5} THEN min(o_totalprice) {LAST5} END AS min,
           CASE WHEN {SEEN5} THEN max(o_totalprice) {LAST5} END AS max, CASE WHEN {SEEN5} THEN count(o_totalprice) {LAST5} END AS count FROM orders""")
def rolling_basic(x: Tables) -> DataFrame:
    out = _with(x, **{h: w.rolling(PER_CUSTOMER, P(), 5, h) for h in ("mean", "sum", "std", "min", "max", "count")})
    return out.withColumn("count", C("count").cast("long"))


@query(f"""SELECT o_orderkey, round(avg(o_totalprice) {SOFAR}, 4) AS mean, round(coalesce(stddev_samp(o_totalprice) {SOFAR}, 0), 4) AS std,
           min(o_totalprice) {SOFAR} AS min, max(o_totalprice) {SOFAR} AS max, round(sum(o_totalprice) {SOFAR}, 4) AS cumsum FROM orders""")
def expanding_basic(x: Tables) -> DataFrame:
    return _with(x, **{h: w.expanding(PER_CUSTOMER, P(), h) for h in ("mean", "std", "min", "max")}, cumsum=w.cumulative(PER_CUSTOMER, P(), "sum"))


@query(f"SELECT o_orderkey, CASE WHEN {SEEN5} THEN round(quantile_cont(o_totalprice, 0.3) {LAST5}, 4) END AS q FROM orders")
def rolling_quantiles(x: Tables) -> DataFrame:
    return _with(x, q=w.rolling_quantile(PER_CUSTOMER, P(), 5, 0.3))


@query(f"SELECT o_orderkey, CASE WHEN {SEEN5} THEN round(coalesce((o_totalprice - avg(o_totalprice) {LAST5}) / nullif(stddev_samp(o_totalprice) {LAST5}, 0), 0), 4) END AS z FROM orders")
def rolling_zscores(x: Tables) -> DataFrame:
    return _with(x, z=w.rolling_zscore(PER_CUSTOMER, P(), 5))


@query(f"SELECT o_orderkey, CASE WHEN {SEEN5} THEN round(skewness(o_totalprice) {LAST5}, 4) END AS skew, CASE WHEN {SEEN5} THEN round(kurtosis(o_totalprice) {LAST5}, 4) END AS kurt FROM orders")
def rolling_shape(x: Tables) -> DataFrame:
    return _with(x, skew=w.rolling_skew(PER_CUSTOMER, P(), 5), kurt=w.rolling_kurtosis(PER_CUSTOMER, P(), 5))


DAY = "epoch(o_orderdate) / 86400.0"


def BENCH():
    return F.unix_timestamp("o_orderdate") / 86400.0


@query(f"""SELECT o_orderkey, CASE WHEN {SEEN5} THEN round(covar_samp(o_totalprice, {DAY}) {LAST5} / 1e6, 4) END AS cov,
           CASE WHEN {SEEN5} THEN round(regr_slope(o_totalprice, {DAY}) {LAST5}, 4) END AS beta,
           CASE WHEN {SEEN5} THEN round(corr(o_totalprice, {DAY}) {LAST5}, 4) END AS corr,
           CASE WHEN {SEEN5} THEN round(power(corr(o_totalprice, {DAY}) {LAST5}, 2), 4) END AS r2 FROM orders""")
def rolling_regression(x: Tables) -> DataFrame:
    out = _orders(x).select("o_orderkey", F.round(w.rolling_cov(PER_CUSTOMER, P(), BENCH(), 5) / 1e6, 4).alias("cov"), F.round(w.rolling_beta(PER_CUSTOMER, P(), BENCH(), 5), 4).alias("beta"), F.round(w.rolling_corr(PER_CUSTOMER, P(), BENCH(), 5), 4).alias("corr"), F.round(w.rolling_r2(PER_CUSTOMER, P(), BENCH(), 5), 4).alias("r2"))
    return out


@query(f"SELECT o_orderkey, max(o_totalprice) {SOFAR} AS cummax, min(o_totalprice) {SOFAR} AS cummin, round(exp(sum(ln(1 + o_totalprice / 1e7)) {SOFAR}), 6) AS cumprod FROM orders")
def cumulative_extremes(x: Tables) -> DataFrame:
    return _orders(x).select("o_orderkey", w.cumulative(PER_CUSTOMER, P(), "max").alias("cummax"), w.cumulative(PER_CUSTOMER, P(), "min").alias("cummin"), F.round(w.cumulative(PER_CUSTOMER, 1 + P() / 1e7, "prod"), 6).alias("cumprod"))


@query(f"SELECT o_orderkey, lag(o_totalprice, 2) OVER ({ROWS}) AS back, lead(o_totalprice) OVER ({ROWS}) AS ahead, round(o_totalprice - lag(o_totalprice) OVER ({ROWS}), 4) AS diff, round((o_totalprice - lag(o_totalprice) OVER ({ROWS})) / lag(o_totalprice) OVER ({ROWS}), 6) AS pct FROM orders")
def shift_diff_pct(x: Tables) -> DataFrame:
    s = PER_CUSTOMER
    return _orders(x).select("o_orderkey", w.shift(s, P(), 2).alias("back"), w.shift(s, P(), -1).alias("ahead"), F.round(w.diff(s, P()), 4).alias("diff"), F.round(w.pct_change(s, P()), 6).alias("pct"))


@query("SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS rank FROM part")
def average_rank(x: Tables) -> DataFrame:
    return x.part.select("p_partkey", w.rank_average(C("p_size"), ["p_brand"]).alias("rank"))


RETURN = f"(SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice / lag(o_totalprice) OVER ({ROWS}) - 1 AS r FROM orders QUALIFY r IS NOT NULL)"


def _returns(x: Tables) -> DataFrame:
    return _orders(x).withColumn("r", w.pct_change(PER_CUSTOMER, P())).filter(C("r").isNotNull())


@query(f"SELECT o_orderkey, CASE WHEN {SEEN5} THEN round(avg(r) {LAST5} / nullif(stddev_samp(r) {LAST5}, 0), 4) END AS sharpe, CASE WHEN {SEEN5} THEN round(-quantile_cont(r, 0.05) {LAST5}, 4) END AS var95 FROM {RETURN}")
def rolling_risk(x: Tables) -> DataFrame:
    return rounded(_returns(x).select("o_orderkey", w.rolling_sharpe(PER_CUSTOMER, C("r"), 5).alias("sharpe"), w.rolling_var(PER_CUSTOMER, C("r"), 5, 0.95).alias("var95")))


@query(f"""WITH r AS {RETURN}, f AS (SELECT o_orderkey, list(r) {LAST5} AS l, avg(r) {LAST5} AS m, quantile_cont(r, 0.2) {LAST5} AS q FROM r) SELECT o_orderkey, CASE WHEN len(l) = 5 THEN round(-list_avg(list_filter(l, lambda v: v <= q)), 4) END AS cvar FROM f""")
def rolling_shortfall(x: Tables) -> DataFrame:
    return rounded(_returns(x).select("o_orderkey", w.rolling_cvar(PER_CUSTOMER, C("r"), 5, 0.8).alias("cvar")))


@query(f"""WITH p AS (SELECT o_orderkey, list(o_totalprice) {LAST5} AS l FROM orders)
SELECT o_orderkey, CASE WHEN len(l) = 5 THEN round(list_max(list_transform(range(1, 6), lambda k: (list_max(l[1:k]) - l[k]) / list_max(l[1:k]))), 6) END AS drawdown FROM p""")
def rolling_drawdown(x: Tables) -> DataFrame:
    return rounded(_orders(x).select("o_orderkey", w.rolling_max_drawdown(PER_CUSTOMER, P(), 5).alias("drawdown")), 6)


@query()
def rolling_downside(x: Tables) -> DataFrame:
    s, r = PER_CUSTOMER, C("r")
    return rounded(_returns(x).select("o_orderkey", w.rolling_sortino(s, r, 5).alias("sortino"), w.rolling_cvar(s, r, 5, 0.8).alias("cvar"), w.rolling_max_drawdown(s, P(), 5).alias("drawdown")))


@query(f"""WITH RECURSIVE o AS (SELECT o_orderkey, o_custkey, o_totalprice AS x, row_number() OVER ({ROWS}) AS k FROM orders), e AS (
SELECT o_orderkey, o_custkey, k, x AS m, 0.0::DOUBLE AS v FROM o WHERE k = 1 UNION ALL
SELECT o.o_orderkey, o.o_custkey, o.k, e.m + (x - e.m) * 2 / 11.0, (e.v + pow(x - e.m, 2) * 2 / 11.0) * 9 / 11.0 FROM e JOIN o ON o.o_custkey = e.o_custkey AND o.k = e.k + 1)
SELECT o_orderkey, round(m, 4) AS ewm_mean, round(v / 1000000, 3) AS ewm_var, round(sqrt(v), 4) AS ewm_std FROM e""")
def ewm_stats(x: Tables) -> DataFrame:
    return rounded(w.ewm(_orders(x), PER_CUSTOMER, "o_totalprice", 10).select("o_orderkey", "ewm_mean", F.round(C("ewm_var") / 1000000, 3).alias("ewm_var"), "ewm_std"))


@query(f"""WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice AS y, (o_orderkey % 17)::DOUBLE AS a, ((o_orderkey * 7) % 23)::DOUBLE AS b FROM orders),
c AS (SELECT o_orderkey, count(*) {LAST6} AS k, var_pop(a) {LAST6} AS aa, covar_pop(a, b) {LAST6} AS ab, var_pop(b) {LAST6} AS bb, covar_pop(a, y) {LAST6} AS ay, covar_pop(b, y) {LAST6} AS yb FROM o)
SELECT o_orderkey, CASE WHEN k = 6 THEN CASE WHEN aa * bb - ab * ab > 1e-6 THEN round((bb * ay - ab * yb) / (aa * bb - ab * ab) / 1000, 2) + 0 ELSE 0 END END AS first, CASE WHEN k = 6 THEN CASE WHEN aa * bb - ab * ab > 1e-6 THEN round((aa * yb - ab * ay) / (aa * bb - ab * ab) / 1000, 2) + 0 ELSE 0 END END AS second FROM c""")
def rolling_factor_betas(x: Tables) -> DataFrame:
    df = _orders(x).withColumns({"a": (C("o_orderkey") % 17).cast("double"), "b": (C("o_orderkey") * 7 % 23).cast("double")})
    betas = C("betas")
    return w.rolling_multi_beta(df, PER_CUSTOMER, "o_totalprice", ["a", "b"], 6).select("o_orderkey", *[(F.round(betas[k] / 1000, 2) + 0).alias(name) for k, name in enumerate(("first", "second"))])


@query(f"""WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice / 1000 AS y, (o_orderkey % 17)::DOUBLE AS a FROM orders), c AS (SELECT o_orderkey, count(*) {LAST6} AS k, var_samp(a) {LAST6} AS aa, covar_samp(a, y) {LAST6} AS ay, var_samp(y) {LAST6} AS yy FROM o),
e AS (SELECT *, (aa + yy) / 2 + sqrt(pow(aa - yy, 2) / 4 + ay * ay) AS w FROM c)
SELECT o_orderkey, CASE WHEN k = 6 THEN round(w, 3) END AS largest, CASE WHEN k = 6 THEN round(w / (aa + yy), 4) END AS share FROM e""")
def rolling_components(x: Tables) -> DataFrame:
    df = _orders(x).withColumns({"y": C("o_totalprice") / 1000, "a": (C("o_orderkey") % 17).cast("double")})
    return w.rolling_pca(df, PER_CUSTOMER, ["y", "a"], 6, 2).select("o_orderkey", F.round(C("eigenvalues")[0], 3).alias("largest"), F.round(C("explained")[0], 4).alias("share"))


# strings and dates


@query("""SELECT doc_id, md5(lower(text)) AS lo, upper(source) AS up, contains(text, 'the') AS has, starts_with(text, 'The') AS begins,
          ends_with(text, '.') AS stops, md5(replace(text, 'th', 'TH')) AS rep, octet_length(encode(text))::INT AS bytes,
          len(string_split(text, '. '))::INT AS sentences FROM documents""")
def string_functions(x: Tables) -> DataFrame:
    c = C("text")
    return x.documents.select(
        "doc_id", F.md5(strings.lower(c)).alias("lo"), strings.upper(C("source")).alias("up"), strings.contains(c, "the").alias("has"),
        strings.startswith(c, "The").alias("begins"), strings.endswith(c, ".").alias("stops"), F.md5(strings.replace(c, "th", "TH")).alias("rep"),
        strings.byte_length(c).alias("bytes"), F.size(strings.split(c, ". ")).alias("sentences"),
    )


@query("""SELECT doc_id, md5(lower(text)) AS lo, length(lower(text))::INT AS lo_chars, md5(replace(text, 'th', 'TH')) AS rep, octet_length(encode(replace(text, 'th', 'THE')))::INT AS rep_bytes,
          len(string_split(text, '. '))::INT AS sentences FROM documents""")
def string_functions_whole(x: Tables) -> DataFrame:
    """lower, replace and split over whole texts, long results as digests and lengths."""
    c = C("text")
    return x.documents.select(
        "doc_id", F.md5(strings.lower(c)).alias("lo"), F.length(strings.lower(c)).alias("lo_chars"), F.md5(strings.replace(c, "th", "TH")).alias("rep"),
        strings.byte_length(strings.replace(c, "th", "THE")).alias("rep_bytes"), F.size(strings.split(c, ". ")).alias("sentences"),
    )


@query("SELECT c_custkey, substr(c_name, 1, 4) AS front, substr(c_name, -4) AS back, trim(concat(' ', c_mktsegment, '  ')) AS seg FROM customer")
def string_slices(x: Tables) -> DataFrame:
    return x.customer.select("c_custkey", strings.byte_slice(C("c_name"), 0, 4).alias("front"), strings.byte_slice(C("c_name"), -4, 0).alias("back"), strings.strip(F.concat(F.lit(" "), "c_mktsegment", F.lit("  "))).alias("seg"))


@query("""SELECT event_id, year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day, hour(ts)::INT AS hour, minute(ts)::INT AS minute, second(ts)::INT AS second,
          dayofyear(ts)::INT AS dayofyear, quarter(ts)::INT AS quarter, dayofweek(ts)::INT AS weekday FROM events""")
def date_fields(x: Tables) -> DataFrame:
    return dates.calendar_frame(x.events.select("event_id", "ts"), "ts").drop("ts")


@query("SELECT DISTINCT date_trunc('week', ts)::TIMESTAMP AS ts FROM events")
def resample_weeks(x: Tables) -> DataFrame:
    return dates.resample(x.events, "ts", "W")


@query("SELECT o_orderkey, (o_orderdate + INTERVAL 2 WEEK)::TIMESTAMP AS later, (o_orderdate + INTERVAL 1 MONTH)::TIMESTAMP AS month FROM orders")
def shift_dates(x: Tables) -> DataFrame:
    return x.orders.select("o_orderkey", dates.shift(C("o_orderdate"), 2, "W").alias("later"), dates.shift(C("o_orderdate"), 1, "M").alias("month"))


@query("SELECT event_id FROM events WHERE ts::TIME >= TIME '22:00:00' OR ts::TIME < TIME '03:00:01'")
def between_times(x: Tables) -> DataFrame:
    return x.events.filter(dates.between_time(C("ts"), "22:00:00", "03:00:00")).select("event_id")


@query("SELECT unnest(generate_series(TIMESTAMP '2024-01-30', TIMESTAMP '2024-03-05', INTERVAL 1 DAY)) AS t")
def date_range_days(x: Tables) -> DataFrame:
    return dates.date_range(x.spark, "2024-01-30 00:00:00", "2024-03-05 00:00:00", "D")


@query("SELECT c_custkey, (rank_dense - 1)::INT AS code FROM (SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) AS rank_dense FROM customer)")
def category_codes(x: Tables) -> DataFrame:
    from tessera.operators.category import codes

    return codes(x.customer, "c_mktsegment").select("c_custkey", C("code"))


# element-wise mathematics


@query("""SELECT event_id, round(sin(value), 6) AS sin, round(atan2(value, 2.0), 6) AS arctan2, round(exp(-value / 100), 6) AS exp, round(ln(value + 1), 6) AS log,
          round(cbrt(value), 6) AS cbrt, floor(value)::BIGINT AS floor, ceil(value)::BIGINT AS ceil, round(fmod(value, 7.0), 6) AS fmod, sign(value - 50)::DOUBLE AS sign FROM events""")
def elementwise(x: Tables) -> DataFrame:
    v = C("value")
    f = lambda name, c: F.round(m.UNARY[name](c), 6).alias(name)
    return x.events.select(
        "event_id", f("sin", v), F.round(m.BINARY["arctan2"](v, F.lit(2.0)), 6).alias("arctan2"), f("exp", -v / 100), f("log", v + 1), f("cbrt", v),
        m.UNARY["floor"](v).alias("floor"), m.UNARY["ceil"](v).alias("ceil"), F.round(m.BINARY["fmod"](v, F.lit(7.0)), 6).alias("fmod"), m.UNARY["sign"](v - 50).alias("sign"),
    )


@query("SELECT width, count(*) AS n FROM (SELECT least(floor((l_quantity - lo) / ((hi - lo) / 10.0)), 9)::INT AS width FROM lineitem, (SELECT min(l_quantity) lo, max(l_quantity) hi FROM lineitem)) GROUP BY 1")
def histogram_quantity(x: Tables) -> DataFrame:
    from tessera.operators.arrays import histogram

    return histogram(x.lineitem, "l_quantity", 10).select(C("bin").alias("width"), "n")
