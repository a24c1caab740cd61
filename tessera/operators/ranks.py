"""Numbers of rows in an order over all rows, without gathering them in one task.

Rows are sorted by ranges; each range counts its rows, the running sums of these
counts (one number a range) go to the driver and back, and each range numbers its
own rows from there.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import cut


def _ranged(df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(parts, *keys).withColumn("_range", F.spark_partition_id()), "ranges")


def numbered(df: DataFrame, keys: Sequence[str | Column], name: str, first: int = 0) -> DataFrame:
    """``df`` with each row's number in the order of ``keys`` (columns that tell rows apart)."""
    rows = _ranged(df, keys)
    counts = {r[0]: r[1] for r in rows.groupBy("_range").count().collect()}
    ranges = sorted(counts)
    before = dict(zip(ranges, accumulate([first, *[counts[p] for p in ranges]]), strict=False))
    offsets = df.sparkSession.createDataFrame(list(before.items()) or [(0, first)], "_range int, _before long")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    out = rows.withColumn("_own", own - 1).join(F.broadcast(offsets), "_range")  # one row a range
    return out.withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_before", "_own")


def value_ranks(df: DataFrame, column: str) -> DataFrame:
    """(column, n, below): distinct non-null values, how often each occurs and how many rows are smaller."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    rows = _ranged(counts, [column])
    sums = {r[0]: r[1] for r in rows.groupBy("_range").agg(F.sum("n")).collect()}
    ranges = sorted(sums)
    before = dict(zip(ranges, accumulate([0, *[sums[p] for p in ranges]]), strict=False))
    offsets = df.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "_range int, _before long")
    running = F.sum("n").over(Window.partitionBy("_range").orderBy(column).rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn("_own", F.coalesce(running, F.lit(0))).join(F.broadcast(offsets), "_range")  # one row a range
    return out.select(column, "n", (F.col("_before") + F.col("_own")).alias("below"))


def average_ranks(df: DataFrame, column: str, name: str = "rank") -> DataFrame:
    """``df`` with the average rank (from 1) of a column; null for null."""
    ranks = value_ranks(df, column).select(F.col(column).alias("_v"), (F.col("below") + (F.col("n") + 1) / 2).alias(name))
    return df.join(ranks, F.col(column) == F.col("_v"), "left").drop("_v")


def quantiles(df: DataFrame, column: str, qs: Sequence[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation; only the values at their places reach the driver."""
    ranks = cut(value_ranks(df, column), "quantiles")
    n = ranks.agg(F.sum("n")).first()[0] or 0
    if not n:
        return [None] * len(qs)
    places = sorted({p for q in qs for p in (int(q * (n - 1)), min(int(q * (n - 1)) + 1, n - 1))})
    held = F.filter(F.array(*[F.lit(p).cast("long") for p in places]), lambda p: (p >= F.col("below")) & (p < F.col("below") + F.col("n")))
    at = {p: float(r[0]) for r in ranks.select(F.col(column), held.alias("at")).filter(F.size("at") > 0).collect() for p in r[1]}
    out = []
    for q in qs:
        k = int(q * (n - 1))
        out.append(at[k] + (at[min(k + 1, n - 1)] - at[k]) * (q * (n - 1) - k))
    return out


def running(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> tuple[DataFrame, dict[str, float]]:
    """``df`` (one row a key) with ``c_before`` for each column, the sum of the rows before, and all sums.

    ``next`` is the following row's value of the last key, null at the end.
    """
    rows = _ranged(df, keys)
    facts = sorted(rows.groupBy("_range").agg(*[F.sum(c).alias(c) for c in columns], F.min(F.struct(*keys)).alias("_least")).collect())
    offsets, sums = [], dict.fromkeys(columns, 0)
    for k, r in enumerate(facts):
        after = facts[k + 1]["_least"][keys[-1]] if k + 1 < len(facts) else None
        offsets.append((r["_range"], *[float(sums[c]) for c in columns], after))
        sums = {c: sums[c] + (r[c] or 0) for c in columns}
    kind = dict(df.dtypes)[keys[-1]]
    schema = ", ".join(["_range int", *[f"`_o_{c}` double" for c in columns], f"_after {kind}"])
    order = Window.partitionBy("_range").orderBy(*keys)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({f"_own_{c}": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in columns} | {"_lead": F.lead(keys[-1]).over(order)})
    out = out.join(F.broadcast(df.sparkSession.createDataFrame(offsets, schema)), "_range")  # one row a range
    return out.select(*df.columns, *[(F.col(f"_o_{c}") + F.col(f"_own_{c}")).alias(f"{c}_before") for c in columns], F.coalesce("_lead", "_after").alias("next")), sums
