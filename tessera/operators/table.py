"""Table operators: projection, nulls, duplicates, joins, set operations, aggregates, reshaping.

Every function takes and returns DataFrames and leaves planning to Catalyst.
Where rows have an order that matters, it is an explicit key. ``compat=True``
selects the zero-for-null rules of array-style table libraries; the default is
SQL's treatment of nulls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.ranks import numbered, quantiles

POSITION = "_pos"
#: The number at the start of a text, as scanners of formatted input read it.
NUMBER_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def numeric_view(c: Column, kind: T.DataType | None = None) -> Column:
    """A column as double: numbers as they are, texts by their leading number or 0, null as null."""
    if kind is not None and is_numeric(kind):
        return c.cast("double")
    if isinstance(kind, T.StringType):
        text = F.regexp_extract(c, NUMBER_PREFIX, 1)
        return F.when(c.isNotNull(), F.coalesce(text.try_cast("double"), F.lit(0.0)))
    return F.when(c.isNotNull(), F.lit(0.0))


# construction and projection


def from_columns(spark: SparkSession, columns: dict[str, Sequence]) -> DataFrame:
    """A frame from named vectors of equal length; columns in alphabetical order."""
    names = sorted(columns)
    if len({len(v) for v in columns.values()}) > 1:
        raise ValueError("columns differ in length")
    return spark.createDataFrame(list(zip(*[columns[c] for c in names], strict=True)), names)


def from_rows(spark: SparkSession, names: Sequence[str], rows: Iterable[Sequence]) -> DataFrame:
    """A frame from row tuples; short rows are padded with nulls, extra cells dropped."""
    padded = [tuple(list(r)[: len(names)] + [None] * (len(names) - len(r))) for r in rows]
    return spark.createDataFrame(padded, list(names))


def with_position(df: DataFrame, *order: str) -> DataFrame:
    """Row numbers from 0 in the order of a unique key, counted range by range."""
    return numbered(df, order, POSITION)


def select(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns)


def drop(df: DataFrame, *columns: str) -> DataFrame:
    """Without the named columns; unknown names do nothing."""
    return df.drop(*columns)


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def insert(df: DataFrame, at: int, name: str, value: Column) -> DataFrame:
    """A new column at a place; it must not exist."""
    if name in df.columns or not 0 <= at <= len(df.columns):
        raise ValueError(f"cannot insert {name!r} at {at}")
    return df.select(*df.columns[:at], value.alias(name), *df.columns[at:])


def assign_values(df: DataFrame, name: str, values: Sequence, *order: str) -> DataFrame:
    """A column from a literal vector, one value for each row in the order of the key."""
    placed = with_position(df, *order)
    if placed.count() != len(values):
        raise ValueError("length differs from the frame's")
    literal = df.sparkSession.createDataFrame(list(enumerate(values)), [POSITION, name])
    return placed.drop(name).join(F.broadcast(literal), POSITION).drop(POSITION)


def iloc(df: DataFrame, rows: Sequence[int], columns: Sequence[int], *order: str) -> DataFrame:
    """Rows and columns by place; rows may repeat and come in the given order (column ``_pos``)."""
    placed = with_position(df, *order)
    picks = df.sparkSession.createDataFrame([(r, i) for i, r in enumerate(rows)], ["_at", "_out"])
    out = placed.join(F.broadcast(picks), F.col(POSITION) == F.col("_at"))
    return out.select(F.col("_out").alias(POSITION), *[df.columns[c] for c in columns])


def astype(df: DataFrame, column: str, kind: str) -> DataFrame:
    """One column cast; texts become numbers by their leading number, else 0; booleans are false for '', 0, false, False."""
    c, had = F.col(column), df.schema[column].dataType
    if kind in ("float64", "double"):
        out = numeric_view(c, had)
    elif kind in ("int", "long"):
        out = numeric_view(c, had).cast("long")
    elif kind == "string":
        out = c.cast("string")
    elif kind == "bool":
        out = F.when(c.isNotNull(), ~c.cast("string").isin("", "0", "false", "False"))
    else:
        raise ValueError(f"unknown type {kind}")
    return df.withColumn(column, out)


def convert_dtypes(df: DataFrame) -> DataFrame:
    """Text columns whose values all begin with a number become double, all truth words boolean; one pass decides."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    words = ("true", "True", "TRUE", "1", "false", "False", "FALSE", "0")
    checks = []
    for c in texts:
        checks += [F.bool_and(F.col(c).rlike(NUMBER_PREFIX) | (F.col(c) == "")).alias(f"n_{c}"), F.bool_and(F.col(c).isin(*words)).alias(f"b_{c}")]
    found = df.agg(*checks).first().asDict()
    out = {}
    for c in texts:
        if found[f"n_{c}"]:
            out[c] = F.when(F.col(c) != "", numeric_view(F.col(c), T.StringType()))
        elif found[f"b_{c}"]:
            out[c] = F.col(c).isin("true", "True", "TRUE", "1")
    return df.withColumns(out) if out else df


def dtypes(df: DataFrame) -> dict[str, str]:
    """Type names by value: float64, int, string, bool, object, or empty for columns without a value."""
    have = df.agg(*[F.count(c).alias(c) for c in df.columns]).first().asDict()
    name = {"double": "float64", "float": "float64", "bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "string": "string", "boolean": "bool"}
    return {c: name.get(k, "object") if have[c] else "empty" for c, k in df.dtypes}


def info(df: DataFrame) -> str:
    """Columns with their types and numbers of values."""
    have = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"c_{c}") for c in df.columns]).first().asDict()
    return "\n".join([f"rows: {have['n']}"] + [f"{c}: {k}, {have[f'c_{c}']} values" for c, k in df.dtypes])


def transpose(df: DataFrame, *order: str) -> DataFrame:
    """Rows as columns "0", "1", ...; all cells as text, for bounded frames."""
    n = df.count()
    placed = with_position(df, *order)
    cells = placed.select(POSITION, F.posexplode(F.array(*[F.col(c).cast("string") for c in df.columns])).alias("row", "cell"))
    return cells.groupBy("row").pivot(POSITION, list(range(n))).agg(F.first("cell")).orderBy("row").drop("row")


def apply_columns(df: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    return df.select(*[fn(F.col(c)).alias(c) for c in df.columns])


# filters, nulls, replacement


def where(df: DataFrame, condition: Column, other) -> DataFrame:
    """Rows that fail the condition have all cells replaced, not removed."""
    return df.select(*[F.when(condition, F.col(c)).otherwise(F.lit(other)).alias(c) for c in df.columns])


def isin(c: Column, values: Sequence) -> Column:
    """Membership; null is a member only if the values hold it."""
    some = F.coalesce(c.isin([v for v in values if v is not None]), F.lit(False))
    return some | c.isNull() if None in values else some


def between(c: Column, low: float, high: float) -> Column:
    return F.coalesce(c.between(low, high), F.lit(False))


def replace(df: DataFrame, old, new) -> DataFrame:
    """Cells whose text equals that of ``old`` become ``new``, in all columns."""
    return df.select(*[F.when(F.col(c).cast("string") == str(old), F.lit(new).cast(k)).otherwise(F.col(c)).alias(c) for c, k in df.dtypes])


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def round_half_away(c: Column, decimals: int) -> Column:
    return F.round(c.cast("double"), decimals)


def dropna(df: DataFrame) -> DataFrame:
    """Without rows that hold a null; NaN is a value."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in df.columns]))


def fillna(df: DataFrame, value, columns: Sequence[str] | None = None) -> DataFrame:
    return df.fillna(value, subset=list(columns) if columns else None)


def duplicated(df: DataFrame, *order: str) -> DataFrame:
    """With ``duplicated``: whether an earlier row (by the key) has equal values outside the key."""
    values = [c for c in df.columns if c not in order]
    w = Window.partitionBy(*values).orderBy(*order)
    return df.withColumn("duplicated", F.row_number().over(w) > 1)


def drop_duplicates(df: DataFrame, *order: str) -> DataFrame:
    """The first row (by the key) of each distinct set of values: one hash aggregate, no sort."""
    values = [c for c in df.columns if c not in order]
    return df.groupBy(*values).agg(F.min(F.struct(*order)).alias("_first")).select(*[F.col(f"_first.{c}").alias(c) for c in order], *values).select(*df.columns)


# joins and sets


def merge(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on equal names with keys coalesced; null keys match each other. how: inner, left, right, outer, semi, anti."""
    if how not in ("inner", "left", "right", "outer", "semi", "anti"):
        raise ValueError(f"unknown join {how}")
    l, r = left.alias("l"), right.alias("r")
    cond = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in on])
    joined = l.join(r, cond, {"semi": "left_semi", "anti": "left_anti"}.get(how, how))
    if how in ("semi", "anti"):
        return joined
    keys = {c: F.coalesce(F.col(f"l.{c}"), F.col(f"r.{c}")).alias(c) for c in on}
    return joined.select(*[keys.get(c, F.col(f"l.{c}")) for c in left.columns], *[F.col(f"r.{c}") for c in right.columns if c not in on])


def concat_horizontal(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Frames side by side by a position column; clashing names get the frame's number."""
    out, seen = None, set()
    for i, f in enumerate(frames):
        names = {c: c if c not in seen else f"{c}_{i}" for c in f.columns if c != key}
        seen |= set(names.values())
        g = f.select(key, *[F.col(c).alias(a) for c, a in names.items()])
        out = g if out is None else out.join(g, key)
    return out


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames; the same set of columns, in the first one's order."""
    if len({frozenset(f.columns) for f in frames}) != 1:
        raise ValueError("columns differ")
    return reduce(DataFrame.unionByName, frames)


def unique(df: DataFrame, column: str, *order: str) -> DataFrame:
    """Distinct values in the order of first appearance (column ``first``); null counts as one."""
    return df.groupBy(column).agg(F.min(F.struct(*order)).alias("first"))


def nunique(df: DataFrame) -> DataFrame:
    """One row: distinct values of each column, null included."""
    return df.agg(*[(F.count_distinct(F.col(c)) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in df.columns])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


# aggregates


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def totals(df: DataFrame, column: str) -> DataFrame:
    """count, sum, mean, min, max, median, sample std and var of a column; without values (or with one, for spread) 0."""
    c = F.col(column).cast("double")
    median = F.lit(quantiles(df.select(c.alias("v")), "v", [0.5])[0]).cast("double")
    stats = {"sum": F.sum(c), "mean": F.avg(c), "min": F.min(c), "max": F.max(c), "median": median, "std": F.stddev_samp(c), "var": F.var_samp(c)}
    return df.agg(F.count(c).alias("count"), *[zero_if_null(v).alias(k) for k, v in stats.items()])


def describe(df: DataFrame, *columns: str) -> DataFrame:
    """Rows count, mean, std, min, 25%, 50%, 75%, max; quartiles with linear interpolation."""
    names = list(columns) or numeric_columns(df)
    quartiles = {c: dict(zip(("25%", "50%", "75%"), quantiles(df.select(F.col(c).cast("double").alias("v")), "v", [0.25, 0.5, 0.75]), strict=True)) for c in names}
    aggregates = {"count": lambda c: F.count(c).cast("double"), "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    parts = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]
    value = lambda c, s: aggregates[s](F.col(c).cast("double")) if s in aggregates else F.lit(quartiles[c][s]).cast("double")
    row = df.agg(*[zero_if_null(value(c, s)).alias(f"{c}\t{s}") for c in names for s in parts])
    cells = [F.struct(F.lit(s).alias("stat"), *[F.col(f"`{c}\t{s}`").alias(c) for c in names]) for s in parts]
    return row.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def _pairwise(df: DataFrame, columns: Sequence[str], f: Callable[[Column, Column], Column]) -> DataFrame:
    row = df.agg(*[f(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}\t{b}") for a in columns for b in columns])
    cells = [F.struct(F.lit(a).alias("column"), *[F.col(f"`{a}\t{b}`").alias(b) for b in columns]) for a in columns]
    return row.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def _both(a: Column, b: Column, x: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), x)


def safe_cov(a: Column, b: Column) -> Column:
    return zero_if_null(F.covar_samp(a, b))


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson over complete pairs; 0 for fewer than two pairs or no variance."""
    spread = F.stddev_pop(_both(a, b, a)) * F.stddev_pop(_both(a, b, b))
    return zero_if_null(F.try_divide(F.covar_pop(a, b), F.when(spread > 0, spread)))


def cov_matrix(df: DataFrame, *columns: str) -> DataFrame:
    """Pairwise-complete sample covariances: label ``column`` and one column for each name, in one pass."""
    return _pairwise(df, columns or numeric_columns(df), safe_cov)


def corr_matrix(df: DataFrame, *columns: str) -> DataFrame:
    return _pairwise(df, columns or numeric_columns(df), safe_corr)


GROUPED = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "median": F.median, "std": F.stddev_samp, "var": F.var_samp}


def group_agg(df: DataFrame, by: Sequence[str], how: dict[str, Sequence[str]], compat: bool = False) -> DataFrame:
    """Several aggregates of several columns (``column_how``) and ``size`` in one hash aggregate; ``compat`` takes nulls as 0."""
    view = (lambda c: zero_if_null(F.col(c).cast("double"))) if compat else (lambda c: F.col(c).cast("double"))
    out = [(zero_if_null if compat else (lambda x: x))(GROUPED[h](view(c))).alias(f"{c}_{h}") for c, hs in how.items() for h in hs]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("size"), *out)


def group_first(df: DataFrame, by: Sequence[str], *order: str) -> DataFrame:
    """The first row of each group by the key, without a sort."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*by, *[F.col(f"_r.{c}").alias(c) for c in rest])


def group_last(df: DataFrame, by: Sequence[str], *order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*by, *[F.col(f"_r.{c}").alias(c) for c in rest])


def group_filter(df: DataFrame, by: Sequence[str], having: Column) -> DataFrame:
    """Rows of the groups whose aggregate condition holds; groups are found by an aggregate and semi-joined."""
    kept = df.groupBy(*by).agg(having.alias("_keep")).filter("_keep")
    cond = reduce(lambda a, b: a & b, [df[c].eqNullSafe(kept[c]) for c in by])
    return df.join(kept, cond, "left_semi")


def group_apply(df: DataFrame, by: Sequence[str], fn, schema: str) -> DataFrame:
    """Split, apply a pandas function, combine."""
    return df.groupBy(*by).applyInPandas(fn, schema)


def pivot_table(df: DataFrame, index: str, columns: str, values: str, how: str = "sum", labels: Sequence | None = None) -> DataFrame:
    """One row for each index value, one column for each label; missing cells are 0. Known ``labels`` save a pass."""
    f = {"sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max}[how]
    wide = df.groupBy(F.col(index).cast("string").alias(index)).pivot(columns, list(labels) if labels else None).agg(f(values))
    return wide.fillna(0, subset=[c for c in wide.columns if c != index])


def crosstab(df: DataFrame, row: str, column: str, labels: Sequence | None = None) -> DataFrame:
    return pivot_table(df.withColumn("_one", F.lit(1)), row, column, "_one", "count", labels)


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(values), "variable", "value")


# order


def sort_values(df: DataFrame, by: str, *tie: str, ascending: bool = True) -> DataFrame:
    c = F.col(by)
    return df.orderBy(c.asc_nulls_first() if ascending else c.desc_nulls_last(), *tie)


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def nlargest(df: DataFrame, n: int, column: str, *tie: str) -> DataFrame:
    return df.orderBy(F.col(column).desc_nulls_last(), *tie).limit(n)


def nsmallest(df: DataFrame, n: int, column: str, *tie: str) -> DataFrame:
    return df.orderBy(F.col(column).asc_nulls_last(), *tie).limit(n)


def sample(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """Exactly n rows without replacement: those with the smallest seeded hashes of the key."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(n)


def to_dict(df: DataFrame, limit: int, orient: str = "list") -> dict | list:
    """Up to ``limit`` rows as ``list`` (column to values), ``records`` or ``index`` (row number to record)."""
    rows = [r.asDict() for r in df.limit(limit).collect()]
    if orient == "records":
        return rows
    if orient == "index":
        return dict(enumerate(rows))
    return {c: [r[c] for r in rows] for c in df.columns}


def iter_columns(df: DataFrame) -> Iterable[tuple[str, DataFrame]]:
    """Each column's name and the frame of that column alone; nothing is read until it is used."""
    return ((c, df.select(c)) for c in df.columns)


def pipe(df: DataFrame, f: Callable[..., DataFrame], *args, **kwargs) -> DataFrame:
    return f(df, *args, **kwargs)


def group_count(df: DataFrame, *keys: str) -> DataFrame:
    """(ngroups): the number of groups, null keys being one."""
    return df.select(*keys).distinct().agg(F.count(F.lit(1)).alias("ngroups"))


def group_rows(df: DataFrame, position: str, *keys: str) -> DataFrame:
    """(keys..., rows): the positions of each group's rows, in order; a group's positions lie in one row."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(position)).alias("rows"))


def series(spark: SparkSession, name: str, values: Sequence) -> DataFrame:
    """(position, name): a named column with the order of its values."""
    kind = next((type(v) for v in values if v is not None), str)
    ddl = {int: "long", float: "double", bool: "boolean"}.get(kind, "string")
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"position long, `{name}` {ddl}")


def as_float(c: Column) -> Column:
    """The number a value begins with, else 0."""
    return F.coalesce(F.regexp_extract(c.cast("string"), r"^\s*([-+]?\d+(\.\d*)?([eE][-+]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def as_int(c: Column) -> Column:
    """The whole number a value begins with, else 0."""
    return F.coalesce(F.regexp_extract(c.cast("string"), r"^\s*([-+]?\d+)", 1).try_cast("long"), F.lit(0))
