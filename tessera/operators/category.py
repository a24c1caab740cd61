"""Categorical columns and hierarchical keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranks import numbered


def categories(df: DataFrame, column: str) -> DataFrame:
    """(category, code): distinct values in text order."""
    values = df.select(F.col(column).alias("category")).filter(F.col("category").isNotNull()).distinct()
    return numbered(values.withColumn("_text", F.col("category").cast("string")), ["_text"], "code").withColumn("code", F.col("code").cast("int")).select("category", "code")


def codes(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``code``, -1 for null."""
    named = categories(df, column).withColumnRenamed("category", column)
    return df.join(named, column, "left").withColumn("code", F.coalesce("code", F.lit(-1)))


def rename_categories(c: Column, mapping: dict) -> Column:
    out = c
    for old, new in mapping.items():
        out = F.when(c == F.lit(old), F.lit(new)).otherwise(out)
    return out


def remove_categories(c: Column, removed: Sequence) -> Column:
    return F.when(~c.isin(*removed), c)


class MultiIndex:
    """Levels of a hierarchical key, kept as columns; each level has a table of its values."""

    def __init__(self, df: DataFrame, levels: Sequence[str]):
        self.df, self.names = df, list(levels)

    @property
    def nlevels(self) -> int:
        return len(self.names)

    def levels(self, name: str) -> DataFrame:
        return categories(self.df, name)

    def codes(self) -> DataFrame:
        out = self.df
        for name in self.names:
            out = codes(out, name).withColumnRenamed("code", f"{name}_code")
        return out

    def get(self, **values) -> DataFrame:
        out = self.df
        for name, v in values.items():
            out = out.filter(F.col(name).eqNullSafe(F.lit(v)))
        return out

    def drop_level(self, name: str) -> "MultiIndex":
        return MultiIndex(self.df.drop(name), [x for x in self.names if x != name])

    def sort_level(self, name: str, *tie: str) -> DataFrame:
        return self.df.orderBy(F.col(name).cast("string"), *tie)

    def equals(self, other: "MultiIndex") -> bool:
        if self.names != other.names:
            return False
        a, b = self.df.select(*self.names), other.df.select(*self.names)
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
