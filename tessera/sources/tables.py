"""Reading of named Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables of one scale-factor folder.
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of ``sf_dir``, by Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
