"""Intermediate tables in the folder that driver and executors share.

The folder is the one in ``spark.checkpoint.dir``; where the session names
none (tests on one machine), a temporary folder is taken and set.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_tables: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI, with its scheme."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(at)
        _made.append((spark, at))
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(at)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it goes when this process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of any file system that Spark can reach."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def bucketed(df: DataFrame, name: str, key: str, once: bool = False) -> DataFrame:
    """Like :func:`cut`, dealt by ``key`` as a shuffle deals: joins and groups by it do not move the table again.

    With ``once``, equal rows are kept once. Spark knows buckets only of tables in its
    catalogue; :func:`release` takes this one out of it.
    """
    spark, path, own = df.sparkSession, fresh_path(df.sparkSession, name), f"tessera_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(n, key)
    (dealt.distinct() if once else dealt).write.format("parquet").bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(own)
    out = spark.table(own)
    _paths[out], _tables[out] = path, own
    return out


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that :func:`cut` wrote and that nothing will read again.

    Shuffle files of finished jobs go as well: Spark deletes them when the
    driver's garbage is collected, which this asks for.
    """
    for df in tables:
        path, own = _paths.pop(df, None), _tables.pop(df, None)
        if own:
            spark.sql(f"DROP TABLE IF EXISTS {own}")
        if path:
            remove(spark, path)
            _made.remove((spark, path))
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim(spark: SparkSession) -> None:
    """Executors collect their garbage and give heap that is free then back to the system.

    A heap grows while there is room for it and seldom shrinks by itself, but Python
    workers need their memory beside it. As many short tasks as there are cores reach
    every executor that has no other work; they change no result wherever they run.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("done")).write.format("noop").mode("overwrite").save()


def made() -> set[str]:
    """Paths that exist now; what comes later can be swept."""
    return {path for _, path in _made}


def sweep(spark: SparkSession, before: set[str], *keep: DataFrame) -> None:
    """Delete the paths made since ``before``, but those of the tables to keep: all that was only a step towards them."""
    kept = {_paths[df] for df in keep}
    for entry in [e for e in _made if e[1] not in before and e[1] not in kept]:
        remove(*entry)
        _made.remove(entry)
    release(spark)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        if spark.sparkContext._jsc is None or spark.sparkContext._gateway is None:
            continue  # the session has ended; the cluster's own policy applies
        try:
            remove(spark, path)
        except Exception:  # one path that cannot go does not keep the others
            continue
