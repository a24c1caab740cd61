"""Small shared pieces for text operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null, as a JVM expression."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids give null."""
    return F.crc32(doc_id.cast("string")) % n


def texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings of an Arrow column; null becomes the empty text."""
    return [x or "" for x in column.to_pylist()]


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of fewer rows from now on: documents are long, and a batch is held on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: What a worker keeps from task to task, by the operator that made it.
held: dict[str, dict[str, object]] = {}


def give_back() -> None:
    """Freed memory goes back to the system: workers live on, and what a task has freed is not kept beside what the next one needs."""
    pa.set_memory_pool(pa.system_memory_pool())  # one allocator for NumPy and Arrow
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        return


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", mb: int = 8, owner: str = "") -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``mb`` MB in each; a longer single text stays whole.

    What other operators than ``owner`` have left in this worker goes first.
    """
    for name in [name for name in held if name != owner]:
        del held[name]
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        mean = max(1, batch.column(batch.schema.get_field_index(column)).nbytes // batch.num_rows)
        step = max(1, (mb << 20) // mean)
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)
    give_back()
