"""String functions as Column expressions: literal patterns, null in, null out; tests give false for null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lower(c: Column) -> Column:
    return F.lower(c)


def upper(c: Column) -> Column:
    return F.upper(c)


def contains(c: Column, part: str) -> Column:
    return F.coalesce(F.contains(c, F.lit(part)), F.lit(False))


def startswith(c: Column, part: str) -> Column:
    return F.coalesce(F.startswith(c, F.lit(part)), F.lit(False))


def endswith(c: Column, part: str) -> Column:
    return F.coalesce(F.endswith(c, F.lit(part)), F.lit(False))


def replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def split(c: Column, sep: str) -> Column:
    """Parts between literal separators; an empty separator gives the characters."""
    return F.split(c, "(?!^)(?!$)" if sep == "" else r"\Q" + sep.replace(r"\E", r"\E\\E\Q") + r"\E", -1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def byte_length(c: Column) -> Column:
    return F.octet_length(c)


def byte_slice(c: Column, start: int, end: int) -> Column:
    """Bytes from start to end; negative places count from the end, end 0 after a negative start is the end."""
    n = F.octet_length(c)
    place = lambda i: F.lit(i) if i >= 0 else F.greatest(n + i, F.lit(0))
    stop = n if start < 0 and end == 0 else place(end)
    a = F.least(place(start), n)
    width = F.greatest(F.least(stop, n) - a, F.lit(0))
    return F.substring(c.cast("binary"), a + 1, width).cast("string")
