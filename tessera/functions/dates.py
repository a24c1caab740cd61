"""Date and time functions: fields, calendars, shifts, zones, durations and periods."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Layouts that texts are read by, in turn.
LAYOUTS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "dd-MMM-yyyy")
#: A frequency's unit for date_trunc and as an interval.
UNITS = {"T": ("minute", "minute"), "H": ("hour", "hour"), "D": ("day", "day"), "W": ("week", "week"), "M": ("month", "month")}


def parse(c: Column) -> Column:
    """A timestamp from text by the first layout that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(x)) for x in LAYOUTS])


FIELDS = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute,
    "second": F.second, "dayofyear": F.dayofyear, "quarter": F.quarter,
}


def field(c: Column, name: str) -> Column:
    return weekday(c) if name == "weekday" else FIELDS[name](c)


def weekday(c: Column) -> Column:
    """0 for Sunday to 6."""
    return F.dayofweek(c) - 1


def date(c: Column) -> Column:
    return F.date_trunc("day", c)


def truncate(c: Column, freq: str) -> Column:
    """The start of the period; weeks begin on Monday."""
    return F.date_trunc(UNITS[freq][0], c)


def date_range(spark: SparkSession, start: str, end: str, freq: str) -> DataFrame:
    """One row ``t`` for each step from start to end, both included; unknown frequencies are days."""
    unit = UNITS.get(freq, UNITS["D"])[1]
    return spark.range(1).select(F.explode(F.expr(f"sequence(timestamp '{start}', timestamp '{end}', interval 1 {unit})")).alias("t"))


def resample(df: DataFrame, column: str, freq: str) -> DataFrame:
    """The distinct period starts."""
    return df.select(truncate(F.col(column), freq).alias(column)).distinct()


def shift(c: Column, periods: int, freq: str, overflow: bool = False) -> Column:
    """Periods later; months clamp to the last day, or run over into the next month with ``overflow``."""
    if freq == "M":
        moved = F.add_months(F.trunc(c, "month"), periods) if overflow else F.add_months(c, periods)
        day = F.make_dt_interval(F.dayofmonth(c) - 1) if overflow else F.make_dt_interval(F.lit(0))
        clock = c - F.date_trunc("day", c)
        return moved.cast("timestamp") + day + clock
    unit = UNITS.get(freq, UNITS["D"])[1]
    return c + F.expr(f"interval {periods} {unit}")


def between_time(c: Column, start: str, end: str) -> Column:
    """Whether the time of day lies in the closed range, which may wrap midnight."""
    t = F.date_format(c, "HH:mm:ss")
    inside = (t >= start) & (t <= end) if start <= end else (t >= start) | (t <= end)
    return F.coalesce(inside, F.lit(False))


def at_time(c: Column, time: str) -> Column:
    return F.coalesce(F.date_format(c, "HH:mm:ss") == time, F.lit(False))


def tz_localize(c: Column, zone: str) -> Column:
    """The instant whose wall clock in the zone is the column's."""
    return F.to_utc_timestamp(c, zone)


def tz_convert(c: Column, zone: str) -> Column:
    """The wall clock in the zone at the instant."""
    return F.from_utc_timestamp(c, zone)


@dataclass(frozen=True)
class Timedelta:
    """A duration."""

    span: timedelta

    def __add__(self, other: "Timedelta") -> "Timedelta":
        return Timedelta(self.span + other.span)

    def __sub__(self, other: "Timedelta") -> "Timedelta":
        return Timedelta(self.span - other.span)

    def __mul__(self, n: int) -> "Timedelta":
        return Timedelta(self.span * n)

    def column(self) -> Column:
        return F.lit(self.span)


@dataclass(frozen=True)
class Period:
    """The half-open span of one period from a start."""

    start: datetime
    freq: str

    @property
    def end(self) -> datetime:
        if self.freq == "M":
            y, m = divmod(self.start.year * 12 + self.start.month, 12)
            return self.start.replace(year=y, month=m + 1)
        return self.start + {"T": timedelta(minutes=1), "H": timedelta(hours=1), "W": timedelta(weeks=1)}.get(self.freq, timedelta(days=1))

    def contains(self, c: Column) -> Column:
        return (c >= F.lit(self.start)) & (c < F.lit(self.end))


def calendar_frame(df: DataFrame, column: str) -> DataFrame:
    """All fields of a timestamp column next to it."""
    return df.withColumns({k: field(F.col(column), k) for k in (*FIELDS, "weekday")})
