"""Time arithmetic on whole microseconds.

Differences count **boundaries crossed** (00:59 to 01:01 is one hour), not whole units
elapsed, so both ends are truncated to the grid first. Microseconds as ``bigint`` keep the
arithmetic inside generated code and independent of calendar types; timestamps are UTC.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

GRID_MICROS = {
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
}


def to_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp."""
    return F.unix_micros(to_col(ts).cast("timestamp"))


def from_micros(us: Column | str) -> Column:
    """Timestamp without time zone from microseconds since 1970."""
    return F.timestamp_micros(to_col(us)).cast("timestamp_ntz")


def literal_micros(value: datetime | str) -> int:
    """Microseconds of a Python or text timestamp, read as UTC unless it carries a zone."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    if value.tzinfo is None:
        value = value.replace(tzinfo=timezone.utc)
    delta = value - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def literal_ts(value: datetime | str) -> Column:
    """Timestamp literal without time zone."""
    return from_micros(F.lit(literal_micros(value)).cast("bigint"))


def floor_micros(us: Column, unit: str) -> Column:
    """Start of the grid cell that holds ``us``."""
    return us - F.pmod(us, F.lit(GRID_MICROS[unit]).cast("bigint"))


def millis_between(start_us: Column, end_us: Column) -> Column:
    """Millisecond boundaries between two instants given in microseconds."""
    return F.unix_millis(F.timestamp_micros(end_us)) - F.unix_millis(F.timestamp_micros(start_us))


def boundaries(unit: str, start: Column | str, end: Column | str) -> Column:
    """Number of ``unit`` boundaries between two timestamps; negative when end is before start."""
    grid = F.lit(GRID_MICROS[unit]).cast("bigint")
    span = floor_micros(micros(end), unit) - floor_micros(micros(start), unit)
    return F.call_function("div", span, grid)


def trunc(unit: str, ts: Column | str) -> Column:
    """``date_trunc`` that keeps the type without a time zone."""
    return F.date_trunc(unit, to_col(ts)).cast("timestamp_ntz")


def day_of(ts: Column | str) -> Column:
    return F.to_date(to_col(ts))


def emonth(ts: Column | str) -> Column:
    """Months since January 1970."""
    c = to_col(ts)
    return (F.year(c) - 1970) * 12 + F.month(c) - 1


def period_range(unit: str, start: Column | str, end: Column | str) -> Column:
    """Indexes 0..n where n is the number of boundaries crossed; one index when n is negative."""
    n = boundaries(unit, start, end)
    return F.sequence(F.lit(0).cast("bigint"), F.greatest(n, F.lit(0).cast("bigint")))


def period_range_plus(unit: str, start: Column | str, end: Column | str) -> Column:
    """As ``period_range`` with one more index."""
    n = boundaries(unit, start, end) + 1
    return F.sequence(F.lit(0).cast("bigint"), F.greatest(n, F.lit(0).cast("bigint")))


def index_range(start: Column | str, end: Column | str) -> Column:
    """Integers from start up to but not including end; empty when end is not above start."""
    s, e = to_col(start).cast("bigint"), to_col(end).cast("bigint")
    empty = F.array().cast("array<bigint>")
    return F.when(e > s, F.sequence(s, F.greatest(e - 1, s))).otherwise(empty)
