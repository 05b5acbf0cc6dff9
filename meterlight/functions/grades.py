"""Grades of model runs: run time, size and spill."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterlight.functions.timeops import to_col

GB = 1_000_000_000

# Grade names in rising order.
TIME_GRADES = ("XS", "S", "M", "L", "XL", "XL+")
SIZE_GRADES = ("XS", "S", "M", "L", "XL")
SPILL_GRADES = ("Good", "Acceptable", "Poor", "VeryPoor")

# Exclusive upper bounds of all but the highest grade.
TIME_BOUNDS_MS = (60_000, 300_000, 900_000, 1_800_000, 3_600_000)
BYTES_BOUNDS = (GB, 10 * GB, 100 * GB, 1000 * GB)
ROWS_BOUNDS = (1_000_000, 10_000_000, 100_000_000, 1_000_000_000)


def _ladder(value: Column, bounds, results) -> Column:
    out = None
    for bound, result in zip(bounds, results):
        cond = value < bound
        out = F.when(cond, F.lit(result)) if out is None else out.when(cond, F.lit(result))
    return out.otherwise(F.lit(results[len(bounds)]))


def run_time_grade(elapsed_ms: Column | str) -> Column:
    return _ladder(to_col(elapsed_ms), TIME_BOUNDS_MS, TIME_GRADES)


def bytes_level(size: Column | str) -> Column:
    """0 to 4; NULL counts as the highest level."""
    return _ladder(to_col(size), BYTES_BOUNDS, range(5))


def rows_level(rows: Column | str) -> Column:
    """0 to 4; NULL counts as the highest level."""
    return _ladder(to_col(rows), ROWS_BOUNDS, range(5))


def size_grade(rows: Column | str, written: Column | str) -> Column:
    """The larger of both levels; a NULL level makes the result the highest grade."""
    rows, written = to_col(rows), to_col(written)
    level = F.when(rows.isNotNull() & written.isNotNull(), F.greatest(rows, written))
    return _ladder(level, (1, 2, 3, 4), SIZE_GRADES)


def spill_grade(local: Column | str, remote: Column | str) -> Column:
    local, remote = to_col(local), to_col(remote)
    return (
        F.when((local == 0) & (remote == 0), F.lit("Good"))
        .when((local <= 5 * GB) & (remote == 0), F.lit("Acceptable"))
        .when((local > 5 * GB) & (remote == 0), F.lit("Poor"))
        .otherwise(F.lit("VeryPoor"))
    )
