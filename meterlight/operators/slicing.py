"""Intervals cut along a day or hour grid.

One generator does the cutting for queries and sessions, by day and by hour. It is a narrow
operation: a row explodes inside its own task, and no slice crosses a grid line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlight.functions.timeops import GRID_MICROS, floor_micros, from_micros, micros, millis_between

COMPLETE = "COMPLETE"
DAILY = "DAILY"


def clip_to_grid(
    df: DataFrame,
    start: str,
    end: str | Column,
    unit: str,
    *,
    with_complete: bool = False,
    open_row: Column | None = None,
    as_of_us: int | None = None,
) -> DataFrame:
    """One row per grid cell that [start, end] touches, clipped to the cell.

    Adds ``st``, ``et``, ``st_period`` (start of the cell), ``duration`` (ms) and, with
    ``with_complete``, ``record_type``: DAILY slices plus one COMPLETE row that spans the
    whole interval. An interval that ends exactly on a grid line has a last slice of length 0.

    Rows where ``open_row`` holds are still running: their end is not known, so they give the
    single cell of their start, cut at ``as_of_us``, and no COMPLETE row.
    """
    grid = F.lit(GRID_MICROS[unit]).cast("bigint")
    end_col = F.col(end) if isinstance(end, str) else end
    start_us, end_us = micros(start), micros(end_col)
    first = floor_micros(start_us, unit)
    cells = F.sequence(first, F.greatest(floor_micros(end_us, unit), first), grid)
    if with_complete:
        cells = F.concat(cells, F.array(F.lit(None).cast("bigint")))
    if open_row is not None:
        cells = F.when(open_row, F.array(first)).otherwise(cells)
        limit = F.lit(as_of_us).cast("bigint")
        end_us = F.when(open_row, F.greatest(limit, start_us)).otherwise(end_us)

    out = df.withColumns({"_start": start_us, "_end": end_us}).withColumn("_cell", F.explode(cells))
    st = F.greatest("_start", "_cell")
    et = F.least(F.col("_end"), F.col("_cell") + grid)
    added = {
        "st": from_micros(st),
        "et": from_micros(et),
        "st_period": from_micros(floor_micros(st, unit)),
        "duration": millis_between(st, et),
    }
    if with_complete:
        added["record_type"] = F.when(F.col("_cell").isNull(), F.lit(COMPLETE)).otherwise(F.lit(DAILY))
    return out.withColumns(added).drop("_start", "_end", "_cell")
