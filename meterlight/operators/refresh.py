"""Incremental refresh with explicit watermarks.

A refresh returns what to append, what to keep open and the new state; writing is up to the
caller. The only thing that reaches the driver is the state, a handful of scalars.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlight.operators.history import day_slices

EPOCH = datetime(1970, 1, 1)


@dataclass(frozen=True)
class Watermarks:
    """Oldest start still running (else the last end seen) and newest end of a finished query."""

    oldest_running: datetime = EPOCH
    newest_completed: datetime = EPOCH


@dataclass(frozen=True)
class QueryRefresh:
    """``incomplete`` replaces the open table if ``changed``; an empty feed leaves it as it is."""

    closed: DataFrame
    incomplete: DataFrame
    state: Watermarks
    changed: bool


def _ts(value: datetime):
    return F.lit(value).cast("timestamp_ntz")


def refresh_queries(
    queries: DataFrame,
    state: Watermarks,
    as_of: datetime | str,
    snapshot: str | None = None,
    running_end: datetime | None = None,
) -> QueryRefresh:
    """Slices that are new since ``state``: finished ones to append, open ones to replace.

    Read: rows that still run (they carry an end before their start) or ended at or after the
    newest end seen, whenever they started: a query may start first and be logged last. A
    finished row that arrives with an end before the newest one seen is not read; the
    source's lateness allowance rules that out.

    Kept open: running rows, and rows that end exactly at the new watermark, because more
    rows with that end may still come; the next refresh reads both again. Everything else is
    closed for good. An empty ``state`` makes a full load.

    The watermarks, the closed and the open rows must see the same log. Where it may grow
    meanwhile, ``snapshot`` names a new folder on shared storage that the rows read are
    written to first. ``running_end`` is the end the log gives all running rows, if it has
    one; the test on the end then reaches the files and skips what was closed long ago.
    """
    running = F.col("start_time") > F.col("end_time")
    unfinished = running if running_end is None else F.col("end_time") == _ts(running_end)
    new = queries.filter(unfinished | (F.col("end_time") >= _ts(state.newest_completed)))
    if snapshot is not None:
        new.write.parquet(snapshot)
        new = queries.sparkSession.read.schema(new.schema).parquet(snapshot)
    seen = new.agg(
        F.min(F.when(running, F.col("start_time"))).alias("oldest"),
        F.max("end_time").alias("last_end"),
        F.max(F.when(~running, F.col("end_time"))).alias("newest"),
    ).first()
    after = Watermarks(
        seen.oldest or seen.last_end or state.oldest_running,
        max(seen.newest or EPOCH, state.newest_completed),
    )
    newest = _ts(after.newest_completed)
    open_row = F.col("incomplete") | (F.col("end_time") == newest)
    slices = day_slices(new.filter(running | (F.col("end_time") <= newest)), as_of)
    return QueryRefresh(slices.filter(~open_row), slices.filter(open_row), after, seen.last_end is not None)


def refresh_simple(
    source: DataFrame, held: DataFrame | None, index: str, newest: datetime | None
) -> DataFrame:
    """Source rows not held yet, by an index column that only grows.

    Rows at the newest value held may be new or old, so those held are subtracted one by one;
    later rows are new. ``newest`` of None loads everything.
    """
    if newest is None or held is None:
        return source
    at = F.col(index) == _ts(newest)
    boundary = source.filter(at).exceptAll(held.filter(at).select(*source.columns))
    return source.filter(F.col(index) > _ts(newest)).unionByName(boundary)


def index_range(held: DataFrame, index: str) -> tuple[datetime | None, datetime | None]:
    """First and last index value of a table: its range, and the next refresh's start."""
    row = held.agg(F.min(index).alias("low"), F.max(index).alias("high")).first()
    return row.low, row.high
