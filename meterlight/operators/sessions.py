"""Sessions of warehouses and clusters, rebuilt from resume and suspend events."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlight.functions.timeops import (
    GRID_MICROS,
    boundaries,
    floor_micros,
    from_micros,
    literal_micros,
    micros,
    millis_between,
)
from meterlight.operators.ordered import neighbour, run_bounds
from meterlight.operators.slicing import COMPLETE, DAILY, clip_to_grid

# The four events that bound sessions, in the order that breaks equal times.
EVENT_CODES = (
    ("RESUME_WAREHOUSE", "STARTED", 1),
    ("RESUME_CLUSTER", "COMPLETED", 2),
    ("SUSPEND_CLUSTER", "COMPLETED", 3),
    ("SUSPEND_WAREHOUSE", "STARTED", 4),
)
ID_SHIFT = Decimal(2**64)  # the warehouse id sits above a 64-bit millisecond clock


def key_events(events: DataFrame, tie: str | None = None) -> DataFrame:
    """Rows of the four bounding events with their code; the rest is noise.

    The filter runs on the raw columns, so it is pushed to the scan.
    """
    code = None
    for name, state, value in EVENT_CODES:
        cond = (F.col("event_name") == name) & (F.col("event_state") == state)
        code = F.when(cond, F.lit(value)) if code is None else code.when(cond, F.lit(value))
    names = [name for name, _, _ in EVENT_CODES]
    last_resort = F.col(tie) if tie else F.xxhash64("cluster_number", "event_reason", "query_id")
    return (
        events.filter(F.col("event_name").isin(names) & F.col("warehouse_id").isNotNull())
        .select(
            micros("timestamp").alias("_us"),
            "warehouse_id",
            "warehouse_name",
            "cluster_number",
            code.alias("_event"),
            last_resort.alias("_tie"),
        )
        .filter(F.col("_event").isNotNull())
    )


def _resolve(rows: DataFrame, chunk: str, starts_only: bool = False) -> DataFrame:
    """Adds run bounds, session type, ``_stop`` and ``_near``, the next event of the group."""
    order = ["_us", "_event", "_tie"]
    rows = run_bounds(
        rows.withColumn("_chunk", floor_micros(F.col("_us"), chunk)),
        "warehouse_id",
        order,
        "_us",
        opens=F.col("_event") == 1,
        closes=F.col("_event") == 4,
    )
    rows = rows.withColumns(
        {
            "session_type": F.when(F.col("_event").isin(1, 4), "WH").otherwise("CL"),
            "_stop": F.col("_event").isin(3, 4),
        }
    )
    group = ["warehouse_id", "session_type", "_run", "warehouse_name", "cluster_number"]
    keep = ~F.col("_stop") if starts_only else None
    return neighbour(rows, group, order, ["_us", "_stop"], step=1, keep=keep)


def _midnight(us):
    return floor_micros(us, "day") + F.lit(GRID_MICROS["day"]).cast("bigint")


def _emit(rows: DataFrame, as_of_us: int) -> DataFrame:
    """Session rows from the start events of resolved rows."""
    now, us = F.lit(as_of_us).cast("bigint"), F.col("_us")
    stopped = F.coalesce(F.col("_near._stop"), F.lit(False))
    end = F.when(stopped, F.col("_near._us")).otherwise(F.least(now, _midnight(us)))
    shifted = F.col("warehouse_id").cast("decimal(19,0)") * F.lit(ID_SHIFT)
    return rows.filter(~F.col("_stop")).select(
        from_micros(us).alias("filterts"),
        "warehouse_id",
        "warehouse_name",
        "cluster_number",
        "session_type",
        (shifted + F.unix_millis(F.timestamp_micros("_run")).cast("decimal(19,0)"))
        .cast("decimal(38,0)")
        .alias("session_id"),
        from_micros(us).alias("session_start"),
        from_micros(end).alias("session_end"),
        millis_between(us, end).alias("duration_ms"),
        (~stopped & (now < _midnight(us))).alias("incomplete"),
        (F.col("_near").isNull() & ~F.col("_over")).alias("pending"),
    )


def sessions(
    events: DataFrame, as_of: datetime | str, tie: str | None = None, chunk: str = "hour"
) -> DataFrame:
    """Warehouse (WH) and cluster (CL) sessions.

    1. Per warehouse, ordered by time and event, a run starts at a warehouse resume, after a
       warehouse suspend, or at the first event; it names the session.
    2. Per session type, session and cluster, a start is closed by the event right after it
       if that is a stop; stops without a start vanish.
    3. A start without a stop ends at the next midnight, or at ``as_of`` before that, and is
       ``incomplete`` while midnight lies ahead.

    ``pending`` marks sessions that a later event may still change: no event followed in
    their group and their run is not over. ``tie`` names a column that orders events of equal
    time and kind. ``chunk`` bounds how much of one warehouse a task sees.
    """
    return _emit(_resolve(key_events(events, tie), chunk, starts_only=True), literal_micros(as_of))


def cut_starts(rows: DataFrame, chunk: str = "hour") -> DataFrame:
    """The start events among ``key_events`` rows with their run and the event that follows, which do
    not depend on the time they are looked at."""
    return _resolve(rows, chunk, starts_only=True).select(
        "_us", "warehouse_id", "warehouse_name", "cluster_number", "session_type", "_run", "_over", "_stop", "_near"
    )


def emit_sessions(starts: DataFrame, as_of: datetime | str) -> DataFrame:
    """The sessions of ``cut_starts`` rows as of an instant."""
    return _emit(starts, literal_micros(as_of))


@dataclass(frozen=True)
class SessionRefresh:
    """``closed`` is final; ``open`` and ``carry`` replace what the refresh before returned.

    All three derive from ``rows``; persist that while writing them, and the work is done once.
    """

    closed: DataFrame
    open: DataFrame
    carry: DataFrame
    rows: DataFrame


def refresh_sessions(
    events: DataFrame,
    as_of: datetime | str,
    open_rows: DataFrame | None = None,
    carry: DataFrame | None = None,
    tie: str | None = None,
    chunk: str = "hour",
) -> SessionRefresh:
    """Sessions after ``events``, all later than those of earlier refreshes.

    Instead of the whole log only ``carry`` is read again: of each run that is not over, the
    first event and the last of each group, which is all that later events can depend on. A
    session is final once no event can change it and its midnight, if it needs one, has
    passed; closed and open rows together always equal ``sessions`` over the whole log.
    """
    now = literal_micros(as_of)
    fresh = key_events(events, tie).withColumn("_done", F.lit(False))
    rows = _resolve(fresh if carry is None else carry.unionByName(fresh), chunk)
    found = _emit(rows.filter(~F.col("_done")), now)
    if open_rows is not None:
        # Settled by their neighbours, these only waited for midnight.
        us = micros("session_start")
        end = F.least(F.lit(now).cast("bigint"), _midnight(us))
        waiting = open_rows.filter(~F.col("pending")).withColumns(
            {
                "session_end": from_micros(end),
                "duration_ms": millis_between(us, end),
                "incomplete": F.lit(now).cast("bigint") < _midnight(us),
            }
        )
        found = found.unionByName(waiting)
    is_open = F.col("pending") | F.col("incomplete")
    needed = F.col("_near").isNull() | (F.col("_us") == F.col("_run"))
    next_carry = rows.filter(~F.col("_over") & needed).select(
        "_us", "warehouse_id", "warehouse_name", "cluster_number", "_event", "_tie",
        (F.col("_done") | F.col("_near").isNotNull()).alias("_done"),
    )
    return SessionRefresh(found.filter(~is_open), found.filter(is_open), next_carry, rows)


def session_slices(session_rows: DataFrame) -> DataFrame:
    """One DAILY row per day a session touches and one COMPLETE row, clipped from its start."""
    plus = session_rows.withColumn(
        "period_plus", boundaries("day", "session_start", "session_end") + 1
    )
    return clip_to_grid(plus, "session_start", "session_end", "day", with_complete=True)


def _pick(slices: DataFrame, record_type: str, session_type: str) -> DataFrame:
    wanted = (F.col("record_type") == record_type) & (F.col("session_type") == session_type)
    return (
        slices.filter(wanted)
        .withColumn("st_day", F.to_date("st_period"))
        .drop("period_plus", "record_type", "session_type")
    )


def warehouse_sessions(slices: DataFrame) -> DataFrame:
    return _pick(slices, COMPLETE, "WH")


def cluster_sessions(slices: DataFrame) -> DataFrame:
    return _pick(slices, COMPLETE, "CL")


def warehouse_sessions_daily(slices: DataFrame) -> DataFrame:
    """Daily slices of warehouse sessions only."""
    return _pick(slices, DAILY, "WH")


def cluster_sessions_daily(slices: DataFrame) -> DataFrame:
    return _pick(slices, DAILY, "CL")


def sessions_hourly(complete_sessions: DataFrame) -> DataFrame:
    """Hourly slices of complete session rows; ``duration`` is the length of the slice."""
    base = complete_sessions.select(
        "session_id", "warehouse_id", "cluster_number", "st_day",
        F.col("st").alias("_from"), F.col("et").alias("_to"),
    )
    return clip_to_grid(base, "_from", "_to", "hour").drop("_from", "_to", "st_period")
