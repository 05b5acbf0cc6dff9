"""Query history: slices, cost, and the enriched complete, daily and hourly datasets."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlight.config import DEFAULT, EngineConfig
from meterlight.functions.tags import tags_to_map
from meterlight.functions.text import hash_literals
from meterlight.functions.timeops import boundaries, literal_micros, micros, millis_between, trunc
from meterlight.functions.warehouses import credit_units, row_cost, units_to_credits
from meterlight.operators.slicing import COMPLETE, DAILY, clip_to_grid


def with_units(df: DataFrame) -> DataFrame:
    """Adds ``credit_units``, the work of the row's ``duration`` as a whole number.

    The formula takes the load percentage as the average over the span; where the platform
    reports peak load it overcounts, which utilization corrects by capping.
    """
    return df.withColumn(
        "credit_units",
        credit_units(
            F.col("duration"),
            F.col("query_load_percent"),
            F.col("warehouse_size"),
            F.col("warehouse_type"),
        ),
    )


def with_cost(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Adds ``unloaded_direct_compute_credits`` and ``cost`` from ``credit_units``.

    The factor of non-standard compute applies at every grain, hourly included.
    """
    return df.withColumns(
        {
            "unloaded_direct_compute_credits": units_to_credits("credit_units"),
            "cost": row_cost("credit_units", "warehouse_id", cfg),
        }
    )


def _marked(queries: DataFrame) -> DataFrame:
    running = F.col("start_time") > F.col("end_time")
    return queries.withColumns(
        {
            "incomplete": F.coalesce(running, F.lit(False)),
            "filterts": F.col("start_time"),
            "period_plus": boundaries("day", "start_time", "end_time") + 1,
        }
    )


def day_slices(queries: DataFrame, as_of: datetime | str, with_complete: bool = True) -> DataFrame:
    """Per query one DAILY row per calendar day touched, and one COMPLETE row.

    A running query carries an end before its start. It has one DAILY row, on the day it
    started and cut at ``as_of``, and no COMPLETE row. Slices are true clips: together they
    cover the query exactly once.
    """
    sliced = clip_to_grid(
        _marked(queries),
        "start_time",
        "end_time",
        "day",
        with_complete=with_complete,
        open_row=F.col("incomplete"),
        as_of_us=literal_micros(as_of),
    )
    if not with_complete:
        sliced = sliced.withColumn("record_type", F.lit(DAILY))
    return with_units(sliced)


def complete_rows(queries: DataFrame) -> DataFrame:
    """The COMPLETE rows of ``day_slices`` alone: one per finished query, nothing is cut."""
    finished = _marked(queries.filter(F.col("start_time") <= F.col("end_time")))
    return with_units(
        finished.withColumns(
            {
                "st": F.col("start_time"),
                "et": F.col("end_time"),
                "st_period": trunc("day", "start_time"),
                "duration": millis_between(micros("start_time"), micros("end_time")),
                "record_type": F.lit(COMPLETE),
            }
        )
    )


def _published(slices: DataFrame, record_type: str, cfg: EngineConfig) -> DataFrame:
    rows = with_cost(slices.filter(F.col("record_type") == record_type), cfg)
    extra = {"st_day": F.to_date("st_period")}
    if "qtag" in slices.columns:
        extra["qtag_filter"] = tags_to_map("qtag")
    return rows.withColumns(extra).drop("period_plus", "record_type")


def _union(closed: DataFrame, incomplete: DataFrame | None) -> DataFrame:
    return closed if incomplete is None else closed.unionByName(incomplete)


def enriched(
    closed: DataFrame, incomplete: DataFrame | None = None, cfg: EngineConfig = DEFAULT
) -> DataFrame:
    """One row per finished query with tag map, credits, cost and start day."""
    return _published(_union(closed, incomplete), COMPLETE, cfg)


def enriched_daily(
    closed: DataFrame, incomplete: DataFrame | None = None, cfg: EngineConfig = DEFAULT
) -> DataFrame:
    """One row per query and day, running queries included."""
    return _published(_union(closed, incomplete), DAILY, cfg)


def enriched_hourly(complete: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """One row per finished query and hour, expanded from the complete rows.

    Fewer rows are read that way than from the daily ones, and the expansion usually
    collapses at once in an aggregate above it.
    """
    base = complete.drop(
        "st", "et", "st_period", "duration", "credit_units", "cost", "unloaded_direct_compute_credits"
    )
    return with_cost(with_units(clip_to_grid(base, "start_time", "end_time", "hour")), cfg)


def normalized(complete: DataFrame) -> DataFrame:
    """The enriched history with every literal of the query text hashed out."""
    return complete.withColumn("query_text", hash_literals("query_text"))
