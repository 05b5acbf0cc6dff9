"""Hourly spend per user and role."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlight.functions.timeops import GRID_MICROS, from_micros, literal_micros, literal_ts
from meterlight.functions.warehouses import credits_per_hour, is_serverless_name


def window_start(as_of: datetime | str) -> int:
    """The full hour before the current one, in microseconds: what one run recomputes."""
    now, hour = literal_micros(as_of), GRID_MICROS["hour"]
    return now - now % hour - hour


def recent(queries: DataFrame, as_of: datetime | str) -> DataFrame:
    """Queries that ended in the hours one run recomputes; running ones are not there."""
    start = from_micros(F.lit(window_start(as_of)).cast("bigint"))
    return queries.filter((F.col("end_time") >= start) & (F.col("end_time") <= literal_ts(as_of)))


def persona_rows(queries: DataFrame) -> DataFrame:
    """Two rows per query, one for its user and one for its role, with their work.

    Work is elapsed milliseconds times the size rate, a whole number; cloud credits are
    decimal. Serverless pools are left out and negative times count as 0.
    """
    rate = F.coalesce(credits_per_hour("warehouse_size"), F.lit(0).cast("bigint"))
    elapsed = F.when(
        F.col("total_elapsed_time").isNotNull(), F.greatest(F.lit(0), F.col("total_elapsed_time"))
    )
    return (
        queries.filter(~is_serverless_name("warehouse_name"))
        .select(
            "end_time",
            (elapsed * rate).alias("_work"),
            F.col("credits_used_cloud_services").cast("decimal(18,9)").alias("_cloud"),
            F.explode(
                F.array(
                    F.struct(F.lit("user").alias("persona"), F.col("user_name").alias("name")),
                    F.struct(F.lit("role").alias("persona"), F.col("role_name").alias("name")),
                )
            ).alias("_who"),
        )
        .select("end_time", "_work", "_cloud", "_who.name", "_who.persona")
    )


def credits_used() -> Column:
    """Aggregate over ``persona_rows``: both sums are exact."""
    return F.sum("_work").cast("double") / F.lit(3_600_000.0) + F.sum("_cloud").cast("double")


def hourly_usage(queries: DataFrame, as_of: datetime | str) -> DataFrame:
    """Credits per user and per role, day and hour of the end of each finished query.

    Users and roles come from one scan: every row is stacked twice and summed before the
    shuffle.
    """
    rows = persona_rows(queries.filter(F.col("start_time") <= F.col("end_time")))
    return rows.groupBy(
        F.to_date("end_time").alias("day"), F.hour("end_time").alias("hour_of_day"), "name", "persona"
    ).agg(credits_used().alias("credits_used"), literal_ts(as_of).alias("last_updated"))


def day_totals(hourly: DataFrame, day: date | str) -> DataFrame:
    """Credits of one day per kind (users, roles) and name."""
    kind = F.when(F.col("persona") == "user", F.lit("users")).otherwise(F.lit("roles"))
    return (
        hourly.filter(F.col("day") == F.lit(str(day)).cast("date"))
        .groupBy(kind.alias("kind"), "name")
        .agg(F.sum("credits_used").alias("credits"))
    )
