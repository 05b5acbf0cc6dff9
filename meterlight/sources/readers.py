"""Readers and filters over the logs. All lazy: filters and columns reach the file scan."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlight.config import SETTLE_DELAYS
from meterlight.functions.timeops import (
    GRID_MICROS,
    from_micros,
    literal_micros,
    micros,
)
from meterlight.sources.schemas import schema


def read(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A log table with its fixed schema: no inference, only the columns used are read."""
    return spark.read.schema(schema(ddl)).parquet(path)


def read_stream(spark: SparkSession, path: str, ddl: str, files_per_batch: int = 1) -> DataFrame:
    """The same table as a stream of new files."""
    return (
        spark.readStream.schema(schema(ddl))
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Columns of a schema by name and order; missing ones are typed NULLs, extras go."""
    have = {c.lower() for c in df.columns}
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema(ddl).fields
        ]
    )


def settled(df: DataFrame, ts_col: str, delay_minutes: int, as_of: datetime | str) -> DataFrame:
    """Rows old enough to be final: the log may still change within its lateness allowance."""
    if delay_minutes <= 0:
        return df
    limit = literal_micros(as_of) - delay_minutes * GRID_MICROS["minute"]
    return df.filter(F.col(ts_col) < from_micros(F.lit(limit).cast("bigint")))


def settled_source(df: DataFrame, table: str, as_of: datetime | str) -> DataFrame:
    """``settled`` with the allowance and column of a named source."""
    delay, ts_col = SETTLE_DELAYS[table]
    return settled(df, ts_col, delay, as_of)


def active_users(users: DataFrame) -> DataFrame:
    """Name and email of users that were not deleted."""
    return users.filter(F.col("deleted_on").isNull()).select("name", "email")


def warehouse_dim(warehouses: DataFrame) -> DataFrame:
    """One row per warehouse name with size and type; the smallest pair of repeated names."""
    pair = F.min(F.struct("warehouse_size", "warehouse_type"))
    return warehouses.groupBy("warehouse_name").agg(pair.alias("pair")).select("warehouse_name", "pair.*")


def date_spine(spark: SparkSession, as_of: datetime | str, days: int = 730) -> DataFrame:
    """The ``days`` days before the day of ``as_of``, as timestamps."""
    today = (datetime(1970, 1, 1) + timedelta(microseconds=literal_micros(as_of))).date()
    return day_range(spark, today - timedelta(days=days), today - timedelta(days=1))


def day_range(spark: SparkSession, start: date, end: date) -> DataFrame:
    """Every day from start to end, both included; its length is fixed by the arguments."""
    return spark.sql(
        "SELECT CAST(d AS TIMESTAMP_NTZ) AS date FROM "
        f"(SELECT explode(sequence(DATE'{start}', DATE'{end}')) AS d)"
    )


def load_window(
    as_of: datetime | str, oldest_running: datetime | str | None, days: int, hours: int
) -> tuple[int, int, int]:
    """Start, end and step in microseconds of the load-history backfill."""
    now = literal_micros(as_of)
    start = now - days * GRID_MICROS["day"]
    if oldest_running is not None:
        start = max(start, literal_micros(oldest_running))
    return start, now, hours * GRID_MICROS["hour"]


def load_chunks(
    load: DataFrame,
    as_of: datetime | str,
    oldest_running: datetime | str | None = None,
    days: int = 14,
    hours: int = 8,
) -> DataFrame:
    """Load-history rows of the look-back, each with the 8-hour window that fetches it.

    The windows tile the look-back, so one range filter reads them all and the window of a
    row is plain arithmetic; nothing loops over windows.
    """
    start, now, step = load_window(as_of, oldest_running, days, hours)
    us = micros("start_time")
    offset = us - F.lit(start).cast("bigint")
    chunk = us - F.pmod(offset, F.lit(step).cast("bigint"))
    low, high = (from_micros(F.lit(v).cast("bigint")) for v in (start, now))
    return load.filter((F.col("start_time") >= low) & (F.col("start_time") < high)).select(
        "*",
        from_micros(chunk).alias("chunk_start"),
        from_micros(chunk + F.lit(step).cast("bigint")).alias("chunk_end"),
    )


def load_range(load: DataFrame) -> DataFrame:
    """First and last end time held per warehouse."""
    return load.groupBy("warehouse_name").agg(
        F.min("end_time").alias("range_min"),
        F.max("end_time").alias("range_max"),
        F.count(F.lit(1)).alias("records"),
    )

