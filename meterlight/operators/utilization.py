"""Compute used by queries against compute paid for, per warehouse and day or hour."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlight.config import SERVERLESS_LABEL, UNITS_PER_CREDIT, EngineConfig
from meterlight.functions.timeops import literal_micros, trunc
from meterlight.functions.warehouses import is_serverless_id, units_to_credits
from meterlight.sources.readers import day_range

CREDITS = "decimal(38,9)"


def utilization(
    slices: DataFrame, metering: DataFrame, serverless: DataFrame | None = None, grain: str = "day"
) -> DataFrame:
    """Query credits joined with metered credits, both sides kept.

    Both sides are aggregated before the join, so the full outer join moves one row per
    warehouse and period, under the name of its latest query there. Query work above the metered credits is capped at them, and the
    ratio is NULL where nothing was metered. Serverless work is metered under id -1.

    Besides the ratio the parts are kept exact for further sums: ``unloaded_units`` where the
    query side counts, ``capped_cc`` where the cap does.
    """
    used = (
        slices.filter(~is_serverless_id("warehouse_id"))
        .groupBy("st_period", "warehouse_id", "st_day" if grain == "day" else F.to_date("st_period").alias("st_day"))
        .agg(
            F.count(F.lit(1)).alias("queries_executed"),
            F.sum("credit_units").alias("units"),
            F.max(F.struct("start_time", "warehouse_name"))["warehouse_name"].alias("warehouse_name"),
        )
    )
    paid = metering.groupBy(trunc(grain, "start_time").alias("m_period"), F.col("warehouse_id").alias("m_id")).agg(
        F.sum(F.col("credits_used_compute").cast(CREDITS)).alias("loaded")
    )
    if serverless is not None:
        paid = paid.unionByName(
            serverless.groupBy(trunc(grain, "start_time").alias("m_period"))
            .agg(F.sum(F.col("credits_used").cast(CREDITS)).alias("loaded"))
            .select("m_period", F.lit(-1).cast("bigint").alias("m_id"), "loaded")
        )
    both = used.join(
        paid,
        (F.col("warehouse_id") == F.col("m_id")) & (F.col("st_period") == F.col("m_period")),
        "full",
    )
    return both.select(
        F.coalesce("st_period", "m_period").alias("period"),
        F.coalesce("warehouse_id", "m_id").alias("warehouse_id"),
        F.coalesce(
            "warehouse_name",
            F.when(F.col("m_id") == -1, F.lit(SERVERLESS_LABEL)),
            F.lit("Unknown"),
        ).alias("warehouse_name"),
        F.coalesce("queries_executed", F.lit(0)).alias("queries"),
        "units",
        F.col("loaded").cast("double").alias("loaded"),
        "st_day",
    ).transform(_ratio)


def _ratio(both: DataFrame) -> DataFrame:
    """Cap, ratio and exact parts from ``units`` and ``loaded``."""
    unloaded = units_to_credits("units")
    capped = F.coalesce(unloaded > F.col("loaded"), F.lit(False))
    unloaded_cc = (
        F.when(F.col("units").isNull(), F.lit(0.0)).when(capped, F.col("loaded")).otherwise(unloaded)
    )
    loaded_cc = F.coalesce("loaded", F.lit(0.0))
    return both.select(
        "period",
        "warehouse_id",
        "warehouse_name",
        "queries",
        unloaded_cc.alias("unloaded_cc"),
        loaded_cc.alias("loaded_cc"),
        F.when(loaded_cc != 0, unloaded_cc / loaded_cc).alias("utilization"),
        "st_day",
        F.when(capped, F.lit(0)).otherwise(F.coalesce("units", F.lit(0))).cast("bigint").alias("unloaded_units"),
        F.when(capped, F.col("loaded")).otherwise(F.lit(0.0)).cast(CREDITS).alias("capped_cc"),
    )


def total_loaded() -> Column:
    """Aggregate: metered credits, summed exactly."""
    return F.sum(F.col("loaded_cc").cast(CREDITS)).cast("double")


def total_ratio() -> Column:
    """Aggregate: used over metered credits of all rows of a group, NULL if nothing metered."""
    used = F.sum("unloaded_units").cast("double") / F.lit(float(UNITS_PER_CREDIT)) + F.sum(
        "capped_cc"
    ).cast("double")
    return F.when(total_loaded() != 0, used / total_loaded())


def in_period(start: date | str, end: date | str, column: str = "period") -> Column:
    """Whole days from start to end, both included."""
    day = F.to_date(column)
    return (day >= F.lit(str(start)).cast("date")) & (day <= F.lit(str(end)).cast("date"))


def heatmap(
    spark: SparkSession,
    util: DataFrame,
    start: date | str,
    end: date | str,
    name: str | None = None,
) -> DataFrame:
    """Utilization of every day from start to end, NULL for days without metering.

    All warehouses but the serverless pool, or the one named.
    """
    rows = util.filter(in_period(start, end) & (F.col("warehouse_name") != SERVERLESS_LABEL))
    if name is not None:
        rows = rows.filter(F.col("warehouse_name") == name)
    daily = rows.groupBy(trunc("day", "period").alias("date")).agg(total_ratio().alias("utilization"))
    spine = day_range(spark, date.fromisoformat(str(start)), date.fromisoformat(str(end)))
    return spine.join(daily, "date", "left").select(F.col("date").alias("period"), "utilization")


def recent_utilization(util: DataFrame, as_of: datetime | str, days: int = 30) -> DataFrame:
    """One row: utilization over the last ``days`` days before ``as_of``."""
    now = F.timestamp_micros(F.lit(literal_micros(as_of)).cast("bigint")).cast("timestamp_ntz")
    day = F.to_date("period").cast("timestamp_ntz")
    recent = (day >= now - F.make_dt_interval(F.lit(days))) & (day <= now)
    return util.filter(recent & (F.col("warehouse_name") != SERVERLESS_LABEL)).agg(
        total_ratio().alias("utilization")
    )


def warehouse_summary(
    util: DataFrame,
    schedules: DataFrame,
    warehouses: DataFrame,
    start: date | str,
    end: date | str,
    cfg: EngineConfig,
) -> DataFrame:
    """Per warehouse: planned size or 'variable', autoscale, spend, utilization, enabled."""
    spend = (
        util.filter(in_period(start, end))
        .groupBy("warehouse_name")
        .agg(total_loaded().alias("loaded"), total_ratio().alias("utilization"))
    )
    planned = schedules.groupBy(F.col("name").alias("warehouse_name")).agg(
        F.max("enabled").alias("enabled"),
        (F.max("scale_max") > 1).alias("autoscale"),
        F.when(F.min("size") == F.max("size"), F.min("size")).otherwise(F.lit("variable")).alias("size"),
    )
    return (
        warehouses.select("warehouse_name", F.col("warehouse_size").alias("actual_size"))
        .join(spend, "warehouse_name", "left")
        .join(planned, "warehouse_name", "left")
        .select(
            F.col("warehouse_name").alias("warehouse"),
            F.coalesce("size", "actual_size").alias("size"),
            F.coalesce("autoscale", F.lit(False)).alias("autoscale"),
            F.coalesce(F.col("loaded") * F.lit(cfg.compute_price), F.lit(0.0)).alias("spend"),
            (F.coalesce("utilization", F.lit(0.0)) * 100).alias("utilization"),
            F.coalesce("enabled", F.lit(False)).alias("enabled"),
        )
    )
