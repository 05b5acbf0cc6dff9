"""Reports: the questions asked of the datasets, each one DataFrame."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlight.config import DEFAULT, EngineConfig
from meterlight.functions.durations import friendly_duration, friendly_duration_ordinal
from meterlight.functions.grades import (
    SIZE_GRADES,
    SPILL_GRADES,
    TIME_GRADES,
    bytes_level,
    rows_level,
    run_time_grade,
    size_grade,
    spill_grade,
)
from meterlight.functions.tags import tag_exists, tag_value
from meterlight.functions.timeops import boundaries, floor_micros, literal_ts, micros, trunc
from meterlight.functions.warehouses import is_serverless_id, total_cost, units_to_credits
from meterlight.operators.labels import OTHER
from meterlight.operators.ordered import neighbour
from meterlight.operators.utilization import in_period, total_loaded, total_ratio
from meterlight.sources.readers import day_range

UUID_PATTERN = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def trunc_unit(start: date | str, end: date | str) -> str:
    """Reports over more than 31 days are monthly, others daily."""
    days = (date.fromisoformat(str(end)[:10]) - date.fromisoformat(str(start)[:10])).days
    return "month" if days > 31 else "day"


def report_filter(
    df: DataFrame, start: str, end: str, names: list[str] | None = None, column: str = "start_time"
) -> DataFrame:
    """Rows between two instants, of the named warehouses or of all."""
    at = F.col(column)
    rows = df.filter((at >= literal_ts(start)) & (at <= literal_ts(end)))
    return rows.filter(F.col("warehouse_name").isin(names)) if names else rows


def cost_utilization(
    util: DataFrame, start: str, end: str, names: list[str] | None = None, cfg: EngineConfig = DEFAULT
) -> DataFrame:
    """Cost of metered compute and utilization per day or month."""
    rows = report_filter(util, start, end, names, "period")
    return rows.groupBy(trunc(trunc_unit(start, end), "period").alias("dt")).agg(
        (total_loaded() * F.lit(cfg.compute_price)).alias("cost"), total_ratio().alias("utilization")
    )


def session_durations(
    sessions: DataFrame, start: str, end: str, names: list[str] | None = None
) -> DataFrame:
    """Number of warehouse sessions per duration bucket."""
    rows = report_filter(sessions, start, end, names, "st")
    return rows.groupBy(
        friendly_duration("duration").alias("duration"), friendly_duration_ordinal("duration").alias("ord")
    ).agg(F.count(F.lit(1)).alias("cnt"))


def session_gaps(
    sessions: DataFrame, start: str, end: str, names: list[str] | None = None, chunk: str = "day"
) -> DataFrame:
    """Number of sessions per bucket of the time since the previous session start.

    The first session of a warehouse has no gap and falls in the longest bucket. Neighbours
    are found per day of a warehouse, so a busy warehouse is not sorted in one task.
    """
    rows = sessions.select("warehouse_id", "warehouse_name", "st", "session_id")
    rows = rows.withColumn("_chunk", floor_micros(micros("st"), chunk))
    rows = neighbour(rows, ["warehouse_id"], ["st", "session_id"], ["st"], step=-1)
    gap = boundaries("second", "_near.st", "st") * 1000
    rows = report_filter(rows.withColumn("gap", gap), start, end, names, "st")
    return rows.groupBy(
        friendly_duration("gap").alias("duration"), friendly_duration_ordinal("gap").alias("ord")
    ).agg(F.count(F.lit(1)).alias("cnt"))


def users_per_warehouse_day(
    daily: DataFrame, start: str, end: str, names: list[str] | None = None, approximate: bool = False
) -> DataFrame:
    """Distinct users per warehouse and day, exact unless asked otherwise."""
    rows = report_filter(daily, start, end, names, "st_period")
    count = F.approx_count_distinct if approximate else F.countDistinct
    return rows.groupBy("warehouse_id", "warehouse_name", "st_period").agg(
        count("user_name").alias("cnt")
    )


def top_spenders(
    labeled: DataFrame,
    start: str,
    end: str,
    names: list[str] | None = None,
    where: Column | None = None,
    cfg: EngineConfig = DEFAULT,
) -> DataFrame:
    """Cost and number of queries per user, dearest first."""
    rows = report_filter(labeled, start, end, names)
    if where is not None:
        rows = rows.filter(where)
    return (
        rows.groupBy("user_name")
        .agg(total_cost("credit_units", "warehouse_id", cfg).alias("cst"), F.count(F.lit(1)).alias("queries"))
        .filter(F.col("cst").isNotNull())
        .orderBy(F.desc("cst"), "user_name")
    )


def _costly(labeled: DataFrame, start: str, end: str, names: list[str] | None) -> DataFrame:
    rows = report_filter(labeled, start, end, names)
    return rows.filter(F.col("query_parameterized_hash").isNotNull() & (F.col("cost") > 0))


def recurring_share(
    labeled: DataFrame,
    start: str,
    end: str,
    names: list[str] | None = None,
    more_than: int = 100,
    cfg: EngineConfig = DEFAULT,
) -> DataFrame:
    """Cost and count of hashes run often within a week, against the rest.

    Weeks are calendar weeks that start on Monday; year and week number taken separately
    would split or merge weeks around New Year.
    """
    per_week = (
        _costly(labeled, start, end, names)
        .groupBy("query_parameterized_hash", trunc("week", "end_time").alias("week"))
        .agg(
            F.sum("credit_units").alias("units"),
            F.sum(F.when(is_serverless_id("warehouse_id"), F.col("credit_units")).otherwise(0)).alias("other"),
            F.count(F.lit(1)).alias("cnt"),
        )
    )
    compute = F.sum(F.col("units") - F.col("other")).cast("double") * F.lit(cfg.compute_price)
    serverless = F.sum("other").cast("double") * F.lit(cfg.serverless_price)
    bucket = F.when(F.col("cnt") > more_than, F.lit("Reoccurring")).otherwise(F.lit("ad-hoc"))
    return per_week.groupBy(bucket.alias("bucket")).agg(
        units_to_credits(compute + serverless).alias("cost"), F.sum("cnt").alias("count")
    )


def top_repeated(
    labeled: DataFrame,
    start: str,
    end: str,
    names: list[str] | None = None,
    by: str = "count",
    n: int = 100,
    cfg: EngineConfig = DEFAULT,
) -> DataFrame:
    """The ``n`` hashes with the largest count, cost or cost_per_query, with a sample text.

    Sorted on the numbers, not on their formatted text; equal numbers by hash. The aggregate
    over all rows carries numbers only. Ids and texts are looked at again for the ``n``
    winners, found by a broadcast of their hashes: the text of the smallest query id.
    """
    rows = _costly(labeled, start, end, names)
    cost = total_cost("credit_units", "warehouse_id", cfg)
    top = (
        rows.groupBy("query_parameterized_hash")
        .agg(
            cost.alias("cost"),
            F.count(F.lit(1)).alias("count"),
            F.max(F.length("query_text")).alias("_length"),
        )
        .filter(F.col("_length") > 0)
        .withColumn("cost_per_query", F.col("cost") / F.col("count"))
        .orderBy(F.desc(by), "query_parameterized_hash")
        .limit(n)
        .drop("_length")
    )
    wanted = rows.filter(F.length("query_text") > 0).join(
        F.broadcast(top.select("query_parameterized_hash")), "query_parameterized_hash", "left_semi"
    )
    samples = wanted.groupBy("query_parameterized_hash").agg(
        F.min("query_id").alias("query_id"), F.min_by("query_text", "query_id").alias("query_text")
    )
    return samples.join(F.broadcast(top), "query_parameterized_hash").select(
        "query_id", "query_text", "query_parameterized_hash", "cost", "count", "cost_per_query"
    )


def topn_other(
    df: DataFrame,
    n: int,
    value: str,
    group: str,
    keys: list[str] | None = None,
    sums: list[str] | None = None,
) -> DataFrame:
    """Sums with all but the ``n`` groups of the largest ``value`` folded into 'Other'.

    ``sums`` are the columns added up, ``value`` alone by default. ``df`` is an aggregate; the
    ranking is a top-n of it and its ``n`` rows are broadcast.
    """
    keys = keys or []
    top = (
        df.groupBy(group)
        .agg(F.sum(value).alias("_total"))
        .orderBy(F.desc("_total"), group)
        .limit(n)
        .select(F.col(group).alias("_name"), F.lit(True).alias("_top"))
    )
    folded = df.join(F.broadcast(top), F.col(group).eqNullSafe(F.col("_name")), "left")
    name = F.when(F.col("_top"), F.col(group)).otherwise(F.lit(OTHER))
    return (
        folded.withColumn(group, name)
        .groupBy(group, *keys)
        .agg(*[F.sum(c).alias(c) for c in sums or [value]])
    )


def query_activity(
    labeled: DataFrame,
    group: str,
    start: str,
    end: str,
    names: list[str] | None = None,
    cfg: EngineConfig = DEFAULT,
) -> DataFrame:
    """Cost and number of queries per date and group, the input of the top-n charts."""
    rows = report_filter(labeled, start, end, names)
    return rows.groupBy(
        trunc(trunc_unit(start, end), "start_time").alias("date"), F.col(group).alias("group")
    ).agg(
        F.sum("credit_units").alias("credit_units"),
        (units_to_credits(F.sum("credit_units")) * F.lit(cfg.compute_price)).alias("cost"),
        F.count(F.lit(1)).alias("queries"),
    )


def weekly_heatmap(
    spark: SparkSession, util: DataFrame, start: date | str, end: date | str, names: list[str] | None = None
) -> DataFrame:
    """Utilization in percent per day of whole weeks, NULL for days without data."""
    first, last = date.fromisoformat(str(start)), date.fromisoformat(str(end))
    low = first - timedelta(days=first.weekday())
    high = last - timedelta(days=last.weekday()) + timedelta(days=6)
    rows = util.filter(in_period(low, high))
    if names:
        rows = rows.filter(F.col("warehouse_name").isin(names))
    daily = rows.groupBy(trunc("day", "period").alias("date")).agg(total_ratio().alias("u"))
    return day_range(spark, low, high).join(daily, "date", "left").select(
        F.col("date").alias("period"),
        F.extract(F.lit("YEAROFWEEK"), "date").alias("year"),
        F.weekofyear("date").alias("week"),
        F.date_format("date", "EEEE").alias("weekday"),
        F.round(F.col("u") * 100, 1).alias("utilization"),
    )


WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def heatmap_grid(weekly: DataFrame) -> DataFrame:
    """One row per ISO week, one column per weekday."""
    return weekly.groupBy("year", "week").pivot("weekday", list(WEEKDAYS)).agg(F.first("utilization"))


def dbt_history(labeled: DataFrame) -> DataFrame:
    """Queries of dbt runs with grades and the fields of their tags."""

    def tag(key: str) -> Column:
        return tag_value("qtag_filter", "dbt", key)

    def either(key: str) -> Column:
        return F.coalesce(tag(key), tag_value("qtag_filter", "undefined", key))

    passed = (
        "query_text", "query_id", "cost", "start_time", "warehouse_name", "warehouse_size",
        "warehouse_id", "user_name", "total_elapsed_time", "end_time", "qtag", "st_day", "query_type",
    )
    plain = ("invocation_id", "materialized", "node_name", "target_schema", "target_database", "project_name")
    return labeled.filter(tag_exists("qtag_filter", "dbt", "invocation_id")).select(
        *passed,
        *_grades(),
        *[tag(k).alias(k) for k in plain],
        either("full_refresh").alias("full_refresh"),
        either("which").alias("which"),
        tag("node_refs").alias("node_refs"),
    )


def _grades() -> list[Column]:
    return [
        run_time_grade("total_elapsed_time").alias("run_time_grade"),
        size_grade(
            rows_level(F.coalesce("rows_produced", F.lit(0))), bytes_level("bytes_written_to_result")
        ).alias("size_grade"),
        spill_grade("bytes_spilled_to_local_storage", "bytes_spilled_to_remote_storage").alias(
            "efficiency_grade"
        ),
    ]


def dbt_models(
    labeled: DataFrame, start: str, end: str, names: list[str] | None = None
) -> DataFrame:
    """Model runs: model id and run id from the tags of one query.

    The tags node_id and invocation_id are paired by name within the row, so nothing is
    exploded or sorted; a model without a run is 'Unknown', and run ids are not models.
    """
    rows = report_filter(labeled, start, end, names).filter(F.col("cost").isNotNull())

    def last(key: str) -> Column:
        own = F.filter("qtag", lambda t: (t["SOURCE"] == "dbt") & (t["KEY"] == key))
        return F.try_element_at(own, F.lit(-1))["VALUE"]

    return (
        rows.withColumns({"model_id": last("node_id"), "run_id": last("invocation_id")})
        .filter(F.col("model_id").isNotNull() & ~F.col("model_id").rlike(UUID_PATTERN))
        .select(
            trunc(trunc_unit(start, end), "start_time").alias("date"),
            "start_time",
            "query_id",
            "cost",
            "credit_units",
            "warehouse_id",
            F.regexp_replace("model_id", '"', "").alias("model_id"),
            F.coalesce("run_id", F.lit("Unknown")).alias("run_id"),
            *_grades(),
        )
    )


def dbt_cost(models: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Cost and number of distinct runs per date."""
    return models.groupBy("date").agg(
        total_cost("credit_units", "warehouse_id", cfg).alias("cost"),
        F.countDistinct("run_id").alias("runs"),
    )


def dbt_model_cost(
    models: DataFrame, n: int = 20, at_least: float = 0.5, cfg: EngineConfig = DEFAULT
) -> DataFrame:
    """Cost per model above a threshold, all but the ``n`` dearest folded into 'Other'.

    The work of both price classes is folded and priced at the end, so 'Other' is exact.
    """
    serverless = is_serverless_id("warehouse_id")
    per_model = (
        models.groupBy("model_id")
        .agg(
            total_cost("credit_units", "warehouse_id", cfg).alias("cost"),
            F.sum(F.when(serverless, 0).otherwise(F.col("credit_units"))).alias("_compute"),
            F.sum(F.when(serverless, F.col("credit_units")).otherwise(0)).alias("_serverless"),
        )
        .filter(F.col("cost") > at_least)
    )
    folded = topn_other(per_model, n, "cost", "model_id", sums=["_compute", "_serverless"])
    price = F.col("_compute").cast("double") * F.lit(cfg.compute_price) + F.col("_serverless").cast(
        "double"
    ) * F.lit(cfg.serverless_price)
    return folded.select("model_id", units_to_credits(price).alias("cost"))


def dbt_trend(models: DataFrame, n: int = 10) -> DataFrame:
    """Latest grade of each model and the direction of its last ``n`` runs.

    The sum of differences of grade positions is the last minus the first, so only the ends
    of the last ``n`` runs matter. The row_number filter is applied before the shuffle too
    (at most ``n`` rows per model and task), so a model with very many runs does no harm.
    """
    order = ["date", "start_time", "query_id"]
    latest = Window.partitionBy("model_id").orderBy(*[F.desc(c) for c in order])
    recent = models.withColumn("_rn", F.row_number().over(latest)).filter(F.col("_rn") <= n)
    grades = {
        "size": ("size_grade", SIZE_GRADES),
        "run_time": ("run_time_grade", TIME_GRADES),
        "efficiency": ("efficiency_grade", SPILL_GRADES),
    }
    rank = F.struct(*order)
    aggs = []
    for name, (column, scale) in grades.items():
        code = F.array_position(F.array(*[F.lit(g) for g in scale]), F.col(column))
        aggs.append(F.max_by(column, rank).alias(f"{name}_grade"))
        aggs.append((F.max_by(code, rank) - F.min_by(code, rank)).alias(f"_{name}"))
    out = recent.groupBy("model_id").agg(*aggs)
    arrow = lambda c: F.when(F.col(c) < 0, "⬇️").when(F.col(c) > 0, "⬆️").otherwise("➖")
    return out.select(
        "model_id",
        *[f"{name}_grade" for name in grades],
        *[arrow(f"_{name}").alias(f"{name}_trend") for name in grades],
    )


def query_list(
    labeled: DataFrame,
    start: str,
    end: str,
    names: list[str] | None = None,
    n: int = 1000,
    cfg: EngineConfig = DEFAULT,
) -> DataFrame:
    """The first ``n`` queries of a period with their cost, ordered so that it is stable."""
    rows = report_filter(labeled, start, end, names)
    return (
        rows.orderBy("start_time", "query_id")
        .limit(n)
        .select(
            "start_time",
            "query_id",
            "user_name",
            "query_text",
            "duration",
            "execution_status",
            (units_to_credits("credit_units") * F.lit(cfg.compute_price)).alias("cost"),
        )
    )
