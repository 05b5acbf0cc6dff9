"""Compute schedules: which slot is due, audits, settings to change, usage per slot.

Times of day are whole seconds; 23:59 stands for the end of the day.
"""

from __future__ import annotations

from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlight.config import SIZE_KEYWORDS
from meterlight.functions.timeops import literal_micros, to_col

LAST_MINUTE = 86_340
GRID_SECONDS = 900
MAX_SLOTS = 10


def _local(moment: datetime | str, tz: str) -> datetime:
    value = datetime.fromisoformat(moment) if isinstance(moment, str) else moment
    if value.tzinfo is None:
        value = value.replace(tzinfo=ZoneInfo("UTC"))
    return value.astimezone(ZoneInfo(tz)).replace(tzinfo=None)


def due_schedules(
    schedules: DataFrame, last_run: datetime | str, this_run: datetime | str, tz: str
) -> DataFrame:
    """The latest enabled slot per warehouse that began in (last_run, this_run].

    Both instants are read in ``tz``; slots are those of the day of ``this_run``, weekday or
    weekend. Missed runs are covered because only the latest slot counts.
    """
    last, now = _local(last_run, tz), _local(this_run, tz)
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)

    def seconds(value: datetime) -> float:
        return (literal_micros(value) - literal_micros(midnight)) / 1_000_000

    is_weekday = now.weekday() < 5
    hits = schedules.filter(
        F.col("enabled")
        & (F.col("weekday") == is_weekday)
        & (F.col("start_at") > seconds(last))
        & (F.col("start_at") <= seconds(now))
    )
    row = F.struct(*schedules.columns)
    return (
        hits.groupBy("name")
        .agg(F.max_by(row, F.struct("start_at", "id_val")).alias("_due"))
        .select("_due.*")
    )


def schedule_gaps(schedules: DataFrame) -> DataFrame:
    """Slots that break the rules of a day plan, with the reason.

    A plan starts at midnight and ends at 23:59, each slot starts where the one before ended,
    times lie on quarter hours, and there are at most ten slots per day type.
    """
    plan = Window.partitionBy("name", "weekday").orderBy("start_at", "id_val")
    whole = Window.partitionBy("name", "weekday")
    on_grid = lambda c: (F.col(c) % GRID_SECONDS == 0) | (F.col(c) == LAST_MINUTE)
    before = F.lag("finish_at").over(plan)
    checks = [
        F.when(before.isNull() & (F.col("start_at") != 0), F.lit("first slot must start at midnight")),
        F.when(
            F.lead("start_at").over(plan).isNull() & (F.col("finish_at") != LAST_MINUTE),
            F.lit("last slot must end at midnight"),
        ),
        F.when(before < F.col("start_at"), F.lit("gap before slot")),
        F.when(before > F.col("start_at"), F.lit("overlap with slot before")),
        F.when(~on_grid("start_at") | ~on_grid("finish_at"), F.lit("not on a quarter hour")),
        F.when(F.count(F.lit(1)).over(whole) > MAX_SLOTS, F.lit("too many slots")),
    ]
    checked = schedules.select(
        "name", "weekday", "id_val", "start_at", F.array_compact(F.array(*checks)).alias("_problems")
    )
    return checked.withColumn("problem", F.explode("_problems")).drop("_problems")


def usage_by_slot(slices: DataFrame, schedules: DataFrame, tz: str) -> DataFrame:
    """Queries and credit units per planned slot, by the local start time of each query.

    Queries are first summed per warehouse, day type and minute (slots begin on minutes), so
    the range join sees at most 2 880 rows per warehouse however busy it is.
    """
    local = F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col("start_time"))
    per_minute = (
        slices.withColumn("_local", local)
        .groupBy(
            F.col("warehouse_name").alias("name"),
            (F.weekday("_local") < 5).alias("weekday"),
            (F.hour("_local") * 60 + F.minute("_local")).alias("minute"),
        )
        .agg(F.count(F.lit(1)).alias("queries"), F.sum("credit_units").alias("credit_units"))
    )
    slots = schedules.select("name", "weekday", "id_val", "start_at", "finish_at", "size")
    ends = F.when(F.col("finish_at") >= LAST_MINUTE, F.lit(86_400)).otherwise(F.col("finish_at"))
    at = F.col("minute") * 60
    return (
        per_minute.join(slots, ["name", "weekday"])
        .filter((at >= F.col("start_at")) & (at < ends))
        .groupBy("name", "weekday", "id_val", "start_at", "size")
        .agg(F.sum("queries").alias("queries"), F.sum("credit_units").alias("credit_units"))
    )


def size_keyword(size: Column | str) -> Column:
    size, out = to_col(size), None
    for name, word in SIZE_KEYWORDS.items():
        cond = size == name
        out = F.when(cond, F.lit(word)) if out is None else out.when(cond, F.lit(word))
    return out


def _flag(value: Column) -> Column:
    return F.when(value, F.lit("True")).otherwise(F.lit("False"))


def _setting(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name} = "), value.cast("string"))


def schedule_changes(due: DataFrame, current: DataFrame) -> DataFrame:
    """Settings of the due slot that differ from the current ones, as text; empty if none.

    Cluster counts and policy are skipped where autoscaling is off on either side, and the
    policy 'Inherit' never changes anything.
    """
    n, c = due.alias("n"), current.alias("c")
    new, old = (lambda x: F.col(f"n.{x}")), (lambda x: F.col(f"c.{x}"))
    scaled = (new("scale_min") != 0) & (old("scale_min") != 0)
    optimized_new = new("size").contains("Snowpark")
    optimized_old = old("warehouse_size").contains("Snowpark")
    resized = new("size") != old("warehouse_size")
    parts = [
        F.when(resized, _setting("WAREHOUSE_SIZE", size_keyword(new("size")))),
        F.when(resized & optimized_new & ~optimized_old, F.lit("WAREHOUSE_TYPE = SNOWPARK-OPTIMIZED")),
        F.when(resized & ~optimized_new & optimized_old, F.lit("WAREHOUSE_TYPE = STANDARD")),
        F.when(
            new("suspend_minutes") != old("suspend_minutes"),
            _setting("AUTO_SUSPEND", new("suspend_minutes") * 60),
        ),
        F.when(new("resume") != old("resume"), _setting("AUTO_RESUME", _flag(new("resume")))),
        F.when(
            scaled & (new("scale_min") != old("scale_min")),
            _setting("MIN_CLUSTER_COUNT", new("scale_min")),
        ),
        F.when(
            scaled & (new("scale_max") != old("scale_max")),
            _setting("MAX_CLUSTER_COUNT", new("scale_max")),
        ),
        F.when(
            scaled
            & (new("warehouse_mode") != old("warehouse_mode"))
            & (new("warehouse_mode") != "Inherit"),
            _setting("SCALING_POLICY", new("warehouse_mode")),
        ),
    ]
    return n.join(c, new("name") == old("warehouse_name")).select(
        new("name").alias("name"), new("id_val").alias("id_val"), F.concat_ws(", ", *parts).alias("changes")
    )


def schedule_statement(schedules: DataFrame) -> DataFrame:
    """Adds ``statement``: all settings of a slot, cluster settings only where it autoscales."""
    scaled = (F.col("scale_min") != 0) & (F.col("scale_max") != 0)
    kind = F.when(F.col("size").contains("Snowpark"), F.lit("SNOWPARK-OPTIMIZED")).otherwise(F.lit("STANDARD"))
    parts = [
        _setting("WAREHOUSE_SIZE", size_keyword("size")),
        _setting("WAREHOUSE_TYPE", kind),
        _setting("AUTO_SUSPEND", F.col("suspend_minutes") * 60),
        _setting("AUTO_RESUME", _flag(F.col("resume"))),
        F.when(scaled, _setting("MIN_CLUSTER_COUNT", F.col("scale_min"))),
        F.when(scaled, _setting("MAX_CLUSTER_COUNT", F.col("scale_max"))),
        F.when(
            scaled & (F.col("warehouse_mode") != "Inherit"),
            _setting("SCALING_POLICY", F.col("warehouse_mode")),
        ),
    ]
    return schedules.withColumn(
        "statement", F.concat(F.lit("alter warehouse "), F.col("name"), F.lit(" set "), F.concat_ws(", ", *parts))
    )


def schedule_history(log: DataFrame) -> DataFrame:
    """Runs of the schedule task: statements, time zone and count out of the JSON output."""
    output = F.from_json(
        "output", "`statements` array<string>, `schedule timezone` string, `warehouses_updated` bigint"
    )
    return log.withColumn("_o", output).select(
        "run",
        "success",
        F.col("_o.statements").alias("statements_executed"),
        F.col("_o").getField("schedule timezone").alias("schedule_timezone"),
        F.col("_o.warehouses_updated").alias("warehouses_updated"),
    )
