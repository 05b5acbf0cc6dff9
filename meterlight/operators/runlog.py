"""Run log of the maintenance tasks, and the status of what they keep up to date."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlight.functions.timeops import literal_ts
from meterlight.sources.schemas import TASK_LOG, schema


def last_output(log: DataFrame, task: str, obj: str) -> DataFrame:
    """One row with the output of the last good run: the input of the next one."""
    good = log.filter(F.col("success") & (F.col("task_name") == task) & (F.col("object_name") == obj))
    return good.agg(F.max_by("output", "task_start").alias("input"))


def open_row(
    spark: SparkSession, log: DataFrame, task: str, obj: str, run_id: str, query_id: str, as_of: datetime | str
) -> DataFrame:
    """The row a starting task adds; it carries the range of the run before."""
    field = lambda name: F.get_json_object("input", f"$.{name}").cast("timestamp_ntz")
    row = last_output(log, task, obj).select(
        literal_ts(as_of).alias("task_start"),
        F.lit(None).cast("boolean").alias("success"),
        F.lit(task).alias("task_name"),
        F.lit(obj).alias("object_name"),
        "input",
        F.lit(None).cast("string").alias("output"),
        F.lit(None).cast("timestamp_ntz").alias("task_finish"),
        F.lit(run_id).alias("task_run_id"),
        F.lit(query_id).alias("query_id"),
        field("range_min").alias("range_min"),
        field("range_max").alias("range_max"),
    )
    return row.select(*schema(TASK_LOG).fieldNames())


def close_row(log: DataFrame, task: str, obj: str, run_id: str, output: str, as_of: datetime | str) -> DataFrame:
    """The log after a task finished; it succeeded unless its output holds SQLERRM."""
    mine = (F.col("task_run_id") == run_id) & (F.col("task_name") == task) & (F.col("object_name") == obj)
    out = F.lit(output)
    updates = {
        "success": F.get_json_object(out, "$.SQLERRM").isNull(),
        "output": out,
        "task_finish": literal_ts(as_of),
        "range_min": F.get_json_object(out, "$.range_min").cast("timestamp_ntz"),
        "range_max": F.get_json_object(out, "$.range_max").cast("timestamp_ntz"),
    }
    return log.withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in updates.items()})


def _outcome(output: Column, as_of: datetime | str, prefix: str = "") -> dict[str, Column]:
    """What a run's output says about it; it succeeded unless that holds SQLERRM."""
    field = lambda name: F.get_json_object(output, f"$.{name}").cast("timestamp_ntz")
    return {
        "success": F.get_json_object(output, "$.SQLERRM").isNull(),
        "output": output,
        "task_finish": literal_ts(as_of),
        "range_min": field(f"{prefix}range_min"),
        "range_max": field(f"{prefix}range_max"),
    }


def start_runs(log: DataFrame, runs: DataFrame, as_of: datetime | str) -> DataFrame:
    """The rows that starting tasks add, from ``runs`` (task_name, object_name, task_run_id, query_id).

    The input of each is the output of the last good run of its task and object, one
    aggregate for all; a first run has none. They carry the range of that run.
    """
    names = ["task_name", "object_name"]
    good = log.filter("success").groupBy(*names).agg(F.max_by("output", F.struct("task_start", "task_run_id")).alias("input"))
    field = lambda name: F.get_json_object("input", f"$.{name}").cast("timestamp_ntz")
    rows = runs.join(good, names, "left").withColumns(
        {
            "task_start": literal_ts(as_of),
            "success": F.lit(None).cast("boolean"),
            "output": F.lit(None).cast("string"),
            "task_finish": F.lit(None).cast("timestamp_ntz"),
            "range_min": field("range_min"),
            "range_max": field("range_max"),
        }
    )
    return rows.select(*schema(TASK_LOG).fieldNames())


def finish_runs(log: DataFrame, results: DataFrame, as_of: datetime | str) -> DataFrame:
    """The log after runs finished, from ``results`` (task_run_id, task_name, object_name, output)."""
    keys = ["task_run_id", "task_name", "object_name"]
    done = log.join(results.select(*keys, F.col("output").alias("_output"), F.lit(True).alias("_done")), keys, "left")
    new = _outcome(F.col("_output"), as_of)
    return done.select(*[F.when(F.col("_done"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in log.columns])


def split_event_runs(log: DataFrame, results: DataFrame, as_of: datetime | str) -> DataFrame:
    """Extra log rows of event runs, from ``results`` (task_run_id, output): one for cluster and one for
    warehouse sessions, each with its own range."""
    base = log.filter(F.col("object_name") == "WAREHOUSE_EVENTS_HISTORY")
    rows = base.join(results.select("task_run_id", F.col("output").alias("_output")), "task_run_id")
    split = rows.withColumn("_kind", F.explode(F.array(F.lit("cluster"), F.lit("warehouse"))))
    cluster, warehouse = (_outcome(F.col("_output"), as_of, f"{kind}_") for kind in ("cluster", "warehouse"))
    mine = {c: F.when(F.col("_kind") == "cluster", cluster[c]).otherwise(warehouse[c]) for c in cluster}
    mine["object_name"] = F.concat(F.upper("_kind"), F.lit("_SESSIONS"))
    return split.select(*[mine[c].alias(c) if c in mine else F.col(c) for c in log.columns])


def close_stale(
    log: DataFrame,
    history: DataFrame,
    as_of: datetime | str,
    task: str | None = None,
    obj: str | None = None,
) -> DataFrame:
    """The log with open rows closed as failed, with the whole history row of their query as details.

    Only the last day of the history is searched, and only the queries of open rows go on from
    there. Open rows without a query id stay open. Every open row is closed unless a task and
    object are named.
    """
    stale = F.col("success").isNull() & F.col("query_id").isNotNull()
    if task is not None:
        stale = stale & (F.col("task_name") == task)
    if obj is not None:
        stale = stale & (F.col("object_name") == obj)
    open_log = log.filter(stale)
    recent = history.filter(F.col("start_time") > literal_ts(as_of) - F.expr("INTERVAL 1 DAY"))
    recent = recent.join(open_log.select("query_id").distinct(), "query_id", "left_semi")
    fields = [F.col(c).alias(c.upper()) for c in history.columns]
    details = recent.select("query_id", F.to_json(F.struct(F.lit(True).alias("FORCE_CLOSED"), *fields)).alias("_found"))
    message = F.concat(
        F.lit("Could not find query history for task="), "task_name",
        F.lit(", object="), "object_name",
        F.lit(", task_run_id="), "task_run_id",
        F.lit(", query_id="), "query_id",
    )
    missing = F.to_json(F.struct(F.lit(True).alias("FORCE_CLOSED"), message.alias("details")))
    open_rows = open_log.join(details, "query_id", "left").withColumns(
        {
            "success": F.lit(False),
            "output": F.coalesce("_found", missing),
            "task_finish": literal_ts(as_of),
        }
    )
    rest = log.filter(~F.coalesce(stale, F.lit(False)))
    return rest.unionByName(open_rows.select(*log.columns))


# Published view, the task and object that keep it, and the period in minutes.
TASK_TABLES = (
    ("REPORTING", "DBT_HISTORY", "QUERY_HISTORY_MAINTENANCE", "QUERY_HISTORY", 60),
    ("REPORTING", "ENRICHED_QUERY_HISTORY", "QUERY_HISTORY_MAINTENANCE", "QUERY_HISTORY", 60),
    ("REPORTING", "ENRICHED_QUERY_HISTORY_DAILY", "QUERY_HISTORY_MAINTENANCE", "QUERY_HISTORY", 60),
    ("REPORTING", "ENRICHED_QUERY_HISTORY_HOURLY", "QUERY_HISTORY_MAINTENANCE", "QUERY_HISTORY", 60),
    ("REPORTING", "LABELED_QUERY_HISTORY", "QUERY_HISTORY_MAINTENANCE", "QUERY_HISTORY", 60),
    ("REPORTING", "WAREHOUSE_DAILY_UTILIZATION", "QUERY_HISTORY_MAINTENANCE", "QUERY_HISTORY", 60),
    ("REPORTING", "WAREHOUSE_HOURLY_UTILIZATION", "QUERY_HISTORY_MAINTENANCE", "QUERY_HISTORY", 60),
    ("REPORTING", "HYBRID_TABLE_USAGE_HISTORY", "SIMPLE_DATA_EVENTS_MAINTENANCE", "HYBRID_TABLE_USAGE_HISTORY", 720),
    ("REPORTING", "LOGIN_HISTORY", "SIMPLE_DATA_EVENTS_MAINTENANCE", "LOGIN_HISTORY", 720),
    ("REPORTING", "MATERIALIZED_VIEW_REFRESH_HISTORY", "SIMPLE_DATA_EVENTS_MAINTENANCE", "MATERIALIZED_VIEW_REFRESH_HISTORY", 720),
    ("REPORTING", "SERVERLESS_TASK_HISTORY", "SIMPLE_DATA_EVENTS_MAINTENANCE", "SERVERLESS_TASK_HISTORY", 720),
    ("REPORTING", "SESSIONS", "SIMPLE_DATA_EVENTS_MAINTENANCE", "SESSIONS", 720),
    ("REPORTING", "TASK_HISTORY", "SIMPLE_DATA_EVENTS_MAINTENANCE", "TASK_HISTORY", 720),
    ("REPORTING", "WAREHOUSE_METERING_HISTORY", "SIMPLE_DATA_EVENTS_MAINTENANCE", "WAREHOUSE_METERING_HISTORY", 720),
    ("REPORTING", "CLUSTER_SESSIONS", "WAREHOUSE_EVENTS_MAINTENANCE", "CLUSTER_SESSIONS", 60),
    ("REPORTING", "CLUSTER_SESSIONS_DAILY", "WAREHOUSE_EVENTS_MAINTENANCE", "CLUSTER_SESSIONS", 60),
    ("REPORTING", "CLUSTER_SESSIONS_HOURLY", "WAREHOUSE_EVENTS_MAINTENANCE", "CLUSTER_SESSIONS", 60),
    ("REPORTING", "WAREHOUSE_SESSIONS", "WAREHOUSE_EVENTS_MAINTENANCE", "WAREHOUSE_SESSIONS", 60),
    ("REPORTING", "WAREHOUSE_SESSIONS_DAILY", "WAREHOUSE_EVENTS_MAINTENANCE", "WAREHOUSE_SESSIONS", 60),
    ("REPORTING", "WAREHOUSE_SESSIONS_HOURLY", "WAREHOUSE_EVENTS_MAINTENANCE", "WAREHOUSE_SESSIONS", 60),
    ("REPORTING", "WAREHOUSE_LOAD_HISTORY", "WAREHOUSE_LOAD_MAINTENANCE", None, 420),
)


def _latest(log: DataFrame) -> DataFrame:
    """Last run per task, object, kind and state; a map-side aggregate instead of a sort."""
    status = F.when(F.col("success"), F.lit("SUCCESS")).when(~F.col("success"), F.lit("FAILURE"))
    runs = log.select(
        "task_name", "object_name", "task_start", "task_finish", "query_id", "range_min", "range_max",
        status.alias("status"),
        F.col("input").isNull().alias("full"),
        F.col("success").isNull().alias("running"),
        F.get_json_object("output", "$.SQLERRM").alias("error_message"),
    )
    keys = ["task_name", "object_name", "full", "running"]
    row = F.struct(*[c for c in runs.columns if c not in keys])
    return (
        runs.groupBy(*keys)
        .agg(F.max_by(row, F.struct("task_start", "query_id")).alias("_r"))
        .select(*keys, "_r.*")
    )


def materialization_status(spark: SparkSession, log: DataFrame, as_of: datetime | str) -> DataFrame:
    """Per published view: range held, last full and incremental run, and the next run.

    An incremental run counts only if it began after a full run that succeeded.
    """
    last = _latest(log)
    full, running = F.col("full"), F.col("running")

    def pick(cond: Column, column: str) -> Column:
        return F.max(F.when(cond, F.col(column)))

    details = {
        "start": "task_start", "end": "task_finish", "status": "status",
        "error_message": "error_message", "query_id": "query_id",
    }
    aggs = [
        F.coalesce(pick(~full, "range_min"), pick(full, "range_min")).alias("range_start"),
        F.coalesce(pick(~full, "range_max"), pick(full, "range_max")).alias("range_end"),
        pick(~running, "task_start").alias("last_start"),
        pick(running, "task_start").alias("running_start"),
        pick(running, "query_id").alias("running_query_id"),
        F.max(F.when(running, F.when(full, F.lit("FULL")).otherwise(F.lit("INCREMENTAL")))).alias("running_type"),
    ]
    for out, column in details.items():
        aggs.append(pick(full & ~running, column).alias(f"last_full_{out}"))
        aggs.append(pick(~full & ~running, column).alias(f"_incr_{out}"))
    summary = last.groupBy("task_name", "object_name").agg(*aggs)
    valid = (F.col("_incr_start") > F.col("last_full_end")) & (F.col("last_full_status") == "SUCCESS")
    summary = summary.withColumns(
        {f"last_incr_{out}": F.when(valid, F.col(f"_incr_{out}")) for out in details}
    )

    tables = spark.createDataFrame(
        list(TASK_TABLES), "user_schema string, user_view string, t string, o string, period int"
    )
    # The load task keeps one object per warehouse, so its view lists all of them.
    matches = (F.col("t") == F.col("task_name")) & (
        (F.col("t") == "WAREHOUSE_LOAD_MAINTENANCE") | (F.col("o") == F.col("object_name"))
    )
    planned = F.coalesce("last_start", literal_ts(as_of)) + F.make_dt_interval(mins=F.col("period"))
    good_full = F.coalesce(F.col("last_full_status") == "SUCCESS", F.lit(False))
    return tables.join(summary, matches, "left").select(
        "user_schema",
        "user_view",
        F.col("object_name").alias("partition"),
        "range_start",
        "range_end",
        *[f"last_full_{out}" for out in details],
        *[f"last_incr_{out}" for out in details],
        F.coalesce("running_start", planned).alias("next_start"),
        F.coalesce(
            "running_type", F.when(good_full, F.lit("INCREMENTAL")).otherwise(F.lit("FULL"))
        ).alias("next_type"),
        F.when(F.col("running_type").isNotNull(), F.lit("EXECUTING")).otherwise(F.lit("SCHEDULED")).alias("next_status"),
        F.col("running_query_id").alias("next_query_id"),
    )


def freshness(history: DataFrame, log: DataFrame) -> DataFrame:
    """One row: first and last query held, and the last good start of both main tasks."""

    def last_start(task: str, name: str) -> Column:
        good = F.coalesce("success", F.lit(False)) & (F.col("task_name") == task)
        return F.max(F.when(good, F.col("task_start"))).alias(name)

    held = history.agg(F.min("start_time").alias("range_min"), F.max("start_time").alias("range_max"))
    runs = log.agg(
        last_start("QUERY_HISTORY_MAINTENANCE", "queries_start"),
        last_start("WAREHOUSE_EVENTS_MAINTENANCE", "events_start"),
    )
    both = held.unionByName(runs, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
