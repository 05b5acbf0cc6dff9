"""Sessions, utilization and the sources beside the query history."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlight.config import DEFAULT
from meterlight.operators import sessions as ses
from meterlight.operators import utilization as util
from meterlight.plans import history as h
from meterlight.plans import oracle_base as o
from meterlight.plans.registry import register
from meterlight.sources import adapters, proxy, readers, schemas

AS_OF = o.AS_OF_EVENTS


def session_rows(spark, d):
    return ses.sessions(adapters.warehouse_events(spark, d), AS_OF, tie="event_id")


def session_slices(spark, d):
    return ses.session_slices(session_rows(spark, d))


def utilization_day(spark, d):
    return util.utilization(
        h.daily(spark, d), adapters.metering(spark, d), adapters.serverless_tasks(spark, d), "day"
    )


def utilization_hour(spark, d):
    return util.utilization(h.hourly(spark, d), adapters.metering(spark, d), None, "hour")


def id_text(df):
    return df.withColumn("session_id", F.col("session_id").cast("string"))


@register(
    "src_warehouse_events",
    o.with_(o.EVENTS)
    + """SELECT ts AS timestamp, warehouse_id, warehouse_name, cluster_number,
  CASE event WHEN 1 THEN 'RESUME_WAREHOUSE' WHEN 2 THEN 'RESUME_CLUSTER' WHEN 3 THEN 'SUSPEND_CLUSTER'
    WHEN 4 THEN 'SUSPEND_WAREHOUSE' ELSE 'RESIZE_WAREHOUSE' END AS event_name FROM ev""",
)
def src_warehouse_events(spark, d):
    full = readers.conform(adapters.warehouse_events(spark, d), schemas.WAREHOUSE_EVENTS)
    return full.select("timestamp", "warehouse_id", "warehouse_name", "cluster_number", "event_name")


@register(
    "src_metering",
    o.with_(o.METERING)
    + """SELECT warehouse_id, warehouse_name, CAST(start_time AS DATE) AS day, sum(compute) AS compute,
  CAST(sum(cloud_milli) AS DOUBLE) / CAST(1000 AS DOUBLE) AS cloud, count(*) AS hours FROM mt GROUP BY ALL""",
)
def src_metering(spark, d):
    full = readers.conform(adapters.metering(spark, d), schemas.METERING)
    return full.groupBy("warehouse_id", "warehouse_name", F.to_date("start_time").alias("day")).agg(
        F.sum("credits_used_compute").cast("double").alias("compute"),
        F.sum("credits_used_cloud_services").cast("double").alias("cloud"),
        F.count(F.lit(1)).alias("hours"),
    )


@register(
    "src_load_history",
    o.with_(o.LOAD)
    + "SELECT start_time, end_time, warehouse_id, warehouse_name, avg_running, avg_queued_load, avg_blocked FROM ld",
)
def src_load_history(spark, d):
    full = readers.conform(adapters.load_history(spark, d), schemas.LOAD_HISTORY)
    return full.select(
        "start_time", "end_time", "warehouse_id", "warehouse_name",
        *[F.col(c).cast("double").alias(c) for c in ("avg_running", "avg_queued_load", "avg_blocked")],
    )


@register(
    "src_live_queries",
    o.with_(o.QH)
    + """SELECT query_id, user_name, warehouse_name, query_type, start_time, bytes_scanned FROM qh
WHERE execution_status = 'RUNNING'""",
)
def src_live_queries(spark, d):
    live = readers.conform(adapters.query_history(spark, d), schemas.LIVE_QUERIES)
    return live.filter(F.col("execution_status") == "RUNNING").select(
        "query_id", "user_name", "warehouse_name", "query_type", "start_time", "bytes_scanned"
    )


@register("src_users_active", o.with_(o.USERS) + "SELECT name, email FROM us WHERE deleted_on IS NULL")
def src_users_active(spark, d):
    return readers.active_users(readers.conform(adapters.users(spark, d), schemas.USERS))


@register(
    "src_serverless_tasks",
    o.with_(o.QH, o.SERVERLESS)
    + "SELECT start_time, end_time, CAST(credits_used AS DOUBLE) AS credits_used, task_id, task_name FROM sv",
)
def src_serverless_tasks(spark, d):
    full = readers.conform(adapters.serverless_tasks(spark, d), schemas.SERVERLESS_TASKS)
    return full.select(
        "start_time", "end_time", F.col("credits_used").cast("double").alias("credits_used"),
        "task_id", "task_name",
    )


@register(
    "src_storage_metrics",
    """SELECT p_partkey AS id, 'table_' || p_partkey AS table_name, CAST(p_size AS BIGINT) * 1000000 AS active_bytes,
  CAST(p_size AS BIGINT) % 7 * 1000 AS time_travel_bytes, CAST(NULL AS BIGINT) AS clone_group_id, p_partkey % 10 = 0 AS deleted FROM part""",
)
def src_storage_metrics(spark, d):
    raw = adapters.table(spark, d, "part").selectExpr(
        "p_partkey AS id", "concat('table_', p_partkey) AS table_name",
        "cast(p_size AS bigint) * 1000000 AS active_bytes", "p_size % 7 * 1000 AS time_travel_bytes",
        "p_partkey % 10 = 0 AS deleted",
    )
    return readers.conform(raw, schemas.STORAGE_METRICS).select(
        "id", "table_name", "active_bytes", "time_travel_bytes", "clone_group_id", "deleted"
    )


@register(
    "settled_source",
    o.with_(o.QH)
    + "SELECT query_id, end_time FROM qh WHERE end_time < TIMESTAMP '2000-01-01 00:00:00' - INTERVAL 180 MINUTE",
)
def settled_source(spark, d):
    q = adapters.query_history(spark, d).select("query_id", "end_time")
    return readers.settled_source(q, "QUERY_HISTORY", "2000-01-01 00:00:00")


@register(
    "proxy_query_history",
    """SELECT 'q' || o_orderkey AS query_id, 'p' || o_orderkey AS proxy_query_id, 'user_' || o_custkey % 40 AS user_name,
  o_orderdate + to_microseconds(o_orderkey) AS proxy_start_time,
  o_orderdate + to_microseconds(o_orderkey + 1500) AS submission_time,
  CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate + to_microseconds(o_orderkey * 1000 + 2500) END AS end_time,
  CASE WHEN o_orderkey % 20 <> 1 THEN '["a' || o_orderkey % 4 || '"]' END AS actions_executed,
  CASE WHEN o_orderkey % 20 <> 1 THEN o_orderkey % 2 = 0 END AS schema_only_request FROM orders""",
)
def proxy_query_history(spark, d):
    return proxy.proxy_log(adapters.proxy_raw(spark, d))


@register(
    "tenant_filter",
    """SELECT 'q' || o_orderkey AS query_id, 'ACC' || o_custkey % 3 || 'EAST-US-2' || 'AZURE' AS tenant_key
FROM orders WHERE o_custkey % 3 = 1 AND o_custkey % 2 = 1""",
)
def tenant_filter(spark, d):
    raw = adapters.proxy_raw(spark, d).select("query_id", "tenant_key")
    return proxy.tenant_filter(raw, adapters.regions(spark), "ACC1", "AZURE_EASTUS2")


@register(
    "load_history_chunks",
    o.with_(o.LOAD)
    + """, r AS (SELECT *, TIMESTAMP '2024-01-17' AS s FROM ld WHERE start_time >= TIMESTAMP '2024-01-17' AND start_time < TIMESTAMP '2024-01-31')
SELECT warehouse_name, s + to_hours(CAST(date_diff('second', s, start_time) // 28800 * 8 AS INTEGER)) AS chunk_start,
  s + to_hours(CAST(date_diff('second', s, start_time) // 28800 * 8 + 8 AS INTEGER)) AS chunk_end, count(*) AS records FROM r GROUP BY ALL""",
)
def load_history_chunks(spark, d):
    rows = readers.load_chunks(adapters.load_history(spark, d), AS_OF)
    return rows.groupBy("warehouse_name", "chunk_start", "chunk_end").agg(
        F.count(F.lit(1)).alias("records")
    )


@register(
    "load_history_range",
    o.with_(o.LOAD)
    + "SELECT warehouse_name, min(end_time) AS range_min, max(end_time) AS range_max, count(*) AS records FROM ld GROUP BY ALL",
)
def load_history_range(spark, d):
    return readers.load_range(adapters.load_history(spark, d))


@register(
    "date_spine",
    o.with_(o.QH)
    + """, sp AS (SELECT CAST(unnest(generate_series(DATE '2001-09-01' - 730, DATE '2001-08-31', INTERVAL 1 DAY)) AS TIMESTAMP) AS date)
SELECT date, count(query_id) AS queries FROM sp LEFT JOIN qh ON date_trunc('day', start_time) = date GROUP BY ALL""",
)
def date_spine(spark, d):
    """Queries per day of the last 730 days, days without any included."""
    per_day = (
        adapters.query_history(spark, d)
        .groupBy(F.date_trunc("day", "start_time").cast("timestamp_ntz").alias("date"))
        .agg(F.count(F.lit(1)).alias("queries"))
    )
    spine = readers.date_spine(spark, h.AS_OF)
    return spine.join(per_day, "date", "left").select(
        "date", F.coalesce("queries", F.lit(0)).alias("queries")
    )


@register(
    "warehouse_dim",
    o.with_(o.WAREHOUSES) + "SELECT warehouse_name, warehouse_size, warehouse_type FROM wh",
)
def warehouse_dim(spark, d):
    return readers.warehouse_dim(adapters.warehouses(spark, d))


SESSION_SQL = o.with_(o.EVENTS, o.SESSIONS)
SLICE_SQL = o.with_(o.EVENTS, o.SESSIONS, o.SESSION_SLICES)


@register(
    "sessions",
    SESSION_SQL
    + """SELECT filterts, warehouse_id, warehouse_name, cluster_number, session_type, session_id, session_start, session_end,
  epoch_us(session_end) // 1000 - epoch_us(session_start) // 1000 AS duration_ms, incomplete FROM ses""",
)
def sessions(spark, d):
    return id_text(session_rows(spark, d)).drop("pending")


@register(
    "session_day_slices",
    SLICE_SQL
    + """SELECT session_id, session_type, cluster_number, record_type, st, et, st_period, duration, incomplete,
  date_diff('day', session_start, session_end) + 1 AS period_plus FROM ss""",
)
def session_day_slices(spark, d):
    return id_text(session_slices(spark, d)).select(
        "session_id", "session_type", "cluster_number", "record_type", "st", "et", "st_period",
        "duration", "incomplete", "period_plus",
    )


def _session_view(name, record_type, session_type, fn):
    @register(
        name,
        SLICE_SQL
        + "SELECT session_id, warehouse_id, warehouse_name, cluster_number, session_start, session_end, st, et, st_period, st_day, duration"
        f" FROM ss WHERE record_type = '{record_type}' AND session_type = '{session_type}'",
    )
    def view(spark, d):
        return id_text(fn(session_slices(spark, d))).select(
            "session_id", "warehouse_id", "warehouse_name", "cluster_number", "session_start",
            "session_end", "st", "et", "st_period", "st_day", "duration",
        )


_session_view("warehouse_sessions", "COMPLETE", "WH", ses.warehouse_sessions)
_session_view("cluster_sessions", "COMPLETE", "CL", ses.cluster_sessions)
_session_view("warehouse_sessions_daily", "DAILY", "WH", ses.warehouse_sessions_daily)
_session_view("cluster_sessions_daily", "DAILY", "CL", ses.cluster_sessions_daily)


def _session_hours(name, session_type, fn):
    @register(
        name,
        SESSION_SQL
        + f""", hx AS (SELECT *, unnest(range(date_diff('hour', session_start, session_end) + 1)) AS i FROM ses WHERE session_type = '{session_type}'),
hy AS (SELECT *, greatest(session_start, date_trunc('hour', session_start) + to_hours(i)) AS st,
  least(session_end, date_trunc('hour', session_start) + to_hours(i + 1)) AS et FROM hx)
SELECT session_id, warehouse_id, cluster_number, st, et, CAST(session_start AS DATE) AS st_day, epoch_us(et) // 1000 - epoch_us(st) // 1000 AS duration FROM hy""",
    )
    def view(spark, d):
        return id_text(ses.sessions_hourly(fn(session_slices(spark, d))))


_session_hours("warehouse_sessions_hourly", "WH", ses.warehouse_sessions)
_session_hours("cluster_sessions_hourly", "CL", ses.cluster_sessions)

DAY_SQL = o.with_(o.QH, o.SLICES, o.DAILY, o.METERING, o.SERVERLESS, o.UTIL_DAY)
UTIL_OUT = "SELECT period, warehouse_id, warehouse_name, queries, unloaded_cc, loaded_cc, utilization, st_day FROM ut"
UTIL_COLUMNS = (
    "period", "warehouse_id", "warehouse_name", "queries", "unloaded_cc", "loaded_cc", "utilization", "st_day",
)


@register("warehouse_daily_utilization", DAY_SQL + UTIL_OUT)
def warehouse_daily_utilization(spark, d):
    return utilization_day(spark, d).select(*UTIL_COLUMNS)


@register(
    "warehouse_hourly_utilization",
    o.with_(o.QH, o.HOURLY, o.METERING, o.utilization("hour", "eh", False)) + UTIL_OUT,
)
def warehouse_hourly_utilization(spark, d):
    return utilization_hour(spark, d).select(*UTIL_COLUMNS)


@register(
    "utilization_heatmap",
    DAY_SQL
    + f""", a AS (SELECT date_trunc('day', period) AS d, {o.RATIO} AS utilization FROM ut
  WHERE CAST(period AS DATE) BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' AND warehouse_name <> 'Serverless Task' GROUP BY ALL)
SELECT CAST(x AS TIMESTAMP) AS period, utilization FROM
  (SELECT unnest(generate_series(TIMESTAMP '2000-01-01', TIMESTAMP '2000-12-31', INTERVAL 1 DAY)) AS x) LEFT JOIN a ON x = d""",
)
def utilization_heatmap(spark, d):
    return util.heatmap(spark, utilization_day(spark, d), "2000-01-01", "2000-12-31")


@register(
    "report_utilization_30d",
    DAY_SQL
    + f"""SELECT {o.RATIO} AS utilization FROM ut WHERE warehouse_name <> 'Serverless Task'
  AND date_trunc('day', period) BETWEEN TIMESTAMP '2001-06-01' - INTERVAL 30 DAY AND TIMESTAMP '2001-06-01'""",
)
def report_utilization_30d(spark, d):
    return util.recent_utilization(utilization_day(spark, d), "2001-06-01 00:00:00")


@register(
    "warehouse_summary",
    o.with_(o.QH, o.SLICES, o.DAILY, o.METERING, o.SERVERLESS, o.UTIL_DAY, o.SCHEDULES, o.WAREHOUSES)
    + f""", sp AS (SELECT warehouse_name, {o.LOADED} AS loaded, {o.RATIO} AS utilization FROM ut
  WHERE CAST(period AS DATE) BETWEEN DATE '1999-01-01' AND DATE '2000-12-31' GROUP BY ALL),
pl AS (SELECT name, bool_or(enabled) AS enabled, max(scale_max) > 1 AS autoscale,
  CASE WHEN count(DISTINCT size) = 1 THEN min(size) ELSE 'variable' END AS size FROM sc GROUP BY ALL)
SELECT wh.warehouse_name AS warehouse, coalesce(size, warehouse_size) AS size, coalesce(autoscale, false) AS autoscale,
  coalesce(loaded * 2, 0) AS spend, coalesce(utilization, 0) * 100 AS utilization, coalesce(enabled, false) AS enabled
FROM wh LEFT JOIN sp USING (warehouse_name) LEFT JOIN pl ON name = wh.warehouse_name""",
)
def warehouse_summary(spark, d):
    return util.warehouse_summary(
        utilization_day(spark, d),
        adapters.schedules(spark, d),
        adapters.warehouses(spark, d),
        "1999-01-01",
        "2000-12-31",
        DEFAULT,
    )
