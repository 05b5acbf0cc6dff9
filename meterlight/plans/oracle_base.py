"""Oracle SQL of the adapted logs. Fragments are CTEs that the registered queries compose."""

from __future__ import annotations

SIZE_LIST = (
    "['X-Small','Small','Medium','Large','X-Large','2X-Large','3X-Large','4X-Large','5X-Large','6X-Large']"
)

QH = f"""
ob AS (SELECT o_orderkey k, o_custkey c, o_orderstatus s, o_orderpriority role_name,
  o_totalprice price, o_custkey % 12 w, o_custkey % 13 = 0 serverless, md5(CAST(o_orderkey AS VARCHAR)) m,
  o_orderdate + to_seconds((o_orderkey * 7919) % 86400) start_time,
  CASE WHEN o_orderkey % 10 = 0 THEN (o_orderkey * 104729) % 200000 ELSE (o_orderkey * 104729) % 4000 END secs
  FROM orders),
qh AS (SELECT 'q' || k AS query_id,
  'select ' || k % 97 || ' from db.t' || c % 20 || ' where k = ''' || k || '''' AS query_text,
  'db' || c % 3 AS database_name, 'main' AS schema_name,
  (['SELECT','INSERT','CREATE_TABLE_AS_SELECT','MERGE','EXECUTE_STREAMLIT'])[k % 5 + 1] AS query_type,
  c * 10 + k % 10 AS session_id, 'user_' || c % 40 AS user_name, role_name,
  CASE WHEN serverless THEN 700001 ELSE w END AS warehouse_id,
  CASE WHEN serverless THEN 'COMPUTE_SERVICE_WH_USER_TASKS_POOL_0' ELSE 'WH_' || w END AS warehouse_name,
  CASE WHEN serverless THEN NULL ELSE ({SIZE_LIST})[w % 10 + 1] END AS warehouse_size,
  CASE WHEN w IN (2, 3) THEN 'SNOWPARK-OPTIMIZED' ELSE 'STANDARD' END AS warehouse_type,
  CAST(1 AS BIGINT) AS cluster_number,
  CASE WHEN k % 50 = 7 THEN 'RUNNING' WHEN s = 'O' THEN 'FAIL' ELSE 'SUCCESS' END AS execution_status,
  start_time,
  CASE WHEN k % 50 = 7 THEN TIMESTAMP '1970-01-01 00:00:00' ELSE start_time + to_seconds(secs) END AS end_time,
  secs * 1000 AS total_elapsed_time,
  CAST(floor(price) AS BIGINT) * 100000 AS bytes_scanned,
  (k * 31) % 2000 * 1000000 AS bytes_written_to_result,
  (k * 7907) % 200000000 AS rows_produced,
  k % 100 AS partitions_scanned, CAST(100 AS BIGINT) AS partitions_total,
  CASE WHEN k % 4 = 0 THEN k * 1000000 ELSE 0 END AS bytes_spilled_to_local_storage,
  CASE WHEN k % 9 = 0 THEN k * 1000 ELSE 0 END AS bytes_spilled_to_remote_storage,
  k % 251 AS compilation_time, k % 7 * 1000 AS query_acceleration_bytes_scanned,
  CAST(k % 10 AS DOUBLE) / CAST(1000 AS DOUBLE) AS credits_used_cloud_services,
  k % 101 AS query_load_percent, md5(CAST(c % 300 AS VARCHAR)) AS query_parameterized_hash,
  k, c, m
  FROM ob)"""

# Tags as rows; ord is the position in the list.
TAGS = """
tags AS (
  SELECT query_id, k, 1 ord, 'dbt' source, 'invocation_id' key,
    substr(m,1,8)||'-'||substr(m,9,4)||'-'||substr(m,13,4)||'-'||substr(m,17,4)||'-'||substr(m,21,12) AS value
    FROM qh WHERE c % 4 = 0
  UNION ALL SELECT query_id, k, 2, 'dbt', 'node_id', 'model.m' || c % 25 FROM qh WHERE c % 4 = 0
  UNION ALL SELECT query_id, k, 3, 'dbt', 'materialized', CASE WHEN k % 2 = 0 THEN 'table' ELSE 'view' END
    FROM qh WHERE c % 4 = 0
  UNION ALL SELECT query_id, k, 4, CASE WHEN k % 3 = 0 THEN 'undefined' ELSE 'dbt' END, 'full_refresh', 'true'
    FROM qh WHERE c % 4 = 0
  UNION ALL SELECT query_id, k, 2, 'app', 'team', 't' || c % 7 FROM qh WHERE c % 4 = 1)"""

RATE = """CASE warehouse_size WHEN 'X-Small' THEN 1 WHEN 'Small' THEN 2 WHEN 'Medium' THEN 4 WHEN 'Large' THEN 8
  WHEN 'X-Large' THEN 16 WHEN '2X-Large' THEN 32 WHEN '3X-Large' THEN 64 WHEN '4X-Large' THEN 128
  WHEN '5X-Large' THEN 256 WHEN '6X-Large' THEN 512 ELSE 0 END"""
FACTOR = "CASE WHEN warehouse_type = 'STANDARD' THEN 2 ELSE 3 END"
UNITS = f"duration * query_load_percent * ({RATE}) * ({FACTOR})"
CREDITS = "CAST(credit_units AS DOUBLE) / CAST(720000000 AS DOUBLE)"
PRICE = "CASE WHEN warehouse_id > 700000 THEN CAST(3 AS DOUBLE) ELSE CAST(2 AS DOUBLE) END"
COST = f"CAST(credit_units AS DOUBLE) * ({PRICE}) / CAST(720000000 AS DOUBLE)"
TOTAL_COST = (
    "(CAST(sum(CASE WHEN warehouse_id > 700000 THEN 0 ELSE credit_units END) AS DOUBLE) * CAST(2 AS DOUBLE)"
    " + CAST(sum(CASE WHEN warehouse_id > 700000 THEN credit_units ELSE 0 END) AS DOUBLE) * CAST(3 AS DOUBLE))"
    " / CAST(720000000 AS DOUBLE)"
)
# Millisecond boundaries crossed: floor both ends (epoch_ms would round).
MS = "epoch_us({b}) // 1000 - epoch_us({a}) // 1000"

AS_OF_QUERIES = "2001-09-01 00:00:00"
AS_OF_EVENTS = "2024-01-31 00:00:00"


def day_slices(qh: str = "qh", as_of: str = AS_OF_QUERIES, name: str = "slices") -> str:
    """COMPLETE and DAILY rows of every query."""
    return f"""
{name}_raw AS (
  SELECT *, false AS incomplete, 'COMPLETE' AS record_type, start_time AS st, end_time AS et
    FROM {qh} WHERE start_time <= end_time
  UNION ALL
  SELECT * EXCLUDE (i), false, 'DAILY', greatest(start_time, date_trunc('day', start_time) + to_days(CAST(i AS INTEGER))),
    least(end_time, date_trunc('day', start_time) + to_days(CAST(i + 1 AS INTEGER)))
    FROM (SELECT *, unnest(range(date_diff('day', start_time, end_time) + 1)) AS i FROM {qh} WHERE start_time <= end_time)
  UNION ALL
  SELECT *, true, 'DAILY', start_time,
    least(TIMESTAMP '{as_of}', date_trunc('day', start_time) + to_days(1)) FROM {qh} WHERE start_time > end_time),
{name} AS (SELECT *, CAST({UNITS} AS BIGINT) AS credit_units FROM (
  SELECT *, {MS.format(a='st', b='et')} AS duration, CAST(date_trunc('day', st) AS TIMESTAMP) AS st_period FROM {name}_raw))"""


SLICES = day_slices()
ENRICHED = f"""
eq AS (SELECT *, {CREDITS} AS credits, {COST} AS cost, CAST(st_period AS DATE) AS st_day
  FROM slices WHERE record_type = 'COMPLETE')"""
DAILY = f"""
ed AS (SELECT *, {CREDITS} AS credits, {COST} AS cost, CAST(st_period AS DATE) AS st_day
  FROM slices WHERE record_type = 'DAILY')"""
HOURLY = f"""
eh AS (SELECT *, {CREDITS} AS credits, {COST} AS cost FROM (SELECT *, CAST({UNITS} AS BIGINT) AS credit_units FROM (
  SELECT *, {MS.format(a='st', b='et')} AS duration, CAST(date_trunc('hour', st) AS TIMESTAMP) AS st_period,
    CAST(date_trunc('day', start_time) AS DATE) AS st_day FROM (
    SELECT * EXCLUDE (i), greatest(start_time, date_trunc('hour', start_time) + to_hours(i)) AS st,
      least(end_time, date_trunc('hour', start_time) + to_hours(i + 1)) AS et
    FROM (SELECT *, unnest(range(date_diff('hour', start_time, end_time) + 1)) AS i FROM qh
      WHERE start_time <= end_time)))))"""

EVENTS = """
ev AS (SELECT ts, user_id AS warehouse_id, 'WH_' || user_id AS warehouse_name,
  CASE WHEN event_type IN ('signup', 'click') THEN NULL ELSE 1 + event_id % 2 END AS cluster_number,
  CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 3 WHEN 'click' THEN 4 END AS event,
  event_id FROM events)"""


def sessions(as_of: str = AS_OF_EVENTS, name: str = "ses", where: str = "true") -> str:
    """Sessions by plain windows over each whole warehouse."""
    return f"""
{name}_e AS (SELECT * FROM ev WHERE event IS NOT NULL AND {where}),
{name}_f AS (SELECT *, CASE WHEN event = 1 OR coalesce(lag(event) OVER w, 4) = 4 THEN 1 ELSE 0 END AS opens
  FROM {name}_e WINDOW w AS (PARTITION BY warehouse_id ORDER BY ts, event, event_id)),
{name}_g AS (SELECT *, sum(opens) OVER (PARTITION BY warehouse_id ORDER BY ts, event, event_id
  ROWS UNBOUNDED PRECEDING) AS run FROM {name}_f),
{name}_h AS (SELECT *, min(ts) OVER (PARTITION BY warehouse_id, run) AS run_ts,
  CASE WHEN event IN (1, 4) THEN 'WH' ELSE 'CL' END AS session_type FROM {name}_g),
{name}_i AS (SELECT *, lead(ts) OVER w AS near_ts, lead(event) OVER w AS near_event FROM {name}_h
  WINDOW w AS (PARTITION BY session_type, warehouse_id, run, cluster_number ORDER BY ts, event, event_id)),
{name}_j AS (SELECT *, date_trunc('day', ts) + to_days(1) AS midnight, coalesce(near_event IN (3, 4), false) AS stopped
  FROM {name}_i WHERE event IN (1, 2)),
{name} AS (SELECT ts AS filterts, warehouse_id, warehouse_name, cluster_number, session_type,
  CAST(CAST(warehouse_id AS HUGEINT) * CAST('18446744073709551616' AS HUGEINT) + epoch_us(run_ts) // 1000 AS VARCHAR) AS session_id,
  ts AS session_start,
  CASE WHEN stopped THEN near_ts ELSE least(TIMESTAMP '{as_of}', midnight) END AS session_end,
  NOT stopped AND TIMESTAMP '{as_of}' < midnight AS incomplete FROM {name}_j)"""


SESSIONS = sessions()
SESSION_SLICES = f"""
ss_raw AS (
  SELECT *, 'COMPLETE' AS record_type, session_start AS st, session_end AS et FROM ses
  UNION ALL
  SELECT * EXCLUDE (i), 'DAILY',
    greatest(session_start, date_trunc('day', session_start) + to_days(CAST(i AS INTEGER))),
    least(session_end, date_trunc('day', session_start) + to_days(CAST(i + 1 AS INTEGER)))
  FROM (SELECT *, unnest(range(date_diff('day', session_start, session_end) + 1)) AS i FROM ses)),
ss AS (SELECT *, {MS.format(a='st', b='et')} AS duration, CAST(date_trunc('day', st) AS TIMESTAMP) AS st_period,
  CAST(st AS DATE) AS st_day FROM ss_raw)"""

METERING = """
mt AS (SELECT l_shipdate + to_hours(l_linenumber) AS start_time, l_shipdate + to_hours(l_linenumber + 1) AS end_time,
  l_suppkey % 12 AS warehouse_id, 'WH_' || l_suppkey % 12 AS warehouse_name,
  l_quantity AS compute, l_linenumber AS cloud_milli FROM lineitem)"""
SERVERLESS = """
sv AS (SELECT start_time, start_time + to_seconds(total_elapsed_time // 1000) AS end_time,
  CAST(k % 20 AS DECIMAL(18,9)) / 10 AS credits_used, k % 50 AS task_id, 'task_' || k % 50 AS task_name,
  schema_name, database_name FROM qh WHERE warehouse_id > 700000)"""


def utilization(grain: str, slices: str, serverless: bool, name: str = "ut") -> str:
    extra = (
        f"UNION ALL SELECT CAST(date_trunc('{grain}', start_time) AS TIMESTAMP), -1, CAST(sum(CAST(credits_used AS DECIMAL(18,9))) AS DOUBLE) FROM sv GROUP BY 1"
        if serverless
        else ""
    )
    return f"""
{name}_q AS (SELECT st_period, warehouse_id, warehouse_name, CAST(st_period AS DATE) AS st_day, count(*) AS n,
  CAST(sum(credit_units) AS BIGINT) AS units FROM {slices} WHERE NOT warehouse_id > 700000 GROUP BY ALL),
{name}_m AS (SELECT CAST(date_trunc('{grain}', start_time) AS TIMESTAMP) AS m_period, warehouse_id AS m_id, sum(compute) AS loaded
  FROM mt GROUP BY ALL {extra}),
{name}_b AS (SELECT *, CAST(units AS DOUBLE) / CAST(720000000 AS DOUBLE) AS unl FROM {name}_q FULL JOIN {name}_m
  ON warehouse_id = m_id AND st_period = m_period),
{name}_c AS (SELECT *, coalesce(unl > loaded, false) AS capped FROM {name}_b),
{name} AS (SELECT coalesce(st_period, m_period) AS period, coalesce(warehouse_id, m_id) AS warehouse_id,
  coalesce(warehouse_name, CASE WHEN m_id = -1 THEN 'Serverless Task' END, 'Unknown') AS warehouse_name,
  coalesce(n, 0) AS queries,
  CASE WHEN units IS NULL THEN CAST(0 AS DOUBLE) WHEN capped THEN loaded ELSE unl END AS unloaded_cc,
  coalesce(loaded, 0) AS loaded_cc,
  CASE WHEN coalesce(loaded, 0) <> 0 THEN
    (CASE WHEN units IS NULL THEN CAST(0 AS DOUBLE) WHEN capped THEN loaded ELSE unl END) / loaded END AS utilization,
  st_day, CASE WHEN capped THEN 0 ELSE coalesce(units, 0) END AS free_units,
  CASE WHEN capped THEN loaded ELSE 0 END AS capped_cc FROM {name}_c)"""


UTIL_DAY = utilization("day", "ed", True)
# Sums of metered credits are decimal, so that they do not depend on the order of the rows.
LOADED = "CAST(sum(CAST(loaded_cc AS DECIMAL(28,9))) AS DOUBLE)"
RATIO = (
    f"CASE WHEN {LOADED} <> 0 THEN (CAST(sum(free_units) AS DOUBLE) / CAST(720000000 AS DOUBLE)"
    f" + CAST(sum(CAST(capped_cc AS DECIMAL(28,9))) AS DOUBLE)) / {LOADED} END"
)

LOAD = """
ld AS (SELECT start_time, start_time + to_minutes(5) AS end_time, warehouse_id, 'WH_' || warehouse_id AS warehouse_name,
  CAST(running AS DOUBLE) / 5 AS avg_running, CAST(queued AS DOUBLE) / 5 AS avg_queued_load,
  CAST(blocked AS DOUBLE) / 5 AS avg_blocked FROM (
  SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start_time, user_id % 50 AS warehouse_id,
    count(*) FILTER (event_type = 'purchase') AS running, count(*) FILTER (event_type = 'view') AS queued,
    count(*) FILTER (event_type = 'error') AS blocked FROM events GROUP BY ALL))"""

USERS = """
us AS (SELECT c_custkey AS user_id, 'user_' || c_custkey AS name,
  TIMESTAMP '1995-01-01' + to_days(CAST(c_custkey % 1000 AS INTEGER)) AS created_on,
  CASE WHEN c_custkey % 17 = 3 THEN TIMESTAMP '2001-01-01' END AS deleted_on,
  CASE WHEN c_custkey % 5 <> 0 THEN 'user_' || c_custkey || '@example.com' END AS email FROM customer)"""

SCHEDULES = f"""
sb AS (SELECT c_custkey k, c_custkey // 4 w, c_custkey % 4 slot, 28800 + (c_custkey // 4) % 4 * 900 morning FROM customer),
sc AS (SELECT 's' || k AS id_val, 'WH_' || w AS name,
  CAST(CASE slot WHEN 1 THEN morning WHEN 2 THEN 61200 ELSE 0 END AS INTEGER) AS start_at,
  CAST(CASE slot WHEN 0 THEN CASE WHEN w % 7 = 0 THEN morning - 900 ELSE morning END WHEN 1 THEN 61200 ELSE 86340 END AS INTEGER) AS finish_at,
  ({SIZE_LIST})[(w + slot) % 10 + 1] AS size, 1 + (w + slot) % 5 AS suspend_minutes, w % 2 = 0 AS resume,
  CASE WHEN w % 3 = 0 THEN 0 ELSE 1 END AS scale_min, CASE WHEN w % 3 = 0 THEN 0 ELSE 1 + (w + slot) % 3 END AS scale_max,
  CASE (w + slot) % 3 WHEN 0 THEN 'Standard' WHEN 1 THEN 'Economy' ELSE 'Inherit' END AS warehouse_mode,
  slot <> 3 AS weekday, w % 11 <> 5 AS enabled FROM sb)"""

WAREHOUSES = f"""
wh AS (SELECT 'WH_' || w AS warehouse_name, ({SIZE_LIST})[w % 10 + 1] AS warehouse_size,
  CASE WHEN k % 3 = 0 THEN 'SNOWPARK-OPTIMIZED' ELSE 'STANDARD' END AS warehouse_type,
  1 + w % 5 AS suspend_minutes, true AS resume, CASE WHEN w % 3 = 0 THEN 0 ELSE 1 END AS scale_min,
  CASE WHEN w % 3 = 0 THEN 0 ELSE 2 END AS scale_max, 'Standard' AS warehouse_mode
  FROM (SELECT c_custkey // 4 AS w, min(c_custkey) AS k FROM customer GROUP BY ALL))"""

TASK_LOG = """
tb AS (SELECT o_orderkey k, o_orderdate + to_seconds((o_orderkey * 7919) % 86400) AS task_start,
  CASE WHEN o_orderkey % 33 = 9 THEN NULL ELSE o_orderkey % 12 <> 6 END AS success, o_custkey % 4 AS t
  FROM orders),
tl AS (SELECT task_start, success,
  (['QUERY_HISTORY_MAINTENANCE','SIMPLE_DATA_EVENTS_MAINTENANCE','WAREHOUSE_EVENTS_MAINTENANCE','WAREHOUSE_LOAD_MAINTENANCE'])[t + 1] AS task_name,
  CASE t WHEN 0 THEN 'QUERY_HISTORY' WHEN 1 THEN (['LOGIN_HISTORY','SESSIONS','TASK_HISTORY'])[k % 3 + 1]
    WHEN 2 THEN (['CLUSTER_SESSIONS','WAREHOUSE_SESSIONS'])[k % 2 + 1] ELSE 'WH_' || k % 5 END AS object_name,
  k % 5 = 0 AS no_input, CASE WHEN success = false THEN 'failed with code ' || k % 9 END AS error_message,
  CASE WHEN success IS NOT NULL THEN task_start + to_minutes(10) END AS task_finish,
  'run' || k AS task_run_id, 'q' || k AS query_id, task_start - to_days(30) AS range_min,
  task_start - to_hours(1) AS range_max, k FROM tb)"""

RULES = """
rl AS (SELECT CASE WHEN c_custkey % 10 = 9 THEN NULL ELSE 'label_' || c_custkey // 3 END AS name,
  CASE WHEN c_custkey % 10 = 9 THEN 'dyn_' || c_custkey // 20
    WHEN (c_custkey // 3) % 4 = 1 THEN 'group_' || (c_custkey // 3) % 6 END AS group_name,
  CASE WHEN (c_custkey // 3) % 4 = 1 THEN c_custkey % 50 END AS group_rank,
  'bytes_scanned > ' || c_custkey AS condition, c_custkey % 10 = 9 AS is_dynamic, c_custkey % 8 <> 1 AS enabled,
  TIMESTAMP '2001-01-01' + to_hours(c_custkey // 3) AS label_created_at,
  TIMESTAMP '2001-01-01' + to_hours(c_custkey // 3) + to_minutes(c_custkey % 2) AS label_modified_at,
  md5(CAST(c_custkey AS VARCHAR)) AS label_id FROM customer)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"
