"""Registered schedule, quota, maintenance and refresh queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from meterlight.functions.warehouses import units_to_credits
from meterlight.operators import history
from meterlight.operators import maintenance as mt
from meterlight.operators import quota
from meterlight.operators import refresh as rf
from meterlight.operators import runlog
from meterlight.operators import schedules as sch
from meterlight.operators import sessions as ses
from meterlight.plans import history as h
from meterlight.plans import oracle_base as o
from meterlight.plans import usage as u
from meterlight.plans.registry import register
from meterlight.session import workspace
from meterlight.sources import adapters, schemas
from meterlight.sources.readers import conform

EQ = o.with_(o.QH, o.SLICES, o.ENRICHED)
SC = o.with_(o.SCHEDULES)
TL = o.with_(o.TASK_LOG)
AS_OF = o.AS_OF_QUERIES
TZ = "America/Los_Angeles"

# 2024-01-10 is a Wednesday; 18:05 UTC is 10:05 in Los Angeles, the last run two hours before.
LAST_RUN, THIS_RUN = "2024-01-10 15:50:00", "2024-01-10 18:05:00"
DUE_SQL = """, du AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY start_at DESC, id_val DESC) AS rn FROM sc
  WHERE enabled AND weekday AND start_at > 7 * 3600 + 50 * 60 AND start_at <= 10 * 3600 + 5 * 60) WHERE rn = 1)"""


def due(spark, d):
    return sch.due_schedules(adapters.schedules(spark, d), LAST_RUN, THIS_RUN, TZ)


@register("due_schedules", SC + DUE_SQL + "SELECT name, id_val, start_at, size, warehouse_mode FROM du")
def due_schedules(spark, d):
    return due(spark, d).select("name", "id_val", "start_at", "size", "warehouse_mode")


KEYWORD = """CASE n.size WHEN 'X-Small' THEN 'XSMALL' WHEN 'Small' THEN 'SMALL' WHEN 'Medium' THEN 'MEDIUM' WHEN 'Large' THEN 'LARGE'
  WHEN 'X-Large' THEN 'XLARGE' WHEN '2X-Large' THEN 'XXLARGE' WHEN '3X-Large' THEN 'XXXLARGE' WHEN '4X-Large' THEN 'X4LARGE'
  WHEN '5X-Large' THEN 'X5LARGE' WHEN '6X-Large' THEN 'X6LARGE' END"""


@register(
    "schedule_changes",
    o.with_(o.SCHEDULES, o.WAREHOUSES)
    + DUE_SQL
    + f"""SELECT n.name, n.id_val, concat_ws(', ',
  CASE WHEN n.size <> w.warehouse_size THEN 'WAREHOUSE_SIZE = ' || {KEYWORD} END,
  CASE WHEN n.suspend_minutes <> w.suspend_minutes THEN 'AUTO_SUSPEND = ' || n.suspend_minutes * 60 END,
  CASE WHEN n.resume <> w.resume THEN 'AUTO_RESUME = ' || CASE WHEN n.resume THEN 'True' ELSE 'False' END END,
  CASE WHEN n.scale_min <> 0 AND w.scale_min <> 0 AND n.scale_min <> w.scale_min THEN 'MIN_CLUSTER_COUNT = ' || n.scale_min END,
  CASE WHEN n.scale_min <> 0 AND w.scale_min <> 0 AND n.scale_max <> w.scale_max THEN 'MAX_CLUSTER_COUNT = ' || n.scale_max END,
  CASE WHEN n.scale_min <> 0 AND w.scale_min <> 0 AND n.warehouse_mode <> w.warehouse_mode AND n.warehouse_mode <> 'Inherit'
    THEN 'SCALING_POLICY = ' || n.warehouse_mode END) AS changes
FROM du n JOIN wh w ON n.name = w.warehouse_name""",
)
def schedule_changes(spark, d):
    return sch.schedule_changes(due(spark, d), adapters.warehouses(spark, d))


@register(
    "schedule_statements",
    SC
    + f"""SELECT id_val, 'alter warehouse ' || name || ' set ' || concat_ws(', ', 'WAREHOUSE_SIZE = ' || {KEYWORD}, 'WAREHOUSE_TYPE = STANDARD',
  'AUTO_SUSPEND = ' || suspend_minutes * 60, 'AUTO_RESUME = ' || CASE WHEN resume THEN 'True' ELSE 'False' END,
  CASE WHEN scale_min <> 0 AND scale_max <> 0 THEN 'MIN_CLUSTER_COUNT = ' || scale_min END,
  CASE WHEN scale_min <> 0 AND scale_max <> 0 THEN 'MAX_CLUSTER_COUNT = ' || scale_max END,
  CASE WHEN scale_min <> 0 AND scale_max <> 0 AND warehouse_mode <> 'Inherit' THEN 'SCALING_POLICY = ' || warehouse_mode END) AS statement FROM sc n""",
)
def schedule_statements(spark, d):
    return sch.schedule_statement(adapters.schedules(spark, d)).select("id_val", "statement")


@register(
    "schedule_gaps",
    SC
    + """, x AS (SELECT *, lag(finish_at) OVER p AS pf, lead(start_at) OVER p AS ns, count(*) OVER (PARTITION BY name, weekday) AS n
  FROM sc WINDOW p AS (PARTITION BY name, weekday ORDER BY start_at, id_val))
SELECT name, weekday, id_val, start_at, 'first slot must start at midnight' AS problem FROM x WHERE pf IS NULL AND start_at <> 0
UNION ALL SELECT name, weekday, id_val, start_at, 'last slot must end at midnight' FROM x WHERE ns IS NULL AND finish_at <> 86340
UNION ALL SELECT name, weekday, id_val, start_at, 'gap before slot' FROM x WHERE pf < start_at
UNION ALL SELECT name, weekday, id_val, start_at, 'overlap with slot before' FROM x WHERE pf > start_at
UNION ALL SELECT name, weekday, id_val, start_at, 'not on a quarter hour' FROM x
  WHERE (start_at % 900 <> 0 AND start_at <> 86340) OR (finish_at % 900 <> 0 AND finish_at <> 86340)
UNION ALL SELECT name, weekday, id_val, start_at, 'too many slots' FROM x WHERE n > 10""",
)
def schedule_gaps(spark, d):
    return sch.schedule_gaps(adapters.schedules(spark, d))


@register(
    "usage_by_schedule_slot",
    o.with_(o.QH, o.SLICES, o.ENRICHED, o.SCHEDULES)
    + """, l AS (SELECT *, start_time - INTERVAL 7 HOUR AS lt FROM eq),
m AS (SELECT warehouse_name, isodow(lt) < 6 AS wd, hour(lt) * 3600 + minute(lt) * 60 AS tod, credit_units FROM l)
SELECT name, weekday, id_val, start_at, size, count(*) AS queries, CAST(sum(credit_units) AS DOUBLE) / CAST(720000000 AS DOUBLE) AS credits
FROM m JOIN sc ON name = warehouse_name AND weekday = wd AND tod >= start_at AND tod < CASE WHEN finish_at >= 86340 THEN 86400 ELSE finish_at END GROUP BY ALL""",
)
def usage_by_schedule_slot(spark, d):
    """A fixed offset zone (seven hours behind), so that the oracle needs no zone data."""
    used = sch.usage_by_slot(h.complete(spark, d), adapters.schedules(spark, d), "-07:00")
    return used.withColumn("credits", units_to_credits("credit_units")).drop("credit_units")


@register(
    "schedule_task_history",
    """SELECT o_orderdate AS run, o_orderkey % 4 <> 0 AS success, 'UTC' AS schedule_timezone, o_orderkey % 3 AS warehouses_updated,
  'alter ' || o_orderkey || ';alter x' AS statements FROM orders""",
)
def schedule_task_history(spark, d):
    log = adapters.table(spark, d, "orders").selectExpr(
        "o_orderdate AS run", "o_orderkey % 4 <> 0 AS success",
        "concat('{\"statements\":[\"alter ', o_orderkey, '\",\"alter x\"],\"schedule timezone\":\"UTC\",\"warehouses_updated\":', o_orderkey % 3, '}') AS output",
    )
    out = sch.schedule_history(log)
    return out.withColumn("statements", F.array_join("statements_executed", ";")).drop("statements_executed")


RATE_STD = f"({o.RATE})"
HOURLY_SQL = f""", w AS (SELECT *, greatest(total_elapsed_time, 0) * {RATE_STD} AS work, CAST(k % 10 AS DECIMAL(18,9)) AS cloud_milli
  FROM qh WHERE NOT starts_with(warehouse_name, 'COMPUTE_SERVICE_WH_USER_TASKS_POOL_') AND start_time <= end_time),
hq AS (SELECT CAST(end_time AS DATE) AS day, CAST(hour(end_time) AS INTEGER) AS hour_of_day, name, persona,
  CAST(sum(work) AS DOUBLE) / CAST(3600000 AS DOUBLE) + CAST(CAST(sum(cloud_milli) AS BIGINT) AS DOUBLE) / CAST(1000 AS DOUBLE) AS credits_used
  FROM (SELECT end_time, work, cloud_milli, user_name AS name, 'user' AS persona FROM w
    UNION ALL SELECT end_time, work, cloud_milli, role_name, 'role' FROM w) GROUP BY ALL)"""


@register(
    "hourly_quota",
    o.with_(o.QH) + HOURLY_SQL + "SELECT day, hour_of_day, name, persona, credits_used FROM hq",
)
def hourly_quota(spark, d):
    """Hours held before the last one are kept, the last two hours recomputed and merged."""
    q = adapters.query_history(spark, d)
    at = "2000-06-01 10:30:00"
    late = F.col("end_time") >= F.lit("2000-06-01 09:00:00").cast("timestamp_ntz")
    partial = F.substring("query_id", 2, 20).cast("bigint") % 2 == 0
    held = quota.hourly_usage(q.filter(~late | partial), at)
    updates = quota.hourly_usage(q.filter(late), AS_OF)
    return mt.upsert(held, updates, ["day", "hour_of_day", "name", "persona"]).drop("last_updated")


@register(
    "quota_usage_map",
    o.with_(o.QH)
    + HOURLY_SQL
    + """SELECT CASE persona WHEN 'user' THEN 'users' ELSE 'roles' END AS kind, name, round(sum(credits_used), 9) AS credits
FROM hq WHERE day = DATE '2000-06-01' GROUP BY ALL""",
)
def quota_usage_map(spark, d):
    hourly = quota.hourly_usage(adapters.query_history(spark, d), AS_OF)
    rows = quota.day_totals(hourly, "2000-06-01").filter(F.col("name").isNotNull())
    return rows.withColumn("credits", F.round("credits", 9))


@register(
    "insert_by_name",
    o.with_(o.QH)
    + """SELECT start_time AS task_start, CAST(NULL AS BOOLEAN) AS success, query_type AS task_name, CAST(NULL AS VARCHAR) AS output, query_id
FROM qh WHERE query_type = 'MERGE'""",
)
def insert_by_name(spark, d):
    """Source columns in another order and case; the target's come out, missing ones NULL."""
    rows = adapters.query_history(spark, d).selectExpr(
        "query_id AS QUERY_ID", "query_type AS task_name", "start_time AS Task_Start", "bytes_scanned AS extra"
    )
    out = mt.insert_by_name(schemas.schema(schemas.TASK_LOG), rows, "task_name = 'MERGE'")
    return out.select("task_start", "success", "task_name", "output", "query_id")


def _moved(full: StructType) -> StructType:
    """The table before its migration: no third column, last two swapped."""
    fields = [f for i, f in enumerate(full.fields) if i != 2]
    fields[-1], fields[-2] = fields[-2], fields[-1]
    return StructType(fields)


@register(
    "schema_diff",
    """SELECT o_orderkey, CAST(NULL AS VARCHAR) AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
  'o_totalprice,o_orderpriority' AS dropped, 'o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS added FROM orders""",
)
def schema_diff(spark, d):
    """An old orders table brought to today's columns, and the changes that name the way.

    The date keeps its position by chance, so it is not dropped; after the drop it no longer
    does, so it is to be added again.
    """
    orders = adapters.table(spark, d, "orders")
    old = orders.select(*_moved(orders.schema).fieldNames())
    drop, add = mt.schema_changes(orders.schema, old.schema)
    return mt.migrate(old, orders.schema).select(
        "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
        F.lit(",".join(drop)).alias("dropped"), F.lit(",".join(add)).alias("added"),
    )


@register(
    "schema_column_list",
    """SELECT string_agg(name || ':' || type, ', ' ORDER BY pos) AS columns, (SELECT count(*) FROM customer) AS records FROM (VALUES
  (1, 'c_custkey', 'bigint'), (2, 'c_name', 'string'), (3, 'c_nationkey', 'int'), (4, 'c_acctbal', 'double'), (5, 'c_mktsegment', 'string')) AS t(pos, name, type)""",
)
def schema_column_list(spark, d):
    customer = adapters.table(spark, d, "customer")
    columns = [("customer", i, f.name, f.dataType.simpleString()) for i, f in enumerate(customer.schema.fields)]
    listed = mt.column_lists(spark.createDataFrame(columns, "table_name string, position int, column string, type string"))
    rows = customer.agg(F.count(F.lit(1)).alias("records")).select(F.lit(None).cast("string").alias("columns"), "records")
    both = rows.unionByName(listed.select("columns", F.lit(None).cast("bigint").alias("records")))
    return both.agg(F.max("columns").alias("columns"), F.max("records").alias("records"))


EARLY_LOAD = "1997-01-01 00:00:00"
FIRST_LOAD = "1999-06-15 12:00:00"


@register(
    "incr_refresh_queries",
    o.with_(o.QH, o.SLICES) + "SELECT query_id, record_type, st, et, duration, incomplete, credit_units FROM slices",
)
def incr_refresh_queries(spark, d):
    """Four refreshes that lose no row.

    The first sees no running query, so those that ran then arrive later with an earlier start;
    its newest row ends exactly at the watermark. The second sees an empty log. Closed rows
    are appended to a table, open rows replace a second one, and the union of both must equal
    a full load.
    """
    path = workspace(spark, "queries")
    log = adapters.query_history(spark, d)
    columns = ["query_id", "record_type", "st", "et", "duration", "incomplete", "credit_units"]
    start = adapters.query_history_at(log, EARLY_LOAD).filter("start_time <= end_time")
    feeds = (
        (start, EARLY_LOAD),
        (log.filter("false"), "1997-02-01 00:00:00"),
        (adapters.query_history_at(log, FIRST_LOAD), FIRST_LOAD),
        (log, AS_OF),
    )
    state = rf.Watermarks()
    for i, (feed, at) in enumerate(feeds):
        step = rf.refresh_queries(feed, state, at, snapshot=f"{path}/read{i}", running_end=rf.EPOCH)
        step.closed.select(*columns).write.mode("append").parquet(f"{path}/closed")
        if step.changed:
            step.incomplete.select(*columns).write.mode("overwrite").parquet(f"{path}/incomplete")
        state = step.state
    return spark.read.parquet(f"{path}/closed").unionByName(spark.read.parquet(f"{path}/incomplete"))


@register(
    "incr_refresh",
    EQ
    + """SELECT st_day, count(*) AS queries, CAST(sum(credit_units) AS BIGINT) AS credit_units FROM eq GROUP BY ALL""",
)
def incr_refresh(spark, d):
    """Three refreshes without tables between them, aggregated by day."""
    log, path = adapters.query_history(spark, d), workspace(spark, "refresh")
    state, closed = rf.Watermarks(), []
    for i, at in enumerate((EARLY_LOAD, FIRST_LOAD, AS_OF)):
        step = rf.refresh_queries(adapters.query_history_at(log, at), state, at, snapshot=f"{path}/read{i}")
        state = step.state
        closed.append(step.closed)
    rows = closed[0].unionByName(closed[1]).unionByName(closed[2])
    done = history.enriched(rows, step.incomplete)
    return done.groupBy("st_day").agg(
        F.count(F.lit(1)).alias("queries"), F.sum("credit_units").alias("credit_units")
    )


@register(
    "incr_refresh_sessions",
    u.SESSION_SQL
    + "SELECT session_id, session_type, cluster_number, session_start, session_end, incomplete FROM ses",
)
def incr_refresh_sessions(spark, d):
    """Three refreshes over parts of the log; closed and open rows must equal one over all."""
    path = workspace(spark, "sessions")
    events = adapters.warehouse_events(spark, d)
    low, open_rows, carry = "2000-01-01 00:00:00", None, None
    steps = ("2024-01-08 07:30:00", "2024-01-20 23:10:00", o.AS_OF_EVENTS)
    for i, at in enumerate(steps):
        part = events.filter(f"timestamp >= TIMESTAMP_NTZ'{low}' AND timestamp < TIMESTAMP_NTZ'{at}'")
        step = ses.refresh_sessions(part, at, open_rows, carry, tie="event_id")
        step.rows.persist()
        step.closed.write.mode("append").parquet(f"{path}/closed")
        step.open.write.parquet(f"{path}/open{i}")
        step.carry.write.parquet(f"{path}/carry{i}")
        step.rows.unpersist()
        open_rows = spark.read.parquet(f"{path}/open{i}")
        carry = spark.read.parquet(f"{path}/carry{i}")
        low = at
    both = spark.read.parquet(f"{path}/closed").unionByName(open_rows)
    return u.id_text(both).select(
        "session_id", "session_type", "cluster_number", "session_start", "session_end", "incomplete"
    )


@register(
    "simple_refresh",
    o.with_(o.METERING)
    + """SELECT warehouse_id, end_time, count(*) AS records, sum(compute) AS compute FROM mt GROUP BY ALL""",
)
def simple_refresh(spark, d):
    """Two loads; the second starts at the newest hour of the first, of which half was held."""
    source = adapters.metering(spark, d).select("warehouse_id", "end_time", "credits_used_compute")
    border = datetime(1999, 6, 15, 3)
    at = F.lit(border).cast("timestamp_ntz")
    held = source.filter(
        (F.col("end_time") < at) | ((F.col("end_time") == at) & (F.col("warehouse_id") % 2 == 0))
    )
    # Written, as a refresh would find it, and read back for its range.
    path = workspace(spark, "metering")
    held.write.parquet(path)
    table = spark.read.parquet(path)
    _, newest = rf.index_range(table, "end_time")
    both = table.unionByName(rf.refresh_simple(source, table, "end_time", newest))
    return both.groupBy("warehouse_id", "end_time").agg(
        F.count(F.lit(1)).alias("records"), F.sum("credits_used_compute").cast("double").alias("compute")
    )


def _simple_tables(spark, d):
    """The seven pass-through logs: name, data, index column."""
    q = adapters.query_history(spark, d)
    logins = adapters.warehouse_events(spark, d).selectExpr(
        "event_id", "timestamp AS event_timestamp", "'LOGIN' AS event_type", "user_name"
    )
    usage = adapters.metering(spark, d).selectExpr(
        "'TABLE' AS object_type", "cast(warehouse_id AS string) AS object_id", "start_time", "end_time",
        "credits_used_cloud_services AS credits_used",
    )
    views = adapters.metering(spark, d).selectExpr(
        "start_time", "end_time", "credits_used", "warehouse_id AS table_id"
    )
    tasks = q.selectExpr("user_name AS name", "query_text", "end_time AS completed_time", "query_id")
    opened = q.selectExpr("session_id", "start_time AS created_on", "user_name")
    return (
        ("SERVERLESS_TASK_HISTORY", adapters.serverless_tasks(spark, d), schemas.SERVERLESS_TASKS, "end_time"),
        ("TASK_HISTORY", tasks, schemas.TASK_HISTORY, "completed_time"),
        ("SESSIONS", opened, schemas.SESSIONS, "created_on"),
        ("WAREHOUSE_METERING_HISTORY", adapters.metering(spark, d), schemas.METERING, "end_time"),
        ("LOGIN_HISTORY", logins, schemas.LOGIN_HISTORY, "event_timestamp"),
        ("HYBRID_TABLE_USAGE_HISTORY", usage, schemas.HYBRID_TABLE_USAGE, "end_time"),
        ("MATERIALIZED_VIEW_REFRESH_HISTORY", views, schemas.VIEW_REFRESH_HISTORY, "end_time"),
    )


@register(
    "simple_tables",
    o.with_(o.QH, o.METERING, o.SERVERLESS)
    + """SELECT 'SERVERLESS_TASK_HISTORY' AS name, count(*) AS records, min(end_time) AS range_min, max(end_time) AS range_max FROM sv
UNION ALL SELECT 'TASK_HISTORY', count(*), min(end_time), max(end_time) FROM qh
UNION ALL SELECT 'SESSIONS', count(*), min(start_time), max(start_time) FROM qh
UNION ALL SELECT 'WAREHOUSE_METERING_HISTORY', count(*), min(end_time), max(end_time) FROM mt
UNION ALL SELECT 'LOGIN_HISTORY', count(*), min(ts), max(ts) FROM events
UNION ALL SELECT 'HYBRID_TABLE_USAGE_HISTORY', count(*), min(end_time), max(end_time) FROM mt
UNION ALL SELECT 'MATERIALIZED_VIEW_REFRESH_HISTORY', count(*), min(end_time), max(end_time) FROM mt""",
)
def simple_tables(spark, d):
    out = None
    for name, df, ddl, index in _simple_tables(spark, d):
        part = conform(df, ddl).agg(
            F.count(F.lit(1)).alias("records"), F.min(index).alias("range_min"), F.max(index).alias("range_max")
        ).select(F.lit(name).alias("name"), "records", "range_min", "range_max")
        out = part if out is None else out.unionByName(part)
    return out


@register(
    "task_log_close_stale",
    o.with_(o.QH, o.TASK_LOG)
    + """, r AS (SELECT query_id, execution_status, user_name FROM qh WHERE start_time > TIMESTAMP '2000-06-01' - INTERVAL 1 DAY)
SELECT task_run_id, CASE WHEN success IS NULL THEN false ELSE success END AS success, CASE WHEN success IS NULL THEN 'true' END AS forced,
  CASE WHEN success IS NULL THEN execution_status END AS execution_status, CASE WHEN success IS NULL THEN user_name END AS user_name,
  CASE WHEN success IS NULL AND user_name IS NULL THEN 'Could not find query history for task=' || task_name || ', object=' || object_name ||
    ', task_run_id=' || task_run_id || ', query_id=' || query_id END AS details,
  CASE WHEN success IS NULL THEN TIMESTAMP '2000-06-01' ELSE task_finish END AS task_finish FROM tl LEFT JOIN r USING (query_id)""",
)
def task_log_close_stale(spark, d):
    closed = runlog.close_stale(
        adapters.task_log(spark, d), adapters.query_history(spark, d), "2000-06-01 00:00:00"
    )
    field = lambda name: F.get_json_object("output", f"$.{name}")
    return closed.select(
        "task_run_id", "success", field("FORCE_CLOSED").alias("forced"),
        field("EXECUTION_STATUS").alias("execution_status"), field("USER_NAME").alias("user_name"),
        field("details").alias("details"), "task_finish",
    )


STATUS_COLUMNS = ("start", "end", "status", "error_message", "query_id")


@register(
    "materialization_status",
    TL
    + """, rk AS (SELECT * FROM (SELECT *, success IS NULL AS running, row_number() OVER (PARTITION BY task_name, object_name, no_input, success IS NULL
    ORDER BY task_start DESC, query_id DESC) AS rn, CASE WHEN success THEN 'SUCCESS' WHEN NOT success THEN 'FAILURE' END AS status FROM tl) WHERE rn = 1),
sm AS (SELECT task_name, object_name,
  coalesce(max(range_min) FILTER (NOT no_input), max(range_min) FILTER (no_input)) AS range_start,
  coalesce(max(range_max) FILTER (NOT no_input), max(range_max) FILTER (no_input)) AS range_end,
  max(task_start) FILTER (NOT running) AS last_start, max(task_start) FILTER (running) AS running_start,
  max(query_id) FILTER (running) AS running_query_id,
  max(CASE WHEN no_input THEN 'FULL' ELSE 'INCREMENTAL' END) FILTER (running) AS running_type,
"""
    + ",\n".join(
        f"  max({c}) FILTER (no_input AND NOT running) AS f_{n}, max({c}) FILTER (NOT no_input AND NOT running) AS i_{n}"
        for n, c in zip(STATUS_COLUMNS, ("task_start", "task_finish", "status", "error_message", "query_id"))
    )
    + """ FROM rk GROUP BY ALL),
sv AS (SELECT *, coalesce(i_start > f_end AND f_status = 'SUCCESS', false) AS ok FROM sm),
tt AS (SELECT * FROM (VALUES ('DBT_HISTORY','QUERY_HISTORY_MAINTENANCE','QUERY_HISTORY',60),('ENRICHED_QUERY_HISTORY','QUERY_HISTORY_MAINTENANCE','QUERY_HISTORY',60),
  ('ENRICHED_QUERY_HISTORY_DAILY','QUERY_HISTORY_MAINTENANCE','QUERY_HISTORY',60),('ENRICHED_QUERY_HISTORY_HOURLY','QUERY_HISTORY_MAINTENANCE','QUERY_HISTORY',60),
  ('LABELED_QUERY_HISTORY','QUERY_HISTORY_MAINTENANCE','QUERY_HISTORY',60),('WAREHOUSE_DAILY_UTILIZATION','QUERY_HISTORY_MAINTENANCE','QUERY_HISTORY',60),
  ('WAREHOUSE_HOURLY_UTILIZATION','QUERY_HISTORY_MAINTENANCE','QUERY_HISTORY',60),
  ('HYBRID_TABLE_USAGE_HISTORY','SIMPLE_DATA_EVENTS_MAINTENANCE','HYBRID_TABLE_USAGE_HISTORY',720),('LOGIN_HISTORY','SIMPLE_DATA_EVENTS_MAINTENANCE','LOGIN_HISTORY',720),
  ('MATERIALIZED_VIEW_REFRESH_HISTORY','SIMPLE_DATA_EVENTS_MAINTENANCE','MATERIALIZED_VIEW_REFRESH_HISTORY',720),
  ('SERVERLESS_TASK_HISTORY','SIMPLE_DATA_EVENTS_MAINTENANCE','SERVERLESS_TASK_HISTORY',720),('SESSIONS','SIMPLE_DATA_EVENTS_MAINTENANCE','SESSIONS',720),
  ('TASK_HISTORY','SIMPLE_DATA_EVENTS_MAINTENANCE','TASK_HISTORY',720),('WAREHOUSE_METERING_HISTORY','SIMPLE_DATA_EVENTS_MAINTENANCE','WAREHOUSE_METERING_HISTORY',720),
  ('CLUSTER_SESSIONS','WAREHOUSE_EVENTS_MAINTENANCE','CLUSTER_SESSIONS',60),('CLUSTER_SESSIONS_DAILY','WAREHOUSE_EVENTS_MAINTENANCE','CLUSTER_SESSIONS',60),
  ('CLUSTER_SESSIONS_HOURLY','WAREHOUSE_EVENTS_MAINTENANCE','CLUSTER_SESSIONS',60),('WAREHOUSE_SESSIONS','WAREHOUSE_EVENTS_MAINTENANCE','WAREHOUSE_SESSIONS',60),
  ('WAREHOUSE_SESSIONS_DAILY','WAREHOUSE_EVENTS_MAINTENANCE','WAREHOUSE_SESSIONS',60),('WAREHOUSE_SESSIONS_HOURLY','WAREHOUSE_EVENTS_MAINTENANCE','WAREHOUSE_SESSIONS',60),
  ('WAREHOUSE_LOAD_HISTORY','WAREHOUSE_LOAD_MAINTENANCE',NULL,420)) AS t(user_view, t, ob, period))
SELECT 'REPORTING' AS user_schema, user_view, object_name AS "partition", range_start, range_end, """
    + ", ".join(f"f_{n} AS last_full_{n}, CASE WHEN ok THEN i_{n} END AS last_incr_{n}" for n in STATUS_COLUMNS)
    + """, coalesce(running_start, coalesce(last_start, TIMESTAMP '2001-09-01') + to_minutes(period)) AS next_start,
  coalesce(running_type, CASE WHEN f_status = 'SUCCESS' THEN 'INCREMENTAL' ELSE 'FULL' END) AS next_type,
  CASE WHEN running_type IS NOT NULL THEN 'EXECUTING' ELSE 'SCHEDULED' END AS next_status, running_query_id AS next_query_id
FROM tt LEFT JOIN sv ON t = task_name AND (t = 'WAREHOUSE_LOAD_MAINTENANCE' OR ob = object_name)""",
)
def materialization_status(spark, d):
    return runlog.materialization_status(spark, adapters.task_log(spark, d), AS_OF)


@register(
    "data_freshness",
    o.with_(o.QH, o.TASK_LOG)
    + """SELECT (SELECT min(start_time) FROM qh) AS range_min, (SELECT max(start_time) FROM qh) AS range_max,
  (SELECT max(task_start) FROM tl WHERE success AND task_name = 'QUERY_HISTORY_MAINTENANCE') AS queries_start,
  (SELECT max(task_start) FROM tl WHERE success AND task_name = 'WAREHOUSE_EVENTS_MAINTENANCE') AS events_start""",
)
def data_freshness(spark, d):
    return runlog.freshness(adapters.query_history(spark, d), adapters.task_log(spark, d))


@register(
    "task_log_last_output",
    TL
    + """SELECT max(task_start) AS last_start, arg_max(k % 100, task_start) AS new_records FROM tl
WHERE success AND task_name = 'QUERY_HISTORY_MAINTENANCE' AND object_name = 'QUERY_HISTORY'""",
)
def task_log_last_output(spark, d):
    """Input handed to the next run: what the last good one put out."""
    last = runlog.last_output(adapters.task_log(spark, d), "QUERY_HISTORY_MAINTENANCE", "QUERY_HISTORY")
    return last.select(
        F.get_json_object("input", "$.range_max").cast("timestamp_ntz").alias("last_start"),
        F.get_json_object("input", "$.new_records").cast("bigint").alias("new_records"),
    )
