"""Usage logs in the shape of the engine, derived from the TPC-H-like test tables.

Every column is an integer formula over the given rows, written the same way in the oracle
SQL (``plans/oracle_base.py``), so both engines start from equal data of the same size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlight.sources.readers import read

SIZES = "array('X-Small','Small','Medium','Large','X-Large','2X-Large','3X-Large','4X-Large','5X-Large','6X-Large')"
TYPES = "array('SELECT','INSERT','CREATE_TABLE_AS_SELECT','MERGE','EXECUTE_STREAMLIT')"


# Columns of the test tables; naming them saves a look into the files.
TABLES = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
    " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "part": "p_partkey bigint, p_size int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read(spark, f"{sf_dir}/{name}.parquet", TABLES[name])


def query_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per order."""
    base = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS k",
        "o_custkey AS c",
        "o_orderstatus AS s",
        "o_orderpriority AS role_name",
        "o_totalprice AS price",
        "o_custkey % 12 AS w",
        "o_custkey % 13 = 0 AS serverless",
        "md5(cast(o_orderkey AS string)) AS m",
        "o_orderdate + make_dt_interval(0, 0, 0, (o_orderkey * 7919) % 86400) AS start_time",
        "CASE WHEN o_orderkey % 10 = 0 THEN (o_orderkey * 104729) % 200000"
        " ELSE (o_orderkey * 104729) % 4000 END AS secs",
    )
    return base.selectExpr(
        "concat('q', k) AS query_id",
        "concat('select ', k % 97, ' from db.t', c % 20, ' where k = ''', k, '''') AS query_text",
        "concat('db', c % 3) AS database_name",
        "'main' AS schema_name",
        f"{TYPES}[cast(k % 5 AS int)] AS query_type",
        "c * 10 + k % 10 AS session_id",
        "concat('user_', c % 40) AS user_name",
        "role_name",
        "CASE WHEN serverless THEN 700001 ELSE w END AS warehouse_id",
        "CASE WHEN serverless THEN 'COMPUTE_SERVICE_WH_USER_TASKS_POOL_0'"
        " ELSE concat('WH_', w) END AS warehouse_name",
        f"CASE WHEN serverless THEN NULL ELSE {SIZES}[cast(w % 10 AS int)] END AS warehouse_size",
        "CASE WHEN w IN (2, 3) THEN 'SNOWPARK-OPTIMIZED' ELSE 'STANDARD' END AS warehouse_type",
        "cast(1 AS bigint) AS cluster_number",
        "CASE WHEN k % 50 = 7 THEN 'RUNNING' WHEN s = 'O' THEN 'FAIL' ELSE 'SUCCESS' END"
        " AS execution_status",
        "start_time",
        "CASE WHEN k % 50 = 7 THEN TIMESTAMP_NTZ'1970-01-01 00:00:00'"
        " ELSE start_time + make_dt_interval(0, 0, 0, secs) END AS end_time",
        "secs * 1000 AS total_elapsed_time",
        "cast(floor(price) AS bigint) * 100000 AS bytes_scanned",
        "(k * 31) % 2000 * 1000000 AS bytes_written_to_result",
        "(k * 7907) % 200000000 AS rows_produced",
        "k % 100 AS partitions_scanned",
        "cast(100 AS bigint) AS partitions_total",
        "CASE WHEN k % 4 = 0 THEN k * 1000000 ELSE 0 END AS bytes_spilled_to_local_storage",
        "CASE WHEN k % 9 = 0 THEN k * 1000 ELSE 0 END AS bytes_spilled_to_remote_storage",
        "k % 251 AS compilation_time",
        "k % 7 * 1000 AS query_acceleration_bytes_scanned",
        "(k % 10) / 1000.0D AS credits_used_cloud_services",
        "k % 101 AS query_load_percent",
        "md5(cast(c % 300 AS string)) AS query_parameterized_hash",
        "CASE c % 4 WHEN 0 THEN array("
        " named_struct('SOURCE', 'dbt', 'KEY', 'invocation_id', 'VALUE', concat_ws('-',"
        "  substr(m, 1, 8), substr(m, 9, 4), substr(m, 13, 4), substr(m, 17, 4), substr(m, 21, 12))),"
        " named_struct('SOURCE', 'dbt', 'KEY', 'node_id', 'VALUE', concat('model.m', c % 25)),"
        " named_struct('SOURCE', 'dbt', 'KEY', 'materialized', 'VALUE',"
        "  CASE WHEN k % 2 = 0 THEN 'table' ELSE 'view' END),"
        " named_struct('SOURCE', CASE WHEN k % 3 = 0 THEN NULL ELSE 'dbt' END, 'KEY',"
        "  'full_refresh', 'VALUE', 'true'))"
        " WHEN 1 THEN array("
        " named_struct('SOURCE', 'app', 'KEY', 'team', 'VALUE', concat('t', c % 5)),"
        " named_struct('SOURCE', 'app', 'KEY', 'team', 'VALUE', concat('t', c % 7)))"
        " ELSE NULL END AS qtag",
    )


def query_history_at(queries: DataFrame, at: str) -> DataFrame:
    """What the log showed at an instant: later starts unknown, later ends still running."""
    known = queries.filter(f"start_time < TIMESTAMP_NTZ'{at}'")
    later = f"end_time > TIMESTAMP_NTZ'{at}'"
    return known.withColumns(
        {
            "execution_status": F.expr(f"CASE WHEN {later} THEN 'RUNNING' ELSE execution_status END"),
            "end_time": F.expr(
                f"CASE WHEN {later} THEN TIMESTAMP_NTZ'1970-01-01 00:00:00' ELSE end_time END"
            ),
        }
    )


def warehouse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One start or stop event per event; every user is a warehouse with two clusters."""
    return table(spark, sf_dir, "events").selectExpr(
        "ts AS timestamp",
        "user_id AS warehouse_id",
        "concat('WH_', user_id) AS warehouse_name",
        "CASE WHEN event_type IN ('signup', 'click') THEN NULL ELSE 1 + event_id % 2 END"
        " AS cluster_number",
        "CASE event_type WHEN 'signup' THEN 'RESUME_WAREHOUSE' WHEN 'purchase' THEN 'RESUME_CLUSTER'"
        " WHEN 'view' THEN 'SUSPEND_CLUSTER' WHEN 'click' THEN 'SUSPEND_WAREHOUSE'"
        " ELSE 'RESIZE_WAREHOUSE' END AS event_name",
        "'WAREHOUSE_AUTO' AS event_reason",
        "CASE WHEN event_type IN ('purchase', 'view') THEN 'COMPLETED' ELSE 'STARTED' END AS event_state",
        "concat('user_', user_id % 40) AS user_name",
        "'PUBLIC' AS role_name",
        "concat('q', event_id) AS query_id",
        "event_id",
    )


def metering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metered hour per line item of a warehouse; use it for sums only."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_shipdate + make_dt_interval(0, l_linenumber) AS start_time",
        "l_shipdate + make_dt_interval(0, l_linenumber + 1) AS end_time",
        "l_suppkey % 12 AS warehouse_id",
        "concat('WH_', l_suppkey % 12) AS warehouse_name",
        "cast(l_quantity AS decimal(38,9)) + cast(l_linenumber AS decimal(38,9)) / 1000 AS credits_used",
        "cast(l_quantity AS decimal(38,9)) AS credits_used_compute",
        "cast(cast(l_linenumber AS decimal(38,9)) / 1000 AS decimal(38,9)) AS credits_used_cloud_services",
    )


def serverless_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs on the serverless pool: the orders of every thirteenth customer."""
    return (
        query_history(spark, sf_dir)
        .filter("warehouse_id > 700000")
        .selectExpr(
            "start_time",
            "start_time + make_dt_interval(0, 0, 0, total_elapsed_time / 1000) AS end_time",
            "cast(cast(substr(query_id, 2) AS bigint) % 20 AS decimal(38,9)) / 10 AS credits_used",
            "cast(substr(query_id, 2) AS bigint) % 50 AS task_id",
            "concat('task_', cast(substr(query_id, 2) AS bigint) % 50) AS task_name",
            "schema_name",
            "database_name",
        )
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One user per customer; the first forty also run queries."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS user_id",
        "concat('user_', c_custkey) AS name",
        "TIMESTAMP_NTZ'1995-01-01 00:00:00' + make_dt_interval(cast(c_custkey % 1000 AS int)) AS created_on",
        "CASE WHEN c_custkey % 17 = 3 THEN TIMESTAMP_NTZ'2001-01-01 00:00:00' END AS deleted_on",
        "CASE WHEN c_custkey % 5 <> 0 THEN concat('user_', c_custkey, '@example.com') END AS email",
    )


def load_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-minute load averages per warehouse, counted from the events."""
    grid = 300_000_000
    us = "unix_micros(cast(ts AS timestamp))"
    return (
        table(spark, sf_dir, "events")
        .selectExpr(
            f"{us} - pmod({us}, {grid}) AS b", "user_id % 50 AS warehouse_id", "event_type"
        )
        .groupBy("b", "warehouse_id")
        .agg(
            F.count(F.when(F.col("event_type") == "purchase", 1)).alias("running"),
            F.count(F.when(F.col("event_type") == "view", 1)).alias("queued"),
            F.count(F.when(F.col("event_type") == "error", 1)).alias("blocked"),
        )
        .selectExpr(
            "cast(timestamp_micros(b) AS timestamp_ntz) AS start_time",
            f"cast(timestamp_micros(b + {grid}) AS timestamp_ntz) AS end_time",
            "warehouse_id",
            "concat('WH_', warehouse_id) AS warehouse_name",
            "cast(running AS decimal(38,2)) / 5 AS avg_running",
            "cast(queued AS decimal(38,2)) / 5 AS avg_queued_load",
            "cast(0 AS decimal(38,2)) AS avg_queued_provisioning",
            "cast(blocked AS decimal(38,2)) / 5 AS avg_blocked",
        )
    )


def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four slots per warehouse, one per customer: three on weekdays, one for the weekend.

    Every seventh warehouse has a gap in the morning, every eleventh is disabled.
    """
    base = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS k", "c_custkey div 4 AS w", "c_custkey % 4 AS slot",
        "cast(28800 + (c_custkey div 4) % 4 * 900 AS int) AS morning",
    )
    return base.selectExpr(
        "concat('s', k) AS id_val",
        "concat('WH_', w) AS name",
        "CASE slot WHEN 1 THEN morning WHEN 2 THEN 61200 ELSE 0 END AS start_at",
        "CASE slot WHEN 0 THEN CASE WHEN w % 7 = 0 THEN morning - 900 ELSE morning END"
        " WHEN 1 THEN 61200 ELSE 86340 END AS finish_at",
        f"{SIZES}[cast((w + slot) % 10 AS int)] AS size",
        "1 + (w + slot) % 5 AS suspend_minutes",
        "w % 2 = 0 AS resume",
        "CASE WHEN w % 3 = 0 THEN 0 ELSE 1 END AS scale_min",
        "CASE WHEN w % 3 = 0 THEN 0 ELSE 1 + (w + slot) % 3 END AS scale_max",
        "CASE (w + slot) % 3 WHEN 0 THEN 'Standard' WHEN 1 THEN 'Economy' ELSE 'Inherit' END"
        " AS warehouse_mode",
        "slot <> 3 AS weekday",
        "w % 11 <> 5 AS enabled",
    )


def warehouses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current settings of each warehouse: four customers make one, the first of them its type."""
    made = table(spark, sf_dir, "customer").groupBy(F.expr("c_custkey div 4").alias("w")).agg(F.min("c_custkey").alias("k"))
    return made.selectExpr(
        "concat('WH_', w) AS warehouse_name",
        f"{SIZES}[cast(w % 10 AS int)] AS warehouse_size",
        "CASE WHEN k % 3 = 0 THEN 'SNOWPARK-OPTIMIZED' ELSE 'STANDARD' END AS warehouse_type",
        "1 + w % 5 AS suspend_minutes",
        "true AS resume",
        "CASE WHEN w % 3 = 0 THEN 0 ELSE 1 END AS scale_min",
        "CASE WHEN w % 3 = 0 THEN 0 ELSE 2 END AS scale_max",
        "'Standard' AS warehouse_mode",
    )


def task_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run log of the maintenance tasks: every order is a run, some never finished."""
    return (
        table(spark, sf_dir, "orders")
        .selectExpr(
            "o_orderkey AS k",
            "o_orderdate + make_dt_interval(0, 0, 0, (o_orderkey * 7919) % 86400) AS task_start",
            "CASE WHEN o_orderkey % 33 = 9 THEN NULL ELSE o_orderkey % 12 <> 6 END AS success",
            "o_custkey % 4 AS t",
        )
        .selectExpr(
            "task_start",
            "success",
            "array('QUERY_HISTORY_MAINTENANCE','SIMPLE_DATA_EVENTS_MAINTENANCE',"
            "'WAREHOUSE_EVENTS_MAINTENANCE','WAREHOUSE_LOAD_MAINTENANCE')[cast(t AS int)] AS task_name",
            "CASE t WHEN 0 THEN 'QUERY_HISTORY'"
            " WHEN 1 THEN array('LOGIN_HISTORY','SESSIONS','TASK_HISTORY')[cast(k % 3 AS int)]"
            " WHEN 2 THEN array('CLUSTER_SESSIONS','WAREHOUSE_SESSIONS')[cast(k % 2 AS int)]"
            " ELSE concat('WH_', k % 5) END AS object_name",
            "CASE WHEN k % 5 = 0 THEN NULL ELSE concat('{\"oldest_running\":\"', task_start, '\"}') END AS input",
            "CASE WHEN success THEN concat('{\"new_records\":', k % 100, ',\"range_max\":\"', task_start, '\"}')"
            " WHEN success = false THEN concat('{\"SQLERRM\":\"failed with code ', k % 9, '\"}') END AS output",
            "CASE WHEN success IS NOT NULL THEN task_start + make_dt_interval(0, 0, 10) END AS task_finish",
            "concat('run', k) AS task_run_id",
            "concat('q', k) AS query_id",
            "task_start - make_dt_interval(30) AS range_min",
            "task_start - make_dt_interval(0, 1) AS range_max",
        )
    )


def probe_actions(queries: DataFrame) -> DataFrame:
    """Alerts already sent: one for each query, a sixth of them of a monitor that is still there."""
    return queries.selectExpr(
        "start_time AS action_time",
        "CASE WHEN cast(substr(query_id, 2) AS bigint) % 6 = 0 THEN 'Big Readers' ELSE 'Retired' END AS probe_name",
        "query_id",
        "'' AS outcome",
    )


def proxy_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw proxy records with epoch microseconds and a JSON action record."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('q', o_orderkey) AS query_id",
        "concat('p', o_orderkey) AS proxy_query_id",
        "concat('user_', o_custkey % 40) AS user_name",
        "concat('ACC', o_custkey % 3, array('US-EAST-1','EAST-US-2')[cast(o_custkey % 2 AS int)],"
        " array('AWS','AZURE')[cast(o_custkey % 2 AS int)]) AS tenant_key",
        "unix_micros(cast(o_orderdate AS timestamp)) + o_orderkey AS raw_start_time",
        "unix_micros(cast(o_orderdate AS timestamp)) + o_orderkey + 1500 AS raw_submission_time",
        "CASE WHEN o_orderkey % 9 <> 0 THEN unix_micros(cast(o_orderdate AS timestamp))"
        " + o_orderkey * 1000 + 2500 END AS raw_end_time",
        "CASE WHEN o_orderkey % 20 = 1 THEN 'not json'"
        " ELSE concat('{\"ACTIONS_APPLIED\":[\"a', o_orderkey % 4, '\"],"
        "\"ACTIONS_INPUT\":{\"SCHEMA_ONLY_REQUEST\":', o_orderkey % 2 = 0, '}}') END AS raw_actions",
    )


def regions(spark: SparkSession) -> DataFrame:
    """Region table of the platform, as far as the tests need it."""
    return spark.createDataFrame(
        [("AWS_US_EAST_1", "AWS", "US-EAST-1"), ("AZURE_EASTUS2", "AZURE", "EASTUS2")],
        "account_region string, cloud string, region string",
    )


def rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label rows with repeats: three customers share each name, some are grouped or dynamic."""
    return table(spark, sf_dir, "customer").selectExpr(
        "CASE WHEN c_custkey % 10 = 9 THEN NULL ELSE concat('label_', c_custkey div 3) END AS name",
        "CASE WHEN c_custkey % 10 = 9 THEN concat('dyn_', c_custkey div 20)"
        " WHEN (c_custkey div 3) % 4 = 1 THEN concat('group_', (c_custkey div 3) % 6) END AS group_name",
        "CASE WHEN (c_custkey div 3) % 4 = 1 THEN c_custkey % 50 END AS group_rank",
        "concat('bytes_scanned > ', c_custkey) AS condition",
        "c_custkey % 10 = 9 AS is_dynamic",
        "c_custkey % 8 <> 1 AS enabled",
        "TIMESTAMP_NTZ'2001-01-01 00:00:00' + make_dt_interval(0, cast(c_custkey div 3 AS int)) AS label_created_at",
        "TIMESTAMP_NTZ'2001-01-01 00:00:00' + make_dt_interval(0, cast(c_custkey div 3 AS int),"
        " cast(c_custkey % 2 AS int)) AS label_modified_at",
        "md5(cast(c_custkey AS string)) AS label_id",
    )
