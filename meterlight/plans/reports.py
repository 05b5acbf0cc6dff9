"""Registered reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlight.functions.durations import friendly_duration, friendly_duration_ordinal
from meterlight.functions.timeops import emonth, index_range, period_range, period_range_plus
from meterlight.operators import reports as r
from meterlight.operators import sessions as ses
from meterlight.operators.labels import Label, apply_labels, label_filter
from meterlight.plans import history as h
from meterlight.plans import oracle_base as o
from meterlight.plans import usage as u
from meterlight.plans.registry import register
from meterlight.sources import adapters

START, END = "1996-01-01 00:00:00", "2000-12-31 00:00:00"
BETWEEN = f"BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"
EQ = o.with_(o.QH, o.SLICES, o.ENRICHED)
WH = o.with_(o.EVENTS, o.SESSIONS, o.SESSION_SLICES)
BUCKET = """CASE WHEN {x} < 180000 THEN '<3 minutes' WHEN {x} < 600000 THEN '3-10 minutes' WHEN {x} < 3600000 THEN '10 minutes - 1 hour'
  WHEN {x} < 14400000 THEN '1 to 4 hours' WHEN {x} < 86400000 THEN '4-24 hours' WHEN {x} < 604800000 THEN '1-7 days'
  WHEN {x} < 2592000000 THEN '7-30 days' ELSE '>30 days' END"""
ORDINAL = """CASE WHEN {x} < 180000 THEN 0 WHEN {x} < 600000 THEN 1 WHEN {x} < 3600000 THEN 2 WHEN {x} < 14400000 THEN 3
  WHEN {x} < 86400000 THEN 4 WHEN {x} < 604800000 THEN 5 WHEN {x} < 2592000000 THEN 6 ELSE 7 END"""


@register(
    "report_cost_utilization",
    u.DAY_SQL
    + f"""SELECT CAST(date_trunc('month', period) AS TIMESTAMP) AS dt, {o.LOADED} * 2 AS cost, {o.RATIO} AS utilization
FROM ut WHERE period {BETWEEN} GROUP BY ALL""",
)
def report_cost_utilization(spark, d):
    return r.cost_utilization(u.utilization_day(spark, d), START, END)


@register(
    "report_session_durations",
    WH
    + f"""SELECT {BUCKET.format(x='duration')} AS duration, {ORDINAL.format(x='duration')} AS ord, count(*) AS cnt
FROM ss WHERE record_type = 'COMPLETE' AND session_type = 'WH' AND st BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' GROUP BY ALL""",
)
def report_session_durations(spark, d):
    rows = ses.warehouse_sessions(u.session_slices(spark, d))
    return r.session_durations(rows, "2024-01-05 00:00:00", "2024-01-25 00:00:00")


@register(
    "report_session_gaps",
    WH
    + f""", g AS (SELECT st, date_diff('second', lag(st) OVER (PARTITION BY warehouse_id ORDER BY st), st) * 1000 AS gap
  FROM ss WHERE record_type = 'COMPLETE' AND session_type = 'WH')
SELECT {BUCKET.format(x='gap')} AS duration, {ORDINAL.format(x='gap')} AS ord, count(*) AS cnt
FROM g WHERE st BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-25' GROUP BY ALL""",
)
def report_session_gaps(spark, d):
    rows = ses.warehouse_sessions(u.session_slices(spark, d))
    return r.session_gaps(rows, "2024-01-01 00:00:00", "2024-01-25 00:00:00")


@register(
    "users_per_warehouse_day",
    o.with_(o.QH, o.SLICES, o.DAILY)
    + f"""SELECT warehouse_id, warehouse_name, st_period, count(DISTINCT user_name) AS cnt FROM ed
WHERE st_period {BETWEEN} GROUP BY ALL""",
)
def users_per_warehouse_day(spark, d):
    return r.users_per_warehouse_day(h.daily(spark, d), START, END)


@register(
    "report_top_spenders",
    EQ
    + f"""SELECT user_name, {o.TOTAL_COST} AS cst, count(*) AS queries FROM eq WHERE start_time {BETWEEN}
GROUP BY user_name HAVING cst IS NOT NULL""",
)
def report_top_spenders(spark, d):
    return r.top_spenders(h.complete(spark, d), START, END)


COSTLY = f"query_parameterized_hash IS NOT NULL AND cost > 0 AND start_time {BETWEEN}"


@register(
    "report_recurring_share",
    EQ
    + f""", a AS (SELECT query_parameterized_hash, date_trunc('week', end_time) AS wk, {o.TOTAL_COST} AS cost,
  sum(credit_units) AS units, count(*) AS cnt, max(warehouse_id) AS mw FROM eq WHERE {COSTLY} GROUP BY ALL)
SELECT CASE WHEN cnt > 2 THEN 'Reoccurring' ELSE 'ad-hoc' END AS bucket,
  CAST(sum(units) AS DOUBLE) * 2 / CAST(720000000 AS DOUBLE) AS cost, CAST(sum(cnt) AS BIGINT) AS count FROM a GROUP BY ALL""",
)
def report_recurring_share(spark, d):
    """Threshold 2 per week instead of 100: the test hashes run a few times per week."""
    return r.recurring_share(h.complete(spark, d), START, END, more_than=2)


def _repeated(by):
    @register(
        "report_top_repeated" if by == "count" else f"report_top_repeated_by_{by}",
        EQ
        + f""", a AS (SELECT query_parameterized_hash, min(query_id) AS query_id, {o.TOTAL_COST} AS cost, count(*) AS count
  FROM eq WHERE {COSTLY} GROUP BY ALL),
t AS (SELECT *, cost / count AS cost_per_query FROM a ORDER BY {by} DESC, query_parameterized_hash LIMIT 100)
SELECT t.query_id, query_text, t.query_parameterized_hash, t.cost, count, cost_per_query FROM t JOIN qh USING (query_id)""",
    )
    def query(spark, d):
        return r.top_repeated(h.complete(spark, d), START, END, by=by)


for _by in ("count", "cost", "cost_per_query"):
    _repeated(_by)


def _activity(name, group, value):
    expr = "units" if value == "credit_units" else "queries"
    out = "CAST(sum(units) AS DOUBLE) / CAST(720000000 AS DOUBLE) * 2 AS cost" if value == "credit_units" else "CAST(sum(queries) AS BIGINT) AS queries"

    @register(
        name,
        EQ
        + f""", a AS (SELECT CAST(date_trunc('month', start_time) AS TIMESTAMP) AS date, {group} AS "group", sum(credit_units) AS units, count(*) AS queries
  FROM eq WHERE start_time {BETWEEN} GROUP BY ALL),
t AS (SELECT "group" FROM a GROUP BY ALL ORDER BY sum({expr}) DESC, "group" LIMIT 10)
SELECT date, CASE WHEN "group" IN (SELECT "group" FROM t) THEN "group" ELSE 'Other' END AS "group", {out} FROM a GROUP BY ALL""",
    )
    def query(spark, d):
        base = r.query_activity(h.complete(spark, d), group, START, END)
        folded = r.topn_other(base, 10, value, "group", ["date"])
        if value == "credit_units":
            credits = F.col("credit_units").cast("double") / F.lit(720_000_000.0)
            return folded.select("date", "group", (credits * 2).alias("cost"))
        return folded


_activity("report_query_activity", "user_name", "credit_units")
_activity("report_query_activity_count", "warehouse_name", "queries")


@register(
    "topn_other",
    o.with_(o.QH)
    + """, a AS (SELECT user_name, sum(bytes_scanned) AS bytes_scanned FROM qh GROUP BY ALL),
t AS (SELECT user_name FROM a ORDER BY bytes_scanned DESC, user_name LIMIT 5)
SELECT CASE WHEN user_name IN (SELECT user_name FROM t) THEN user_name ELSE 'Other' END AS user_name, CAST(sum(bytes_scanned) AS BIGINT) AS bytes_scanned
FROM a GROUP BY ALL""",
)
def topn_other(spark, d):
    q = adapters.query_history(spark, d)
    return r.topn_other(q.groupBy("user_name").agg(F.sum("bytes_scanned").alias("bytes_scanned")), 5, "bytes_scanned", "user_name")


HEAT = (
    u.DAY_SQL
    + f""", a AS (SELECT date_trunc('day', period) AS d, {o.RATIO} AS u FROM ut GROUP BY ALL),
w AS (SELECT CAST(x AS TIMESTAMP) AS period, CAST(isoyear(x) AS INTEGER) AS year, CAST(week(x) AS INTEGER) AS week, dayname(x) AS weekday, round(u * 100, 1) AS utilization
  FROM (SELECT unnest(generate_series(TIMESTAMP '1999-12-27', TIMESTAMP '2001-01-07', INTERVAL 1 DAY)) AS x) LEFT JOIN a ON x = d)"""
)


@register("report_weekly_heatmap", HEAT + "SELECT * FROM w")
def report_weekly_heatmap(spark, d):
    return r.weekly_heatmap(spark, u.utilization_day(spark, d), "2000-01-01", "2001-01-02")


@register(
    "report_weekly_heatmap_grid",
    HEAT
    + "SELECT year, week, "
    + ", ".join(f"max(utilization) FILTER (weekday = '{x}') AS {x}" for x in r.WEEKDAYS)
    + " FROM w GROUP BY ALL",
)
def report_weekly_heatmap_grid(spark, d):
    return r.heatmap_grid(r.weekly_heatmap(spark, u.utilization_day(spark, d), "2000-01-01", "2001-01-02"))


GRADES = """
  CASE WHEN total_elapsed_time < 60000 THEN 'XS' WHEN total_elapsed_time < 300000 THEN 'S' WHEN total_elapsed_time < 900000 THEN 'M'
    WHEN total_elapsed_time < 1800000 THEN 'L' WHEN total_elapsed_time < 3600000 THEN 'XL' ELSE 'XL+' END AS run_time_grade,
  (['XS','S','M','L','XL'])[greatest(
    CASE WHEN rows_produced < 1000000 THEN 0 WHEN rows_produced < 10000000 THEN 1 WHEN rows_produced < 100000000 THEN 2
      WHEN rows_produced < 1000000000 THEN 3 ELSE 4 END,
    CASE WHEN bytes_written_to_result < 1000000000 THEN 0 WHEN bytes_written_to_result < 10000000000 THEN 1
      WHEN bytes_written_to_result < 100000000000 THEN 2 WHEN bytes_written_to_result < 1000000000000 THEN 3 ELSE 4 END) + 1] AS size_grade,
  CASE WHEN bytes_spilled_to_remote_storage <> 0 THEN 'VeryPoor' WHEN bytes_spilled_to_local_storage = 0 THEN 'Good'
    WHEN bytes_spilled_to_local_storage <= 5000000000 THEN 'Acceptable' ELSE 'Poor' END AS efficiency_grade"""
INVOCATION = "substr(m,1,8)||'-'||substr(m,9,4)||'-'||substr(m,13,4)||'-'||substr(m,17,4)||'-'||substr(m,21,12)"


@register(
    "dbt_history",
    EQ
    + f"""SELECT query_id, cost, start_time, warehouse_name, user_name, total_elapsed_time, st_day, query_type, {GRADES},
  {INVOCATION} AS invocation_id, CASE WHEN k % 2 = 0 THEN 'table' ELSE 'view' END AS materialized,
  CAST(NULL AS VARCHAR) AS node_name, 'true' AS full_refresh FROM eq WHERE c % 4 = 0""",
)
def dbt_history(spark, d):
    return r.dbt_history(h.complete(spark, d)).select(
        "query_id", "cost", "start_time", "warehouse_name", "user_name", "total_elapsed_time", "st_day",
        "query_type", "run_time_grade", "size_grade", "efficiency_grade", "invocation_id", "materialized",
        "node_name", "full_refresh",
    )


MODELS = (
    EQ
    + f""", dm AS (SELECT CAST(date_trunc('month', start_time) AS TIMESTAMP) AS date, start_time, query_id, cost, credit_units, warehouse_id,
  'model.m' || c % 25 AS model_id, {INVOCATION} AS run_id, {GRADES} FROM eq WHERE c % 4 = 0 AND start_time {BETWEEN})"""
)


def models(spark, d):
    return r.dbt_models(h.complete(spark, d), START, END)


@register(
    "report_dbt_models",
    MODELS + "SELECT date, cost, model_id, run_id, run_time_grade, size_grade, efficiency_grade FROM dm",
)
def report_dbt_models(spark, d):
    return models(spark, d).select(
        "date", "cost", "model_id", "run_id", "run_time_grade", "size_grade", "efficiency_grade"
    )


@register(
    "report_dbt_cost",
    MODELS + f"SELECT date, {o.TOTAL_COST} AS cost, count(DISTINCT run_id) AS runs FROM dm GROUP BY ALL",
)
def report_dbt_cost(spark, d):
    return r.dbt_cost(models(spark, d))


@register(
    "report_dbt_model_cost",
    MODELS
    + f""", a AS (SELECT model_id, {o.TOTAL_COST} AS cost FROM dm GROUP BY ALL HAVING cost > 0.5),
t AS (SELECT model_id FROM a ORDER BY cost DESC, model_id LIMIT 20)
SELECT CASE WHEN model_id IN (SELECT model_id FROM t) THEN model_id ELSE 'Other' END AS model_id, {o.TOTAL_COST} AS cost
FROM dm WHERE model_id IN (SELECT model_id FROM a) GROUP BY 1""",
)
def report_dbt_model_cost(spark, d):
    return r.dbt_model_cost(models(spark, d))


@register(
    "report_dbt_trend",
    MODELS
    + """, x AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY date DESC, start_time DESC, query_id DESC) AS rn,
  list_position(['XS','S','M','L','XL'], size_grade) AS sc, list_position(['XS','S','M','L','XL','XL+'], run_time_grade) AS tc,
  list_position(['Good','Acceptable','Poor','VeryPoor'], efficiency_grade) AS ec FROM dm),
y AS (SELECT * FROM x WHERE rn <= 10), z AS (SELECT model_id, max(rn) AS mx FROM y GROUP BY ALL)
SELECT a.model_id, a.size_grade, a.run_time_grade, a.efficiency_grade,
  CASE WHEN a.sc < b.sc THEN '⬇️' WHEN a.sc > b.sc THEN '⬆️' ELSE '➖' END AS size_trend,
  CASE WHEN a.tc < b.tc THEN '⬇️' WHEN a.tc > b.tc THEN '⬆️' ELSE '➖' END AS run_time_trend,
  CASE WHEN a.ec < b.ec THEN '⬇️' WHEN a.ec > b.ec THEN '⬆️' ELSE '➖' END AS efficiency_trend
FROM z JOIN y a ON a.model_id = z.model_id AND a.rn = 1 JOIN y b ON b.model_id = z.model_id AND b.rn = mx""",
)
def report_dbt_trend(spark, d):
    return r.dbt_trend(models(spark, d))


@register(
    "query_list",
    EQ
    + f"""SELECT start_time, query_id, user_name, query_text, duration, execution_status, credits * 2 AS cost FROM eq
WHERE start_time {BETWEEN} ORDER BY start_time, query_id LIMIT 1000""",
)
def query_list(spark, d):
    return r.query_list(h.complete(spark, d), START, END)


@register(
    "report_filter",
    EQ
    + f"""SELECT query_id, warehouse_name, start_time FROM eq WHERE start_time {BETWEEN} AND warehouse_name IN ('WH_1', 'WH_5')""",
)
def report_filter(spark, d):
    rows = r.report_filter(h.complete(spark, d), START, END, ["WH_1", "WH_5"])
    return rows.select("query_id", "warehouse_name", "start_time")


@register(
    "label_filter",
    EQ
    + """, l AS (SELECT query_id, coalesce(compilation_time > 100, false) AS a, coalesce(query_type = 'SELECT', false) AS b,
  coalesce(bytes_scanned > 20000000000, false) AS c, coalesce(rows_produced > 150000000, false) AS e FROM eq)
SELECT query_id FROM l WHERE a AND (b OR c) AND NOT e""",
)
def label_filter_query(spark, d):
    labels = [
        Label("compilation_time > 100", "long compile"),
        Label("query_type = 'SELECT'", "reads"),
        Label("bytes_scanned > 20000000000", "big"),
        Label("rows_produced > 150000000", "many rows"),
    ]
    rows = apply_labels(h.complete(spark, d), labels)
    return rows.filter(label_filter(["long compile"], ["reads", "big"], ["many rows"])).select("query_id")


@register(
    "friendly_duration",
    o.with_(o.QH)
    + f""", x AS (SELECT query_id, total_elapsed_time * 20 AS ms, start_time, start_time + to_seconds(total_elapsed_time // 50) AS e FROM qh)
SELECT query_id, {BUCKET.format(x='ms')} AS by_ms, {ORDINAL.format(x='ms')} AS ord, {BUCKET.format(x='ms')} AS by_span FROM x""",
)
def friendly_duration_query(spark, d):
    q = adapters.query_history(spark, d).selectExpr(
        "query_id", "total_elapsed_time * 20 AS ms", "start_time",
        "start_time + make_dt_interval(0, 0, 0, total_elapsed_time div 50) AS e",
    )
    return q.select(
        "query_id",
        friendly_duration("ms").alias("by_ms"),
        friendly_duration_ordinal("ms").alias("ord"),
        friendly_duration("start_time", "e").alias("by_span"),
    )


@register(
    "emonth",
    o.with_(o.QH)
    + "SELECT CAST(date_diff('month', DATE '1970-01-01', CAST(start_time AS DATE)) AS INTEGER) AS emonth, count(*) AS queries FROM qh GROUP BY ALL",
)
def emonth_query(spark, d):
    q = adapters.query_history(spark, d)
    return q.groupBy(emonth("start_time").alias("emonth")).agg(F.count(F.lit(1)).alias("queries"))


@register(
    "period_range",
    o.with_(o.QH)
    + """SELECT query_id, CAST(greatest(date_diff('day', start_time, end_time), 0) + 1 AS INTEGER) AS days, CAST(greatest(date_diff('hour', start_time, end_time), 0) + 1 AS INTEGER) AS hours,
  CAST(greatest(date_diff('minute', start_time, end_time), 0) + 1 AS INTEGER) AS minutes, CAST(greatest(date_diff('day', start_time, end_time) + 1, 0) + 1 AS INTEGER) AS days_plus,
  CAST(greatest(k % 7 - 2, 0) AS INTEGER) AS indexes FROM qh""",
)
def period_range_query(spark, d):
    q = adapters.query_history(spark, d).withColumn("k", F.substring("query_id", 2, 20).cast("bigint"))
    size = lambda unit: F.size(period_range(unit, "start_time", "end_time"))
    return q.select(
        "query_id",
        size("day").alias("days"),
        size("hour").alias("hours"),
        size("minute").alias("minutes"),
        F.size(period_range_plus("day", "start_time", "end_time")).alias("days_plus"),
        F.size(index_range(F.lit(2), F.col("k") % 7)).alias("indexes"),
    )
