"""Query history: slices, cost, tags, labels of text."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlight.functions.grades import run_time_grade, size_grade, spill_grade, bytes_level, rows_level
from meterlight.functions.tags import (
    extract_tags,
    tag_equals,
    tag_exists,
    tag_keys,
    tag_matches,
    tag_sources,
    tag_value,
    tags_to_map,
)
from meterlight.functions.text import fingerprint, hash_literals, referenced_tables
from meterlight.functions.warehouses import (
    credit_price,
    credits_per_milli,
    is_serverless_id,
    is_serverless_name,
    warehouse_multiplier,
)
from meterlight.operators import history
from meterlight.plans import oracle_base as o
from meterlight.plans.registry import register
from meterlight.sources import adapters, schemas
from meterlight.sources.readers import conform

AS_OF = o.AS_OF_QUERIES


def slices(spark, d):
    return history.day_slices(adapters.query_history(spark, d), AS_OF)


def complete(spark, d):
    """Enriched history; only finished queries, so nothing is cut into days first."""
    return history.enriched(history.complete_rows(adapters.query_history(spark, d)))


def daily(spark, d):
    rows = history.day_slices(adapters.query_history(spark, d), AS_OF, with_complete=False)
    return history.enriched_daily(rows)


def hourly(spark, d):
    return history.enriched_hourly(complete(spark, d))


@register(
    "src_query_history",
    o.with_(o.QH)
    + """SELECT query_id, query_text, database_name, query_type, session_id, user_name, role_name, warehouse_id,
  warehouse_name, warehouse_size, warehouse_type, execution_status, start_time, end_time, total_elapsed_time,
  bytes_scanned, rows_produced, CAST(NULL AS VARCHAR) AS query_hash, credits_used_cloud_services FROM qh""",
)
def src_query_history(spark, d):
    full = conform(adapters.query_history(spark, d), schemas.QUERY_HISTORY)
    return full.select(
        "query_id", "query_text", "database_name", "query_type", "session_id", "user_name",
        "role_name", "warehouse_id", "warehouse_name", "warehouse_size", "warehouse_type",
        "execution_status", "start_time", "end_time", "total_elapsed_time", "bytes_scanned",
        "rows_produced", "query_hash", "credits_used_cloud_services",
    )


SLICE_COLUMNS = ("query_id", "record_type", "st", "et", "st_period", "duration", "incomplete", "credit_units")


@register(
    "query_day_slices",
    o.with_(o.QH, o.SLICES)
    + "SELECT query_id, record_type, st, et, st_period, duration, incomplete, credit_units FROM slices",
)
def query_day_slices(spark, d):
    return slices(spark, d).select(*SLICE_COLUMNS)


@register(
    "query_cost",
    o.with_(o.QH, o.SLICES, o.ENRICHED)
    + f"SELECT query_id, warehouse_id, warehouse_size, duration, credits, cost, {o.PRICE} AS price FROM eq",
)
def query_cost(spark, d):
    return complete(spark, d).select(
        "query_id", "warehouse_id", "warehouse_size", "duration",
        F.col("unloaded_direct_compute_credits").alias("credits"), "cost",
        credit_price("warehouse_id").alias("price"),
    )


@register(
    "enriched_query_history",
    o.with_(o.QH, o.SLICES, o.ENRICHED)
    + """SELECT query_id, user_name, st, et, st_period, st_day, duration, incomplete, credits, cost,
  CASE WHEN c % 4 = 0 THEN 'model.m' || c % 25 END AS node_id FROM eq""",
)
def enriched_query_history(spark, d):
    return complete(spark, d).select(
        "query_id", "user_name", "st", "et", "st_period", "st_day", "duration", "incomplete",
        F.col("unloaded_direct_compute_credits").alias("credits"), "cost",
        tag_value("qtag_filter", "dbt", "node_id").alias("node_id"),
    )


@register(
    "enriched_query_history_daily",
    o.with_(o.QH, o.SLICES, o.DAILY)
    + "SELECT query_id, user_name, st, et, st_period, st_day, duration, incomplete, credits, cost FROM ed",
)
def enriched_query_history_daily(spark, d):
    return daily(spark, d).select(
        "query_id", "user_name", "st", "et", "st_period", "st_day", "duration", "incomplete",
        F.col("unloaded_direct_compute_credits").alias("credits"), "cost",
    )


@register(
    "enriched_query_history_hourly",
    o.with_(o.QH, o.HOURLY)
    + "SELECT query_id, user_name, st, et, st_period, st_day, duration, credits, cost FROM eh",
)
def enriched_query_history_hourly(spark, d):
    return hourly(spark, d).select(
        "query_id", "user_name", "st", "et", "st_period", "st_day", "duration",
        F.col("unloaded_direct_compute_credits").alias("credits"), "cost",
    )


@register(
    "is_serverless",
    o.with_(o.QH)
    + """SELECT warehouse_id > 700000 AS by_id, starts_with(warehouse_name, 'COMPUTE_SERVICE_WH_USER_TASKS_POOL_') AS by_name,
  count(*) AS queries FROM qh GROUP BY ALL""",
)
def is_serverless(spark, d):
    return (
        adapters.query_history(spark, d)
        .groupBy(
            is_serverless_id("warehouse_id").alias("by_id"),
            is_serverless_name("warehouse_name").alias("by_name"),
        )
        .agg(F.count(F.lit(1)).alias("queries"))
    )


@register(
    "warehouse_multiplier",
    o.with_(o.QH)
    + f""", r AS (SELECT warehouse_size, warehouse_type, CAST({o.RATE} AS DOUBLE) AS rate FROM qh),
r2 AS (SELECT *, CASE WHEN warehouse_size IS NULL THEN NULL WHEN warehouse_type = 'STANDARD' THEN rate
  WHEN warehouse_size NOT IN ('X-Small', 'Small') THEN rate * 1.5 END AS multiplier FROM r)
SELECT warehouse_size, warehouse_type, min(multiplier) AS multiplier,
  min(coalesce(multiplier, 0) / CAST(3600 AS DOUBLE) / CAST(1000 AS DOUBLE)) AS per_milli, count(*) AS queries
FROM r2 GROUP BY ALL""",
)
def warehouse_multiplier_query(spark, d):
    q = adapters.query_history(spark, d)
    return q.groupBy("warehouse_size", "warehouse_type").agg(
        F.min(warehouse_multiplier("warehouse_size", "warehouse_type")).alias("multiplier"),
        F.min(credits_per_milli("warehouse_size", "warehouse_type")).alias("per_milli"),
        F.count(F.lit(1)).alias("queries"),
    )


@register(
    "query_fingerprint",
    o.with_(o.QH)
    + r""", f AS (SELECT query_id, query_text,
  md5(lower(trim(regexp_replace(regexp_replace(regexp_replace(query_text, '''(?:[^'']|'''')*''', '?', 'g'),
    '\b[0-9]+(?:\.[0-9]+)?\b', '?', 'g'), '\s+', ' ', 'g')))) AS fingerprint,
  CAST(('0x' || substr(md5(CAST(k % 97 AS VARCHAR)), 1, 8)) AS BIGINT) % 1000000000 AS n FROM qh)
SELECT query_id, fingerprint, 'select ' || n || ' from db.t' || c % 20 || ' where k = ''' || md5(CAST(k AS VARCHAR)) || '''' AS hashed
FROM f JOIN qh USING (query_id)""",
)
def query_fingerprint(spark, d):
    return adapters.query_history(spark, d).select(
        "query_id",
        fingerprint("query_text").alias("fingerprint"),
        hash_literals("query_text").alias("hashed"),
    )


@register(
    "table_usage",
    o.with_(o.QH)
    + """, t AS (SELECT upper(database_name || '.DB.T' || c % 20) AS table_name FROM qh
  UNION ALL SELECT upper(database_name || '.MAIN.LOOKUP') FROM qh WHERE k % 4 = 1)
SELECT table_name, count(*) AS queries FROM t GROUP BY ALL""",
)
def table_usage(spark, d):
    """Every fourth text is wrapped in a WITH that joins a second table."""
    wrapped = F.concat(
        F.lit("with recent as ("), "query_text", F.lit(") select * from recent r join lookup l on true")
    )
    odd = F.substring("query_id", 2, 20).cast("bigint") % 4 == 1
    text = F.when(odd, wrapped).otherwise(F.col("query_text"))
    return (
        adapters.query_history(spark, d)
        .select(F.explode(referenced_tables(text, "database_name", "schema_name")).alias("table_name"))
        .groupBy("table_name")
        .agg(F.count(F.lit(1)).alias("queries"))
    )


@register(
    "qtag_map",
    o.with_(o.QH, o.TAGS) + "SELECT query_id, source, key, value FROM tags",
)
def qtag_map(spark, d):
    return _tag_rows(adapters.query_history(spark, d).select("query_id", tags_to_map("qtag").alias("m")))


def _tag_rows(mapped):
    """One row per source and key. The outer form keeps the parsing out of pushed filters."""
    inner = mapped.select("query_id", F.explode_outer("m").alias("source", "inner"))
    rows = inner.select("query_id", "source", F.explode_outer("inner").alias("key", "value"))
    return rows.filter(F.col("key").isNotNull())


@register(
    "qtag_extract",
    o.with_(o.QH, o.TAGS) + "SELECT query_id, source, key, value FROM tags",
)
def qtag_extract(spark, d):
    text = F.concat(
        "query_text",
        F.when(
            F.col("qtag").isNotNull(), F.concat(F.lit(" /* "), F.to_json("qtag"), F.lit(" */"))
        ).otherwise(F.lit(" /* [{bad */")),
    )
    found = adapters.query_history(spark, d).select("query_id", tags_to_map(extract_tags(text)).alias("m"))
    return _tag_rows(found)


@register(
    "qtag_match",
    o.with_(o.QH)
    + """SELECT query_id, coalesce(c % 4 = 1 AND c % 7 = 3, false) AS team_t3, c % 4 = 0 AS has_node,
  c % 4 = 0 AND k % 3 <> 0 AS full_refresh, CASE WHEN c % 4 = 0 THEN 'model.m' || c % 25 END AS node,
  c % 4 = 0 AND c % 25 < 10 AS small_model, false AS partial FROM qh""",
)
def qtag_match(spark, d):
    m = adapters.query_history(spark, d).select("query_id", tags_to_map("qtag").alias("m"))
    return m.select(
        "query_id",
        tag_equals("m", "app", "team", "t3").alias("team_t3"),
        tag_exists("m", "dbt", "node_id").alias("has_node"),
        tag_exists("m", "dbt", "full_refresh").alias("full_refresh"),
        tag_value("m", "dbt", "node_id").alias("node"),
        tag_matches("m", "dbt", "node_id", r"MODEL\.m[0-9]", "i").alias("small_model"),
        tag_matches("m", "dbt", "node_id", "model").alias("partial"),
    )


@register(
    "qtag_keys",
    o.with_(o.QH)
    + """SELECT query_id, CASE c % 4 WHEN 0 THEN CASE WHEN k % 3 = 0 THEN 'dbt,undefined' ELSE 'dbt' END WHEN 1 THEN 'app' END AS sources,
  CASE WHEN c % 4 = 0 THEN CASE WHEN k % 3 = 0 THEN 'invocation_id,materialized,node_id'
    ELSE 'full_refresh,invocation_id,materialized,node_id' END END AS dbt_keys FROM qh""",
)
def qtag_keys(spark, d):
    m = adapters.query_history(spark, d).select("query_id", tags_to_map("qtag").alias("m"))
    return m.select(
        "query_id",
        F.array_join(tag_sources("m"), ",").alias("sources"),
        F.array_join(tag_keys("m", "dbt"), ",").alias("dbt_keys"),
    )


@register(
    "dbt_grades",
    o.with_(o.QH)
    + """SELECT query_id,
  CASE WHEN total_elapsed_time < 60000 THEN 'XS' WHEN total_elapsed_time < 300000 THEN 'S' WHEN total_elapsed_time < 900000 THEN 'M'
    WHEN total_elapsed_time < 1800000 THEN 'L' WHEN total_elapsed_time < 3600000 THEN 'XL' ELSE 'XL+' END AS run_time_grade,
  (['XS','S','M','L','XL'])[greatest(
    CASE WHEN rows_produced < 1000000 THEN 0 WHEN rows_produced < 10000000 THEN 1 WHEN rows_produced < 100000000 THEN 2
      WHEN rows_produced < 1000000000 THEN 3 ELSE 4 END,
    CASE WHEN bytes_written_to_result < 1000000000 THEN 0 WHEN bytes_written_to_result < 10000000000 THEN 1
      WHEN bytes_written_to_result < 100000000000 THEN 2 WHEN bytes_written_to_result < 1000000000000 THEN 3 ELSE 4 END) + 1] AS size_grade,
  CASE WHEN bytes_spilled_to_remote_storage <> 0 THEN 'VeryPoor' WHEN bytes_spilled_to_local_storage = 0 THEN 'Good'
    WHEN bytes_spilled_to_local_storage <= 5000000000 THEN 'Acceptable' ELSE 'Poor' END AS efficiency_grade FROM qh""",
)
def dbt_grades(spark, d):
    return adapters.query_history(spark, d).select(
        "query_id",
        run_time_grade("total_elapsed_time").alias("run_time_grade"),
        size_grade(rows_level("rows_produced"), bytes_level("bytes_written_to_result")).alias("size_grade"),
        spill_grade("bytes_spilled_to_local_storage", "bytes_spilled_to_remote_storage").alias("efficiency_grade"),
    )
