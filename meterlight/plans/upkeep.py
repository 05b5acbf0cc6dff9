"""Registered queries on the life of rules, runs and written tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlight.operators import maintenance as mt
from meterlight.operators import runlog
from meterlight.plans import history as h
from meterlight.plans import oracle_base as o
from meterlight.plans.registry import register
from meterlight.session import workspace
from meterlight.sources import adapters

AS_OF = o.AS_OF_QUERIES
TL = o.with_(o.TASK_LOG)
NOW = f"TIMESTAMP '{AS_OF}'"

# rules ----------------------------------------------------------------------------------------

ONE = """, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(name, group_name) ORDER BY label_id) AS rn FROM rl) WHERE rn = 1)
"""
SHOWN = ["name", "group_name", "condition", "label_id", "label_created_at", "label_modified_at"]
UPGRADE_AT, GAP_SECONDS = "2001-01-02 12:00:00", 86_400


def shipped(spark, d):
    """The rules that come with the system: one for each name, or for each group without a name."""
    rules = adapters.rule_rows(spark, d).withColumn("_k", F.coalesce("name", "group_name"))
    return mt.dedupe(rules, ["_k"], "label_id").drop("_k")


def shown(rules):
    """New rules have a random id, shown as 'fresh'."""
    fresh = F.when(F.length("label_id") == 36, F.lit("fresh")).otherwise(F.col("label_id"))
    return rules.withColumn("label_id", fresh).select(*SHOWN)


@register(
    "initialize_rules",
    o.with_(o.RULES) + ONE + "SELECT name, group_name, condition, 'fresh' AS label_id, label_created_at, label_created_at AS label_modified_at FROM one",
)
def initialize_rules(spark, d):
    """An empty table that was never filled gets the shipped rules."""
    rules = shipped(spark, d)
    return shown(mt.initialize_rules(rules.limit(0), rules, inited=False))


@register(
    "upgrade_rules",
    o.with_(o.RULES)
    + ONE
    + f""", old AS (SELECT * FROM one WHERE date_diff('second', label_created_at, TIMESTAMP '{UPGRADE_AT}') > {GAP_SECONDS})
SELECT one.name, one.group_name, one.condition || ' AND true' AS condition, coalesce(old.label_id, 'fresh') AS label_id,
  one.label_created_at, one.label_created_at AS label_modified_at FROM one LEFT JOIN old USING (label_id)""",
)
def upgrade_rules(spark, d):
    """The stored rules are the shipped ones of a day ago and nobody changed them: those stay with their ids
    and get the new conditions, rules shipped since come in."""
    rules = shipped(spark, d).withColumn("label_modified_at", F.col("label_created_at"))
    stored = rules.filter(f"timestampdiff(SECOND, label_created_at, TIMESTAMP_NTZ'{UPGRADE_AT}') > {GAP_SECONDS}")
    newer = rules.withColumn("condition", F.concat("condition", F.lit(" AND true"))).drop("label_id", "label_modified_at")
    return shown(mt.upgrade_rules(stored, newer, UPGRADE_AT, GAP_SECONDS))


@register(
    "upgrade_rules_kept",
    o.with_(o.RULES) + ONE + "SELECT name, group_name, condition, label_id, label_created_at, label_modified_at FROM one",
)
def upgrade_rules_kept(spark, d):
    """Users have changed rules: nothing is upgraded, the table stays as it is."""
    rules = shipped(spark, d)
    newer = rules.withColumn("condition", F.concat("condition", F.lit(" AND true"))).drop("label_id", "label_modified_at")
    after = mt.upgrade_rules(rules, newer, "2002-01-01 00:00:00", GAP_SECONDS)
    return shown(rules if after is None else after)


@register(
    "rule_lists",
    o.with_(o.RULES)
    + """SELECT group_name, count(*) AS rules, string_agg(name, ', ' ORDER BY coalesce(group_rank, 0), label_id) AS names
FROM rl WHERE group_name IS NOT NULL AND name IS NOT NULL GROUP BY ALL""",
)
def rule_lists(spark, d):
    return mt.rule_lists(adapters.rule_rows(spark, d))


# runs -----------------------------------------------------------------------------------------


@register(
    "task_log_start",
    TL
    + f""", last AS (SELECT task_name, object_name, max(task_start) AS task_start, arg_max(k % 100, struct_pack(s := task_start, r := task_run_id)) AS n FROM tl WHERE success GROUP BY ALL)
SELECT r.task_name, r.object_name, 'next' || r.task_name || r.object_name AS task_run_id, {NOW} AS task_start, CAST(n AS BIGINT) AS new_records, last.task_start AS range_max, CAST(NULL AS BOOLEAN) AS success
FROM (SELECT DISTINCT task_name, object_name FROM tl) r LEFT JOIN last USING (task_name, object_name)""",
)
def task_log_start(spark, d):
    """Every task starts on every object; each gets the output of its last good run."""
    log = adapters.task_log(spark, d)
    runs = log.select("task_name", "object_name").distinct().withColumns(
        {"task_run_id": F.concat(F.lit("next"), "task_name", "object_name"), "query_id": F.lit("q")}
    )
    started = runlog.start_runs(log, runs, AS_OF)
    records = F.get_json_object("input", "$.new_records").cast("bigint")
    return started.select("task_name", "object_name", "task_run_id", "task_start", records.alias("new_records"), "range_max", "success")


@register(
    "task_log_finish",
    TL
    + f"""SELECT task_run_id, CASE WHEN success IS NULL THEN k % 2 = 0 ELSE success END AS success,
  CASE WHEN success IS NULL THEN {NOW} ELSE task_finish END AS task_finish,
  CASE WHEN success IS NOT NULL THEN range_min WHEN k % 2 = 0 THEN task_start END AS range_min,
  CASE WHEN success IS NOT NULL THEN range_max WHEN k % 2 = 0 THEN task_start + INTERVAL 1 HOUR END AS range_max,
  CASE WHEN success IS NULL AND k % 2 = 1 THEN 'stopped' WHEN NOT success THEN error_message END AS error FROM tl""",
)
def task_log_finish(spark, d):
    """All open runs end: those of even orders well, with a range, the others with an error."""
    log = adapters.task_log(spark, d)
    good = F.substring("task_run_id", 4, 20).cast("bigint") % 2 == 0
    fine = F.concat(F.lit('{"range_min":"'), F.col("task_start").cast("string"), F.lit('","range_max":"'), (F.col("task_start") + F.expr("INTERVAL 1 HOUR")).cast("string"), F.lit('"}'))
    output = F.when(good, fine).otherwise(F.lit('{"SQLERRM":"stopped"}'))
    results = log.filter("success IS NULL").select("task_run_id", "task_name", "object_name", output.alias("output"))
    done = runlog.finish_runs(log, results, AS_OF)
    return done.select("task_run_id", "success", "task_finish", "range_min", "range_max", F.get_json_object("output", "$.SQLERRM").alias("error"))


@register(
    "task_log_split",
    TL
    + f"""SELECT task_run_id, kind || '_SESSIONS' AS object_name, true AS success, {NOW} AS task_finish,
  CASE kind WHEN 'CLUSTER' THEN task_start ELSE task_start + INTERVAL 1 DAY END AS range_min, CASE kind WHEN 'CLUSTER' THEN NULL ELSE task_start + INTERVAL 2 DAY END AS range_max
FROM tl, (VALUES ('CLUSTER'), ('WAREHOUSE')) AS t(kind)""",
)
def task_log_split(spark, d):
    """Every run read as one of the event task: a row for cluster and one for warehouse sessions."""
    log = adapters.task_log(spark, d).withColumn("object_name", F.lit("WAREHOUSE_EVENTS_HISTORY"))
    at = lambda days: (F.col("task_start") + F.expr(f"INTERVAL {days} DAYS")).cast("string")
    ranges = F.struct(at(0).alias("cluster_range_min"), at(1).alias("warehouse_range_min"), at(2).alias("warehouse_range_max"))
    rows = runlog.split_event_runs(log, log.select("task_run_id", F.to_json(ranges).alias("output")), AS_OF)
    return rows.select("task_run_id", "object_name", "success", "task_finish", "range_min", "range_max")


# written tables -------------------------------------------------------------------------------

LAYOUT = ["record_type", "st_day"]


def layout(spark, d, path):
    """Slices in folders by record type and day, sorted inside."""
    rows = h.slices(spark, d).select("query_id", "record_type", "st_period", "duration")
    rows = rows.withColumn("st_day", F.to_date("st_period"))
    mt.write_layout(rows, path, LAYOUT, ["st_period", "query_id"])
    return rows


@register(
    "table_layout",
    o.with_(o.QH, o.SLICES)
    + """SELECT record_type, CAST(st_period AS DATE) AS st_day, count(*) AS slices, CAST(sum(duration) AS BIGINT) AS duration FROM slices
WHERE record_type = 'DAILY' AND st_period BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '2000-03-31' GROUP BY ALL""",
)
def table_layout(spark, d):
    """Read back, only the folders of the days asked for are listed and read."""
    path = workspace(spark, "layout")
    layout(spark, d, path)
    back = mt.batch_read(spark, path, "record_type = 'DAILY' AND st_day BETWEEN DATE'2000-01-01' AND DATE'2000-03-31'")
    return back.groupBy("record_type", "st_day").agg(F.count(F.lit(1)).alias("slices"), F.sum("duration").alias("duration"))


@register(
    "overwrite_days",
    o.with_(o.QH, o.SLICES)
    + """SELECT record_type, CAST(st_period AS DATE) AS st_day, count(*) AS slices,
  CAST(sum(CASE WHEN record_type = 'DAILY' AND month(st_period) = 3 THEN 2 * duration ELSE duration END) AS BIGINT) AS duration FROM slices GROUP BY ALL""",
)
def overwrite_days(spark, d):
    """The daily slices of each March are doubled: their days are rewritten, all others stay."""
    path = workspace(spark, "layout")
    rows = layout(spark, d, path)
    changed = rows.filter("record_type = 'DAILY' AND month(st_day) = 3").withColumn("duration", 2 * F.col("duration"))
    mt.overwrite_days(changed, path, LAYOUT)
    back = mt.batch_read(spark, path)
    return back.groupBy(*LAYOUT).agg(F.count(F.lit(1)).alias("slices"), F.sum("duration").alias("duration"))


@register(
    "batch_read",
    o.with_(o.USERS) + "SELECT user_id, name, email, row_number() OVER (ORDER BY name DESC, user_id) AS place FROM us WHERE email IS NOT NULL QUALIFY place <= 25",
)
def batch_read(spark, d):
    """Two appends by name, read back with a filter and an order; the first 25."""
    path = workspace(spark, "users")
    users = adapters.users(spark, d).select("user_id", "name", "email")
    mt.append(users, path, users.schema, "user_id % 2 = 0")
    mt.append(users.select("email", "user_id", "name"), path, users.schema, "user_id % 2 = 1")
    rows = mt.batch_read(spark, path, "email IS NOT NULL", [F.desc("name"), "user_id"], 25)
    return rows.withColumn("place", F.row_number().over(_whole_order()).cast("bigint"))


def _whole_order():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1)).orderBy(F.desc("name"), "user_id")  # over 25 rows


@register("replace_table", o.with_(o.USERS) + "SELECT user_id, name, 'new' AS email FROM us WHERE user_id % 3 <> 0")
def replace_table(spark, d):
    """Truncate and reload: nothing of the first load is left."""
    path = workspace(spark, "users")
    users = adapters.users(spark, d).select("user_id", "name", "email")
    mt.replace_table(users, path)
    mt.replace_table(users.filter("user_id % 3 <> 0").withColumn("email", F.lit("new")), path)
    return mt.batch_read(spark, path)
