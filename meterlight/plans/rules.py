"""Registered label, monitor and rule-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlight.functions.maps import merge_concat_objects, merge_objects
from meterlight.operators import labels as lb
from meterlight.operators import maintenance as mt
from meterlight.operators import monitors as mon
from meterlight.plans import history as h
from meterlight.plans import oracle_base as o
from meterlight.plans.registry import register
from meterlight.sources import adapters, readers

EQ = o.with_(o.QH, o.SLICES, o.ENRICHED)
AS_OF = o.AS_OF_QUERIES

UNGROUPED = (
    lb.Label("rows_produced > 50000000", "Large Results"),
    lb.Label("warehouse_size IN ('Large', 'X-Large')", "Mid Size"),
    lb.Label("bytes_scanned > 1", "Switched Off", enabled=False),
)
GROUPED = (
    lb.Label("bytes_scanned > 30000000000", "heavy", "weight", 1),
    lb.Label("bytes_scanned > 10000000000", "medium", "weight", 2),
    lb.Label("warehouse_size = 'Small'", "tiny compute", "compute", 1),
    lb.Label("warehouse_size LIKE '%X-Large'", "huge compute", "compute", 1),
    lb.Label("role_name LIKE '1-%'", "urgent", "compute", 2),
)
DYNAMIC = (
    lb.Label("try_element_at(try_element_at(qtag_filter, 'dbt'), 'node_id')", group="Model", dynamic=True),
    lb.Label("partitions_scanned div 25", group="Scan Quarter", dynamic=True),
)
UNGROUPED_SQL = """coalesce(rows_produced > 50000000, false) AS "Large Results",
  coalesce(warehouse_size IN ('Large', 'X-Large'), false) AS "Mid Size\""""
GROUPED_SQL = """CASE WHEN bytes_scanned > 30000000000 THEN 'heavy' WHEN bytes_scanned > 10000000000 THEN 'medium' ELSE 'Other' END AS weight,
  CASE WHEN warehouse_size LIKE '%X-Large' THEN 'huge compute' WHEN warehouse_size = 'Small' THEN 'tiny compute'
    WHEN role_name LIKE '1-%' THEN 'urgent' ELSE 'Other' END AS compute"""
DYNAMIC_SQL = """CASE WHEN c % 4 = 0 THEN 'model.m' || c % 25 ELSE 'Other' END AS "Model",
  CAST(partitions_scanned // 25 AS VARCHAR) AS "Scan Quarter\""""


def _labels(name, rules, sql, columns):
    @register(name, EQ + f"SELECT query_id, {sql} FROM eq")
    def query(spark, d):
        return lb.apply_labels(h.complete(spark, d), rules).select("query_id", *columns)


_labels("labels_ungrouped", UNGROUPED, UNGROUPED_SQL, ["Large Results", "Mid Size"])
_labels("labels_grouped", GROUPED, GROUPED_SQL, ["weight", "compute"])
_labels("labels_dynamic", DYNAMIC, DYNAMIC_SQL, ["Model", "Scan Quarter"])


@register(
    "labeled_query_history",
    EQ + f"SELECT query_id, cost, st_day, {UNGROUPED_SQL}, {GROUPED_SQL}, {DYNAMIC_SQL} FROM eq",
)
def labeled_query_history(spark, d):
    return lb.apply_labels(h.complete(spark, d), UNGROUPED + GROUPED + DYNAMIC).select(
        "query_id", "cost", "st_day", "Large Results", "Mid Size", "weight", "compute", "Model", "Scan Quarter"
    )


@register(
    "predefined_labels",
    EQ
    + """, u AS (SELECT query_parameterized_hash, count(*) AS uses FROM eq GROUP BY ALL)
SELECT query_id, coalesce(rows_produced > 50000000, false) AS "Large Results",
  query_type IN ('CREATE_TABLE_AS_SELECT', 'INSERT') AS "Writes", 10 * bytes_scanned < bytes_written_to_result AS "Expanding Output",
  partitions_scanned > partitions_total * 0.95 AS "Full Scans", compilation_time > 100 AS "Long Compilation",
  total_elapsed_time > 600000 AS "Long Queries", cost > 0.5 AS "Expensive Queries",
  query_acceleration_bytes_scanned > 0 AS "Accelerated Queries", uses > 1000 AS "Reoccurring Queries", uses < 10 AS "ad-hoc Queries",
  c % 4 = 0 AS "dbt Queries", CASE WHEN c % 4 = 0 THEN 'model.m' || c % 25 ELSE 'Other' END AS "dbt Models",
  CASE c % 4 WHEN 0 THEN 'dbt' WHEN 1 THEN 'app' ELSE 'Other' END AS "qtag Sources"
FROM eq JOIN u USING (query_parameterized_hash)""",
)
def predefined_labels(spark, d):
    rows = lb.with_hash_uses(h.complete(spark, d))
    names = [x.name or x.group for x in lb.PREDEFINED_LABELS]
    return lb.apply_labels(rows, lb.PREDEFINED_LABELS).select("query_id", *names)


USES = ", u AS (SELECT query_parameterized_hash, count(*) AS uses FROM eq GROUP BY ALL)\n"


@register(
    "recurring_queries",
    EQ + USES + "SELECT query_id, uses > 60 AS is_recurring FROM eq JOIN u USING (query_parameterized_hash)",
)
def recurring_queries(spark, d):
    return lb.recurring(h.complete(spark, d), 60).select("query_id", "is_recurring")


@register(
    "adhoc_queries",
    EQ + USES + "SELECT query_id, uses < 45 AS is_ad_hoc FROM eq JOIN u USING (query_parameterized_hash)",
)
def adhoc_queries(spark, d):
    return lb.ad_hoc(h.complete(spark, d), 45).select("query_id", "is_ad_hoc")


CHECKED = ("bytes_scanned > 10000000000", "no_such_column > 10", "cost > 0.5", "start_time +", "array(1) > 2", "warehouse_size LIKE '%X-Large' AND rows_produced > 50000000")


@register(
    "validate_rule",
    EQ
    + "\nUNION ALL ".join(
        f"SELECT '{r.replace(chr(39), chr(39) * 2)}' AS rule, {'true' if ok else 'false'} AS valid, "
        + (f"(SELECT count(*) FILTER ({r}) FROM eq)" if ok else "CAST(NULL AS BIGINT)")
        + " AS matches"
        for r, ok in zip(CHECKED, (True, False, True, False, False, True))
    ),
)
def validate_rule(spark, d):
    """Which rules fit the history, by analysis alone, and how many rows those match."""
    return lb.check_rules(h.complete(spark, d), CHECKED)


@register(
    "label_name_conflicts",
    o.with_(o.RULES)
    + """, p AS (SELECT name, 0 AS g FROM rl WHERE group_name IS NULL AND name IS NOT NULL UNION ALL SELECT group_name, 1 FROM rl WHERE group_name IS NOT NULL),
n AS (SELECT name, sum(1 - g) AS ls, sum(g) AS gs FROM p GROUP BY ALL)
SELECT name, 'label exists twice' AS problem FROM n WHERE ls > 1
UNION ALL SELECT name, 'label named like a group' FROM n WHERE ls > 0 AND gs > 0
UNION ALL SELECT DISTINCT name, 'label exists twice in its group' FROM (SELECT group_name, name FROM rl WHERE group_name IS NOT NULL AND name IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT group_name, 'dynamic group has other rules' FROM rl WHERE group_name IS NOT NULL GROUP BY ALL HAVING count(*) > 1 AND bool_or(is_dynamic)
UNION ALL SELECT name, 'column exists' FROM n WHERE lower(name) IN ('label_4', 'group_1')""",
)
def label_name_conflicts(spark, d):
    return lb.name_conflicts(adapters.rule_rows(spark, d), ["query_id", "Label_4", "group_1"])


@register(
    "dedupe_rules",
    o.with_(o.RULES)
    + """SELECT name, group_name, label_id, condition FROM (SELECT *, row_number() OVER (PARTITION BY name, group_name ORDER BY label_id) AS rn FROM rl) WHERE rn = 1""",
)
def dedupe_rules(spark, d):
    return mt.remove_duplicate_labels(adapters.rule_rows(spark, d)).select(
        "name", "group_name", "label_id", "condition"
    )


@register(
    "rules_changed",
    o.with_(o.RULES)
    + """, a AS (SELECT name, group_name, label_created_at AS at FROM rl), b AS (SELECT name, group_name, label_modified_at AS at FROM rl)
SELECT *, 'old' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT *, 'new' AS side FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
def rules_changed(spark, d):
    rules = adapters.rule_rows(spark, d)
    old = rules.select("name", "group_name", F.col("label_created_at").alias("at"))
    new = rules.select("name", "group_name", F.col("label_modified_at").alias("at"))
    return mt.changed(old, new, ["name", "group_name", "at"])


@register(
    "merge_missing_rules",
    o.with_(o.RULES)
    + """, e AS (SELECT * FROM rl WHERE label_id < '4')
SELECT name, group_name, label_id FROM rl WHERE name IS NOT NULL AND name NOT IN (SELECT name FROM e WHERE name IS NOT NULL)
UNION ALL SELECT name, group_name, label_id FROM rl WHERE name IS NULL AND group_name NOT IN (SELECT group_name FROM e WHERE group_name IS NOT NULL)""",
)
def merge_missing_rules(spark, d):
    rules = adapters.rule_rows(spark, d)
    return mt.merge_missing(rules.filter("label_id < '4'"), rules).select("name", "group_name", "label_id")


@register(
    "merge_two_key",
    o.with_(o.RULES)
    + """, one AS (SELECT name, group_name, condition, label_id FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(name, group_name) ORDER BY label_id) AS rn FROM rl) WHERE rn = 1),
t AS (SELECT * FROM one WHERE substr(label_id, 1, 1) < '8'), n AS (SELECT name, group_name, condition || ' AND true' AS condition FROM one WHERE substr(label_id, 2, 1) < '8')
SELECT t.name, t.group_name, coalesce(n.condition, t.condition) AS condition, t.label_id FROM t LEFT JOIN n ON coalesce(n.name, n.group_name) = coalesce(t.name, t.group_name) AND (n.name IS NULL) = (t.name IS NULL)
UNION ALL SELECT name, group_name, condition, 'fresh' FROM n WHERE NOT EXISTS (SELECT 1 FROM t WHERE coalesce(n.name, n.group_name) = coalesce(t.name, t.group_name) AND (n.name IS NULL) = (t.name IS NULL))""",
)
def merge_two_key(spark, d):
    """New rows get a random id, shown here as 'fresh'."""
    rules = mt.dedupe(
        adapters.rule_rows(spark, d).withColumn("_k", F.coalesce("name", "group_name")), ["_k"], "label_id"
    ).select("name", "group_name", "condition", "label_id")
    target = rules.filter("substr(label_id, 1, 1) < '8'")
    updates = rules.filter("substr(label_id, 2, 1) < '8'").selectExpr(
        "name", "group_name", "concat(condition, ' AND true') AS condition"
    )
    merged = mt.upsert_two_key(target, updates, "name", "group_name", ["label_id"], "label_id")
    shown = F.when(F.length("label_id") == 36, F.lit("fresh")).otherwise(F.col("label_id"))
    return merged.withColumn("label_id", shown)


@register(
    "merge_upsert",
    o.with_(o.USERS)
    + """, n AS (SELECT user_id, name, 'new_' || user_id || '@example.com' AS email FROM us WHERE user_id % 3 = 0
  UNION ALL SELECT user_id + 10000000, 'late_' || user_id, NULL FROM us WHERE user_id % 3 = 1)
SELECT user_id, name, email FROM us WHERE user_id NOT IN (SELECT user_id FROM n) UNION ALL SELECT * FROM n""",
)
def merge_upsert(spark, d):
    target = adapters.users(spark, d).select("user_id", "name", "email")
    updates = target.filter("user_id % 3 = 0").selectExpr(
        "user_id", "name", "concat('new_', user_id, '@example.com') AS email"
    )
    added = target.filter("user_id % 3 = 1").selectExpr(
        "user_id + 10000000 AS user_id", "concat('late_', user_id) AS name", "cast(NULL AS string) AS email"
    )
    return mt.upsert(target, updates.unionByName(added), ["user_id"])


LIVE = (
    o.with_(o.QH, o.WAREHOUSES)
    + """, lv AS (SELECT q.*, coalesce(CASE warehouse_size2 WHEN 'X-Small' THEN 1 WHEN 'Small' THEN 2 WHEN 'Medium' THEN 4 WHEN 'Large' THEN 8
    WHEN 'X-Large' THEN 16 WHEN '2X-Large' THEN 32 WHEN '3X-Large' THEN 64 WHEN '4X-Large' THEN 128 WHEN '5X-Large' THEN 256
    WHEN '6X-Large' THEN 512 END * CASE WHEN type2 = 'STANDARD' THEN 1.0 WHEN warehouse_size2 IN ('X-Small', 'Small') THEN NULL ELSE 1.5 END, 0)
    * CAST(date_diff('second', start_time, TIMESTAMP '2001-09-01') * 1000 AS DOUBLE) / CAST(3600000 AS DOUBLE) AS approx_credits
  FROM (SELECT qh.*, wh.warehouse_size AS warehouse_size2, coalesce(wh.warehouse_type, 'STANDARD') AS type2 FROM qh LEFT JOIN wh USING (warehouse_name)
    WHERE execution_status = 'RUNNING') q)"""
)
PROBES = (
    mon.Probe("Silent", "bytes_scanned > 0"),
    mon.Probe("Long Queries", mon.PREDEFINED_PROBES[0].condition, notify_writer=True),
    mon.Probe("Big Readers", "bytes_scanned > 10000000000", notify_other="#ops, #cost", notify_other_method="Slack"),
    mon.Probe("Costs 50 Credits", "approx_credits > 50", notify_writer=True, notify_other="cost@example.com", cancel=True),
    mon.Probe("Off", "true", cancel=True, enabled=False),
)
MATCH_SQL = """, ma AS (SELECT *, 1 AS rank, 'Long Queries' AS probe_name FROM lv WHERE start_time < TIMESTAMP '2001-09-01' - INTERVAL 10 MINUTE AND query_type <> 'EXECUTE_STREAMLIT'
  UNION ALL SELECT *, 2, 'Big Readers' FROM lv WHERE bytes_scanned > 10000000000
  UNION ALL SELECT *, 3, 'Costs 50 Credits' FROM lv WHERE approx_credits > 50)"""


def live(spark, d):
    """The live feed: queries still running, with their approximate credits."""
    running = adapters.query_history(spark, d).filter("execution_status = 'RUNNING'")
    dim = readers.warehouse_dim(adapters.warehouses(spark, d))
    return mon.with_credits(running, dim, AS_OF)


def fired(spark, d):
    return adapters.probe_actions(adapters.query_history(spark, d))


@register("approx_credits", LIVE + "SELECT query_id, warehouse_name, approx_credits FROM lv")
def approx_credits(spark, d):
    return live(spark, d).select("query_id", "warehouse_name", "approx_credits")


@register("probe_matches", LIVE + MATCH_SQL + "SELECT query_id, probe_name FROM ma")
def probe_matches(spark, d):
    return mon.match_probes(live(spark, d), PROBES).select("query_id", "probe_name")


NEW_SQL = """, nw AS (SELECT * FROM ma WHERE NOT (probe_name = 'Big Readers' AND k % 6 = 0)),
ft AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rn FROM nw) WHERE rn = 1)"""


@register("probe_new_matches", LIVE + MATCH_SQL + NEW_SQL + "SELECT query_id, probe_name FROM ft")
def probe_new_matches(spark, d):
    found = mon.match_probes(live(spark, d), PROBES, fired(spark, d), first_only=True)
    return found.select("query_id", "probe_name")


@register(
    "predefined_probes",
    LIVE
    + """SELECT query_id, 'Long Queries' AS probe_name FROM lv WHERE start_time < TIMESTAMP '2001-09-01' - INTERVAL 10 MINUTE AND query_type <> 'EXECUTE_STREAMLIT'
UNION ALL SELECT query_id, 'Big Readers' FROM lv WHERE bytes_scanned > 10000000000
UNION ALL SELECT query_id, 'Costs 10 Credits' FROM lv WHERE approx_credits > 10
UNION ALL SELECT query_id, 'Costs 50 Credits' FROM lv WHERE approx_credits > 50""",
)
def predefined_probes(spark, d):
    found = mon.match_probes(live(spark, d), mon.PREDEFINED_PROBES, need_action=False)
    return found.select("query_id", "probe_name")


ACTIONS = (
    o.with_(o.QH, o.WAREHOUSES, o.USERS)
    + LIVE[LIVE.index(", lv AS"):]
    + MATCH_SQL
    + """, ac AS (SELECT ma.*, CASE WHEN probe_name IN ('Long Queries', 'Costs 50 Credits') THEN us.email END AS writer
  FROM ma LEFT JOIN us ON us.name = ma.user_name AND us.deleted_on IS NULL)"""
)


def actions(spark, d):
    found = mon.match_probes(live(spark, d), PROBES)
    return mon.probe_actions(found, PROBES, readers.active_users(adapters.users(spark, d)), AS_OF)


TAKEN_SQL = """CASE probe_name WHEN 'Long Queries' THEN CASE WHEN writer IS NULL THEN '' ELSE writer || ',' END
    WHEN 'Costs 50 Credits' THEN CASE WHEN writer IS NULL THEN '' ELSE writer || ',' END || 'cost@example.com' END AS email,
  CASE WHEN probe_name = 'Big Readers' THEN '#ops, #cost' END AS slack, CASE WHEN probe_name = 'Costs 50 Credits' THEN 'true' ELSE 'false' END AS cancel"""


def taken(column):
    """Destinations by method and the CANCEL flag of an action."""
    return [F.try_element_at(column, F.lit(k)).alias(k.lower()) for k in ("Email", "Slack", "CANCEL")]


@register(
    "probe_actions",
    ACTIONS + f"SELECT query_id, probe_name, user_name, TIMESTAMP '2001-09-01' AS probe_time, {TAKEN_SQL} FROM ac",
)
def probe_actions(spark, d):
    return actions(spark, d).select("query_id", "probe_name", "user_name", "probe_time", *taken("action_taken"))


@register(
    "render_message",
    ACTIONS
    + f""", tk AS (SELECT *, {TAKEN_SQL}, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS began FROM ac)
SELECT query_id, probe_name, 'Email' AS method, email AS destination, 'Monitor ' || probe_name || ': query ' || query_id AS subject,
  'The monitor ' || probe_name || ' has found a running query.' || chr(10) || chr(10) || 'query:     ' || query_id || chr(10) || 'started:   ' || began || chr(10) ||
  'by:        ' || user_name || chr(10) || 'warehouse: ' || warehouse_name || chr(10) || 'account:   ACC1' || chr(10) || chr(10) || query_text || chr(10) AS body
FROM tk WHERE length(email) > 1
UNION ALL SELECT query_id, probe_name, 'Slack', slack, NULL, '*' || probe_name || '* has found query `' || query_id || '`, started `' || began || '` by ' || user_name ||
  ' on `' || warehouse_name || '` in account `ACC1`:' || chr(10) || '```' || query_text || '```' FROM tk WHERE length(slack) > 1""",
)
def render_message(spark, d):
    return mon.messages(actions(spark, d), "ACC1")


@register(
    "dup_destinations",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' || c_custkey || '@x.org' WHEN 2 THEN '' ELSE 'b@x.org' END AS duplicates FROM customer""",
)
def dup_destinations(spark, d):
    rows = adapters.table(spark, d, "customer").selectExpr(
        "c_custkey",
        "CASE c_custkey % 4 WHEN 0 THEN 'a@x.org, b@x.org' WHEN 1 THEN concat('A', c_custkey, '@x.org,b@x.org ,a', c_custkey, '@x.org')"
        " WHEN 2 THEN 'single@x.org' ELSE ' b@x.org,c@x.org,B@X.ORG' END AS notify_other",
    )
    found = mon.duplicate_destinations(rows, "notify_other", "Email")
    return found.select("c_custkey", F.array_join("duplicates", ",").alias("duplicates"))


@register(
    "merge_maps",
    o.with_(o.QH)
    + """SELECT query_id, CASE WHEN k % 3 = 0 THEN 'b' ELSE 'a' END AS last_wins, CASE WHEN k % 3 = 0 THEN 'a,b' ELSE 'a' END AS joined,
  CASE WHEN k % 3 <> 0 THEN 'c' END AS only_second FROM qh""",
)
def merge_maps(spark, d):
    rows = adapters.query_history(spark, d).select(
        "query_id",
        F.create_map(F.lit("x"), F.lit("a")).alias("m"),
        F.create_map(
            F.when(F.substring("query_id", 2, 20).cast("bigint") % 3 == 0, F.lit("x")).otherwise(F.lit("y")),
            F.when(F.substring("query_id", 2, 20).cast("bigint") % 3 == 0, F.lit("b")).otherwise(F.lit("c")),
        ).alias("n"),
    )
    return rows.select(
        "query_id",
        F.try_element_at(merge_objects("m", "n"), F.lit("x")).alias("last_wins"),
        F.try_element_at(merge_concat_objects("m", "n"), F.lit("x")).alias("joined"),
        F.try_element_at(merge_concat_objects("m", "n"), F.lit("y")).alias("only_second"),
    )
