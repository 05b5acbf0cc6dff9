"""Query monitors: alert rules matched against running queries, each once per query."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlight.functions.maps import merge_concat_objects
from meterlight.functions.text import render
from meterlight.functions.timeops import literal_micros, literal_ts, micros, millis_between
from meterlight.functions.warehouses import warehouse_multiplier


@dataclass(frozen=True)
class Probe:
    """An alert rule. ``condition`` is Spark SQL over the live feed; ``as_of`` is the clock."""

    name: str
    condition: str
    notify_writer: bool = False
    notify_writer_method: str = "Email"
    notify_other: str | None = ""
    notify_other_method: str = "Email"
    cancel: bool = False
    enabled: bool | None = True

    def acts(self) -> bool:
        return bool(self.cancel or self.notify_writer or len(self.notify_other or "") > 3)


# The monitors every installation starts with; they notify nobody until edited.
PREDEFINED_PROBES = (
    Probe(
        "Long Queries",
        "start_time < as_of - INTERVAL 10 MINUTES AND NOT query_type = 'EXECUTE_STREAMLIT'",
    ),
    Probe("Big Readers", "bytes_scanned > 10000000000"),
    Probe("Costs 10 Credits", "approx_credits > 10"),
    Probe("Costs 50 Credits", "approx_credits > 50"),
)

SUBJECT = "Monitor {probe_name}: query {query_id}"
EMAIL_BODY = (
    "The monitor {probe_name} has found a running query.\n\n"
    "query:     {query_id}\nstarted:   {start_time}\nby:        {user_name}\n"
    "warehouse: {warehouse_name}\naccount:   {identifier}\n\n{query_text}\n"
)
#: For chats that show what stands between back quotes as code.
CHAT_BODY = (
    "*{probe_name}* has found query `{query_id}`, started `{start_time}` by {user_name} on "
    "`{warehouse_name}` in account `{identifier}`:\n```{query_text}```"
)


def load_probes(table: DataFrame) -> list[Probe]:
    """The rules of a monitor table, oldest first: configuration, read whole into the plan."""
    columns = (
        "name", "condition", "notify_writer", "notify_writer_method", "notify_other",
        "notify_other_method", "cancel", "enabled",
    )
    found = table.orderBy("probe_created_at", "name").select(*columns).collect()
    return [
        Probe(r[0], r[1], bool(r[2]), r[3] or "Email", r[4], r[5] or "Email", bool(r[6]), r[7]) for r in found
    ]


def with_credits(df: DataFrame, dim: DataFrame, as_of: datetime | str) -> DataFrame:
    """Adds ``as_of`` and ``approx_credits``: size rate times the time since the start.

    Warehouses missing from ``dim`` cost nothing; a missing type counts as STANDARD.
    """
    now = F.lit(literal_micros(as_of)).cast("bigint")
    known = dim.select(
        F.col("warehouse_name"),
        F.col("warehouse_size").alias("_size"),
        F.col("warehouse_type").alias("_type"),
    )
    rate = F.coalesce(
        warehouse_multiplier("_size", F.coalesce("_type", F.lit("STANDARD"))), F.lit(0.0)
    )
    ms = millis_between(micros("start_time"), now)
    return (
        df.join(known, "warehouse_name", "left")
        .withColumns(
            {"as_of": literal_ts(as_of), "approx_credits": rate * ms.cast("double") / F.lit(3_600_000.0)}
        )
        .drop("_size", "_type")
    )


def active(probes: Iterable[Probe], need_action: bool = True) -> list[Probe]:
    """Enabled rules that do something, so that a silent rule never hides a later one."""
    return [p for p in probes if p.enabled is not False and (p.acts() or not need_action)]


def matched_names(probes: Iterable[Probe]) -> Column:
    """Names of the rules that hold for a row, in rule order."""
    names = [F.when(F.expr(p.condition), F.lit(p.name)) for p in probes]
    return F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")


def match_probes(
    live: DataFrame,
    probes: Iterable[Probe],
    fired: DataFrame | None = None,
    first_only: bool = False,
    own_session: int | None = None,
    need_action: bool = True,
) -> DataFrame:
    """One row per query and rule that holds and has not fired for that query.

    ``first_only`` keeps the first such rule per query, as one pass of the monitor loop does.
    Rules are a projection, so the feed is read once; ``fired`` is reduced to one row per
    query before the only join.
    """
    rows = live
    if own_session is not None:
        rows = rows.filter(F.col("session_id") != own_session)
    rows = rows.withColumn("_hits", matched_names(active(probes, need_action))).filter(F.size("_hits") > 0)
    if fired is not None:
        before = fired.groupBy("query_id").agg(F.collect_set("probe_name").alias("_fired"))
        rows = (
            rows.join(before, "query_id", "left")
            .withColumn(
                "_hits", F.array_except("_hits", F.coalesce("_fired", F.array().cast("array<string>")))
            )
            .drop("_fired")
            .filter(F.size("_hits") > 0)
        )
    picked = F.slice("_hits", 1, 1) if first_only else F.col("_hits")
    return rows.withColumn("probe_name", F.explode(picked)).drop("_hits")


def probe_actions(
    matches: DataFrame, probes: Iterable[Probe], users: DataFrame, as_of: datetime | str
) -> DataFrame:
    """What to do for each match: method to destination, plus the CANCEL flag.

    The writer is notified only if their email is known. Destinations of the same method are
    joined with commas. ``users`` has name and email.
    """
    rules = list(probes)
    empty = F.create_map().cast("map<string,string>")

    def of_rule(value) -> Column:
        out = None
        for p in rules:
            cond, item = F.col("probe_name") == p.name, value(p)
            out = F.when(cond, item) if out is None else out.when(cond, item)
        return out

    writer = of_rule(
        lambda p: F.when(
            F.lit(p.notify_writer) & F.col("_email").isNotNull(),
            F.create_map(F.lit(p.notify_writer_method), F.col("_email")),
        ).otherwise(empty)
    )
    other = of_rule(
        lambda p: empty
        if p.notify_other is None
        else F.create_map(F.lit(p.notify_other_method), F.lit(p.notify_other))
    )
    cancel = of_rule(lambda p: F.lit("true" if p.cancel else "false"))
    people = users.select(F.col("name").alias("user_name"), F.col("email").alias("_email"))
    return (
        matches.join(people, "user_name", "left")
        .withColumns({"_writer": writer, "_other": other})
        .select(
            literal_ts(as_of).alias("probe_time"),
            "probe_name",
            "query_id",
            F.map_concat(
                merge_concat_objects("_writer", "_other"), F.create_map(F.lit("CANCEL"), cancel)
            ).alias("action_taken"),
            "user_name",
            "warehouse_name",
            "start_time",
            "query_text",
        )
    )


def action_log(actions: DataFrame) -> DataFrame:
    """Rows of the action log for ``probe_actions`` rows: methods with their destinations, the CANCEL flag,
    and an outcome that is empty until it is reported."""
    return actions.select(
        F.col("probe_time").alias("action_time"),
        "probe_name",
        "query_id",
        F.col("action_taken").alias("actions_taken"),
        F.lit("").alias("outcome"),
        *("user_name", "warehouse_name", "start_time", "query_text"),
    )


def messages(actions: DataFrame, identifier: str) -> DataFrame:
    """What to send for each action: a row for each method that has a destination.

    Mails have a subject and a plain body, other methods (chats) no subject and a body with
    code marks.
    """
    values = {
        c: F.col(c)
        for c in ("probe_name", "query_id", "user_name", "warehouse_name", "start_time", "query_text")
    }
    values["identifier"] = F.lit(identifier)
    sent = actions.select("*", F.explode(F.map_filter("action_taken", lambda k, v: (k != "CANCEL") & (F.length(v) > 1))).alias("method", "destination"))
    mail = F.lower("method") == "email"
    return sent.select(
        "query_id",
        "probe_name",
        "method",
        "destination",
        F.when(mail, render(SUBJECT, values)).alias("subject"),
        F.when(mail, render(EMAIL_BODY, values)).otherwise(render(CHAT_BODY, values)).alias("body"),
    )


def duplicate_destinations(df: DataFrame, column: str, method: str) -> DataFrame:
    """Adds ``duplicates``: destinations named more than once in a comma-separated list.

    Email addresses are compared without case.
    """
    parts = F.transform(F.split(F.col(column), ","), lambda x: F.trim(x))
    if method.lower() == "email":
        parts = F.transform(parts, lambda x: F.lower(x))
    return (
        df.withColumn("_parts", parts)
        .withColumn(
            "duplicates",
            F.array_sort(
                F.filter(
                    F.array_distinct("_parts"),
                    lambda x: F.size(F.filter(F.col("_parts"), lambda y: y == x)) > 1,
                )
            ),
        )
        .drop("_parts")
    )
