"""Registered streaming queries.

Each writes the adapted log in a few time slices, as files that arrive one after the other,
runs the stream after each arrival, and returns the table the stream keeps. It must equal the
batch twin over the whole log, which the oracle computes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlight.functions.timeops import literal_ts
from meterlight.operators import monitors as mon
from meterlight.plans import oracle_base as o
from meterlight.plans import rules
from meterlight.plans import state as st
from meterlight.plans import usage as u
from meterlight.plans.registry import register
from meterlight.session import workspace
from meterlight.sources import adapters, readers
from meterlight.streaming import streams, tables


def incoming(spark, path, schema):
    return spark.readStream.schema(schema).parquet(path)


QUERY_BOUNDS = ("1997-01-01 00:00:00", "1999-01-01 00:00:00")
EVENT_BOUNDS = ("2024-01-09 10:20:00", "2024-01-20 22:00:00")


SETTLED_AT = "2024-01-25 12:00:00"


@register(
    "stream_settled",
    o.with_(o.EVENTS)
    + f"SELECT event_id, ts AS timestamp, warehouse_id FROM ev WHERE ts < TIMESTAMP '{SETTLED_AT}' - INTERVAL 180 MINUTE",
)
def stream_settled(spark, d):
    """The log up to now: every seventh row arrives a slice late, long after its allowance, and every
    fifth comes again with the next slice. What is younger than three hours is withheld."""
    path = workspace(spark, "settled")
    df = adapters.warehouse_events(spark, d).select("event_id", "timestamp", "warehouse_id")
    at, previous = F.col("timestamp"), None
    for high in (*EVENT_BOUNDS, SETTLED_AT):
        own = (at < literal_ts(high)) if previous is None else (at >= literal_ts(previous)) & (at < literal_ts(high))
        shown = df.filter(own) if high == SETTLED_AT else df.filter(own & (F.col("event_id") % 7 != 0))
        if previous is not None:
            shown = shown.unionByName(df.filter((at < literal_ts(previous)) & ((F.col("event_id") % 7 == 0) | (F.col("event_id") % 5 == 0))))
        shown.write.mode("append").parquet(f"{path}/in")
        keep = tables.keep_settled(path, "timestamp", 180, ["event_id"], clock=lambda now=high: now)
        tables.run_available(incoming(spark, f"{path}/in", df.schema), path, keep)
        previous = high
    return tables.settled_kept(spark, path, df.schema)


@register(
    "stream_incremental",
    o.with_(o.QH)
    + "SELECT query_id, user_name, start_time, end_time, query_load_percent FROM qh",
)
def stream_incremental(spark, d):
    return tables.queries_kept(spark, _query_feed(spark, d, _feed_columns(adapters.query_history(spark, d))))


def _feed_columns(log):
    return log.select("query_id", "user_name", "start_time", "end_time", "query_load_percent")


def _query_feed(spark, d, log, clock=False):
    """Running rows arrive with their slice; those that finish come again, finished. Some finished
    rows are repeated in a batch and after it, and some running ones come after the finished row.
    Some batches hold running rows alone."""
    path = workspace(spark, "incremental")
    for i, now in enumerate(_query_arrivals(log, f"{path}/feed")):
        tables.arrive(log, f"{path}/feed/arrival={i}", f"{path}/in")
        keep = tables.keep_queries(path, clock=(lambda: now) if clock else None)
        tables.run_available(incoming(spark, f"{path}/in", log.schema), path, keep)
    return path


def _query_arrivals(log, path):
    """Writes what each arrival shows to a folder of its own, all from one scan; returns their times."""
    epoch = literal_ts("1970-01-01 00:00:00")
    at, end, part = F.col("start_time"), F.col("end_time"), F.crc32("query_id") % 5
    versions, times, previous = [], [], None
    for high in (*QUERY_BOUNDS, o.AS_OF_QUERIES):
        limit = literal_ts(high)
        since = F.lit(True) if previous is None else at >= literal_ts(previous)
        shown = [(since & (at < limit), F.when(end > limit, epoch).otherwise(end))]
        if previous is not None:
            late = literal_ts(previous)
            old = (at < late) & (at <= end)
            shown.append((old & (end > late), end))
            shown.append((old & (end <= limit) & (part == 0), end))
            shown.append((old & (end <= late) & (part == 1), epoch))
        for where, as_end in shown:
            arrival = len(times) + (at > as_end).cast("int")
            versions.append(F.when(where, F.struct(arrival.alias("arrival"), as_end.alias("end_time"))))
        times += [high, high]
        previous = high
    rows = log.withColumn("_shown", F.explode(F.array(*versions))).filter("_shown.arrival IS NOT NULL")
    shown = rows.withColumns({"end_time": F.col("_shown.end_time"), "arrival": F.col("_shown.arrival")}).drop("_shown")
    shown.write.partitionBy("arrival").parquet(path)
    return times


@register(
    "stream_incremental_slices",
    o.with_(o.QH, o.SLICES) + "SELECT query_id, record_type, st, et, duration, incomplete, credit_units FROM slices",
)
def stream_incremental_slices(spark, d):
    """The slices of the closed and of the open table equal those of the whole log."""
    path = _query_feed(spark, d, adapters.query_history(spark, d), clock=True)
    return tables.slices_kept(spark, path).select("query_id", "record_type", "st", "et", "duration", "incomplete", "credit_units")


@register(
    "stream_sessions",
    u.SESSION_SQL
    + "SELECT session_id, session_type, cluster_number, session_start, session_end, incomplete FROM ses",
)
def stream_sessions(spark, d):
    """Every ninth event comes a slice late, and one instant is parted by two slices."""
    path = workspace(spark, "stream-sessions")
    df = adapters.warehouse_events(spark, d)
    at, previous = F.col("timestamp"), "1900-01-01 00:00:00"
    for high in (*EVENT_BOUNDS, "9999-01-01 00:00:00"):
        own = (at >= literal_ts(previous)) & (at < literal_ts(high))
        late = F.col("event_id") % 9 == 0
        shown = df.filter(own) if high.startswith("9999") else df.filter(own & ~late)
        shown = shown.unionByName(df.filter(late & (at < literal_ts(previous)) & (at >= literal_ts(_slice_before(previous)))))
        shown.write.mode("append").parquet(f"{path}/in")
        sdf = incoming(spark, f"{path}/in", df.schema)
        tables.run_available(sdf, path, tables.keep_sessions(path, tie="event_id"))
        previous = high
    kept = tables.sessions_kept(spark, path, o.AS_OF_EVENTS)
    return u.id_text(kept).select(
        "session_id", "session_type", "cluster_number", "session_start", "session_end", "incomplete"
    )


def _slice_before(bound):
    """Where the slice begins that ends at a bound."""
    edges = ["1900-01-01 00:00:00", *EVENT_BOUNDS]
    return edges[max(edges.index(bound) - 1, 0)]


def _alerts(spark, d):
    """The feed shows every running query again with each slice, and a third of them first a slice
    after they started; each match fires once, as of the last run."""
    path = workspace(spark, "alerts")
    feed = adapters.query_history(spark, d).filter("execution_status = 'RUNNING'")
    dim = readers.warehouse_dim(adapters.warehouses(spark, d))
    users = readers.active_users(adapters.users(spark, d))
    slow = F.crc32("query_id") % 3 == 0
    low = "1900-01-01 00:00:00"
    for high in (*QUERY_BOUNDS, o.AS_OF_QUERIES):
        started = F.col("start_time") < literal_ts(high)
        shown = feed.filter(started & (~slow | (F.col("start_time") < literal_ts(low)) | F.lit(high == o.AS_OF_QUERIES)))
        shown.write.mode("append").parquet(f"{path}/in")
        live = mon.with_credits(incoming(spark, f"{path}/in", feed.schema), dim, o.AS_OF_QUERIES)
        keep = tables.log_alerts(path, rules.PROBES, users, clock=lambda: o.AS_OF_QUERIES)
        tables.run_available(streams.stream_probe_matches(live, rules.PROBES), path, keep)
        low = high
    return tables.alerts_kept(spark, path)


@register(
    "stream_probe_alerts",
    rules.LIVE + rules.MATCH_SQL + "SELECT probe_name, query_id, user_name, warehouse_name, start_time FROM ma",
)
def stream_probe_alerts(spark, d):
    return _alerts(spark, d).select("probe_name", "query_id", "user_name", "warehouse_name", "start_time")


@register(
    "stream_probe_actions",
    rules.ACTIONS
    + f"""SELECT TIMESTAMP '{o.AS_OF_QUERIES}' AS action_time, probe_name, query_id, {rules.TAKEN_SQL}, '' AS outcome FROM ac""",
)
def stream_probe_actions(spark, d):
    """The action log: what was to be done, exactly once."""
    return _alerts(spark, d).select("action_time", "probe_name", "query_id", *rules.taken("actions_taken"), "outcome")


@register(
    "stream_hourly_quota",
    o.with_(o.QH) + st.HOURLY_SQL + "SELECT day, hour_of_day, name, persona, credits_used FROM hq",
)
def stream_hourly_quota(spark, d):
    """Every fifth query is logged a slice after it ended, hours or years late."""
    path = workspace(spark, "quota")
    df = adapters.query_history(spark, d).select(
        "query_id", "start_time", "end_time", "user_name", "role_name", "warehouse_name", "warehouse_size",
        "total_elapsed_time", "credits_used_cloud_services",
    )
    late = F.crc32("query_id") % 5 == 0
    arrival = sum(F.when(F.col("end_time") >= literal_ts(b), 1).otherwise(0) for b in QUERY_BOUNDS)
    arrival = F.least(arrival + F.when(late, 1).otherwise(0), F.lit(len(QUERY_BOUNDS)))
    for k in range(len(QUERY_BOUNDS) + 1):
        df.filter(arrival == k).write.mode("append").parquet(f"{path}/in")
        sdf = streams.stream_finished(incoming(spark, f"{path}/in", df.schema))
        tables.run_available(sdf, path, tables.keep_quota(path))
    return tables.quota_kept(spark, path)
