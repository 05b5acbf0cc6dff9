"""Schedules, quota, run log, refreshes and streams on hand-made rows."""

import json
import os
import zlib
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meterlight.operators import monitors as mon
from meterlight.operators import quota
from meterlight.operators import refresh as rf
from meterlight.operators import runlog
from meterlight.operators import schedules as sch
from meterlight.sources import proxy, readers, schemas
from meterlight.streaming import streams, tables

D = datetime
H = 3600


def slot(i, name, start, finish, size="Small", weekday=True, enabled=True, smin=1, smax=2, mode="Standard", suspend=1):
    return (f"s{i}", name, start, finish, size, suspend, True, smin, smax, mode, None, weekday, None, enabled, None)


def plan(spark, *slots):
    return spark.createDataFrame(list(slots), schemas.schema(schemas.SCHEDULES))


def day_plan(spark, **kw):
    return plan(
        spark,
        slot(0, "W", 0, 9 * H, **kw),
        slot(1, "W", 9 * H, 17 * H, "X-Large", **kw),
        slot(2, "W", 17 * H, sch.LAST_MINUTE, **kw),
        slot(3, "W", 0, sch.LAST_MINUTE, "X-Small", weekday=False),
    )


@pytest.mark.parametrize(
    "last, now, tz, due",
    [
        ("2024-01-10 08:50:00", "2024-01-10 09:00:00", "UTC", ["s1"]),
        ("2024-01-10 09:00:00", "2024-01-10 09:15:00", "UTC", []),  # already run at nine
        ("2024-01-10 08:00:00", "2024-01-10 20:00:00", "UTC", ["s2"]),  # missed runs: latest wins
        ("2024-01-12 23:45:00", "2024-01-13 00:00:00", "UTC", ["s3"]),  # Friday to Saturday
        ("2024-01-10 16:55:00", "2024-01-10 17:05:00", "America/Los_Angeles", ["s1"]),
    ],
)
def test_due(spark, last, now, tz, due):
    assert [r.id_val for r in sch.due_schedules(day_plan(spark), last, now, tz).collect()] == due


def test_disabled_schedules_do_nothing(spark):
    out = sch.due_schedules(day_plan(spark, enabled=False), "2024-01-10 08:50:00", "2024-01-10 09:00:00", "UTC")
    assert out.count() == 0


def test_gaps(spark):
    assert sch.schedule_gaps(day_plan(spark)).count() == 0
    bad = plan(
        spark,
        slot(0, "A", 900, 2 * H), slot(1, "A", 3 * H, 5 * H), slot(2, "A", 4 * H, 7 * H + 60),
        *[slot(10 + i, "B", i * H, sch.LAST_MINUTE if i == 10 else (i + 1) * H) for i in range(11)],
    )
    out = {(r.id_val, r.problem) for r in sch.schedule_gaps(bad).collect()}
    assert {p for i, p in out if i == "s0"} == {"first slot must start at midnight"}
    assert {p for i, p in out if i == "s1"} == {"gap before slot"}
    assert {p for i, p in out if i == "s2"} == {
        "overlap with slot before", "last slot must end at midnight", "not on a quarter hour",
    }
    assert sum(p == "too many slots" for _, p in out) == 11


@pytest.mark.parametrize(
    "new, old, changes",
    [
        (dict(size="Small"), dict(), ""),
        (dict(size="X-Large"), dict(), "WAREHOUSE_SIZE = XLARGE"),
        (dict(size="Medium Snowpark"), dict(), "WAREHOUSE_SIZE = MEDIUM, WAREHOUSE_TYPE = SNOWPARK-OPTIMIZED"),
        (dict(suspend=5), dict(), "AUTO_SUSPEND = 300"),
        (dict(smin=2, smax=4), dict(), "MIN_CLUSTER_COUNT = 2, MAX_CLUSTER_COUNT = 4"),
        (dict(smin=0, smax=0, mode="Economy"), dict(), ""),
        (dict(mode="Inherit"), dict(), ""),
        (dict(mode="Economy"), dict(), "SCALING_POLICY = Economy"),
    ],
)
def test_changes(spark, new, old, changes):
    now = spark.createDataFrame(
        [("W", "Small", 1, True, 1, 2, "Standard")],
        "warehouse_name string, warehouse_size string, suspend_minutes bigint, resume boolean,"
        " scale_min bigint, scale_max bigint, warehouse_mode string",
    )
    assert sch.schedule_changes(plan(spark, slot(0, "W", 0, H, **new)), now).first().changes == changes


def test_usage_by_slot_covers_every_query(spark):
    rows = [("W", D(2024, 1, 10) + timedelta(minutes=17 * i), 1) for i in range(84)]
    rows += [("W", D(2024, 1, 13, 12), 5)]
    used = sch.usage_by_slot(
        spark.createDataFrame(rows, "warehouse_name string, start_time timestamp_ntz, credit_units bigint"),
        day_plan(spark),
        "UTC",
    )
    got = {r.id_val: r.queries for r in used.collect()}
    assert sum(got.values()) == len(rows) and got["s3"] == 1


def test_quota(spark):
    ddl = (
        "user_name string, role_name string, warehouse_name string, warehouse_size string, start_time timestamp_ntz,"
        " end_time timestamp_ntz, total_elapsed_time bigint, credits_used_cloud_services double"
    )
    s, e = D(2024, 1, 1, 9, 59), D(2024, 1, 1, 10, 0)
    rows = [
        ("ann", "R", "W", "Small", s, e, 3_600_000, 0.25),
        ("ann", "R", "W", None, s, e, 1_000, 0.5),
        ("bob", "R", "W", "Small", s, e, -5, 0.0),
        ("bob", "R", "COMPUTE_SERVICE_WH_USER_TASKS_POOL_1", "Small", s, e, 10**9, 1.0),
        ("bob", "R", "W", "Small", s, D(1970, 1, 1), 10**9, 1.0),
    ]
    out = quota.hourly_usage(spark.createDataFrame(rows, ddl), "2024-01-01 10:30:00")
    got = {(r.persona, r.name): (r.day, r.hour_of_day, r.credits_used) for r in out.collect()}
    at = (date(2024, 1, 1), 10)
    assert got == {("user", "ann"): (*at, 2.75), ("user", "bob"): (*at, 0.0), ("role", "R"): (*at, 2.75)}
    totals = {(r.kind, r.name): r.credits for r in quota.day_totals(out, "2024-01-01").collect()}
    assert totals == {("users", "ann"): 2.75, ("users", "bob"): 0.0, ("roles", "R"): 2.75}
    assert quota.recent(spark.createDataFrame(rows, ddl), "2024-01-01 10:30:00").count() == 4


LOG = schemas.TASK_LOG


def test_run_log(spark):
    good = (D(2024, 5, 6), True, "T", "O", "{}", json.dumps({"range_min": "2024-01-01 00:00:00"}), D(2024, 5, 6, 1), "r1", "q1", None, None)
    stale = (D(2024, 5, 6, 1), None, "T", "O", "{}", None, None, "r2", "q2", None, None)
    lost = (D(2024, 5, 6, 1), None, "T", "O", "{}", None, None, "r3", "q3", None, None)
    log = spark.createDataFrame([good, stale, lost], schemas.schema(LOG))
    history = spark.createDataFrame(
        [("q2", D(2024, 5, 6, 2), "INCIDENT", "ann", "W"), ("q1", D(2024, 5, 6, 2), "SUCCESS", "ann", "W")],
        "query_id string, start_time timestamp_ntz, execution_status string, user_name string, warehouse_name string",
    )
    closed = runlog.close_stale(log, history, "2024-05-06 12:00:00")
    rows = {r.task_run_id: r for r in closed.collect()}
    assert rows["r1"].success is True and rows["r2"].success is False and len(rows) == 3
    details = json.loads(rows["r2"].output)
    assert details["FORCE_CLOSED"] is True and details["EXECUTION_STATUS"] == "INCIDENT"
    assert "Could not find query history" in json.loads(rows["r3"].output)["details"]
    opened = runlog.open_row(spark, closed, "T", "O", "r4", "q4", "2024-05-06 13:00:00").first()
    assert opened.success is None and opened.range_min == D(2024, 1, 1) and opened.input == good[5]
    both = closed.unionByName(runlog.open_row(spark, closed, "T", "O", "r4", "q4", "2024-05-06 13:00:00"))
    done = runlog.close_row(both, "T", "O", "r4", '{"SQLERRM":"x"}', "2024-05-06 14:00:00")
    last = {r.task_run_id: r for r in done.collect()}["r4"]
    assert last.success is False and last.task_finish == D(2024, 5, 6, 14)


def test_status_of_an_empty_log(spark):
    empty = spark.createDataFrame([], schemas.schema(LOG))
    rows = runlog.materialization_status(spark, empty, "2024-01-01 00:00:00").collect()
    assert len(rows) == len(runlog.TASK_TABLES)
    assert {r.next_type for r in rows} == {"FULL"} and {r.next_status for r in rows} == {"SCHEDULED"}


def test_incremental_counts_only_after_a_good_full_run(spark):
    def run(hour, full, success):
        end = None if success is None else D(2024, 1, 1, hour, 30)
        return (D(2024, 1, 1, hour), success, "QUERY_HISTORY_MAINTENANCE", "QUERY_HISTORY", None if full else "{}", "{}", end, f"r{hour}", f"q{hour}", None, None)

    def status(*runs):
        log = spark.createDataFrame(list(runs), schemas.schema(LOG))
        out = runlog.materialization_status(spark, log, "2024-01-02 00:00:00")
        return out.filter("user_view = 'LABELED_QUERY_HISTORY'").first()

    ok = status(run(1, True, True), run(2, False, True), run(3, False, None))
    assert ok.last_incr_query_id == "q2" and ok.next_status == "EXECUTING" and ok.next_type == "INCREMENTAL"
    failed = status(run(1, True, False), run(2, False, True))
    assert failed.last_incr_query_id is None and failed.next_type == "FULL"
    before = status(run(2, True, True), run(1, False, True))
    assert before.last_incr_start is None and before.next_start == D(2024, 1, 1, 3)


def queries(spark, rows):
    ddl = (
        "query_id string, start_time timestamp_ntz, end_time timestamp_ntz, query_load_percent bigint,"
        " warehouse_size string, warehouse_type string, warehouse_id bigint"
    )
    return spark.createDataFrame([(*r, 100, "Small", "STANDARD", 1) for r in rows], ddl)


def test_refresh_keeps_boundary_and_running_rows_open(spark):
    epoch = D(1970, 1, 1)
    first = queries(spark, [("a", D(2024, 1, 1, 1), D(2024, 1, 1, 2)), ("b", D(2024, 1, 1, 3), D(2024, 1, 1, 4)), ("c", D(2024, 1, 1, 3), epoch)])
    one = rf.refresh_queries(first, rf.Watermarks(), "2024-01-01 05:00:00")
    ids = lambda df: sorted(r.query_id for r in df.filter("record_type = 'DAILY'").collect())
    assert ids(one.closed) == ["a"] and ids(one.incomplete) == ["b", "c"]
    assert one.state == rf.Watermarks(D(2024, 1, 1, 3), D(2024, 1, 1, 4))
    # c finished, d arrived late with the same end as b, e is still running
    second = queries(
        spark,
        [("a", D(2024, 1, 1, 1), D(2024, 1, 1, 2)), ("b", D(2024, 1, 1, 3), D(2024, 1, 1, 4)), ("c", D(2024, 1, 1, 3), D(2024, 1, 1, 6)),
         ("d", D(2024, 1, 1, 3, 30), D(2024, 1, 1, 4)), ("e", D(2024, 1, 1, 5), epoch)],
    )
    two = rf.refresh_queries(second, one.state, "2024-01-01 07:00:00")
    assert ids(two.closed) == ["b", "d"] and ids(two.incomplete) == ["c", "e"]
    none = rf.refresh_queries(second.limit(0), two.state, "2024-01-01 08:00:00")
    assert none.state == two.state and none.closed.count() == 0 and not none.changed


@pytest.mark.parametrize("running_end", [None, D(1970, 1, 1)])
def test_refresh_without_running_rows_loses_nothing(spark, tmp_path, running_end):
    hours = {"a": (1, 2), "b": (1, 4), "c": (5, 6), "d": (0, 7), "e": (6, 7)}
    at = lambda names: queries(spark, [(n, *(D(2024, 1, 1, h) for h in hours[n])) for n in names])
    ids = lambda df: [r.query_id for r in df.filter("record_type = 'DAILY'").collect()]
    state, closed, kept = rf.Watermarks(), [], []
    for i, names in enumerate(["ab", "ab", "abcd", "", "abcde"]):
        feed = at(names) if names else at("a").limit(0)
        step = rf.refresh_queries(feed, state, "2024-01-01 09:00:00", str(tmp_path / f"read{i}"), running_end)
        closed += ids(step.closed)
        if step.changed:
            kept = ids(step.incomplete)
        state = step.state
    assert sorted(closed + kept) == ["a", "b", "c", "d", "e"]
    assert state.newest_completed == D(2024, 1, 1, 7)


def test_simple_refresh_takes_boundary_rows_once(spark):
    src = spark.createDataFrame([(i, D(2024, 1, 1, h)) for i, h in enumerate([1, 2, 2, 2, 3])], "i int, t timestamp_ntz")
    held = src.filter("i IN (0, 1, 2)")
    _, newest = rf.index_range(held, "t")
    assert sorted(r.i for r in rf.refresh_simple(src, held, "t", newest).collect()) == [3, 4]
    assert rf.refresh_simple(src, None, "t", None).count() == 5


def test_readers(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = spark.createDataFrame([(D(2024, 1, 1, h), 1) for h in range(12)], "end_time timestamp_ntz, warehouse_id bigint")
    readers.conform(rows, schemas.METERING).write.parquet(path)
    back = readers.settled_source(readers.read(spark, path, schemas.METERING), "WAREHOUSE_METERING_HISTORY", "2024-01-01 12:00:00")
    assert back.columns[:2] == ["start_time", "end_time"] and back.count() == 6
    plan_text = back._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(end_time), LessThan(end_time" in plan_text
    assert readers.date_spine(spark, "2024-03-01 10:00:00", 3).agg(F.min("date"), F.max("date")).first()[:] == (D(2024, 2, 27), D(2024, 2, 29))
    for ddl in schemas.SOURCES.values():
        schemas.schema(ddl)
    assert len(schemas.schema(schemas.QUERY_HISTORY).fields) == 70


def test_load_chunks(spark):
    now = D(2024, 1, 15)
    rows = spark.createDataFrame([(now - timedelta(hours=h), "W") for h in (1, 7, 9, 14 * 24, 14 * 24 + 1)], "start_time timestamp_ntz, warehouse_name string")
    out = {r.start_time: r.chunk_start for r in readers.load_chunks(rows, now).collect()}
    assert len(out) == 4 and out[now - timedelta(hours=9)] == now - timedelta(hours=16)
    assert len(readers.load_chunks(rows, now, now - timedelta(hours=8)).collect()) == 2


def test_tenant(spark):
    regions = spark.createDataFrame([("AZURE_EASTUS2", "AZURE", "EASTUS2"), ("AWS_X", "AWS", "X")], "account_region string, cloud string, region string")
    rows = spark.createDataFrame([("A1EAST-US-2AZURE",), ("A1XAWS",), ("A1EASTUS2AZURE",)], "tenant_key string")
    keep = lambda account, region: [r[0] for r in proxy.tenant_filter(rows, regions, account, region).collect()]
    assert keep("A1", "AZURE_EASTUS2") == ["A1EAST-US-2AZURE"]
    assert keep("A1", "PUBLIC.AWS_X") == ["A1XAWS"]
    assert keep("A1", "NOWHERE") == []


def arrive(spark, path, ddl, rows, on_batch, make=lambda sdf: sdf):
    """Rows come as one more file; what has arrived is processed."""
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(f"{path}/in")
    tables.run_available(make(spark.readStream.schema(ddl).parquet(f"{path}/in")), path, on_batch)


def folders(path, table):
    return sorted(p for p in os.listdir(f"{path}/{table}") if p.startswith("batch="))


def test_stream_settled_withholds_rows_and_lets_late_ones_through(spark, tmp_path):
    path, ddl = str(tmp_path), "event_id bigint, timestamp timestamp_ntz"
    now = []
    keep = tables.keep_settled(path, "timestamp", 180, ["event_id"], clock=lambda: now[-1])
    ids = lambda: sorted(r.event_id for r in tables.settled_kept(spark, path, schemas.schema(ddl)).collect())
    t = lambda h, m=0: D(2024, 1, 1, h, m)
    for at, rows, want in (
        (t(12), [(1, t(8)), (1, t(8)), (2, t(11)), (3, t(9))], [1]),  # nine o'clock is just not old enough
        (t(14, 30), [(1, t(8)), (2, t(11)), (4, t(14))], [1, 2, 3]),
        (t(15), [(5, t(2)), (2, t(11))], [1, 2, 3, 5]),  # thirteen hours late
        (t(15), [(6, t(12))], [1, 2, 3, 5]),
        (t(23), [], [1, 2, 3, 4, 5, 6]),
    ):
        now.append(at)
        if rows:
            arrive(spark, path, ddl, rows, keep)
        else:
            keep(spark.createDataFrame([], ddl), 4)
        assert ids() == want
    assert folders(path, "held") == ["batch=3", "batch=4"]
    # The same batch again, as after a crash, changes nothing.
    keep(spark.createDataFrame([], ddl), 4)
    assert ids() == [1, 2, 3, 4, 5, 6]
    whole = [(1, t(8)), (2, t(11)), (3, t(9)), (4, t(14)), (5, t(2)), (6, t(12))]
    assert readers.settled(spark.createDataFrame(whole, ddl), "timestamp", 180, t(23)).count() == 6


def test_stream_queries_see_batches_of_running_rows_only(spark, tmp_path):
    path, ddl = str(tmp_path), "query_id string, start_time timestamp_ntz, end_time timestamp_ntz"
    t = lambda h, m=0: D(2024, 1, 1, h, m)
    keep = tables.keep_queries(path)
    kept = lambda: {r.query_id: r.end_time for r in tables.queries_kept(spark, path).collect()}
    arrive(spark, path, ddl, [("x", t(1), t(2))], keep)
    arrive(spark, path, ddl, [("y", t(3), rf.EPOCH)], keep)
    assert kept() == {"x": t(2), "y": rf.EPOCH}
    assert tables.watermarks_kept(spark, path) == rf.Watermarks(t(3), t(2))
    arrive(spark, path, ddl, [("y", t(3), t(9)), ("x", t(1), rf.EPOCH), ("z", t(0), t(1))], keep)
    assert kept() == {"x": t(2), "y": t(9), "z": t(1)}
    assert tables.watermarks_kept(spark, path) == rf.Watermarks(t(9), t(9))
    arrive(spark, path, ddl, [("w", t(5), rf.EPOCH)], keep)
    assert kept() == {"x": t(2), "y": t(9), "z": t(1), "w": rf.EPOCH}
    assert folders(path, "open") == folders(path, "state") == ["batch=2", "batch=3"]


def test_stream_queries_of_many_days_take_few_files(spark, tmp_path):
    path, ddl = str(tmp_path), "query_id string, start_time timestamp_ntz, end_time timestamp_ntz, tags map<string,string>"
    keep = tables.keep_queries(path)
    row = lambda n, end=None, tag="a": (f"q{n}", D(2020, 1, 1) + timedelta(days=n), end or D(2020, 1, 2) + timedelta(days=n), {"t": tag})
    # Twice in a batch, finished before running, on 300 days.
    arrive(spark, path, ddl, [row(n) for n in range(300)] + [row(7), row(8, rf.EPOCH), row(300, rf.EPOCH)], keep)
    late = [row(5), row(9, D(2022, 1, 1)), row(6, rf.EPOCH), row(300, D(2022, 1, 1)), row(299, rf.EPOCH), row(301, rf.EPOCH, "a"), row(301, rf.EPOCH, "b")]
    arrive(spark, path, ddl, late, keep)
    keep(spark.createDataFrame(late, ddl), 1)  # the same batch again, as after a crash
    files = [f for _, _, names in os.walk(f"{path}/closed") for f in names if f.endswith(".parquet")]
    assert len(files) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = sorted((int(r.query_id[1:]), r.end_time, r.tags["t"]) for r in tables.queries_kept(spark, path).collect())
    want = [(n, row(n)[2], "a") for n in range(300)] + [(300, D(2022, 1, 1), "a"), (301, rf.EPOCH, "b")]
    assert kept == want


def test_stream_sessions_in_any_order_and_replayed(spark, tmp_path):
    from test_sessions import DDL, brute, event, found

    path = str(tmp_path)
    t = lambda h, m=0: D(2024, 1, 1, h, m)
    batches = [
        [event(t(10), 1, 1, eid=1), event(t(12), 1, 2, 1, eid=3)],
        [event(t(11), 1, 2, 2, eid=2), event(t(14), 1, 3, 1, eid=4), event(t(15), 2, 1, eid=5)],
        [event(t(9), 1, 4, eid=9), event(t(16), 1, 4, eid=6)],
        # Two warehouses resume in one instant in two batches; a run is parted by a late resume.
        [event(t(17), 3, 1, eid=10), event(t(13), 1, 1, eid=11)],
        [event(t(17), 4, 1, eid=12), event(t(17), 3, 2, 1, eid=13), event(t(10), 1, 2, 3, eid=14)],
        [event(t(1), 3, 1, eid=15), event(t(2), 3, 4, eid=16), event(D(2024, 1, 3, 1), 4, 4, eid=17)],
    ]
    keep = tables.keep_sessions(path, tie="event_id")
    as_of, got = D(2024, 1, 2, 6), []
    for rows in batches:
        arrive(spark, path, DDL, rows, keep)
        got += rows
        until = max(as_of, max(e[0] for e in got if isinstance(e[0], D)) if isinstance(got[0][0], D) else as_of)
        assert found(tables.sessions_kept(spark, path, until)) == brute(got, until)
    # The same batch again, as after a crash, changes nothing.
    keep(spark.createDataFrame(batches[-1], DDL), len(batches) - 1)
    assert found(tables.sessions_kept(spark, path, until)) == brute(got, until)
    assert folders(path, "runs") == ["batch=4", "batch=5"]


def test_stream_sessions_rewrite_only_days_that_change(spark, tmp_path):
    from test_sessions import DDL, event

    path = str(tmp_path)
    keep = tables.keep_sessions(path, tie="event_id")
    day = lambda n, h: D(2024, 1, n, h)
    arrive(spark, path, DDL, [event(day(n, 1), w, 1, eid=10 * n + w) for n in (1, 2, 3) for w in (1, 2)], keep)
    files = lambda n: sorted(os.listdir(f"{path}/sessions/day=2024-01-0{n}"))
    before = [files(n) for n in (1, 2, 3)]
    arrive(spark, path, DDL, [event(day(3, 2), 1, 4, eid=50)], keep)
    assert [files(n) == b for n, b in zip((1, 2, 3), before)] == [True, True, False]


def test_stream_sessions_without_any(spark, tmp_path):
    from test_sessions import DDL, event

    keep = tables.keep_sessions(str(tmp_path), tie="event_id")
    arrive(spark, str(tmp_path), DDL, [event(D(2024, 1, 1), 1, 4, eid=1)], keep)
    assert tables.sessions_kept(spark, str(tmp_path), D(2024, 1, 2)).count() == 0


def test_stream_alerts_fire_once_in_any_order(spark, tmp_path):
    """A query that started at eight and matches after one of 12:01 still fires."""
    path = str(tmp_path)
    ddl = "query_id string, user_name string, warehouse_name string, start_time timestamp_ntz, query_text string, bytes_scanned bigint"
    probes = (mon.Probe("Big", "bytes_scanned > 10", notify_writer=True, notify_other=None, cancel=True), mon.Probe("Huge", "bytes_scanned > 100", notify_other="#ops", notify_other_method="Slack"))
    users = spark.createDataFrame([("ann", "ann@x.org")], "name string, email string")
    t = lambda h, m=0: D(2024, 1, 1, h, m)
    row = lambda q, at, n, who="ann": (q, who, "W", at, "select 1", n)
    now = []
    keep = tables.log_alerts(path, probes, users, clock=lambda: now[-1])
    for at, rows in (
        (t(12, 5), [row("a", t(12), 50), row("b", t(12, 1), 20), row("c", t(8), 5), row("a", t(12), 50)]),
        (t(12, 6), [row("c", t(8), 11), row("a", t(12), 60)]),
        (t(12, 7), [row("a", t(12), 101), row("c", t(8), 12), row("d", t(7), 11, "bob")]),
    ):
        now.append(at)
        arrive(spark, path, ddl, rows, keep, lambda sdf: streams.stream_probe_matches(sdf, probes))
    got = {(r.probe_name, r.query_id): (r.action_time, r.actions_taken, r.outcome) for r in tables.alerts_kept(spark, path).collect()}
    mail = {"Email": "ann@x.org", "CANCEL": "true"}
    assert got == {
        ("Big", "a"): (t(12, 5), mail, ""),
        ("Big", "b"): (t(12, 5), mail, ""),
        ("Big", "c"): (t(12, 6), mail, ""),
        ("Huge", "a"): (t(12, 7), {"Slack": "#ops", "CANCEL": "false"}, ""),
        ("Big", "d"): (t(12, 7), {"CANCEL": "true"}, ""),
    }
    assert tables.alerts_kept(spark, path).count() == len(got)


def test_stream_quota_takes_late_rows_and_overwrites_their_days(spark, tmp_path):
    path = str(tmp_path)
    ddl = (
        "start_time timestamp_ntz, end_time timestamp_ntz, user_name string, role_name string, warehouse_name string, "
        "warehouse_size string, total_elapsed_time bigint, credits_used_cloud_services double"
    )
    row = lambda day, h, who="ann": (D(2024, 1, day, h), D(2024, 1, day, h, 30), who, None, "W", "Small", 1_800_000, 0.25)
    batches = [[row(1, 9), row(1, 20), row(2, 14)], [row(2, 9), row(2, 14, None)], [row(2, 15), (D(2024, 1, 2), rf.EPOCH, "ann", "r", "W", "Small", 0, 0.0)]]
    keep = tables.keep_quota(path)
    for rows in batches:
        arrive(spark, path, ddl, rows, keep, streams.stream_finished)
    files = sorted(os.listdir(f"{path}/quota/day=2024-01-01"))
    # Five hours late, and the same batch once more.
    late = [row(2, 10), row(2, 9)]
    arrive(spark, path, ddl, late, keep, streams.stream_finished)
    keep(spark.createDataFrame(late, ddl), 3)
    whole = spark.createDataFrame([r for b in (*batches, late) for r in b], ddl)
    want = quota.hourly_usage(whole, "2024-01-03 00:00:00").drop("last_updated")
    assert sorted(map(str, tables.quota_kept(spark, path).collect())) == sorted(map(str, want.collect()))
    assert sorted(os.listdir(f"{path}/quota/day=2024-01-01")) == files


def test_query_feed_shows_all_versions_from_one_scan(spark, tmp_path):
    from meterlight.plans import streams as feeds

    bounds = [D.fromisoformat(b) for b in (*feeds.QUERY_BOUNDS, feeds.o.AS_OF_QUERIES)]
    rows = []
    for n in range(400):
        start = D(1996, 1, 1) + timedelta(days=5 * n, hours=n % 24)
        end = rf.EPOCH if n % 11 == 0 else bounds[n % 2] if n % 13 == 0 else start + timedelta(days=(n % 7) * 30)
        rows.append((f"q{n}", start, max(start, end) if end != rf.EPOCH else end))
    want, previous = [], None
    for limit in bounds:
        shown = [(q, s, rf.EPOCH if e > limit else e) for q, s, e in rows if s < limit and (previous is None or s >= previous)]
        for q, s, e in rows:
            if previous is not None and s < previous and s <= e:
                part = zlib.crc32(q.encode()) % 5
                shown += [(q, s, e)] * ((e > previous) + (part == 0 and e <= limit)) + [(q, s, rf.EPOCH)] * (part == 1 and e <= previous)
        want += [sorted(x for x in shown if x[1] <= x[2]), sorted(x for x in shown if x[1] > x[2])]
        previous = limit
    log = spark.createDataFrame(rows, "query_id string, start_time timestamp_ntz, end_time timestamp_ntz")
    times = feeds._query_arrivals(log, f"{tmp_path}/feed")
    assert [D.fromisoformat(t) for t in times] == [b for b in bounds for _ in range(2)]
    before = []
    for i, rows_of in enumerate(want):
        tables.arrive(log, f"{tmp_path}/feed/arrival={i}", f"{tmp_path}/in")
        before += rows_of
        assert sorted(r[:] for r in spark.read.schema(log.schema).parquet(f"{tmp_path}/in").collect()) == sorted(before)
    # An arrival of no rows comes as a file, too.
    tables.arrive(log, f"{tmp_path}/feed/arrival=9", f"{tmp_path}/none")
    assert spark.read.parquet(f"{tmp_path}/none").count() == 0
