"""Sessions against a brute-force walk over each warehouse, for every way of cutting the log."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meterlight.operators import ordered
from meterlight.operators.sessions import EVENT_CODES, refresh_sessions, session_slices, sessions

D = datetime
CODES = {code: (name, state) for name, state, code in EVENT_CODES}
DDL = (
    "timestamp timestamp_ntz, warehouse_id bigint, warehouse_name string, cluster_number bigint,"
    " event_name string, event_state string, event_reason string, query_id string, event_id bigint"
)


def event(ts, wid, code, cluster=None, eid=0, name="W"):
    kind, state = CODES.get(code, ("RESIZE_WAREHOUSE", "STARTED"))
    return (ts, wid, name, cluster, kind, state, "r", "q", eid)


def brute(events, as_of):
    """The recipe, row by row."""
    out = []
    for wid in {e[1] for e in events}:
        mine = [e for e in events if e[1] == wid]
        code = {e: c for e in mine for c, v in CODES.items() if v == (e[4], e[5])}
        mine = sorted((e for e in mine if e in code), key=lambda e: (e[0], code[e], e[8]))
        groups, run, previous = {}, None, 4
        for e in mine:
            if code[e] == 1 or previous == 4:
                run = e[0]
            previous = code[e]
            kind = "WH" if code[e] in (1, 4) else "CL"
            groups.setdefault((kind, run, e[2], e[3]), []).append(e)
        for (kind, start, name, cluster), rows in groups.items():
            for i, e in enumerate(rows):
                if code[e] in (3, 4):
                    continue
                nxt = rows[i + 1] if i + 1 < len(rows) else None
                midnight = D(e[0].year, e[0].month, e[0].day) + timedelta(days=1)
                stopped = nxt is not None and code[nxt] in (3, 4)
                end = nxt[0] if stopped else min(as_of, midnight)
                sid = wid * 2**64 + (start - D(1970, 1, 1)) // timedelta(milliseconds=1)
                out.append((wid, kind, cluster, sid, e[0], end, not stopped and as_of < midnight))
    return sorted(out, key=repr)


def found(df):
    return sorted(
        (
            (r.warehouse_id, r.session_type, r.cluster_number, int(r.session_id), r.session_start, r.session_end, r.incomplete)
            for r in df.collect()
        ),
        key=repr,
    )


def random_log(seed, n=300, days=3, warehouses=3):
    """Events with many equal times, one warehouse far busier than the others."""
    rng, out = random.Random(seed), []
    for eid in range(n):
        wid = 1 if rng.random() < 0.6 else rng.randrange(1, warehouses + 1)
        code = rng.choice([1, 2, 2, 3, 3, 4, 9])
        ts = D(2024, 1, 1) + timedelta(minutes=7 * rng.randrange(days * 24 * 60 // 7))
        cluster = None if code in (1, 4, 9) else rng.randrange(1, 3)
        out.append(event(ts, wid, code, cluster, eid))
    return out


@pytest.mark.parametrize("chunk", ["minute", "hour", "day"])
@pytest.mark.parametrize("seed", [1, 2])
def test_random_logs(spark, seed, chunk):
    log, as_of = random_log(seed), D(2024, 1, 3, 20)
    df = spark.createDataFrame(log, DDL)
    assert found(sessions(df, as_of, "event_id", chunk)) == brute(log, as_of)


def test_edges(spark):
    day = D(2024, 1, 1)
    log = [
        event(day, 1, 1, eid=1),  # start, start again, stop
        event(day + timedelta(hours=1), 1, 1, eid=2),
        event(day + timedelta(hours=2), 1, 4, eid=3),
        event(day + timedelta(hours=3), 1, 4, eid=4),  # stop without a start
        event(day, 2, 1, eid=5),  # cluster and warehouse stop at the same time
        event(day + timedelta(hours=1), 2, 2, 1, eid=6),
        event(day + timedelta(hours=5), 2, 4, eid=8),
        event(day + timedelta(hours=5), 2, 3, 1, eid=7),
        event(day + timedelta(hours=23), 3, 2, None, eid=9),  # never stopped, no cluster number
    ]
    df = spark.createDataFrame(log, DDL)
    for as_of in (D(2024, 1, 1, 23, 30), D(2024, 1, 2), D(2024, 1, 9)):
        assert found(sessions(df, as_of, "event_id")) == brute(log, as_of)


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_refreshes_equal_one_pass(spark, seed):
    log, rng = random_log(seed, n=160), random.Random(seed)
    cuts = sorted(D(2024, 1, 1) + timedelta(minutes=rng.randrange(3 * 24 * 60)) for _ in range(3))
    cuts.append(D(2024, 1, 4, 1))
    closed, open_rows, carry, low = [], None, None, D(2000, 1, 1)
    for cut in cuts:
        part = [e for e in log if low <= e[0] < cut]
        step = refresh_sessions(spark.createDataFrame(part, DDL), cut, open_rows, carry, tie="event_id")
        closed += found(step.closed)
        # Through rows, as a written table would be.
        open_rows = spark.createDataFrame(step.open.collect(), step.open.schema)
        carry_rows = step.carry.collect()
        carry = spark.createDataFrame(carry_rows, step.carry.schema)
        assert sorted(closed + found(open_rows), key=repr) == brute([e for e in log if e[0] < cut], cut)
        low = cut
    # What is carried does not grow with the log: run starts and last events of open runs.
    assert len(carry_rows) <= 3 * 8


def test_slices_start_at_the_session(spark):
    log = [event(D(2024, 1, 1, 22), 1, 1, eid=1), event(D(2024, 1, 3, 1), 1, 4, eid=2)]
    out = session_slices(sessions(spark.createDataFrame(log, DDL), D(2024, 2, 1), "event_id"))
    rows = {(r.record_type, r.st, r.et) for r in out.collect()}
    assert rows == {
        ("COMPLETE", D(2024, 1, 1, 22), D(2024, 1, 3, 1)),
        ("DAILY", D(2024, 1, 1, 22), D(2024, 1, 2)),
        ("DAILY", D(2024, 1, 2), D(2024, 1, 3)),
        ("DAILY", D(2024, 1, 3), D(2024, 1, 3, 1)),
    }


@pytest.mark.parametrize("step", [1, -1])
@pytest.mark.parametrize("width", [1, 7, 1000])
def test_neighbour_equals_window(spark, step, width):
    rng = random.Random(11)
    data = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(500), i) for i in range(300)]
    df = spark.createDataFrame(data, "k string, ts int, id int")
    df = df.withColumn("_chunk", F.floor(F.col("ts") / width))
    out = ordered.neighbour(df, ["k"], ["ts", "id"], ["id"], step)
    got = {r.id: r._near.id if r._near else None for r in out.collect()}
    want = {}
    for key in ("a", "b", None):
        ids = [i for k, ts, i in sorted((x for x in data if x[0] == key), key=lambda x: (x[1], x[2]))]
        for pos, i in enumerate(ids):
            near = pos + step
            want[i] = ids[near] if 0 <= near < len(ids) else None
    assert got == want
