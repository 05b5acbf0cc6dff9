"""Slices: hand-made edges, and what must hold for any interval."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meterlight.functions import timeops as t
from meterlight.operators import history
from meterlight.operators.slicing import clip_to_grid

D = datetime


def rows(spark, pairs):
    return spark.createDataFrame(
        [(i, s, e) for i, (s, e) in enumerate(pairs)], "id int, s timestamp_ntz, e timestamp_ntz"
    )


@pytest.mark.parametrize(
    "unit, start, end, expected",
    [
        ("hour", D(2024, 1, 1, 0, 59), D(2024, 1, 1, 1, 1), [60, 60]),
        ("hour", D(2024, 1, 1, 0, 10), D(2024, 1, 1, 0, 10), [0]),
        ("hour", D(2024, 1, 1, 0, 0), D(2024, 1, 1, 1, 0), [3600, 0]),
        ("day", D(2024, 1, 1, 23, 0), D(2024, 1, 2, 0, 0), [3600, 0]),
        ("day", D(2024, 1, 1, 12, 0), D(2024, 1, 3, 6, 0), [43200, 86400, 21600]),
    ],
)
def test_edges(spark, unit, start, end, expected):
    out = clip_to_grid(rows(spark, [(start, end)]), "s", "e", unit).orderBy("st", "et")
    assert [r.duration for r in out.collect()] == [x * 1000 for x in expected]


@pytest.mark.parametrize("unit", ["hour", "day"])
def test_slices_partition_the_interval(spark, unit):
    rng = random.Random(7)
    pairs = []
    for _ in range(400):
        s = D(2024, 2, 27) + timedelta(microseconds=rng.randrange(5 * 86_400_000_000))
        pairs.append((s, s + timedelta(microseconds=rng.choice([0, 1, 999, rng.randrange(3 * 86_400_000_000)]))))
    df = rows(spark, pairs)
    out = clip_to_grid(df, "s", "e", unit)
    grid = timedelta(days=1) if unit == "day" else timedelta(hours=1)
    by_id = {}
    for r in out.collect():
        by_id.setdefault(r.id, []).append(r)
    assert len(by_id) == len(pairs)
    for i, (s, e) in enumerate(pairs):
        parts = sorted(by_id[i], key=lambda r: (r.st, r.et))
        assert parts[0].st == s and parts[-1].et == e
        for a, b in zip(parts, parts[1:]):
            assert a.et == b.st
        for p in parts:
            assert p.st_period <= p.st <= p.et <= p.st_period + grid
        ms = lambda x: (x - D(1970, 1, 1)) // timedelta(milliseconds=1)
        assert sum(p.duration for p in parts) == ms(e) - ms(s)


def query(spark, start, end, **kw):
    row = dict(
        query_id="q", start_time=start, end_time=end, query_load_percent=50, warehouse_size="Small",
        warehouse_type="STANDARD", warehouse_id=1, **kw,
    )
    ddl = (
        "query_id string, start_time timestamp_ntz, end_time timestamp_ntz, query_load_percent bigint,"
        " warehouse_size string, warehouse_type string, warehouse_id bigint"
    )
    return spark.createDataFrame([tuple(row.values())], ddl)


def test_running_query_has_one_daily_row(spark):
    out = history.day_slices(query(spark, D(2024, 1, 1, 22), D(1970, 1, 1)), "2024-01-05 00:00:00").collect()
    assert [(r.record_type, r.st, r.et, r.incomplete) for r in out] == [
        ("DAILY", D(2024, 1, 1, 22), D(2024, 1, 2), True)
    ]
    out = history.day_slices(query(spark, D(2024, 1, 1, 22), D(1970, 1, 1)), "2024-01-01 22:30:00").collect()
    assert out[0].et == D(2024, 1, 1, 22, 30)


@pytest.mark.parametrize(
    "size, kind, wid, credits, cost",
    [
        ("Small", "STANDARD", 1, 1.0, 2.0),  # an hour at half load on 2 credits per hour
        ("Small", "SNOWPARK-OPTIMIZED", 1, 1.5, 3.0),
        ("Small", None, 1, 1.5, 3.0),
        ("Small", "STANDARD", 700_001, 1.0, 3.0),
        ("Huge", "STANDARD", 1, 0.0, 0.0),
        (None, "STANDARD", 1, 0.0, 0.0),
    ],
)
def test_cost(spark, size, kind, wid, credits, cost):
    q = query(spark, D(2024, 1, 1, 1), D(2024, 1, 1, 2)).withColumns(
        {
            "warehouse_size": F.lit(size).cast("string"),
            "warehouse_type": F.lit(kind).cast("string"),
            "warehouse_id": F.lit(wid).cast("bigint"),
        }
    )
    row = history.enriched(history.day_slices(q, "2024-02-01 00:00:00")).first()
    assert (row.unloaded_direct_compute_credits, row.cost) == (credits, cost)


def test_daily_and_hourly_credits_equal_complete(spark):
    q = query(spark, D(2024, 1, 1, 1, 23, 45, 678901), D(2024, 1, 3, 2, 3, 4, 567))
    slices = history.day_slices(q, "2024-02-01 00:00:00")
    complete = history.enriched(slices)
    total = complete.agg(F.sum("credit_units")).first()[0]
    assert history.enriched_daily(slices).agg(F.sum("credit_units")).first()[0] == total
    assert history.enriched_hourly(complete).agg(F.sum("credit_units")).first()[0] == total


def test_complete_rows_are_those_of_the_slices(spark):
    q = query(spark, D(2024, 1, 1, 22), D(2024, 1, 3, 1)).unionByName(query(spark, D(2024, 1, 1, 22), D(1970, 1, 1)))
    slices = history.day_slices(q, "2024-02-01 00:00:00").filter("record_type = 'COMPLETE'")
    alone = history.complete_rows(q).select(*slices.columns)
    assert alone.collect() == slices.collect() and alone.count() == 1
    days = history.day_slices(q, "2024-02-01 00:00:00", with_complete=False)
    assert days.count() == 4 and days.filter("record_type <> 'DAILY'").count() == 0


def test_boundaries_and_ranges(spark):
    df = rows(spark, [(D(2024, 1, 1, 0, 59), D(2024, 1, 1, 1, 1)), (D(2024, 1, 2), D(2024, 1, 1))])
    out = df.select(
        t.boundaries("hour", "s", "e").alias("h"),
        t.boundaries("day", "s", "e").alias("d"),
        F.size(t.period_range("day", "s", "e")).alias("r"),
        F.size(t.index_range(F.lit(3), F.lit(3))).alias("x"),
        t.emonth("s").alias("m"),
    ).collect()
    assert [tuple(r) for r in out] == [(1, 0, 1, 0, 648), (-24, -1, 1, 0, 648)]
