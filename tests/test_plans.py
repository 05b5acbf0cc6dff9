"""Physical plans: what reaches the scan, and what must never appear."""

import re

import pytest

from meterlight.operators import history, reports
from meterlight.operators.sessions import sessions
from meterlight.plans import catalog
from meterlight.sources import adapters, schemas
from meterlight.sources.readers import conform, read

SF_DIR = "/root/testdata/sf0.001"
# These write tables while the query is built.
WRITING = [n for n in catalog.QUERIES if n.startswith(("stream_", "incr_", "simple_refresh", "table_layout", "overwrite_days", "batch_read", "replace_table"))]


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.fixture(autouse=True)
def whole_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(WRITING)))
def test_no_cross_joins_and_no_python(spark, no_broadcast, name):
    plan = plan_of(catalog.QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert not re.search(r"Python|Pandas|InArrow", plan)
    # No window sorts everything in a single task.
    assert not re.search(r"Window \[.*\], \[\], \[", plan)


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "query_history")
    conform(adapters.query_history(spark, SF_DIR), schemas.QUERY_HISTORY).write.parquet(path)
    return path


def test_report_reads_few_columns_and_pushes_its_filter(spark, log):
    rows = history.enriched(history.complete_rows(read(spark, log, schemas.QUERY_HISTORY)))
    plan = plan_of(reports.top_spenders(rows, "1996-01-01 00:00:00", "1997-01-01 00:00:00", ["WH_1"]))
    scan = re.search(r"FileScan parquet \[([^\]]*)\]", plan).group(1)
    assert len(scan.split(",")) == 8
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan).group(1)
    assert "GreaterThanOrEqual(start_time" in pushed and "EqualTo(warehouse_name,WH_1)" in pushed


def test_daily_filter_passes_the_generator(spark, log):
    rows = history.enriched_daily(
        history.day_slices(read(spark, log, schemas.QUERY_HISTORY), "2001-09-01 00:00:00", with_complete=False)
    )
    plan = plan_of(reports.report_filter(rows, "1996-01-01 00:00:00", "1997-01-01 00:00:00").select("st"))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan).group(1)
    assert "LessThanOrEqual(start_time" in pushed


def test_sessions_never_shuffle_rows_by_warehouse_alone(spark, no_broadcast):
    """Rows move by (warehouse, chunk); a whole warehouse only meets as one row per chunk."""
    plan = plan_of(sessions(adapters.warehouse_events(spark, SF_DIR), "2024-01-31 00:00:00", "event_id"))
    found = re.findall(r"([ :]*)\+- Exchange hashpartitioning\(([^)]*), 8\).*\n([^\n]*\n[^\n]*)", plan)
    assert found and "SinglePartition" not in plan
    for _, keys, below in found:
        names = re.findall(r"([a-z_]+)#", keys)
        if names == ["warehouse_id"]:
            assert "SortAggregate(key=[warehouse_id" in below and "_chunk" in below
        elif names != ["warehouse_id", "_chunk"]:
            # Rows of a chunk keep a lane of their own; only edge rows share one per group.
            assert names == ["warehouse_id", "session_type", "_run", "warehouse_name", "cluster_number", "_lane"]


@pytest.mark.parametrize("name, scans, by_chunk", [("sessions", 1, 1), ("report_session_gaps", 1, 1), ("warehouse_sessions_hourly", 1, 1)])
def test_sessions_read_their_source_once(spark, no_broadcast, name, scans, by_chunk):
    """Rows and the summaries of their chunks come from one scan and one exchange."""
    df = catalog.QUERIES[name](spark, SF_DIR)
    df.collect()
    plan = plan_of(df).split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == scans
    assert len(re.findall(r"[-:] +(?:\+- )?Exchange hashpartitioning\(warehouse_id#\d+L, _chunk#\d+L, \d+\), REPARTITION", plan)) == by_chunk
    assert "ReusedExchange" in plan


@pytest.mark.parametrize("name", ["predefined_labels", "recurring_queries", "adhoc_queries"])
def test_hash_counts_come_from_one_aggregate(spark, no_broadcast, name):
    plan = plan_of(catalog.QUERIES[name](spark, SF_DIR))
    assert plan.count("FileScan") == 2 and len(re.findall(r"partial_count", plan)) == 1


def test_top_n_per_model_is_limited_before_the_shuffle(spark):
    plan = plan_of(catalog.QUERIES["report_dbt_trend"](spark, SF_DIR))
    assert plan.index("Final") < plan.index("Exchange hashpartitioning(model_id") < plan.index("Partial")


def test_aggregates_combine_before_the_shuffle(spark):
    plan = plan_of(catalog.QUERIES["report_top_spenders"](spark, SF_DIR))
    assert "partial_sum" in plan


def test_layout_reads_and_rewrites_only_its_days(spark, tmp_path):
    import os

    from pyspark.sql import functions as F

    from meterlight.operators import maintenance as mt

    path = str(tmp_path / "slices")
    rows = spark.range(3000).selectExpr(
        "id AS query_id", "CASE WHEN id % 2 = 0 THEN 'DAILY' ELSE 'COMPLETE' END AS record_type",
        "date_add(DATE'2024-01-01', cast(id % 10 AS int)) AS st_day", "cast(id * 7 % 100 AS int) AS at",
    )
    mt.write_layout(rows, path, ["record_type", "st_day"], ["at"])
    back = mt.batch_read(spark, path, "record_type = 'DAILY' AND st_day = DATE'2024-01-03'", ["at", "query_id"], 5)
    plan = plan_of(back)
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan).group(1)
    assert "record_type" in filters and "st_day" in filters and "TakeOrderedAndProject" in plan
    assert [r.at for r in back.collect()] == sorted(r.at for r in rows.filter("record_type = 'DAILY' AND st_day = DATE'2024-01-03'").collect())[:5]
    files = lambda: {d: sorted(f for f in fs if f.endswith("parquet")) for d, _, fs in os.walk(path)}
    before = files()
    mt.overwrite_days(rows.filter("st_day = DATE'2024-01-02'").withColumn("at", F.lit(-1)), path, ["record_type", "st_day"])
    after = files()
    assert {d for d in before if before[d] != after[d]} == {f"{path}/record_type=COMPLETE/st_day=2024-01-02"}
    assert mt.batch_read(spark, path).count() == 3000
    assert mt.batch_read(spark, path, "at = -1").count() == 300
