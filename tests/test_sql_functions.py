"""SQL functions against the Column functions they mirror."""

from pyspark.sql import functions as F

from meterlight.functions import durations, grades, sql, tags, timeops, warehouses
from meterlight.operators import labels as lb


def test_same_as_column_functions(spark):
    names = sql.register_functions(spark)
    assert len(names) == len(sql.definitions())
    rows = [("Small", "STANDARD", 10), ("Small", "SNOWPARK-OPTIMIZED", 700_001), ("Large", "SNOWPARK-OPTIMIZED", 3), (None, "STANDARD", 4)]
    df = spark.createDataFrame(rows, "size string, kind string, id bigint").crossJoin(
        spark.createDataFrame([(None,), (0,), (179_999,), (5_000_000_000,), (10**13,)], "n bigint")
    )
    pairs = {
        "warehouse_multiplier(size, kind)": warehouses.warehouse_multiplier("size", "kind"),
        "warehouse_credits_per_milli(size, kind)": warehouses.credits_per_milli("size", "kind"),
        "is_serverless_warehouse(id)": warehouses.is_serverless_id("id"),
        "get_credit_cost(id)": warehouses.credit_price("id"),
        "friendly_duration(n)": durations.friendly_duration("n"),
        "friendly_duration_ordinal(n)": durations.friendly_duration_ordinal("n"),
        "model_run_time(n)": grades.run_time_grade("n"),
        "model_size(model_size_rows(n), model_size_bytes(id))": grades.size_grade(grades.rows_level("n"), grades.bytes_level("id")),
        "model_efficiency(n, n)": grades.spill_grade("n", "n"),
        "emonth(TIMESTAMP_NTZ'2024-03-05 01:02:03')": timeops.emonth(F.lit("2024-03-05").cast("timestamp_ntz")),
    }
    for text, column in pairs.items():
        assert df.filter(~F.expr(text).eqNullSafe(column)).count() == 0, text


def test_tag_functions_in_a_label(spark):
    sql.register_functions(spark)
    df = spark.createDataFrame([({"dbt": {"node_id": "m1"}},), ({"app": {"team": "t1"}},), (None,)], "qtag_filter map<string,map<string,string>>")
    rules = [
        lb.Label("array_contains(qtag_sources(qtag_filter), 'dbt')", "dbt"),
        lb.Label("qtag_matches(qtag_filter, 'app', 'team', 't[0-9]')", "team"),
        lb.Label("qtag(qtag_filter, 'app', 'team', 't2')", "team two"),
        lb.Label("qtag_exists(qtag_filter, 'dbt', 'node_id')", "node"),
        lb.Label("qtag_value(qtag_filter, 'dbt', 'node_id')", group="model", dynamic=True),
    ]
    out = lb.apply_labels(df, rules).drop("qtag_filter").collect()
    assert [tuple(r) for r in out] == [
        (True, False, False, True, "m1"), (False, True, False, False, "Other"), (False, False, False, False, "Other"),
    ]
    assert df.select(tags.tag_sources("qtag_filter")).first()[0] == ["dbt"]
