"""Labels, monitors and the tables that hold them."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from meterlight.functions import maps, tags, text
from meterlight.operators import labels as lb
from meterlight.operators import maintenance as mt
from meterlight.operators import monitors as mon
from meterlight.operators import utilization as ut
from meterlight.sources import readers

D = datetime


def test_label_shapes(spark):
    df = spark.createDataFrame([(1, "a"), (5, None), (9, "b")], "x int, t string")
    rules = [
        lb.Label("x > 4", "big"),
        lb.Label("t = 'a'", "null is false"),
        lb.Label("x > 8", "huge", "size", 2),
        lb.Label("x > 4", "large", "size", 1),
        lb.Label("x < 0", "never", "other group", 1),
        lb.Label("t", group="text", dynamic=True),
        lb.Label("true", "off", enabled=False),
        lb.Label("true", "unset", enabled=None),
    ]
    out = lb.apply_labels(df, rules)
    assert "off" not in out.columns and "unset" in out.columns
    rows = {r.x: r for r in out.collect()}
    assert [rows[x]["big"] for x in (1, 5, 9)] == [False, True, True]
    assert [rows[x]["null is false"] for x in (1, 5, 9)] == [True, False, False]
    assert [rows[x]["size"] for x in (1, 5, 9)] == ["Other", "large", "large"]
    assert {r["other group"] for r in rows.values()} == {"Other"}
    assert [rows[x]["text"] for x in (1, 5, 9)] == ["a", "Other", "b"]


def test_rank_ties_go_by_name(spark):
    df = spark.range(1)
    rules = [lb.Label("true", "b", "g", 1), lb.Label("true", "a", "g", 1), lb.Label("true", "0", "g")]
    assert lb.apply_labels(df, rules).first().g == "a"


@pytest.mark.parametrize("rule, valid", [("id > 1", True), ("nope > 1", False), ("id >", False), ("array(1) > 2", False)])
def test_validate_rule(spark, rule, valid):
    assert (lb.validate_rule(spark.range(1), rule) is None) == valid


def test_label_filter(spark):
    df = spark.createDataFrame([(i, bool(i & 1), bool(i & 2), bool(i & 4)) for i in range(8)], "i int, a boolean, b boolean, c boolean")
    keep = lambda **k: {r.i for r in df.filter(lb.label_filter(**k)).collect()}
    assert keep() == set(range(8))
    assert keep(include_all=["a", "b"]) == {3, 7}
    assert keep(include_any=["a", "b"], exclude_any=["c"]) == {1, 2, 3}


LIVE = "query_id string, user_name string, warehouse_name string, session_id bigint, start_time timestamp_ntz, bytes_scanned bigint, query_type string, query_text string"


def live(spark):
    rows = [
        ("q1", "ann", "W", 1, D(2024, 1, 1, 10), 5, "SELECT", "t"),
        ("q2", "bob", "W", 2, D(2024, 1, 1, 11), 50, "SELECT", "t"),
        ("q3", "cy", "W", 3, D(2024, 1, 1, 12), 50, "SELECT", "t"),
    ]
    return spark.createDataFrame(rows, LIVE)


def test_each_rule_fires_once(spark):
    rules = [
        mon.Probe("silent", "true"),
        mon.Probe("one", "bytes_scanned > 10", cancel=True),
        mon.Probe("same", "bytes_scanned > 10", notify_other="a@b.c"),
        mon.Probe("off", "true", cancel=True, enabled=False),
    ]
    fired = spark.createDataFrame([("one", "q2"), ("other", "q3")], "probe_name string, query_id string")
    pairs = lambda df: {(r.query_id, r.probe_name) for r in df.collect()}
    assert pairs(mon.match_probes(live(spark), rules)) == {("q2", "one"), ("q2", "same"), ("q3", "one"), ("q3", "same")}
    first = mon.match_probes(live(spark), rules, fired, first_only=True)
    assert pairs(first) == {("q2", "same"), ("q3", "one")}
    assert pairs(mon.match_probes(live(spark), rules, own_session=3)) == {("q2", "one"), ("q2", "same")}
    assert mon.match_probes(live(spark), [], fired).count() == 0


def test_actions_and_messages(spark):
    rules = [
        mon.Probe("both", "true", notify_writer=True, notify_other="x@y.z", cancel=True),
        mon.Probe("slack", "true", notify_other="#a", notify_other_method="Slack", notify_writer=True),
    ]
    users = spark.createDataFrame([("ann", "ann@x"), ("bob", None)], "name string, email string")
    acts = mon.probe_actions(mon.match_probes(live(spark), rules), rules, users, "2024-01-01 13:00:00")
    got = {(r.query_id, r.probe_name): r.action_taken for r in acts.collect()}
    assert got[("q1", "both")] == {"Email": "ann@x,x@y.z", "CANCEL": "true"}
    assert got[("q2", "both")] == {"Email": "x@y.z", "CANCEL": "true"}
    assert got[("q1", "slack")] == {"Email": "ann@x", "Slack": "#a", "CANCEL": "false"}
    assert got[("q3", "slack")] == {"Slack": "#a", "CANCEL": "false"}
    sent = {(r.query_id, r.probe_name, r.method): r for r in mon.messages(acts, "ACC").collect()}
    mail = sent["q1", "both", "Email"]
    assert (mail.destination, mail.subject) == ("ann@x,x@y.z", "Monitor both: query q1")
    assert "query:     q1\n" in mail.body and "account:   ACC\n" in mail.body
    chat = sent["q1", "slack", "Slack"]
    assert (chat.destination, chat.subject) == ("#a", None)
    assert chat.body.startswith("*slack* has found query `q1`") and chat.body.endswith("```")
    # Cancelling is no message, and who has no address gets none.
    assert ("q3", "slack", "Email") not in sent and not any(m == "CANCEL" for _, _, m in sent)


def test_render(spark):
    df = spark.range(1)
    col = text.render("a {x} b {x}{y} }", {"x": F.lit(1), "y": F.lit(None).cast("string")})
    assert df.select(col).first()[0] == "a 1 b 1null }"
    with pytest.raises(KeyError):
        text.render("{gone}", {})


@pytest.mark.parametrize(
    "value, method, duplicates",
    [
        ("a@x.org, A@X.org", "Email", ["a@x.org"]),
        ("#a, #A", "Slack", []),
        ("#a,#b , #a,#b", "Slack", ["#a", "#b"]),
        ("one@x.org", "Email", []),
    ],
)
def test_duplicate_destinations(spark, value, method, duplicates):
    df = spark.createDataFrame([(value,)], "v string")
    assert mon.duplicate_destinations(df, "v", method).first().duplicates == duplicates


def test_tags(spark):
    entries = [("a", "k", "1"), ("a", "k", "2"), (None, "k", "3"), ("b", None, "4")]
    df = spark.createDataFrame([(entries,), (None,), ([],)], f"t {tags.TAG_SCHEMA}")
    maps_ = [r[0] for r in df.select(tags.tags_to_map("t")).collect()]
    assert maps_ == [{"a": {"k": "2"}, "undefined": {"k": "3"}, "b": {"undefined": "4"}}, None, {}]
    sql = [
        ('select 1 /* [{"SOURCE":"s","KEY":"k","VALUE":"v"}] */',),
        ("select 1",),
        ("/* [{broken] */",),
    ]
    out = spark.createDataFrame(sql, "q string").select(tags.extract_tags("q")).collect()
    assert out[0][0][0].VALUE == "v" and out[1][0] is None


def test_maps(spark):
    df = spark.createDataFrame([({"a": "1", "e": ""}, {"a": "2", "b": "3", "e": "4"})], "x map<string,string>, y map<string,string>")
    row = df.select(maps.merge_objects("x", "y").alias("m"), maps.merge_concat_objects("x", "y").alias("c")).first()
    assert row.m == {"a": "2", "b": "3", "e": "4"}
    assert row.c == {"a": "1,2", "b": "3", "e": "4"}


def test_text(spark):
    sql = [
        ("SELECT a1, 'it''s' FROM db.t1 WHERE x = 10.5 -- note 7",),
        ("select a1, 'other'   from db.t1 where x = 99",),
        ("with c as (select * from base) select * from c join s.u on true join d.s.v on 1 = 1",),
    ]
    df = spark.createDataFrame(sql, "q string")
    rows = df.select(
        text.fingerprint("q").alias("f"),
        text.hash_literals("q").alias("h"),
        text.referenced_tables("q", F.lit("db0"), F.lit("main")).alias("t"),
        text.referenced_tables("q", F.lit("db0"), F.lit("main"), exclude_cte=False).alias("all"),
    ).collect()
    assert rows[0].f == rows[1].f != rows[2].f
    assert "a1" in rows[0].h and "t1" in rows[0].h and "it''s" not in rows[0].h and "10.5" not in rows[0].h
    assert rows[0].h != rows[1].h
    assert rows[2].t == ["D.S.V", "DB0.MAIN.BASE", "DB0.S.U"]
    assert rows[2].all == ["D.S.V", "DB0.MAIN.BASE", "DB0.MAIN.C", "DB0.S.U"]


def test_text_with_literals_lists_and_quotes(spark):
    sql = [
        "select 1 from a, b as x, s.c y where note = '-- not a comment' and 1 = 1 join t2 on true",
        'select 1 from "My T" join d."S 1".v using (k) -- from gone',
        "select extract(day from ts) /* from no */ from t where x = 'from lit' order by 1",
        "select 1 from a where note = '-- other' join t3 on true",
    ]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(sql)], "i int, q string")
    rows = df.select(
        text.fingerprint("q").alias("f"), text.strip_comments("q").alias("s"),
        text.referenced_tables("q", F.lit("db0"), F.lit("main")).alias("t"),
    ).orderBy("i").collect()
    assert rows[0].t == ["DB0.MAIN.A", "DB0.MAIN.B", "DB0.MAIN.T2", "DB0.S.C"]
    assert rows[1].t == ["D.S 1.V", "DB0.MAIN.My T"]
    assert rows[2].t == ["DB0.MAIN.T"]
    assert rows[3].s == sql[3] and rows[1].s.endswith("(k) ")
    assert len({r.f for r in rows}) == 4


def test_many_rules_are_read_whole(spark):
    table = spark.range(1500).selectExpr(
        "'id % 1500 = ' || id AS condition", "'label_' || id AS name", "CAST(NULL AS string) AS group_name",
        "CAST(NULL AS int) AS group_rank", "false AS is_dynamic", "true AS enabled",
    )
    assert len(lb.load_labels(table)) == 1500


def test_size_and_type_of_a_warehouse_come_from_one_row(spark):
    rows = [("W", "Large", "STANDARD"), ("W", "Small", "SNOWPARK-OPTIMIZED")]
    dim = readers.warehouse_dim(spark.createDataFrame(rows, "warehouse_name string, warehouse_size string, warehouse_type string"))
    assert [tuple(r) for r in dim.collect()] == [("W", "Large", "STANDARD")]


def test_renamed_warehouse_has_one_row_a_day(spark):
    used = [(1, "OLD", D(2024, 1, 1), D(2024, 1, 1, 3), 100), (1, "NEW", D(2024, 1, 1), D(2024, 1, 1, 9), 100)]
    paid = [(1, "OLD", D(2024, 1, 1, 3), 5.0), (1, "NEW", D(2024, 1, 1, 9), 7.0)]
    slices = spark.createDataFrame(used, "warehouse_id long, warehouse_name string, st_period timestamp_ntz, start_time timestamp_ntz, credit_units long")
    slices = slices.withColumn("st_day", F.to_date("st_period"))
    metering = spark.createDataFrame(paid, "warehouse_id long, warehouse_name string, start_time timestamp_ntz, credits_used_compute double")
    rows = ut.utilization(slices, metering).collect()
    assert [(r.warehouse_name, r.queries, r.loaded_cc) for r in rows] == [("NEW", 2, 12.0)]


def test_very_long_literals(spark):
    long = "x" * 200_000 + "''" * 50_000
    df = spark.createDataFrame([(f"select '{long}', 12",), ("select 'a', 7",)], "q string")
    rows = df.select(text.fingerprint("q").alias("f"), F.length(text.hash_literals("q")).alias("n")).collect()
    assert rows[0].f == rows[1].f and rows[0].n > 50_000


def test_dedupe_keeps_one_of_many(spark):
    rows = [("a", None, "3"), ("a", None, "1"), ("a", None, "2"), ("a", "g", "5"), (None, "g", "7"), (None, "g", "6")]
    df = spark.createDataFrame(rows, "name string, group_name string, label_id string")
    out = {tuple(r) for r in mt.remove_duplicate_labels(df).collect()}
    assert out == {("a", None, "1"), ("a", "g", "5"), (None, "g", "6")}


def test_upserts(spark):
    t = spark.createDataFrame([("a", None, 1, "i1"), (None, "g", 2, "i2"), ("z", None, 3, "i3")], "name string, grp string, v int, id string")
    u = spark.createDataFrame([("a", None, 10), (None, "g", 20), ("new", None, 30), (None, "h", 40)], "name string, grp string, v int")
    out = {(r.name, r.grp, r.v): r.id for r in mt.upsert_two_key(t, u, "name", "grp", ["id"], "id").collect()}
    assert out.keys() == {("a", None, 10), (None, "g", 20), ("z", None, 3), ("new", None, 30), (None, "h", 40)}
    assert out[("a", None, 10)] == "i1" and out[(None, "g", 20)] == "i2" and out[("z", None, 3)] == "i3"
    assert len(out[("new", None, 30)]) == 36


def test_merge_missing(spark):
    ddl = "name string, group_name string, label_id string"
    pre = spark.createDataFrame([("a", None, "1"), (None, "g", "2"), ("b", "h", "3")], ddl)
    assert mt.merge_missing(pre.limit(0), pre).count() == 3
    mine = spark.createDataFrame([("a", None, "x"), (None, "g", "y")], ddl)
    assert [r.name for r in mt.merge_missing(mine, pre).collect()] == ["b"]


def label_rows(spark, rows):
    ddl = (
        "name string, group_name string, group_rank bigint, label_created_at timestamp_ntz, condition string,"
        " enabled boolean, label_modified_at timestamp_ntz, is_dynamic boolean, label_id string"
    )
    return spark.createDataFrame(rows, ddl)


def test_predefined_labels_come_and_are_upgraded(spark):
    then, now = D(2024, 1, 1), D(2024, 6, 1)
    pre = label_rows(spark, [("a", None, None, then, "x > 1", True, now, False, None), (None, "g", None, then, "x", True, now, True, None)])
    empty = pre.limit(0)
    first = mt.initialize_rules(empty, pre, inited=False)
    assert first.count() == 2 and first.filter("label_modified_at = label_created_at").count() == 2
    assert mt.initialize_rules(empty, pre, inited=True) is None
    assert mt.initialize_rules(pre, pre, inited=False) is None
    mine = label_rows(spark, [(*r[:6], then, r[7], f"id{i}") for i, r in enumerate(pre.collect())])
    newer = label_rows(spark, [("a", None, None, then, "x > 2", True, now, False, None), (None, "g", None, then, "x", True, now, True, None), ("b", None, None, D(2024, 5, 31), "y", True, now, False, None)])
    up = {(r.name, r.group_name): r for r in mt.upgrade_rules(mine, newer, now, 3 * 86_400).collect()}
    assert up[("a", None)].condition == "x > 2" and up[("a", None)].label_id == "id0"
    assert up[(None, "g")].label_id == "id1" and len(up[("b", None)].label_id) == 36
    edited = mine.withColumn("label_modified_at", F.lit(now).cast("timestamp_ntz"))
    assert mt.upgrade_rules(edited, newer, now, 3 * 86_400) is None


def test_rules_from_tables(spark):
    then = D(2024, 1, 1)
    table = label_rows(spark, [("a", None, None, then, "x > 1", None, then, None, "1"), ("l", "g", 2, then, "x > 2", False, then, False, "2")])
    assert lb.load_labels(table) == [lb.Label("x > 1", "a", enabled=None), lb.Label("x > 2", "l", "g", 2, enabled=False)]
    probes = spark.createDataFrame(
        [("p", "true", True, None, None, "Slack", None, None, then, then)],
        "name string, condition string, notify_writer boolean, notify_writer_method string, notify_other string,"
        " notify_other_method string, cancel boolean, enabled boolean, probe_modified_at timestamp_ntz, probe_created_at timestamp_ntz",
    )
    assert mon.load_probes(probes) == [mon.Probe("p", "true", True, "Email", None, "Slack", False, None)]


def test_schema_changes(spark):
    view = spark.createDataFrame([], "a int, b string, h1 string, h2 int").schema
    table = spark.createDataFrame([(1, "x", 5, "h")], "a int, b string, h2 int, h1 string")
    drop, add = mt.schema_changes(view, table.schema)
    assert drop == ["h2", "h1"] and add == ["h1", "h2"]
    moved = mt.migrate(table, view)
    assert moved.columns == ["a", "b", "h1", "h2"] and tuple(moved.first()) == (1, "x", "h", 5)
    assert mt.schema_changes(view, view) == ([], [])
    changed = mt.migrate(spark.createDataFrame([("1", "x")], "a string, b string"), view)
    assert tuple(changed.first()) == (None, "x", None, None)


def test_partition_overwrite_touches_only_its_days(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("d1", 1), ("d2", 2)], "day string, v int")
    mt.write_layout(rows, path, ["day"], ["v"])
    mt.overwrite_days(spark.createDataFrame([("d2", 20), ("d2", 21)], "day string, v int"), path, ["day"])
    got = sorted((r.day, r.v) for r in spark.read.schema("v int, day string").parquet(path).collect())
    assert got == [("d1", 1), ("d2", 20), ("d2", 21)]
