"""Sinks that keep tables from micro-batches, exactly once.

Rows that only ever come to a table are written to a folder named after their batch, which a
replayed batch overwrites. Tables whose rows change lie in partitions by day: a batch works out
the new content of the days it touches, writes it down once, and then overwrites just those
partitions; a replay finds what was written and goes on from there. What a batch hands to the
next one is a small table of its own, which goes when the batch after has been written. All
state lies in the checkpointed folder on shared storage; nothing is kept in the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, IntegerType, StructField, StructType

from meterlight.functions.timeops import GRID_MICROS, from_micros, literal_micros, micros
from meterlight.operators import monitors as mon
from meterlight.operators.history import day_slices
from meterlight.operators.maintenance import overwrite_days, upsert
from meterlight.operators.quota import persona_rows
from meterlight.operators.refresh import EPOCH, Watermarks
from meterlight.operators.sessions import cut_starts, emit_sessions, key_events

Clock = Callable[[], "datetime | str"]


def run_available(
    sdf: DataFrame, path: str, on_batch: Callable[[DataFrame, int], None], mode: str = "append"
) -> StreamingQuery:
    """Processes everything that has arrived, then stops; call again when more has."""
    query = (
        sdf.writeStream.outputMode(mode)
        .foreachBatch(on_batch)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def _remove(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def arrive(log: DataFrame, source: str, target: str) -> None:
    """The files of one folder come to another, where a stream finds them; without any, one without rows does."""
    spark = log.sparkSession
    fs, at = _file_system(spark, source)
    if not fs.exists(at):
        log.limit(0).write.mode("append").parquet(target)
        return
    into = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs.mkdirs(into)
    for s in fs.listStatus(at):
        # Tasks name their files alike in every folder of one write.
        if not fs.rename(s.getPath(), spark._jvm.org.apache.hadoop.fs.Path(into, f"{at.getName()}-{s.getPath().getName()}")):
            raise OSError(f"{s.getPath()} cannot come to {target}")


def _write(df: DataFrame, path: str, table: str, batch: int, by: Iterable[str] = ()) -> None:
    out = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    out.partitionBy(*by).parquet(f"{path}/{table}/batch={batch}")


def read_all(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Every batch of a table."""
    return spark.read.parquet(f"{path}/{table}")


def read_batch(spark: SparkSession, path: str, table: str, batch: int) -> DataFrame:
    return spark.read.parquet(f"{path}/{table}/batch={batch}")


def _before(spark: SparkSession, path: str, table: str, schema, batch: int | None = None) -> DataFrame:
    """The rows of a table that batches before ``batch`` wrote; none if there is no table yet."""
    if not _exists(spark, f"{path}/{table}"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(f"{path}/{table}")
    return rows if batch is None else rows.filter(F.col("batch") < batch)


def _handed_on(spark: SparkSession, path: str, table: str, schema, batch: int) -> DataFrame:
    """What the batch before handed on."""
    at = f"{path}/{table}/batch={batch - 1}"
    return spark.read.schema(schema).parquet(at) if _exists(spark, at) else spark.createDataFrame([], schema)


def _hand_on(df: DataFrame, path: str, table: str, batch: int) -> None:
    """Written for the next batch. What the batch before last handed on is needed by no replay."""
    _write(df, path, table, batch)
    _remove(df.sparkSession, f"{path}/{table}/batch={batch - 2}")


def last_batch(spark: SparkSession, path: str, table: str) -> int:
    """Number of the newest batch that handed this table on, with or without rows: by its folders."""
    fs, at = _file_system(spark, f"{path}/{table}")
    return max(int(s.getPath().getName().removeprefix("batch=")) for s in fs.listStatus(at) if s.isDirectory())


def _replace_days(content: Callable[[], DataFrame], spark: SparkSession, path: str, table: str, batch: int) -> None:
    """Overwrites the ``day`` partitions of a table that occur in ``content``, which may read that table.

    The content is written down first. If the batch fails while partitions are overwritten, its
    replay takes what was written instead of reading a table that is changed in part.
    """
    at = f"{path}/new-{table}/batch={batch}"
    if not _exists(spark, f"{at}/_SUCCESS"):
        _write(content(), path, f"new-{table}", batch)
    rows = spark.read.parquet(at)
    if not rows.isEmpty():
        overwrite_days(rows, f"{path}/{table}", ["day"])
    _remove(spark, f"{path}/new-{table}/batch={batch - 1}")


def _day(ts: str):
    return F.to_date(ts)


def _one_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row of those with equal keys, whatever their order."""
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")


def _with(schema: StructType, *columns: str) -> StructType:
    """A schema with the columns of its folders behind it."""
    kinds = {"day": DateType(), "batch": IntegerType()}
    return StructType([*schema.fields, *(StructField(c, kinds[c]) for c in columns)])


# settled rows ---------------------------------------------------------------------------------


def keep_settled(
    path: str, ts: str, delay_minutes: int, keys: list[str], clock: Clock | None = None
) -> Callable[[DataFrame, int], None]:
    """Rows of a log once they are final, each once: the streaming form of ``readers.settled``.

    A row waits in ``held`` until the clock is past its lateness allowance. One that arrives
    later than that is final at once and comes through like any other. A row that comes again
    is left out: it is looked up among those held and those settled on its days. ``clock`` is
    the time of the run; without one it is the newest row seen.
    """

    def on_batch(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        schema = df.schema
        last = _handed_on(spark, path, "clock", "now bigint", batch).first()
        fresh = _one_each(df, keys).persist()
        seen = fresh.agg(F.max(micros(ts)).alias("newest"), F.min(_day(ts)).alias("oldest")).first()
        now = max(last.now if last else 0, literal_micros(clock()) if clock else seen.newest or 0)
        held = _handed_on(spark, path, "held", schema, batch)
        if seen.oldest is not None:
            known = _before(spark, path, "settled", _with(df.schema, "batch", "day"), batch)
            fresh_rows = fresh.join(held.select(*keys), keys, "left_anti").join(
                known.filter(F.col("day") >= F.lit(seen.oldest)).select(*keys), keys, "left_anti"
            )
            held = held.unionByName(fresh_rows)
        limit = now - delay_minutes * GRID_MICROS["minute"]
        ready = F.lit(True) if delay_minutes <= 0 else micros(ts) < F.lit(limit).cast("bigint")
        _write(held.filter(ready).withColumn("day", _day(ts)), path, "settled", batch, ["day"])
        _hand_on(held.filter(~ready), path, "held", batch)
        _hand_on(spark.range(1).select(F.lit(now).cast("bigint").alias("now")), path, "clock", batch)
        fresh.unpersist()

    return on_batch


def settled_kept(spark: SparkSession, path: str, schema) -> DataFrame:
    return _before(spark, path, "settled", _with(schema, "batch", "day")).drop("batch", "day")


# queries --------------------------------------------------------------------------------------


def _newest(df: DataFrame) -> DataFrame:
    """One version of each query: a finished one if there is any, of the latest arrival, then with the latest end."""
    # A map has no order; its text has.
    ties = [F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in df.schema]
    order = [F.desc(c) for c in (F.expr("start_time <= end_time"), "arrival", "end_time", *ties)]
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return df.withColumn("_nth", nth).filter("_nth = 1").drop("_nth", "arrival")


STATE = "oldest_running timestamp_ntz, newest_completed timestamp_ntz"


def keep_queries(path: str, clock: Clock | None = None) -> Callable[[DataFrame, int], None]:
    """Closed queries appended once, running ones replaced by each batch.

    A query first arrives as running and later as finished; the finished row removes it from
    the open table. A finished row that comes again is not stored again, and a running row that
    comes after the finished one does not open the query again. A query keeps its start time,
    so only the days of the closed table from the oldest start in the batch on are read. Its
    files hold the rows of a batch sorted by start, with the day as a column that reads are
    narrowed by: a log of many days gives as many files as its rows fill, not some for each day.

    Each batch hands on the two watermarks: the oldest start still running (else the newest
    end seen) and the newest end of a finished query. With a ``clock`` it also writes slices:
    those of closed queries once, those of open ones anew.
    """

    def on_batch(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        schema = df.schema
        running = F.col("start_time") > F.col("end_time")
        earlier = _handed_on(spark, path, "open", schema, batch).withColumn("arrival", F.lit(batch - 1))
        seen = df.withColumn("arrival", F.lit(batch)).unionByName(earlier)
        latest = _newest(seen.filter(running.isNotNull()))
        oldest = df.agg(F.min(_day("start_time"))).first()[0]
        if oldest is not None:
            closed = _before(spark, path, "closed", _with(schema, "day", "batch"), batch)
            known = closed.filter(F.col("day") >= F.lit(oldest)).select("query_id")
            latest = latest.join(known, "query_id", "left_anti")
        latest = latest.persist()
        done, still = latest.filter(~running), latest.filter(running)
        by_time = done.withColumn("day", _day("start_time")).sortWithinPartitions("start_time")
        _write(by_time, path, "closed", batch)
        _hand_on(still, path, "open", batch)
        if clock is not None:
            _write(day_slices(done, clock()), path, "closed-slices", batch)
            _hand_on(day_slices(still, clock()), path, "open-slices", batch)
        none = F.lit(None).cast("timestamp_ntz")
        seen = _handed_on(spark, path, "state", STATE, batch).select(none.alias("start"), F.col("newest_completed").alias("end"))
        seen = seen.unionByName(done.select(none.alias("start"), F.col("end_time").cast("timestamp_ntz").alias("end")))
        seen = seen.unionByName(still.select(F.col("start_time").cast("timestamp_ntz").alias("start"), none.alias("end")))
        after = seen.agg(F.coalesce(F.min("start"), F.max("end")).alias("oldest_running"), F.max("end").alias("newest_completed"))
        _hand_on(after, path, "state", batch)
        latest.unpersist()

    return on_batch


def queries_kept(spark: SparkSession, path: str) -> DataFrame:
    """Finished queries and those still running."""
    still = read_batch(spark, path, "open", last_batch(spark, path, "state"))
    return _before(spark, path, "closed", _with(still.schema, "day", "batch")).drop("batch", "day").unionByName(still)


def slices_kept(spark: SparkSession, path: str) -> DataFrame:
    """The slices of finished queries and of those still running, as of the last batch."""
    still = read_batch(spark, path, "open-slices", last_batch(spark, path, "state"))
    return _before(spark, path, "closed-slices", _with(still.schema, "batch")).drop("batch").unionByName(still)


def watermarks_kept(spark: SparkSession, path: str) -> Watermarks:
    """The watermarks after the last batch."""
    row = read_batch(spark, path, "state", last_batch(spark, path, "state")).first()
    return Watermarks(row.oldest_running or EPOCH, row.newest_completed or EPOCH)


# sessions -------------------------------------------------------------------------------------

EVENTS = "_us bigint, warehouse_id bigint, warehouse_name string, cluster_number bigint, _event int, _tie bigint"
RUNS = "warehouse_id bigint, _last bigint"


def keep_sessions(path: str, tie: str | None = None, chunk: str = "hour") -> Callable[[DataFrame, int], None]:
    """Sessions from a stream of events, in any order and however late.

    A batch reopens only what its events touch. For each warehouse that is the run before its
    first new event, or the last run if the event comes after all others, and all that follows:
    those events are cut anew, and the sessions that begin there replace the ones before, in
    the days they begin on. An event at the instant of another one is like a late one. What
    was cut does not depend on the clock; open ends are filled in by :func:`sessions_kept`.

    Between batches only the last run of each warehouse is handed on. Earlier runs are looked
    up for warehouses with late events alone.
    """

    def on_batch(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        typed = [F.col(f).cast(kind).alias(f) for f, kind in (x.split() for x in EVENTS.split(", "))]
        _write(key_events(df, tie).select(*typed), path, "events", batch)
        fresh = read_batch(spark, path, "events", batch)
        runs = _handed_on(spark, path, "runs", RUNS, batch)
        first = fresh.groupBy("warehouse_id").agg(F.min("_us").alias("_first")).join(runs, "warehouse_id", "left").persist()
        late = first.filter("_first <= _last")
        since = first.select("warehouse_id", F.when(F.col("_first") > F.col("_last"), F.col("_last")).alias("_since"))
        newest_late = late.agg(F.max("_first")).first()[0]
        if newest_late is not None:
            day = F.to_date(from_micros(F.lit(newest_late).cast("bigint")))
            known = spark.read.parquet(f"{path}/sessions").filter(F.col("day") <= day).select("warehouse_id", "_run")
            found = known.join(late, "warehouse_id").filter("_run < _first").groupBy("warehouse_id").agg(F.max("_run").alias("_found"))
            since = since.join(found, "warehouse_id", "left").select("warehouse_id", F.coalesce("_since", "_found").alias("_since"))
        since = since.fillna({"_since": -(1 << 62)}).persist()
        low = since.agg(F.min("_since")).first()[0]
        if low is not None:
            new = None

            def content() -> DataFrame:
                nonlocal new
                events = _before(spark, path, "events", f"{EVENTS}, batch int", batch + 1).filter(F.col("_us") >= low)
                touched = events.join(since, "warehouse_id").filter("_us >= _since").drop("_since", "batch")
                new = cut_starts(touched, chunk).withColumn("day", _day(from_micros(F.col("_us")))).persist()
                if not _exists(spark, f"{path}/sessions"):
                    return new
                kept = spark.read.parquet(f"{path}/sessions").join(new.select("day").distinct(), "day", "left_semi")
                kept = kept.join(since, "warehouse_id", "left").filter("_since IS NULL OR _us < _since").drop("_since")
                return kept.unionByName(new.select(*kept.columns))

            _replace_days(content, spark, path, "sessions", batch)
            cut = read_batch(spark, path, "new-sessions", batch).join(since.select("warehouse_id"), "warehouse_id", "left_semi")
            last = cut.groupBy("warehouse_id").agg(F.max("_run").alias("_last"))
            runs = upsert(runs, last, ["warehouse_id"])
            if new is not None:
                new.unpersist()
        _hand_on(runs, path, "runs", batch)
        first.unpersist()
        since.unpersist()

    return on_batch


def sessions_kept(spark: SparkSession, path: str, as_of: datetime | str) -> DataFrame:
    """All sessions as of an instant; those without a stop end at midnight or, before that, now."""
    if not _exists(spark, f"{path}/sessions"):
        return emit_sessions(cut_starts(spark.createDataFrame([], EVENTS)), as_of)
    return emit_sessions(spark.read.parquet(f"{path}/sessions").drop("day"), as_of)


# alerts ---------------------------------------------------------------------------------------

ACTIONS = (
    "action_time timestamp_ntz, probe_name string, query_id string, actions_taken map<string,string>, outcome string, "
    "user_name string, warehouse_name string, start_time timestamp_ntz, query_text string, batch int, day date"
)


def log_alerts(
    path: str, probes: Iterable[mon.Probe], users: DataFrame, clock: Clock
) -> Callable[[DataFrame, int], None]:
    """The action log: what to do for each match that it does not hold yet, so that each fires once.

    It needs no order of arrival: a query that started long ago and matches now fires now. A
    query keeps its start time, so only the days of the log from the oldest start in the batch
    on are read. ``outcome`` is empty until whoever sends and cancels reports back.
    """
    rules = list(probes)

    def on_batch(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        keys = ["probe_name", "query_id"]
        fresh = _one_each(df.select(*keys, "user_name", "warehouse_name", "start_time", "query_text"), keys).persist()
        oldest = fresh.agg(F.min(_day("start_time"))).first()[0]
        if oldest is not None:
            held = _before(spark, path, "actions", ACTIONS, batch).filter(F.col("day") >= F.lit(oldest))
            actions = mon.probe_actions(fresh.join(held.select(*keys), keys, "left_anti"), rules, users, clock())
            log = mon.action_log(actions).withColumn("day", _day("start_time"))
            _write(log, path, "actions", batch, ["day"])
        fresh.unpersist()

    return on_batch


def alerts_kept(spark: SparkSession, path: str) -> DataFrame:
    return _before(spark, path, "actions", ACTIONS).drop("batch", "day")


# hourly spend ---------------------------------------------------------------------------------

QUOTA_KEYS = ["day", "hour_of_day", "name", "persona"]
QUOTA = "hour_of_day int, name string, persona string, work bigint, cloud decimal(38,9), day date"


def keep_quota(path: str) -> Callable[[DataFrame, int], None]:
    """Exact sums of work per hour, name and persona, from a stream of finished queries.

    The hours of a batch are added up, merged into the days they belong to, and those days are
    overwritten in place. A query that ends in an hour long past raises that hour.
    """

    def on_batch(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession

        def added(rows: DataFrame) -> DataFrame:
            sums = (F.sum("work").alias("work"), F.sum("cloud").cast("decimal(38,9)").alias("cloud"))
            return rows.groupBy(*QUOTA_KEYS).agg(*sums)

        def content() -> DataFrame:
            rows = persona_rows(df).select(
                _day("end_time").alias("day"), F.hour("end_time").alias("hour_of_day"), "name", "persona",
                F.col("_work").alias("work"), F.col("_cloud").alias("cloud"),
            )
            fresh = added(rows).persist()
            held = _before(spark, path, "quota", QUOTA).join(fresh.select("day").distinct(), "day", "left_semi")
            same = [held[k].eqNullSafe(fresh[k]) for k in QUOTA_KEYS]
            updates = added(fresh.unionByName(held.join(fresh, same, "left_semi")))
            return upsert(held, updates, QUOTA_KEYS, null_safe=True)

        _replace_days(content, spark, path, "quota", batch)

    return on_batch


def quota_kept(spark: SparkSession, path: str) -> DataFrame:
    """Credits per hour, name and persona."""
    credits = F.col("work").cast("double") / F.lit(3_600_000.0) + F.col("cloud").cast("double")
    return _before(spark, path, "quota", QUOTA).select(*QUOTA_KEYS, credits.alias("credits_used"))
