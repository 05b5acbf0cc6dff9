"""Table maintenance on plain parquet: insert by name, upserts, dedupe, schema changes.

Merges are written as joins that give the new content of the table; ``overwrite_days``
rewrites only the day partitions that changed.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from meterlight.functions.timeops import boundaries, literal_ts


def insert_by_name(target: StructType, df: DataFrame, where: str | None = None) -> DataFrame:
    """Rows of ``df`` that satisfy ``where``, in the columns and types of the target.

    Columns are matched by name without case; ones the source lacks are NULL.
    """
    rows = df.filter(where) if where else df
    have = {c.lower(): c for c in df.columns}
    return rows.select(
        *[
            (F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in target.fields
        ]
    )


def append(df: DataFrame, path: str, target: StructType, where: str | None = None) -> None:
    insert_by_name(target, df, where).write.mode("append").parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Truncate and reload. ``df`` must not read from ``path``."""
    df.write.option("partitionOverwriteMode", "static").mode("overwrite").parquet(path)


def write_layout(df: DataFrame, path: str, columns: list[str], sort: list[str], mode: str = "append") -> None:
    """Partitioned write, so that readers prune by record type and day.

    Rows are rebalanced by the layout columns: each directory gets few, even files, and a
    huge day is split over several tasks instead of going through one.
    """
    rows = df.hint("rebalance", *columns).sortWithinPartitions(*columns, *sort)
    rows.write.partitionBy(*columns).mode(mode).parquet(path)


def overwrite_days(df: DataFrame, path: str, columns: list[str]) -> None:
    """Rewrites only the partitions that occur in ``df``."""
    df.hint("rebalance", *columns).write.option("partitionOverwriteMode", "dynamic").partitionBy(
        *columns
    ).mode("overwrite").parquet(path)


def batch_read(
    spark: SparkSession, path: str, where: str | None = None, order: list[str] | None = None, limit: int | None = None
) -> DataFrame:
    """Rows of a written table in an order; the filter reaches the folders and files.

    With ``limit`` each task keeps that many rows before they meet; without one the order is
    made by ranges over all tasks.
    """
    rows = spark.read.parquet(path)
    rows = rows.filter(where) if where else rows
    rows = rows.orderBy(*order) if order else rows
    return rows.limit(limit) if limit is not None else rows


def column_lists(columns: DataFrame) -> DataFrame:
    """Per table_name the columns as ``name:type``, in the order of their positions, in one text."""
    text = F.expr("listagg(column || ':' || type, ', ') WITHIN GROUP (ORDER BY position)")
    return columns.groupBy("table_name").agg(text.alias("columns"))


def rule_lists(labels: DataFrame) -> DataFrame:
    """Per group the names of its rules in the order they apply: by rank, then by id."""
    grouped = labels.filter("group_name IS NOT NULL AND name IS NOT NULL")
    names = F.expr("listagg(name, ', ') WITHIN GROUP (ORDER BY coalesce(group_rank, 0), label_id)")
    return grouped.groupBy("group_name").agg(F.count(F.lit(1)).alias("rules"), names.alias("names"))


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], null_safe: bool = False) -> DataFrame:
    """Target after a merge: rows of ``updates`` replace those with equal keys or are added.

    A NULL key equals nothing, so such rows are kept on both sides, as in MERGE; with
    ``null_safe`` it equals another NULL.
    """
    new = updates.select(*keys).distinct()
    if null_safe:
        new = new.select(*[F.col(k).alias(f"_new_{k}") for k in keys])
        kept = target.join(new, [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys], "left_anti")
    else:
        kept = target.join(new, keys, "left_anti")
    return kept.select(*target.columns).unionByName(updates.select(*target.columns))


def upsert_two_key(
    target: DataFrame, updates: DataFrame, key: str, other_key: str, keep: list[str], id_col: str
) -> DataFrame:
    """Merge on ``key`` where an update has one, else on ``other_key``.

    Matched rows keep the target's ``keep`` columns; new rows get a fresh id.
    """

    def merge(rows: DataFrame, new: DataFrame, on: str) -> DataFrame:
        old = rows.filter(F.col(on).isNotNull()).select(on, *[F.col(c).alias(f"_{c}") for c in keep])
        filled = new.join(old, on, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in keep})
        filled = filled.withColumn(id_col, F.coalesce(id_col, F.uuid()))
        return upsert(rows, filled.select(*target.columns), [on])

    blank = updates if id_col in updates.columns else updates.withColumn(id_col, F.lit(None).cast("string"))
    named = blank.filter(F.col(key).isNotNull())
    unnamed = blank.filter(F.col(key).isNull())
    return merge(merge(target, named, key), unnamed, other_key)


def dedupe(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row by ``order`` per key, NULL keys grouped. A map-side aggregate, no sort."""
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.min_by(row, order).alias("_row")).select("_row.*")


def remove_duplicate_labels(labels: DataFrame) -> DataFrame:
    """One row per name without a group, and per name and group with one."""
    return dedupe(labels, ["name", "group_name"], "label_id")


def changed(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows found on one side only, with the side: the MINUS both ways."""
    a, b = old.select(*columns), new.select(*columns)
    return (
        a.subtract(b).withColumn("side", F.lit("old")).unionByName(
            b.subtract(a).withColumn("side", F.lit("new"))
        )
    )


def merge_missing(existing: DataFrame, predefined: DataFrame) -> DataFrame:
    """Predefined rules not there yet: by name, or by group for rules without a name."""
    named = predefined.filter("name IS NOT NULL").join(
        existing.filter("name IS NOT NULL").select("name").distinct(), "name", "left_anti"
    )
    groups = predefined.filter("name IS NULL").join(
        existing.filter("group_name IS NOT NULL").select("group_name").distinct(), "group_name", "left_anti"
    )
    return named.select(*predefined.columns).unionByName(groups.select(*predefined.columns))


def initialize_rules(existing: DataFrame, predefined: DataFrame, inited: bool) -> DataFrame | None:
    """Predefined labels to insert into an empty table, or None if it was ever filled."""
    if inited or not existing.isEmpty():
        return None
    return predefined.withColumns(
        {"label_modified_at": F.col("label_created_at"), "label_id": F.uuid()}
    )


def upgrade_rules(
    existing: DataFrame, predefined: DataFrame, as_of: datetime | str, gap_seconds: int
) -> DataFrame | None:
    """The label table after an upgrade of the predefined labels, or None if users changed any.

    Unchanged means that names and times of the predefined labels older than the gap are
    exactly those of the table. Ids and creation times of labels that stay are kept.
    """
    age = boundaries("second", "label_created_at", literal_ts(as_of))
    old = predefined.filter(age > gap_seconds).select(
        "name", "group_name", F.col("label_created_at").alias("at")
    )
    mine = existing.select("name", "group_name", F.col("label_modified_at").alias("at"))
    if not changed(old, mine, ["name", "group_name", "at"]).isEmpty():
        return None
    updates = predefined.withColumns(
        {"label_modified_at": F.col("label_created_at"), "label_id": F.lit(None).cast("string")}
    )
    keep = ["label_id", "label_created_at"]
    return upsert_two_key(existing, updates, "name", "group_name", keep, "label_id")


def _positions(schema: StructType) -> dict[tuple[str, str, int], StructField]:
    return {
        (f.name.lower(), f.dataType.simpleString(), i): f for i, f in enumerate(schema.fields, start=1)
    }


def schema_changes(view: StructType, table: StructType) -> tuple[list[str], list[str]]:
    """Columns to drop from the table, then columns to add, in the order of the view.

    A column counts as equal only with the same name, type and position, first among all
    columns and then among those left after the drop.
    """
    want, have = _positions(view), _positions(table)
    drop = [f.name for key, f in have.items() if key not in want]
    left = _positions(StructType([f for f in table.fields if f.name not in drop]))
    add = [f.name for key, f in want.items() if key not in left]
    return drop, add


def schema_diff(spark: SparkSession, view: StructType, table: StructType) -> DataFrame:
    """``schema_changes`` as rows: action, column, type, position in the view."""
    drop, add = schema_changes(view, table)
    types = {f.name: f.dataType.simpleString() for f in table.fields}
    rows = [("drop", name, types[name], None) for name in drop]
    for i, f in enumerate(view.fields, start=1):
        if f.name in add:
            rows.append(("add", f.name, f.dataType.simpleString(), i))
    return spark.createDataFrame(rows, "action string, column string, type string, position int")


def migrate(table: DataFrame, view: StructType) -> DataFrame:
    """Table rows in the schema of the view.

    Columns of equal name and type keep their values wherever they stood; columns that are
    new or changed type start empty.
    """
    have = {f.name.lower(): f.dataType for f in table.schema.fields}
    return table.select(
        *[
            (F.col(f.name) if have.get(f.name.lower()) == f.dataType else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in view.fields
        ]
    )
