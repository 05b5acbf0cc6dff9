"""Labels: user-written predicates that classify queries, compiled into one projection."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


OTHER = "Other"


@dataclass(frozen=True)
class Label:
    """A rule. ``condition`` is Spark SQL over the enriched history."""

    condition: str
    name: str | None = None
    group: str | None = None
    rank: int | None = None
    dynamic: bool = False
    enabled: bool | None = True


# The labels every installation starts with. Usage counts per parameterized
# hash come from ``with_hash_uses``.
PREDEFINED_LABELS = (
    Label("rows_produced > 50000000", "Large Results"),
    Label("query_type IN ('CREATE_TABLE_AS_SELECT', 'INSERT')", "Writes"),
    Label("10 * bytes_scanned < bytes_written_to_result", "Expanding Output"),
    Label("coalesce(partitions_scanned, 0) > coalesce(partitions_total, 1) * 0.95", "Full Scans"),
    Label("compilation_time > 100", "Long Compilation"),
    Label("total_elapsed_time > 600000", "Long Queries"),
    Label("cost > 0.5", "Expensive Queries"),
    Label("query_acceleration_bytes_scanned > 0", "Accelerated Queries"),
    Label("hash_uses > 1000", "Reoccurring Queries"),
    Label("hash_uses < 10", "ad-hoc Queries"),
    Label("map_contains_key(qtag_filter, 'dbt')", "dbt Queries"),
    Label(
        "try_element_at(try_element_at(qtag_filter, 'dbt'), 'node_id')", group="dbt Models", dynamic=True
    ),
    Label("try_element_at(array_sort(map_keys(qtag_filter)), 1)", group="qtag Sources", dynamic=True),
)


def load_labels(table: DataFrame) -> list[Label]:
    """The rules of a label table: configuration, read whole, as they become part of the plan."""
    rows = table.select("condition", "name", "group_name", "group_rank", "is_dynamic", "enabled")
    return [Label(r[0], r[1], r[2], r[3], bool(r[4]), r[5]) for r in rows.collect()]


def label_columns(labels: Iterable[Label]) -> list[Column]:
    """One column per ungrouped label, per group and per dynamic group.

    Ungrouped: true where the condition holds, false otherwise, NULL included. Grouped: name
    of the first label by rank whose condition holds, else 'Other', for every group. Dynamic:
    value of the expression as text, else 'Other'. Disabled labels are left out.
    """
    active = [x for x in labels if x.enabled is not False]
    columns = [
        F.when(F.expr(x.condition), True).otherwise(False).alias(x.name)
        for x in active
        if x.group is None
    ]
    grouped = [x for x in active if x.group is not None and not x.dynamic]
    for group in sorted({x.group for x in grouped}):
        members = [x for x in grouped if x.group == group]
        members.sort(key=lambda x: (x.rank is None, x.rank or 0, x.name or ""))
        chain = None
        for x in members:
            cond, value = F.expr(x.condition), F.lit(x.name)
            chain = F.when(cond, value) if chain is None else chain.when(cond, value)
        columns.append(chain.otherwise(F.lit(OTHER)).alias(group))
    for x in active:
        if x.dynamic:
            value = F.coalesce(F.expr(x.condition).cast("string"), F.lit(OTHER))
            columns.append(value.alias(x.group))
    return columns


def apply_labels(df: DataFrame, labels: Iterable[Label]) -> DataFrame:
    """All labels in a single flat projection."""
    return df.select("*", *label_columns(labels))


def validate_rule(df: DataFrame, condition: str, dynamic: bool = False) -> str | None:
    """Error text of a condition that does not fit the history, or None. Nothing is run."""
    try:
        value = F.expr(condition).cast("string") if dynamic else F.when(F.expr(condition), 1)
        df.select(value).schema
    except (AnalysisException, ParseException) as error:
        return str(error).splitlines()[0]
    return None


def check_rules(df: DataFrame, conditions: Iterable[str]) -> DataFrame:
    """A row per condition: rule, valid, matches. One pass counts the rows that the valid ones match."""
    rules = list(conditions)
    valid = [validate_rule(df, rule) is None for rule in rules]
    counted = df.agg(*[(F.count(F.when(F.expr(r), 1)) if ok else F.lit(None).cast("bigint")).alias(f"_{i}") for i, (r, ok) in enumerate(zip(rules, valid))])
    rows = [F.struct(F.lit(r).alias("rule"), F.lit(ok).alias("valid"), F.col(f"_{i}").alias("matches")) for i, (r, ok) in enumerate(zip(rules, valid))]
    return counted.select(F.explode(F.array(*rows)).alias("row")).select("row.*")


def name_conflicts(labels: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Names that cannot become columns, with the reason.

    Labels must be unique without a group and within their group; a group may not share its
    name with a label or a second dynamic rule, and nothing may be called like a column.
    """
    alone = labels.filter("group_name IS NULL AND name IS NOT NULL")
    grouped = labels.filter("group_name IS NOT NULL")

    def found(rows: DataFrame, problem: str) -> DataFrame:
        return rows.select(F.col("name"), F.lit(problem).alias("problem")).distinct()

    published = alone.select(F.col("name"), F.lit(0).alias("is_group")).unionByName(
        grouped.select(F.col("group_name").alias("name"), F.lit(1).alias("is_group"))
    )
    per_name = published.groupBy("name").agg(
        F.sum(1 - F.col("is_group")).alias("labels"), F.sum("is_group").alias("groups")
    )
    in_group = grouped.filter("name IS NOT NULL").groupBy("group_name", "name").count()
    dynamic = grouped.groupBy(F.col("group_name").alias("name")).agg(
        F.sum(F.when(F.coalesce("is_dynamic", F.lit(False)), 1).otherwise(0)).alias("dynamic"),
        F.count(F.lit(1)).alias("rules"),
    )
    taken = [c.lower() for c in columns]
    return reduce(
        DataFrame.unionByName,
        [
            found(per_name.filter("labels > 1"), "label exists twice"),
            found(per_name.filter("labels > 0 AND groups > 0"), "label named like a group"),
            found(in_group.filter("count > 1"), "label exists twice in its group"),
            found(dynamic.filter("dynamic > 0 AND rules > 1"), "dynamic group has other rules"),
            found(per_name.filter(F.lower("name").isin(taken)), "column exists"),
        ],
    )


def hash_uses(df: DataFrame) -> DataFrame:
    """How often each parameterized hash was run."""
    return (
        df.filter(F.col("query_parameterized_hash").isNotNull())
        .groupBy("query_parameterized_hash")
        .agg(F.count(F.lit(1)).alias("hash_uses"))
    )


def with_hash_uses(df: DataFrame) -> DataFrame:
    """Adds ``hash_uses``, NULL for queries without a hash.

    One hash may hold most rows: the counts are one small row per hash, and adaptive execution
    splits a partition of rows that is too large over several tasks.
    """
    return df.join(hash_uses(df), "query_parameterized_hash", "left").select(*df.columns, "hash_uses")


def recurring(df: DataFrame, n: int, name: str = "is_recurring") -> DataFrame:
    """Adds a boolean: the hash was run more than ``n`` times."""
    flagged = with_hash_uses(df)
    return flagged.withColumn(name, F.coalesce(F.col("hash_uses") > n, F.lit(False))).drop("hash_uses")


def ad_hoc(df: DataFrame, n: int, name: str = "is_ad_hoc") -> DataFrame:
    """Adds a boolean: the hash was run fewer than ``n`` times."""
    flagged = with_hash_uses(df)
    return flagged.withColumn(name, F.coalesce(F.col("hash_uses") < n, F.lit(False))).drop("hash_uses")


def label_filter(
    include_all: Iterable[str] = (), include_any: Iterable[str] = (), exclude_any: Iterable[str] = ()
) -> Column:
    """Rows with all of some labels, any of others and none of the rest."""
    cond = F.lit(True)
    for name in include_all:
        cond = cond & F.col(f"`{name}`")
    any_of, none_of = list(include_any), list(exclude_any)
    if any_of:
        cond = cond & reduce(Column.__or__, [F.col(f"`{x}`") for x in any_of])
    if none_of:
        cond = cond & ~reduce(Column.__or__, [F.col(f"`{x}`") for x in none_of])
    return cond
