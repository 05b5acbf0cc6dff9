"""Ordered operations per key that do not put a whole key into one task.

A window over a busy warehouse would sort all of its rows in a single task. Here a key is
split into time chunks: neighbours inside a chunk come from a window over (key, chunk), and
only the edge row of each chunk, one per chunk, goes through a second window over the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbour(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: list[str],
    step: int,
    keep: Column | None = None,
    chunk: str = "_chunk",
    name: str = "_near",
) -> DataFrame:
    """Adds struct ``name`` with ``values`` of the next (``step=1``) or previous (``-1``) row.

    Rows are ordered by ``order`` within ``keys``; ``chunk`` must be a prefix of that order.
    The struct is NULL where there is no neighbour. With ``keep`` only rows that satisfy it
    come out, and the others move no further than they must.

    The edge row of a chunk carries the payload at the chunk's far end. In the second window
    edge rows share one lane per key, where the neighbouring edge holds what is missing; all
    other rows stay in the lane of their chunk.
    """
    ahead = step > 0
    inside = Window.partitionBy(*keys, chunk).orderBy(*order)
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    payload = F.struct(F.lit(True).alias("_here"), *values)
    shift, pick = (F.lead, F.first) if ahead else (F.lag, F.last)
    tagged = df.withColumns(
        {name: shift(payload, 1).over(inside), "_edge": pick(payload).over(whole)}
    )
    is_edge = F.col(name).isNull()
    if keep is not None:
        tagged = tagged.filter(is_edge | keep)
    laned = tagged.withColumns(
        {
            "_lane": F.when(~is_edge, F.col(chunk)),
            "_edge": F.when(is_edge, F.col("_edge")),
        }
    )
    across = Window.partitionBy(*keys, "_lane").orderBy(chunk)
    out = laned.withColumn(name, F.coalesce(name, shift("_edge", 1).over(across))).drop("_edge", "_lane")
    return out if keep is None else out.filter(keep)


def run_bounds(
    df: DataFrame, key: str, order: list[str], us: str, opens: Column, closes: Column, chunk: str = "_chunk"
) -> DataFrame:
    """Adds ``_run``, the instant at which the row's run began, and ``_over``.

    A run begins at a row that ``opens``, at the row after one that ``closes``, and at the
    first row of the key. It is over once it was closed or a later run began; only the last
    run of a key can still go on.

    Rows are dealt by (key, chunk) once. Each chunk is reduced to one row (its first instant, how it
    begins and ends, its last run start). Scans over those rows, one per chunk and key, tell
    every chunk which run it continues and which run is the last; the join back is on the
    partitioning the rows already have. Rows travel as one struct that both the rows and their
    summaries need whole, so that both read the same exchange and the source is scanned once.
    """
    inside = Window.partitionBy(key, chunk).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flagged = df.withColumns({"_opens": opens, "_closes": closes})
    payload = [c for c in flagged.columns if c not in (key, chunk)]
    dealt = flagged.select(key, chunk, F.struct(*payload).alias("_row")).repartition(key, chunk)
    marked = dealt.select(key, chunk, "_row", "_row.*")
    begins = F.col("_opens") | F.coalesce(F.lag("_closes").over(inside), F.lit(False))
    marked = marked.withColumn("_begin", F.when(begins, F.col(us)))
    marked = marked.withColumn("_local", F.last("_begin", ignorenulls=True).over(so_far))
    rank = F.struct(*order)
    ends = marked.groupBy(key, chunk).agg(
        F.min_by("_row", rank).alias("_head_row"), F.max_by("_row", rank).alias("_tail_row"), F.max("_begin").alias("_last_begin")
    )
    per_chunk = ends.select(
        key,
        chunk,
        F.col(f"_head_row.{us}").alias("_first"),
        F.col("_head_row._opens").alias("_head_opens"),
        F.col("_tail_row._closes").alias("_tail_closes"),
        "_last_begin",
    )
    scan = Window.partitionBy(key).orderBy(chunk)
    whole = scan.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = scan.rowsBetween(Window.unboundedPreceding, -1)
    head_starts = F.col("_head_opens") | F.coalesce(F.lag("_tail_closes").over(scan), F.lit(True))
    carried = (
        per_chunk.withColumn("_head", F.when(head_starts, F.col("_first")))
        .withColumn("_out", F.coalesce("_last_begin", "_head"))
        .select(
            key,
            chunk,
            F.coalesce("_head", F.last("_out", ignorenulls=True).over(before)).alias("_from"),
            F.max("_out").over(whole).alias("_newest"),
            F.last("_tail_closes").over(whole).alias("_ended"),
        )
    )
    return (
        marked.join(carried, [key, chunk], "left")
        .withColumn("_run", F.coalesce("_local", "_from"))
        .withColumn("_over", F.col("_ended") | (F.col("_run") < F.col("_newest")))
        .drop("_row", "_opens", "_closes", "_begin", "_local", "_from", "_newest", "_ended")
    )
