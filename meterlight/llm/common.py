"""What several operators share: reading, written tables, Arrow batches, exact bounds."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlight.session import workspace

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once to the folder the executors share.

    It cuts the lineage: ids given to rows stay the same however often the table is read,
    and a lost executor loses nothing.
    """
    path = workspace(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few numbers that one task writes, about, and the fewest tasks that write a table.
NARROW_ROWS, NARROW_TASKS = 500_000, 8


def held_narrow(df: DataFrame, name: str, rows: int) -> DataFrame:
    """Like :func:`held` for at most ``rows`` rows of a few numbers: as many files as they fill."""
    return held(df.coalesce(max(NARROW_TASKS, -(-rows // NARROW_ROWS))), name)


def documents(docs: DataFrame) -> DataFrame:
    """Only (doc_id, text): other columns, whatever their names, never reach an operator."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def pairs(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(doc_id, text) of a batch; a null text counts as empty."""
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
        yield doc_id, text or ""


#: Bytes of text in a batch that are turned into Python objects together, about.
SLICE_BYTES = 12 << 20


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, large ones in parts of about ``size`` bytes, without a copy; a row stays whole.

    Rows count with their text, if there is one, else alike.
    """
    for b in batches:
        if b.nbytes <= size:
            yield b
            continue
        if "text" in b.schema.names:
            weight = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        else:
            weight = np.full(b.num_rows, b.nbytes // b.num_rows)
        ends = np.cumsum(weight)
        first = 0
        while first < b.num_rows:
            end = max(int(np.searchsorted(ends, (ends[first - 1] if first else 0) + size, "right")), first + 1)
            yield b.slice(first, end - first)
            first = end


def freed() -> None:
    """Gives back what a task has used: the worker lives on, beside those of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def filtered(docs: DataFrame, keep: Callable[[], Callable[[list[str]], Iterable[bool]]]) -> DataFrame:
    """The rows of ``docs`` whose texts are kept, all columns as given; ``keep`` makes the function of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = keep()
        for b in slices(batches):
            yield b.filter(pa.array(of([t or "" for t in b.column("text").to_pylist()]), pa.bool_()))
        del of
        freed()

    return docs.mapInArrow(run, docs.schema)


def arrow_map(df: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` for a function that yields columns as a dict of lists; batches come in :func:`slices`."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in each(slices(batches)):
            yield pa.RecordBatch.from_arrays(
                [x.cast(f.type) if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in arrow], schema=arrow
            )
        freed()

    return df.mapInArrow(run, schema)


def remainder(column: str, of: int):
    """crc32 of the id written as text, modulo ``of``; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % of


#: Bins in a unit of the values that :func:`exceeded` looks at first.
BINS = 1 << 12


def exceeded(df: DataFrame, keys: list[str], share: float) -> DataFrame:
    """(keys, value): of each group of ``df`` (keys, value, n) the least value such that the rows above
    it have at most ``share`` of the group's total ``n``. Exact, over all rows.

    Equal values are added up and bins of values counted first, so that a task sorts the bins of
    a group and then the different values of one bin, not the group.
    """
    alike = df.groupBy(*keys, "value").agg(F.sum("n").alias("n"))
    alike = held(alike.withColumn("bin", F.floor(F.col("value") * BINS)), "values")
    bins = alike.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    down = Window.partitionBy(*keys).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*keys, "bin", "n", F.coalesce(F.sum("n").over(down), F.lit(0)).alias("before"), (F.sum("n").over(Window.partitionBy(*keys)) * share).alias("least"))
    crossed = (F.col("before") <= F.col("least")) & (F.col("before") + F.col("n") > F.col("least"))
    # One bin a group.
    inside = alike.join(F.broadcast(bins.where(crossed).select(*keys, "bin", F.col("before").alias("base"), "least")), [*keys, "bin"])
    down = Window.partitionBy(*keys).orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    return inside.withColumn("before", F.col("base") + F.coalesce(F.sum("n").over(down), F.lit(0))).where(crossed).select(*keys, "value")


class Memo:
    """Values of strings that come again and again, worked out once and kept in bounds.

    Two generations: when the young one holds ``size`` entries it becomes the old one, and what
    is still asked for moves back. ``make`` gets many new strings at a time.
    """

    def __init__(self, make: Callable[[list[str]], Iterable], size: int) -> None:
        self.make, self.size, self.young, self.old = make, size, {}, {}

    def __call__(self, keys: list[str]) -> list:
        young = self.young
        out = list(map(young.get, keys))
        if None in out:
            missing = dict.fromkeys([k for k, v in zip(keys, out) if v is None])
            kept = {k: v for k, v in zip(missing, map(self.old.get, missing)) if v is not None}
            new = [k for k in missing if k not in kept]
            kept.update(zip(new, self.make(new)))
            young.update(kept)
            out = [kept[k] if v is None else v for k, v in zip(keys, out)]
        if len(young) > self.size:
            self.old, self.young = young, {}
        return out


# White space beyond ASCII.
_RARE_BLANK = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def blanks(text: str) -> str:
    """The text with white space beyond ASCII as blanks; the controls 1C to 1F are not white space."""
    return text if text.isascii() else _RARE_BLANK.sub(" ", text)


#: Bytes of text that are cut into chunks together, about.
CUT_BYTES = 12 << 20


def portions(texts: list[str], size: int = CUT_BYTES) -> Iterator[tuple[int, int]]:
    """(first, end) of neighbouring texts that are cut together."""
    first = held_bytes = 0
    for i, t in enumerate(texts):
        held_bytes += len(t)
        if held_bytes >= size:
            yield first, i + 1
            first, held_bytes = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def cut(texts: list[str], separator: str | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(different chunks, index of each chunk in order, first chunk of each text and the end).

    Chunks lie between runs of ASCII white space, or between single separators. Empty chunks at
    the ends of a text are kept.
    """
    given = pa.array(texts, pa.large_string())
    parts = pc.ascii_split_whitespace(given) if separator is None else pc.split_pattern(given, separator)
    coded = pc.list_flatten(parts).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(parts.offsets).astype(np.int64)
