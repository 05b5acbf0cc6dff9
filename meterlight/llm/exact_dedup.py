"""Exact deduplication by Grace hashing: partition, spill, compare complete content."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from meterlight.llm.common import arrow_map, freed, held, slices

#: Bytes of a task's rows that are combined before they are sent.
COMBINE_BYTES = 16 << 20
#: Bytes of distinct content that the table of one bucket holds.
TABLE_BYTES = 24 << 20
#: Spill files a bucket is divided into, by the next bits of the hash.
FANOUT_BITS = 4


#: Columns of the combined rows, before the one that holds the text.
COMBINED = StructType([StructField(c, StringType() if c == "sha" else LongType()) for c in ("doc_id", "rid", "lead", "sha", "h", "n")])


class ContentTable:
    """Open addressing with linear probing over (hash, content); equal hashes compare contents."""

    def __init__(self) -> None:
        self.slots, self.hashes, self.contents, self.bytes = [-1] * 1024, [], [], 0

    def find(self, h: int, content: bytes) -> int:
        """The index of the content, or minus one minus the free slot."""
        mask = len(self.slots) - 1
        at = h & mask
        while (i := self.slots[at]) >= 0:
            if self.hashes[i] == h and self.contents[i] == content:
                return i
            at = (at + 1) & mask
        return -1 - at

    def add(self, slot: int, h: int, content: bytes) -> int:
        self.slots[slot] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content)
        if 2 * len(self.hashes) > len(self.slots):
            self.slots = [-1] * (4 * len(self.slots))
            mask = len(self.slots) - 1
            for i, h in enumerate(self.hashes):
                at = h & mask
                while self.slots[at] >= 0:
                    at = (at + 1) & mask
                self.slots[at] = i
        return len(self.hashes) - 1


def grace(records: Iterable[tuple], budget: int = TABLE_BYTES, level: int = 0) -> Iterator[list[tuple]]:
    """Groups of records (hash, content, ...) with equal content.

    Records go to a table until it holds ``budget`` bytes of distinct content. From then on
    only copies of what it holds are taken up; all others are divided into spill files by the
    next bits of the hash, and each file is treated the same way. The files have no names and
    belong to this task alone; a task that is run again makes its own.
    """
    found, members, files = ContentTable(), [], []
    for h, content, *rest in records:
        at = found.find(h, content)
        if at < 0 and (found.bytes < budget or (level + 1) * FANOUT_BITS > 64):
            at = found.add(-1 - at, h, content)
            members.append([])
        if at >= 0:
            members[at].append(tuple(rest))
            continue
        files = files or [tempfile.TemporaryFile() for _ in range(1 << FANOUT_BITS)]
        # The low bits choose the slot, so the high ones choose the file.
        bucket = (h >> (64 - (level + 1) * FANOUT_BITS)) & ((1 << FANOUT_BITS) - 1)
        pickle.dump((h, content, *rest), files[bucket])
    yield from members
    del found, members
    for f in files:
        f.seek(0)
        yield from grace(_spilled(f), budget, level + 1)
        f.close()


def _spilled(f) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def _best(rows: Iterable[tuple]) -> tuple:
    """Of (doc_id, row id, ...) the one that stays: the largest doc_id, of equal ones the first row."""
    return max(rows, key=lambda r: (r[0] is not None, r[0] or 0, -r[1]))


def _combined(docs: DataFrame, carry: bool, combine_bytes: int) -> DataFrame:
    """A row per document; of equal documents near each other one carries the text for all.

    That bounds what a group sends: of a third of all rows, one text for each ``combine_bytes`` of them. The text
    travels once: with ``carry`` inside the row, else by itself.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if carry:
        given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    carried = given.columns[-1]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seen = TaskContext.get().partitionId() << 33, 0
        waiting, size = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seen
            whole = pa.Table.from_batches(waiting).combine_chunks()
            texts = whole["text"] if carried == "text" else pc.struct_field(whole["row"], "text").cast(pa.string())
            found, groups, group_of, hashes = ContentTable(), [], [], []
            digests = []
            for i, (doc_id, text) in enumerate(zip(whole["doc_id"].to_pylist(), texts)):
                content = (text.as_py() or "").encode()
                digest = sha256(content)
                h = int.from_bytes(digest.digest()[:8], "big")
                at = found.find(h, content)
                if at < 0:
                    at = found.add(-1 - at, h, content)
                    groups.append([])
                    hashes.append(h - (1 << 64) if h >> 63 else h)
                groups[at].append((doc_id, first + seen + i))
                group_of.append(at)
                digests.append(digest.hexdigest())
            best = [_best(g)[1] for g in groups]
            rows = range(first + seen, first + seen + len(group_of))
            leads = pa.array([i if best[g] == r else None for i, (g, r) in enumerate(zip(group_of, rows))], pa.int64())
            out = [
                whole["doc_id"].combine_chunks(),
                pa.array(rows, pa.int64()),
                pa.array([best[g] for g in group_of], pa.int64()),
                pa.array(digests, pa.string()),
                pa.array([hashes[g] for g in group_of], pa.int64()),
                pa.array([len(groups[g]) if best[g] == r else None for g, r in zip(group_of, rows)], pa.int64()),
            ]
            sent = whole[carried].take(leads)
            seen += len(group_of)
            return pa.RecordBatch.from_arrays([*out, sent.combine_chunks() if isinstance(sent, pa.ChunkedArray) else sent], [*COMBINED.names, carried])

        for batch in slices(batches, combine_bytes):
            waiting.append(batch)
            size += batch.nbytes
            if size >= combine_bytes:
                yield flush()
                waiting, size = [], 0
        if waiting and sum(b.num_rows for b in waiting):
            yield flush()
        waiting = []
        freed()

    return given.mapInArrow(each, StructType([*COMBINED.fields, StructField(carried, given.schema[carried].dataType)]))


def _groups(combined: DataFrame, table_bytes: int) -> DataFrame:
    """(rid, keep_rid, keep_id, group_size) for every row that carries a text."""
    text = F.col("text" if "text" in combined.columns else "row.text").cast("string")
    leads = combined.where(F.col("n").isNotNull()).select("h", F.coalesce(text, F.lit("")).alias("text"), "doc_id", "rid", "n").repartition("h")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for h, text, *rest in zip(*(b.column(i).to_pylist() for i in range(5))):
                yield h & ((1 << 64) - 1), text.encode(), *rest

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        out = {"rid": [], "keep_rid": [], "keep_id": [], "group_size": []}
        for group in grace(records(batches), table_bytes):
            keep_id, keep_rid, _ = _best(group)
            size = sum(n for _, _, n in group)
            for _, rid, _ in group:
                for name, v in zip(out, (rid, keep_rid, keep_id, size)):
                    out[name].append(v)
            if len(out["rid"]) >= 20_000:
                yield out
                out = {k: [] for k in out}
        yield out

    return arrow_map(leads, each, "rid long, keep_rid long, keep_id long, group_size long")


def groups(docs: DataFrame, combine_bytes: int = COMBINE_BYTES, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as empty. Of equal texts the row with
    the largest doc_id stays; a null doc_id is the smallest, and of rows with the same doc_id
    the first one read stays, so exactly one row of a group is kept. Rows repeat as given. An
    empty table gives an empty one. Other columns are not read.

    Two shuffles: one text for each distinct content of a task, by content hash, and the row
    ids (no text) back to the documents.
    """
    combined = held(_combined(docs, False, combine_bytes), "exact-dedup")
    found = _groups(combined, table_bytes).withColumnRenamed("rid", "lead")
    return (
        combined.select("doc_id", "rid", "lead", "sha")
        .join(found, "lead")
        .select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.col("sha").alias("text_sha256"))
    )


def deduplicated(docs: DataFrame, combine_bytes: int = COMBINE_BYTES, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of ``docs`` that :func:`groups` keeps, with all their columns as given."""
    combined = held(_combined(docs, True, combine_bytes), "exact-dedup")
    kept = _groups(combined, table_bytes).where(F.col("rid") == F.col("keep_rid")).select("rid")
    return combined.where(F.col("n").isNotNull()).join(kept, "rid", "left_semi").select([F.col("row")[c].alias(c) for c in docs.columns])
