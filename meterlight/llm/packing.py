"""Packing of tokenised documents into fixed windows, best fit decreasing."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlight.llm.common import arrow_map, documents, pairs

WINDOW = 2048
END_ID = 1
#: Pieces that are packed together, about; more pieces make more such groups.
GROUP_PIECES = 16_384

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = PIECES + ", sequence_id long, offset long"


class ByteTokenizer:
    """Ids of a byte-level BPE vocabulary in the tokenizers JSON format.

    Merging is done by tiktoken with the ranks read from the same file. Special tokens inside a
    text get their ids, as the tokenizers library does.
    """

    #: Fixed value: the word pattern of this family of vocabularies.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str) -> None:
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        # The byte alphabet: printable bytes stand for themselves, the rest follow from 256 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        others = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        self.special = {t["content"]: t["id"] for t in given["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in given["model"]["vocab"].items() if t not in self.special}
        self.own = tiktoken.Encoding("vocabulary", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def __call__(self, text: str) -> np.ndarray:
        text = text if text.isascii() else text.encode("utf-8", "replace").decode()
        return self.own.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


def _tokenizer(path: str) -> ByteTokenizer:
    """One for each Python worker."""
    kept = _tokenizer.__dict__
    if path not in kept:
        kept[path] = ByteTokenizer(path)
    return kept[path]


def _ids(tokens: ByteTokenizer, batch: pa.RecordBatch, end_id: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids with the end id) of a batch's rows."""
    for doc_id, text in pairs(batch):
        yield doc_id, np.append(tokens(text), np.uint32(end_id)).astype("<u4", copy=False)


def pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Every document cut into full windows and one shorter rest; narrow rows without the ids."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        tokens = _tokenizer(vocabulary)
        for batch in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in PIECES.split(", ")}
            for doc_id, ids in _ids(tokens, batch, end_id):
                for at in range(0, len(ids), window):
                    piece = ids[at : at + window]
                    for name, v in zip(out, (doc_id, at, len(piece), crc32(piece.tobytes()), len(ids))):
                        out[name].append(v)
            yield out

    return arrow_map(documents(docs), each, PIECES)


class OpenWindows:
    """Open windows by remaining capacity: a segment tree finds the tightest one that fits."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _change(self, capacity: int, by: int) -> None:
        at = self.leaves + capacity
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        self._change(capacity, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """The (capacity, sequence) with the least capacity of at least ``length``."""
        at, count = self.leaves + length, self.count
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        self._change(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(sequence, offset) for lengths in falling order."""
    windows, used, out = OpenWindows(window), 0, []
    for n in lengths:
        capacity, sequence = windows.take(n) or (window, used)
        used += sequence == used
        out.append((sequence, window - capacity))
        if capacity > n:
            windows.put(capacity - n, sequence)
    return out


def packed(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows are packed once each, a null
    doc_id stays null, other columns are not read, an empty table gives an empty one. Equal
    lengths are ordered by doc_id, start and content.

    Only narrow rows move. They are dealt evenly into groups of about ``group_pieces``, whatever
    their ids, and each group is packed by one task; a group leaves a few windows unfilled.
    """
    cut = pieces(docs, vocabulary, window, end_id)
    rows = docs.select("doc_id").count()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        got = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if got is None or not got.num_rows:
            return
        by = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
        got = got.sort_by(by).combine_chunks()
        first = TaskContext.get().partitionId() << 40
        placed = best_fit(got["length"].to_pylist(), window)
        yield {f: got[f].combine_chunks() for f in got.column_names} | {
            "sequence_id": [first + s for s, _ in placed],
            "offset": [o for _, o in placed],
        }

    return arrow_map(cut.repartition(max(1, -(-rows // group_pieces))), each, PLACED)


def sequences(docs: DataFrame, placed: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, pad_id: int = 0) -> DataFrame:
    """The packed ids: (sequence_id, length, ids), padded to the window unless the length is a power of two."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        tokens = _tokenizer(vocabulary)
        for batch in batches:
            out = {"doc_id": [], "start": [], "ids_crc32": [], "ids": []}
            for doc_id, ids in _ids(tokens, batch, end_id):
                for at in range(0, len(ids), window):
                    piece = ids[at : at + window]
                    for name, v in zip(out, (doc_id, at, crc32(piece.tobytes()), piece.astype("i4").tolist())):
                        out[name].append(v)
            yield out

    ids = arrow_map(documents(docs), cut, "doc_id long, start long, ids_crc32 long, ids array<int>").dropDuplicates(["doc_id", "start", "ids_crc32"]).alias("i")
    at = placed.alias("p")
    same = F.col("p.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("p.start") == F.col("i.start")) & (F.col("p.ids_crc32") == F.col("i.ids_crc32"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("p.offset", "i.ids"))), lambda x: x["ids"]))
    joined = at.join(ids, same).groupBy("p.sequence_id").agg(whole.alias("ids")).withColumn("length", F.size("ids"))
    short = (F.col("length") < window) & (F.col("length").bitwiseAND(F.col("length") - 1) != 0)
    padded = F.when(short, F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(window) - F.col("length")))).otherwise(F.col("ids"))
    return joined.select("sequence_id", "length", padded.alias("ids"))
