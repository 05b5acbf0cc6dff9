"""Benchmark decontamination: prefix-filtered join of benchmark windows with documents, verified word by word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlight.llm.common import arrow_map, documents, held, portions
from meterlight.llm.words import LOWER, STEP, rolled, word_hashes, word_spans

#: Words of a benchmark window; an item of fewer is one window.
WINDOW = 10
#: Words of the shingles that windows and documents are joined by; a window of fewer words is one shingle.
SHINGLE = 3
#: Bits of the filter of shingles that tasks hold: so many for each shingle, between these powers of two.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 16, 27
#: Bytes of words: digits, a to z after lower-casing, and all beyond ASCII.
_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


class Words:
    """The words of some texts together."""

    def __init__(self, texts: list[str]) -> None:
        raw = [t.encode("utf-8", "replace") for t in texts]
        self.data = b"\n".join(raw).translate(LOWER)
        self.starts, self.ends = word_spans(self.data, _WORD)
        self.hashes = word_hashes(self.data, self.starts, self.ends)
        #: First word of each text, and the end.
        self.first = np.searchsorted(self.starts, np.cumsum([0, *(len(r) + 1 for r in raw)]))

    def joined(self, first: int, end: int) -> str:
        return " ".join([self.data[s:e].decode() for s, e in zip(self.starts[first:end].tolist(), self.ends[first:end].tolist())])


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, words): the windows of every item, as lower-cased words with blanks between them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            ids, texts = b.column("item_id").to_pylist(), [t or "" for t in b.column("text").to_pylist()]
            for i, text in zip(ids, texts):
                words = Words([text])
                n = len(words.starts)
                for at in range(0, max(n - WINDOW + 1, min(n, 1)), 10_000):
                    some = range(at, min(at + 10_000, max(n - WINDOW + 1, 1)))
                    yield {"item_id": [i] * len(some), "words": [words.joined(k, min(k + WINDOW, n)) for k in some]}

    given = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(given, each, "item_id string, words string")


def _shingles(windows: DataFrame) -> DataFrame:
    """(window, words, size, offset, token) for each shingle of the windows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            words = Words(b.column("words").to_pylist())
            tokens, sizes = [], []
            for first, end in zip(words.first, words.first[1:]):
                tokens.append(rolled(words.hashes[first:end], min(SHINGLE, end - first)).view(np.int64))
                sizes.append(int(end - first))
            yield {"window": b.column("window"), "words": b.column("words"), "size": sizes, "tokens": tokens}

    found = arrow_map(windows, each, "window long, words string, size int, tokens array<long>")
    return found.select("window", "words", "size", F.posexplode("tokens").alias("offset", "token"))


class Filter:
    """A bitmap of the first bits of some shingles' hashes: it lets all of them pass, and few others.

    It is put together from groups of 64 bits and has at most 2**MOST_BITS of them, however many
    shingles there are.
    """

    def __init__(self, tokens: DataFrame, lengths: list[int]) -> None:
        n = tokens.count()
        self.lengths = lengths
        self.bits = min(max((BITS_EACH * n).bit_length(), LEAST_BITS), MOST_BITS)
        place = f"shiftrightunsigned(token, {64 - self.bits})"
        groups = (
            tokens.selectExpr(f"int(shiftright({place}, 6)) AS group", f"shiftleft(1L, int({place} & 63)) AS bit")
            .groupBy("group")
            .agg(F.bit_or("bit").alias("bits"))
            .toArrow()
        )
        self.bitmap = np.zeros(1 << max(self.bits - 6, 0), np.uint64)
        self.bitmap[groups["group"].to_numpy()] = groups["bits"].to_numpy().view(np.uint64)

    def found(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, length, token) of the texts' shingles that pass; none reaches into the next text."""
        out = []
        for n in self.lengths:
            tokens = rolled(words.hashes, n)
            place = tokens >> np.uint64(64 - self.bits)
            at = np.flatnonzero((self.bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1))
            text = np.searchsorted(words.first, at, "right") - 1
            at = at[at + n <= words.first[text + 1]]
            out.append((at, np.full(len(at), n), tokens[at].view(np.int64)))
        return tuple(np.concatenate(x) if out else np.empty(0, np.int64) for x in (zip(*out) if out else ((), (), ())))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Words]]:
    texts = [t or "" for t in batch.column("text").to_pylist()]
    for first, end in portions(texts, STEP):
        yield first, end, Words(texts[first:end])


def _counts(docs: DataFrame, known: Filter) -> DataFrame:
    """(token, n): how often shingles that pass stand in the documents, summed in the task first."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for _, _, words in _texts(b):
                token, n = np.unique(shared.value.found(words)[2], return_counts=True)
                yield {"token": pa.array(token, pa.int64()), "n": pa.array(n, pa.int64())}

    return arrow_map(docs.select("text"), each, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _places(docs: DataFrame, known: Filter) -> DataFrame:
    """(row, doc_id, n_words, places): a row per document, with the places of shingles that pass.

    A place holds the words around it, as many as a window can cover.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for start, end, words in _texts(b):
                places = [[] for _ in range(start, end)]
                at, length, token = shared.value.found(words)
                text = np.searchsorted(words.first, at, "right") - 1
                for i, p, n, t in zip(text.tolist(), at.tolist(), length.tolist(), token.tolist()):
                    first, last = int(words.first[i]), int(words.first[i + 1])
                    low, high = max(p + n - WINDOW, first), min(p + WINDOW, last)
                    places[i].append({"token": t, "at": p - first, "low": low - first, "around": words.joined(low, high)})
                yield {
                    "row": b.column("row").slice(start, end - start),
                    "doc_id": b.column("doc_id").slice(start, end - start),
                    "n_words": pa.array(np.diff(words.first).astype(np.int64)),
                    "places": places,
                }

    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    return arrow_map(numbered, each, "row long, doc_id long, n_words long, places array<struct<token:long,at:int,low:int,around:string>>")


def hits(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Where benchmark windows stand in the documents: (documents, hits, owners).

    documents: (row, doc_id, n_words), a row for each given one. hits: (row, start, size, window),
    in words. owners: (window, item_id).

    1. The shingles of all different windows are counted in all documents. A window with a
       shingle that no document has stands in none.
    2. A window's shingles are ordered by rarity. All of them must be there, so the necessary
       prefix is the rarest one: only those are looked for in the documents and joined.
    3. The window must lie inside the document (length and position), and its words must be
       equal, one by one, to those around the shingle.

    Tasks hold a bitmap of bounded size; everything else is joined by Spark, so neither windows
    nor places have a limit.
    """
    docs = documents(docs)
    owned = held(benchmark_windows(benchmark).distinct(), "benchmark-windows")
    windows = held(owned.select("words").distinct().withColumn("window", F.monotonically_increasing_id()), "benchmark-texts")
    shingles = held(_shingles(windows), "benchmark-shingles")
    lengths = sorted({min(r["size"], SHINGLE) for r in shingles.select("size").distinct().collect()})  # at most WINDOW sizes
    counts = _counts(docs, Filter(shingles.select("token").distinct(), lengths))
    weighed = shingles.join(counts, "token", "left").groupBy("window").agg(
        F.min(F.coalesce("n", F.lit(0))).alias("least"),
        F.min_by(F.struct("token", "offset", "size", "words"), F.struct(F.coalesce("n", F.lit(0)), "token", "offset")).alias("rarest"),
    )
    prefix = held(weighed.where("least > 0").select("window", "rarest.*"), "benchmark-prefixes")
    found = held(_places(docs, Filter(prefix.select("token").distinct(), lengths)), "benchmark-places")
    place = found.select("row", "n_words", F.explode("places").alias("place")).select("row", "n_words", "place.*")
    start = F.col("at") - F.col("offset")
    inside = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    own = F.slice(F.split("around", " "), F.col("start") - F.col("low") + 1, F.col("size"))
    met = place.join(prefix, "token").where(inside).withColumn("start", start).where(F.array_join(own, " ") == F.col("words"))
    return found.select("row", "doc_id", "n_words"), met.select("row", "start", "size", "window"), owned.join(windows, "words").select("window", "item_id")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, items (the sorted item_ids, as strings).

    n_hit counts the document's words inside any occurrence of a window, items holds the items
    with one. Words are runs of digits, letters a to z (A to Z count as them) and characters
    beyond ASCII; a null or empty text has none, and nothing is hit in it. Repeated rows and
    null ids are judged like any other; items with the same item_id count as one, a null one as the empty
    string. An empty table gives an empty one; without benchmark items nothing is hit. Whole
    texts are read; other columns are not.
    """
    all_docs, found, owners = hits(docs, benchmark)
    found = held(found, "benchmark-hits")
    # A word counts for the first of the windows, by start, that reaches it.
    earlier = Window.partitionBy("row").orderBy("start", "size", "window").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    fresh = F.greatest(end - F.greatest("start", F.coalesce(F.max(end).over(earlier), F.lit(0))), F.lit(0))
    covered = found.select("row", fresh.alias("fresh")).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    items = found.select("row", "window").distinct().join(owners, "window").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return (
        all_docs.join(covered.join(items, "row"), "row", "left")
        .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    )
