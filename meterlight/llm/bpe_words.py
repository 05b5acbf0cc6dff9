"""BPE encoding and decoding through a table of distinct words."""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlight.llm.common import arrow_map, blanks, cut, documents, held, portions
from meterlight.llm.words import word_hashes
from meterlight.session import workspace

#: The most frequent words, which every task holds; all others are joined. With at most
#: HOT_CHARS characters a word this bounds what is broadcast.
HOT_WORDS = 500_000
HOT_CHARS = 40
#: Bytes of text that a task cuts into words together, about.
CUT_BYTES = 4 << 20
#: Different words that a task counts before it sends them.
COUNTED_WORDS = 200_000
#: Entries that a task packs together by portion.
PACKED_ENTRIES = 200_000
#: Buckets of words for each shuffle partition.
BUCKETS_EACH = 4
ASCII_BLANKS = " \t\n\x0b\x0c\r"


class Splitter:
    """Words of a text as the vocabulary's normaliser and pre-tokenizer cut them.

    Normalising is NFC, white space to blanks, lower case; words never hold white space, so a
    text is cut at blanks and each different chunk is looked at once. A special token inside a
    text is a word of its own, marked by a leading blank, which no other word has.
    """

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        self.special = {t["content"]: t["id"] for t in given["added_tokens"]}
        splits = [p["pattern"]["Regex"] for p in given["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.words = regex.compile(splits[0].replace(r"[^\s", r"[^\p{White_Space}")).findall
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def chunk(self, text: str) -> list[str]:
        """The words of a chunk; most are ASCII letters, with or without one mark behind them."""
        if text.isascii():
            if text.isalpha():
                return [text]
            if text[:-1].isalpha() and not text[-1].isalnum():
                return [text[:-1], text[-1]]
        return self.words(text)

    def normal(self, text: str) -> str:
        # Lower case letter by letter: a final sigma has no form of its own.
        return blanks(unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower().strip(ASCII_BLANKS)

    def alone(self, text: str) -> list[str]:
        """The words of a text that may hold special tokens."""
        out = []
        for part in self.parts.split(text):
            out += [" " + part] if part in self.special else self.words(self.normal(part))
        return out

    def __call__(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """(words of each different chunk, chunk at each position, first position of each text and the end)."""
        special = {i: t for i, t in enumerate(texts) if "<|" in t}
        chunks, index, offsets = cut(["" if i in special else self.normal(t) for i, t in enumerate(texts)])
        words = list(map(self.chunk, chunks))
        # A text with something like a special token is one chunk of its own.
        for i, t in special.items():
            index[offsets[i]] = len(words)
            words.append(self.alone(t))
        return words, index, offsets


class WordEncoder:
    """Ids of single words, by the model of the vocabulary file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        self.model = own.model
        self.special = {t.content: i for i, t in own.get_added_tokens_decoder().items()}
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        others = [b for b in range(256) if b not in set(plain)]
        self.letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}

    def __call__(self, word: str) -> list[int]:
        if word[0] == " ":
            return [self.special[word[1:]]]
        return [t.id for t in self.model.tokenize("".join(self.letter[b] for b in word.encode()))]


def _once(make, path: str):
    """One for each Python worker."""
    kept = _once.__dict__
    key = f"{make.__name__}:{path}"
    if key not in kept:
        kept[key] = make(path)
    return kept[key]


def pieces(spark, vocabulary: str) -> DataFrame:
    """(id, piece) of the vocabulary, special tokens included: the table that decoding joins."""
    with open(vocabulary, encoding="utf-8") as f:
        given = json.load(f)
    rows = {i: t for t, i in given["model"]["vocab"].items()} | {t["id"]: t["content"] for t in given["added_tokens"]}
    return spark.createDataFrame(sorted(rows.items()), "id int, piece string")


def _zipped(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, byte by byte in planes, as equal high bytes then lie together."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unzipped(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return planes.T.copy().view("<u4").ravel().astype(np.int64)


def _steps(numbers: np.ndarray) -> np.ndarray:
    """Differences, which are small where numbers rise one by one."""
    return np.diff(numbers, prepend=0) & 0xFFFFFFFF


def _summed(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps) & 0xFFFFFFFF


def _zipped_words(words: list[str]) -> bytes:
    """Neither words nor ids and pieces hold line feeds."""
    return zstandard.ZstdCompressor(level=3).compress("\n".join(words).encode())


def _unzipped_words(data: bytes) -> list[str]:
    text = zstandard.ZstdDecompressor().decompress(data).decode()
    return text.split("\n") if text else []


PORTION = "portion long, doc_ids array<long>, ends binary, chunks binary, chunk_sizes binary, chunk_words binary, words binary, counts binary"


def cut_texts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """A row for each portion of some texts, each text cut once; written, in buckets by portion.

    A portion, a row of a few compressed numbers and words, holds its different words and how often each stands there, its different chunks as
    numbers of words, and its texts as numbers of chunks. From here on no text moves.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        split, number = _once(Splitter, vocabulary), TaskContext.get().partitionId() << 32
        for b in batches:
            doc_ids, texts = b.column("doc_id").to_pylist(), [t or "" for t in b.column("text").to_pylist()]
            for first, end in portions(texts, CUT_BYTES):
                chunks, index, offsets = split(texts[first:end])
                known: dict[str, int] = {}
                flat = np.array([known.setdefault(w, len(known)) for chunk in chunks for w in chunk], np.int64)
                size = np.array([len(chunk) for chunk in chunks], np.int64)
                counts = np.bincount(flat, np.repeat(np.bincount(index, minlength=len(chunks)), size), minlength=len(known))
                yield {
                    "portion": [number],
                    "doc_ids": [doc_ids[first:end]],
                    "ends": [_zipped(_steps(offsets[1:]))],
                    "chunks": [_zipped(index)],
                    "chunk_sizes": [_zipped(size)],
                    "chunk_words": [_zipped(_steps(flat))],
                    "words": [_zipped_words(list(known))],
                    "counts": [_zipped(counts)],
                }
                number += 1

    spark = docs.sparkSession
    cut = arrow_map(documents(docs), each, PORTION)
    path = workspace(spark, "bpe-portions")
    name = "bpe_portions_" + uuid.uuid4().hex
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut.write.bucketBy(buckets, "portion").option("path", path).saveAsTable(name)
    written = spark.table(name)
    # Only the name goes; the files and what reads them stay.
    spark.sql(f"DROP TABLE {name}")
    return written


def word_table(cut: DataFrame, vocabulary: str) -> DataFrame:
    """(word, n, ids, pieces): every distinct word of all texts, encoded and decoded once.

    A task adds up the counts of its portions and sends its words by buckets of their hash, a
    compressed row for each; a bucket is added up where it arrives.
    The ids are exploded, joined with the vocabulary's id-to-piece table (broadcast; it has as
    many rows as the vocabulary) and put together again. The rows of a word stay neighbours and
    in order all along, so nothing is shuffled for that.
    """

    spark = cut.sparkSession
    buckets = BUCKETS_EACH * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counts: dict[str, int] = defaultdict(int)
        for b in batches:
            for words, n in zip(b.column("words"), b.column("counts")):
                for w, k in zip(_unzipped_words(words.as_py()), _unzipped(n.as_py()).tolist()):
                    counts[w] += k
                if len(counts) > COUNTED_WORDS:
                    yield _dealt(counts, buckets)
                    counts.clear()
        yield _dealt(counts, buckets)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own, counts, at = _once(WordEncoder, vocabulary), defaultdict(int), None
        for b in batches:
            for bucket, words, n in zip(*(b.column(c).to_pylist() for c in ("bucket", "words", "counts"))):
                if bucket != at:
                    yield {"word": list(counts), "n": list(counts.values()), "ids": list(map(own, counts))}
                    at = bucket
                    counts.clear()
                for w, k in zip(_unzipped_words(words), _unzipped(n).tolist()):
                    counts[w] += k
        yield {"word": list(counts), "n": list(counts.values()), "ids": list(map(own, counts))}

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            if last is not None:
                b = pa.Table.from_batches([last, b]).combine_chunks().to_batches()[0]
            starts = np.flatnonzero(b.column("at").to_numpy() == 0)
            # The last word may go on in the next batch.
            last = b.slice(int(starts[-1]))
            yield _words_of(b.slice(0, int(starts[-1])), starts[:-1])
        if last is not None:
            yield _words_of(last, np.zeros(1, np.int64))

    dealt = arrow_map(cut.select("words", "counts"), count, "bucket int, words binary, counts binary").repartition("bucket").sortWithinPartitions("bucket")
    ids = arrow_map(dealt, encode, "word string, n long, ids array<int>").select("word", "n", F.posexplode("ids").alias("at", "id"))
    by_piece = ids.join(F.broadcast(pieces(cut.sparkSession, vocabulary)), "id").select("word", "n", "at", "id", "piece")
    return arrow_map(by_piece, together, "word string, n long, ids array<int>, pieces array<string>")


def _dealt(counts: dict[str, int], buckets: int) -> dict:
    """Words and their counts, a row for each bucket."""
    if not counts:
        return {"bucket": [], "words": [], "counts": []}
    words, n = list(counts), np.fromiter(counts.values(), np.int64)
    data = "\n".join(words).encode()
    size = np.array([len(w.encode()) for w in words], np.int64)
    ends = np.cumsum(size + 1) - 1
    bucket = (word_hashes(data, ends - size, ends) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    first = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    parts = np.split(order, first[1:])
    return {
        "bucket": bucket[order][first],
        "words": [_zipped_words([words[i] for i in p.tolist()]) for p in parts],
        "counts": [_zipped(n[p]) for p in parts],
    }


def _words_of(b: pa.RecordBatch, starts: np.ndarray) -> dict:
    """Rows (word, n, at, id, piece) with a row for each id as one for each word."""
    first = pa.array(starts)
    ends = pa.array(np.append(starts, b.num_rows).astype(np.int32))
    lists = {c: pa.ListArray.from_arrays(ends, b.column(of)) for c, of in (("ids", "id"), ("pieces", "piece"))}
    return {"word": b.column("word").take(first), "n": b.column("n").take(first)} | lists


def _least_count(words: DataFrame, most: int) -> int:
    """The count from which on at most ``most`` words of at most HOT_CHARS characters are seen.

    It is a power of the eighth root of two, so that the histogram stays small whatever the corpus.
    """
    step = F.floor(F.log2("n") * 8).cast("int")
    bins = words.where(F.length("word") <= HOT_CHARS).groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("n")).collect()
    least, total = 1 << 62, 0
    for b in sorted(bins, key=lambda b: -b["step"]):
        total += b["words"]
        if total > most:
            break
        least = b["n"]
    return least


class Entries:
    """Sizes, ids and pieces of the frequent words, as Arrow columns; they travel compressed."""

    def __init__(self, words: bytes, size: bytes, ids: bytes, pieces: bytes) -> None:
        self.packed = words, size, ids, pieces
        self.words = pa.array(_unzipped_words(words), pa.large_string())
        self.size = _unzipped(size)
        self.text = {c: pa.array(_unzipped_words(t), pa.large_string()) for c, t in (("ids", ids), ("pieces", pieces))}

    def __reduce__(self) -> tuple:
        return Entries, self.packed

    @classmethod
    def of(cls, table: pa.Table) -> Entries:
        table = table.sort_by("word")
        words, ids, pieces = (_zipped_words(table[c].to_pylist()) for c in ("word", "ids", "pieces"))
        return cls(words, _zipped(table["size"].to_numpy()), ids, pieces)

    def places(self, words: pa.Array) -> np.ndarray:
        """Where each word stands among the frequent ones; -1 for others."""
        return pc.fill_null(pc.index_in(words.cast(pa.large_string()), value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _joined(docs: DataFrame, vocabulary: str, hot_words: int) -> tuple[DataFrame, Broadcast]:
    """Portions with the table entries of their rarer words, and the frequent entries.

    Each rarer word of a portion is joined once; the entries then meet their portion, which
    lies in its bucket and does not move.
    """
    spark = docs.sparkSession
    cut = cut_texts(docs, vocabulary)
    words = held(word_table(cut, vocabulary), "bpe-words")
    entry = words.select("word", "n", F.size("ids").alias("size"), F.concat_ws(" ", F.col("ids").cast("array<string>")).alias("ids"), F.concat_ws(" ", "pieces").alias("pieces"))
    least = _least_count(words, hot_words)
    is_hot = (F.length("word") <= HOT_CHARS) & (F.col("n") >= least)
    frequent = spark.sparkContext.broadcast(Entries.of(entry.where(is_hot).drop("n").toArrow()))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            words, place, ends = _places(frequent.value, b)
            for portion, first, end in zip(b.column("portion").to_pylist(), [0, *ends], ends):
                at = np.flatnonzero(place[first:end] < 0)
                yield {"portion": np.full(len(at), portion), "at": at, "word": words.slice(first, end - first).take(pa.array(at))}

    wanted = arrow_map(cut.select("portion", "words"), rare, "portion long, at int, word string")
    met = wanted.join(entry.where(~is_hot).drop("n"), "word").select("portion", F.concat_ws("\t", "at", "size", "ids", "pieces").alias("entry"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        waiting: dict[int, list[str]] = defaultdict(list)
        n = 0
        for b in batches:
            for portion, one in zip(b.column("portion").to_pylist(), b.column("entry").to_pylist()):
                waiting[portion].append(one)
            n += b.num_rows
            if n >= PACKED_ENTRIES:
                yield {"portion": list(waiting), "entries": [_zipped_words(e) for e in waiting.values()]}
                waiting.clear()
                n = 0
        yield {"portion": list(waiting), "entries": [_zipped_words(e) for e in waiting.values()]}

    found = arrow_map(met, packed, "portion long, entries binary").groupBy("portion").agg(F.collect_list("entries").alias("rare"))
    return cut.drop("counts").join(found, "portion", "left"), frequent


def _places(known: Entries, batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, list[int]]:
    """(words, place among the frequent ones, end of each portion's words) of a batch of portions."""
    words = [_unzipped_words(w) for w in batch.column("words").to_pylist()]
    flat = pa.array([w for some in words for w in some], pa.large_string())
    return flat, known.places(flat), np.cumsum([len(w) for w in words]).tolist()


def _strung(values: pa.Array, index: np.ndarray, ends: np.ndarray) -> pa.Array:
    """For each list the values of its numbers, joined by blanks; a list ends where ``ends`` says."""
    taken = values.take(pa.array(index))
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], ends))), taken), pa.scalar(" ", pa.large_string()))


def _each_portion(frequent: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, dict[str, pa.Array]]]:
    """(doc_ids, number of tokens, ids and pieces of each text joined by blanks), a portion at a time."""
    known: Entries = frequent.value
    for batch in batches:
        _, places, word_ends = _places(known, batch)
        for i, first, end in zip(range(batch.num_rows), [0, *word_ends], word_ends):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            place = places[first:end]
            rare = [e.split("\t") for some in row["rare"].as_py() or () for e in _unzipped_words(some)]
            size, own = known.size, known.text
            if rare:
                at, sizes, ids, text = zip(*rare)
                place[np.array(at, np.int64)] = len(size) + np.arange(len(rare))
                size = np.concatenate((size, np.array(sizes, np.int64)))
                own = {c: pa.concat_arrays([known.text[c], pa.array(t, pa.large_string())]) for c, t in (("ids", ids), ("pieces", text))}
            ends, chunks, chunk_sizes, flat = (_unzipped(row[c].as_py()) for c in ("ends", "chunks", "chunk_sizes", "chunk_words"))
            ends, chunk_ends, flat = _summed(ends), np.cumsum(chunk_sizes), _summed(flat)
            of_word = place[flat] if len(flat) else np.empty(0, np.int64)
            strung = {c: _strung(_strung(text, of_word, chunk_ends), chunks, ends) for c, text in own.items()}
            per_chunk = np.diff(np.concatenate(([0], np.cumsum(size[of_word])))[np.concatenate(([0], chunk_ends))])
            tokens = np.diff(np.concatenate(([0], np.cumsum(per_chunk[chunks])))[np.concatenate(([0], ends))])
            yield row["doc_ids"].values, tokens, strung


def encoded(docs: DataFrame, vocabulary: str, hot_words: int = HOT_WORDS) -> DataFrame:
    """(doc_id, ids): the ids of every whole text, special tokens in a text included.

    A null or empty text has no ids. Repeated rows and null ids are encoded like any other; no
    other column is read; an empty table gives an empty one.
    """
    joined, frequent = _joined(docs, vocabulary, hot_words)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for doc_ids, _, strung in _each_portion(frequent, batches):
            yield {"doc_id": doc_ids, "ids": [[int(i) for i in t.split()] for t in strung["ids"].to_pylist()]}

    return arrow_map(joined, each, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) for (doc_id, ids): pieces joined by id and put together with blanks.

    Rows are told apart by a number that is written with them, so ids may repeat or be null; a
    row without ids gives an empty text.
    """
    own = held(ids.select("doc_id", "ids", F.monotonically_increasing_id().alias("row")), "bpe-ids")
    parts = own.select("row", F.posexplode("ids").alias("at", "id")).join(F.broadcast(pieces(ids.sparkSession, vocabulary)), "id")
    text = parts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p")).select("row", F.concat_ws(" ", F.col("p")["piece"]).alias("text"))
    return own.select("doc_id", "row").join(text, "row", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def digests(docs: DataFrame, vocabulary: str, hot_words: int = HOT_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what :func:`encoded` and decoding give."""
    joined, frequent = _joined(docs, vocabulary, hot_words)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for doc_ids, tokens, strung in _each_portion(frequent, batches):
            ids, text = ([sha256(t).hexdigest() for t in strung[c].cast(pa.large_binary()).to_pylist()] for c in ("ids", "pieces"))
            yield {"doc_id": doc_ids, "n_tokens": tokens, "ids_sha256": ids, "decoded_sha256": text}

    return arrow_map(joined, each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
