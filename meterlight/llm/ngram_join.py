"""N-gram Jaccard join by universe partition: segments, one-deletion neighbourhoods, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlight.llm.common import arrow_map, documents, held, held_narrow, portions
from meterlight.llm.graph import apart, components
from meterlight.llm.words import LOWER, STEP, mixed, rolled, word_hashes, word_spans

SHINGLE = 5
#: Similarity of linked documents, as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
#: Each size band is so much wider than the one below.
BAND = 1.5
#: Segments beyond those the bound needs, as a share of them: so many of the costliest go unused.
SPARE = 0.25
#: A band's segments are compared with one deletion when that costs at most so many keys a document.
DELETION_KEYS = 24
#: Bits of the parity bitmaps that candidates are compared by before their texts are.
BITS = 1024
#: Members of a key that are compared in one task; larger ones are divided into blocks.
BLOCK = 2048
#: Pairs of a block whose bitmaps are compared at once.
PAIRS = 100_000

#: Bytes of words: all but ASCII white space.
_WORD = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])


def _hashed(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, shingles) of each text as rows of two independent 64-bit hashes.

    Words are what stands between ASCII white space, A-Z in lower case. Of fewer than five words the
    whole sequence is one shingle; without words there is none.
    """
    raw = [t.encode("utf-8", "replace") for t in texts]
    data = b"\n".join(raw).translate(LOWER)
    starts, ends = word_spans(data, _WORD)
    offsets = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raw)]))
    words = np.stack([word_hashes(data, starts, ends, key) for key in (0, 1)])
    shingles = np.stack([rolled(words[key], SHINGLE, key) for key in (0, 1)])
    for first, end in zip(offsets.tolist(), offsets[1:].tolist()):
        n = end - first
        if n >= SHINGLE:
            yield words[:, first:end], shingles[:, first : end - SHINGLE + 1]
        else:
            yield words[:, first:end], np.stack([rolled(words[key, first:end], n, key) if n else np.empty(0, np.uint64) for key in (0, 1)])


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct 5-word shingles of each text, as 64-bit hashes."""
    return [np.unique(s[0]) for _, s in _hashed(texts)]


def identified_sets(texts: list[str]) -> list[tuple[np.ndarray, bytes | None]]:
    """The sets of :func:`shingle_sets`, each with a name that equal sets share: from 128 bits of every shingle."""
    out = []
    for _, both in _hashed(texts):
        own, at = np.unique(both[0], return_index=True)
        out.append((own, xxhash.xxh128_digest(own.tobytes() + both[1][at].tobytes()) if len(own) else None))
    return out


def _ranked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each different pair."""
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1] if len(a) else np.empty(0, np.int64)


def exact_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingles of each text by numbers that only equal ones of these texts share: nothing is hashed."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.large_string())))
    coded = pc.list_flatten(parts).dictionary_encode()
    words, index = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # White space at the ends of a text leaves empty words there.
    kept = (pc.binary_length(words).to_numpy(zero_copy_only=False) > 0)[index] if len(index) else np.empty(0, bool)
    offsets = np.concatenate(([0], np.cumsum(kept)))[np.asarray(parts.offsets).astype(np.int64)]
    index = index[kept]
    two = _ranked(index[:-1], index[1:])
    four = _ranked(two[:-2], two[2:])
    five = _ranked(four[:-1], index[4:])
    short: dict[tuple, int] = {}
    out = []
    for first, end in zip(offsets.tolist(), offsets[1:].tolist()):
        if end - first >= SHINGLE:
            out.append(np.unique(five[first : end - SHINGLE + 1]))
        else:
            whole = tuple(index[first:end].tolist())
            out.append(np.array([-1 - short.setdefault(whole, len(short))] if whole else [], np.int64))
    return out


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets reach the similarity, exactly."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * DENOMINATOR >= (len(a) + len(b) - common) * NUMERATOR and common > 0


def largest_difference(a: int, b: int) -> int:
    """Elements in which sets of these sizes may differ and still be linked."""
    return (a + b) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)


@lru_cache(maxsize=None)
def band(k: int) -> tuple[int, int, int, int]:
    """(first size, end, segments compared exactly, segments compared with one deletion) of a band.

    Segments are parts of the universe of shingles. Sets that differ in at most H elements and
    have Σ v segments' worth of allowance (1: equal parts, 2: parts that differ in at most one
    element) with Σ v > H agree in one of them. Deletions cost a key for each element but let
    half as many, twice as large segments do; the cheaper way is chosen for each band. The
    segments compared exactly have spares: of those a set leaves out its costliest, the ones
    with the fewest elements, which unrelated sets share most easily.
    """
    first = int(np.ceil(BAND**k)) if k else 1
    end = max(int(np.ceil(BAND ** (k + 1))), first + 1)
    allowance = largest_difference(end - 1, end - 1) + 1
    # Keys of half as many segments with deletions: each segment, and each element once.
    if 1 < allowance and (allowance + 1) // 2 + end <= DELETION_KEYS:
        return first, end, allowance % 2, allowance // 2
    return first, end, allowance + int(SPARE * allowance), 0


def band_of(n: int) -> int:
    k = max(int(np.log(n) / np.log(BAND)) - 1, 0)
    while band(k)[1] <= n:
        k += 1
    return k


def keys(s: np.ndarray) -> np.ndarray:
    """The index keys of a set: those of its own band, and of the larger bands that its partners may lie in.

    Two linked sets share a key in the band of the larger one.
    """
    n = len(s)
    largest = n * DENOMINATOR // NUMERATOR
    spread, out = mixed(s), []
    for k in range(band_of(n), band_of(largest) + 1):
        first, end, exact, deletion = band(k)
        need = largest_difference(n, min(end - 1, largest)) + 1
        segments = exact + deletion
        segment = ((spread >> np.uint64(20)) % np.uint64(segments)).astype(np.int64)
        size = np.bincount(segment, minlength=segments)
        order = np.argsort(segment, kind="stable")
        starts = np.cumsum(size) - size
        running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(spread[order] + np.uint64(k)))))
        sums = running[starts + size] - running[starts]
        name = np.arange(segments, dtype=np.uint64) + np.uint64((k + 1) << 32)
        whole = mixed(sums + mixed(name) + size.astype(np.uint64))
        # Exact segments: by number of elements, then by key; the costliest are left out.
        take = np.lexsort((whole[:exact], -size[:exact]))[: max(need - 2 * deletion, 0)]
        out.append(whole[:exact][take])
        if deletion:
            of = segment[order]
            with_deletion = of >= exact
            less = sums[of] - mixed(spread[order] + np.uint64(k))
            out += [whole[exact:], mixed(less + mixed(name)[of] + (size[of] - 1).astype(np.uint64))[with_deletion]]
    return np.unique(np.concatenate(out))


def bitmap(s: np.ndarray) -> bytes:
    """Parities of the elements' bits: two bitmaps differ in at most as many bits as the sets in elements."""
    counts = np.bincount((mixed(s ^ np.uint64(0x5bd1e995)) >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _each_set(batch: pa.RecordBatch) -> Iterator[tuple[int, list[tuple[np.ndarray, bytes | None]]]]:
    """(position of the first row, sets with their names) for some rows of a batch at a time."""
    texts = [t or "" for t in batch.column("text").to_pylist()]
    for first, end in portions(texts, STEP):
        yield first, identified_sets(texts[first:end])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_hash, set_id, keys, bits): a row per document, all from one pass over the texts.

    Equal sets have equal 128-bit names; set_id is the first half. An empty set has neither. Of
    equal sets of a task only the first that has a doc_id carries its keys.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        done: set[bytes] = set()
        for b in batches:
            doc_ids = b.column("doc_id").to_pylist()
            for first, named in _each_set(b):
                sets, hashes = zip(*named)
                found = []
                for doc_id, s, h in zip(doc_ids[first:], sets, hashes):
                    new = doc_id is not None and h is not None and h not in done
                    found.append(keys(s) if new else np.empty(0, np.uint64))
                    if new:
                        done.add(h)
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield {
                    "doc_id": b.column("doc_id").slice(first, len(sets)),
                    "n_shingles": [len(s) for s in sets],
                    "set_hash": hashes,
                    "set_id": [h and int.from_bytes(h[:8], "big", signed=True) for h in hashes],
                    "keys": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64))),
                    "bits": [bitmap(s) for s in sets],
                }

    schema = "doc_id long, n_shingles long, set_hash binary, set_id long, keys array<long>, bits binary"
    return arrow_map(documents(docs), each, schema)


def _shared(keyed: DataFrame) -> DataFrame:
    """(key, id, least) for the ids of keys that several ids have; least is the smallest of them.

    Nearly all keys stand alone. The rows are dealt by key once; each task sorts its own in
    numpy. A key has one row for each different set, never one for each copy.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        parts = [(b.column("key").to_numpy(), b.column("id").to_numpy()) for b in batches]
        if not parts:
            return
        key, ids = (np.concatenate(x) for x in zip(*parts))
        del parts
        order = np.lexsort((ids, key))
        key, ids = key[order], ids[order]
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])))[: len(key)]
        key, ids = key[fresh], ids[fresh]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
        size = np.diff(np.concatenate((starts, [len(key)])))
        least, many = np.repeat(ids[starts], size), np.repeat(size > 1, size)
        for at in range(0, int(many.sum()), 100_000):
            some = np.flatnonzero(many)[at : at + 100_000]
            yield {"key": pa.array(key[some]), "id": pa.array(ids[some]), "least": pa.array(least[some])}

    return arrow_map(keyed.repartition("key"), each, "key long, id long, least long")


def _possible(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and parity bitmaps leave possible."""
    left = sketch.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    some = pairs.join(sketch.withColumnRenamed("id", "b"), "b").join(left, "a").select("a", "b", "n", "n_a", "bits", "bits_a")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            if b.num_rows:
                n, m = b.column("n").to_numpy(), b.column("n_a").to_numpy()
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in ("bits", "bits_a"))
                bound = (n + m) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)
                fits = pa.array((np.abs(n - m) <= bound) & (np.bitwise_count(x ^ y).sum(axis=1) <= bound))
                yield {c: b.column(c).filter(fits) for c in ("a", "b")}

    return arrow_map(some, each, "a long, b long").distinct()


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of a written table whose whole texts are linked, by their words themselves."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = held(docs.join(ids, "doc_id", "left_semi"), "ngram-texts")
    some = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(
        texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text")), "a"
    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            left, right = b.column("a").to_pylist(), b.column("b").to_pylist()
            texts, others = b.column("text").to_pylist(), b.column("text_b").to_pylist()
            first = size = 0
            for i in range(len(left)):
                size += len(texts[i]) + len(others[i])
                if size < STEP and i < len(left) - 1:
                    continue
                # A text of many pairs is cut once.
                different = list(dict.fromkeys(texts[first : i + 1] + others[first : i + 1]))
                sets = dict(zip(different, exact_sets(different)))
                hit = [k for k in range(first, i + 1) if linked(sets[texts[k]], sets[others[k]])]
                yield {"a": [left[k] for k in hit], "b": [right[k] for k in hit]}
                first, size = i + 1, 0

    return arrow_map(some.select("a", "b", "text", "text_b"), each, "a long, b long")


def _open_pairs(members: DataFrame, most: int) -> DataFrame:
    """(a, b, cut) from (key, id, least, component, n, bits): pairs of a key in different components
    that size and bitmap leave possible, at most ``most`` of each two components in a block; cut
    marks pairs of a block that has more.

    Keys with many members are divided into blocks, and two blocks meet in a task of their own.
    """
    block = members.withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / BLOCK)).cast("int")).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    met = block.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "least", "component", "n", "bits"
    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        waiting: list[tuple] = []
        at = None
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                if row[:3] != at:
                    if waiting:
                        yield _pairs_of(waiting, most)
                    at, waiting = row[:3], []
                waiting.append(row)
        if waiting:
            yield _pairs_of(waiting, most)

    return arrow_map(met.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "id"), each, "a long, b long, cut boolean").groupBy("a", "b").agg(F.max("cut").alias("cut"))


def _pairs_of(rows: list[tuple], most: int) -> dict:
    _, low, high, block, ids, least, component, n, bits = zip(*rows)
    ids, component, n, block, least = (np.array(x) for x in (ids, component, n, block, least))
    bits = np.frombuffer(b"".join(bits), np.uint64).reshape(len(ids), -1)
    out: dict[str, list] = {"a": [], "b": []}
    seen: dict[tuple, int] = {}
    cut, step = False, max(PAIRS // len(ids), 1)
    for first in range(0, len(ids), step):
        i, j = np.nonzero(np.arange(len(ids)) > np.arange(first, min(first + step, len(ids)))[:, None])
        i += first
        # Pairs with the key's least have been compared before.
        fits = (component[i] != component[j]) & (ids[i] != least[i]) & (ids[j] != least[j])
        if low[0] != high[0]:
            fits &= block[i] != block[j]
        i, j = i[fits], j[fits]
        bound = (n[i] + n[j]) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)
        fits = np.abs(n[i] - n[j]) <= bound
        i, j, bound = i[fits], j[fits], bound[fits]
        differ = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1)
        fits = differ <= bound
        i, j = i[fits], j[fits]
        order = np.lexsort((differ[fits], i))
        for x, y in zip(i[order].tolist(), j[order].tolist()):
            two = (min(component[x], component[y]), max(component[x], component[y]))
            if seen.get(two, 0) < most:
                seen[two] = seen.get(two, 0) + 1
                out["a"].append(int(min(ids[x], ids[y])))
                out["b"].append(int(max(ids[x], ids[y])))
            else:
                cut = True
    return out | {"cut": [cut] * len(out["a"])}


def joined(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id.

    Two documents are linked when their sets of 5-word shingles have a Jaccard similarity of at
    least 0.8; component_id is the smallest doc_id reachable by links. A document without words
    (null, empty, only white space) is linked with nothing. Rows with the same doc_id count as
    one document for links, each keeps its own row; rows without a doc_id are linked with
    nothing and have a null component_id. No other column is read; an empty table gives an
    empty one.

    1. Equal sets become one class, known by its smallest doc_id; only classes go on.
    2. Every class emits the keys of its size band. Each key's members are compared with one
       of them by size and parity bitmap. Of what stays possible, one pair for each id is
       compared by text, word by word, then those that are still in different components; so groups of
       copies are joined without looking at all their pairs.
    3. What then shares a key but no component is compared in the same way: first a few pairs
       for each two components, then more, until no pair is open.
    """
    texts = documents(docs).where(F.col("doc_id").isNotNull())
    measured = held(signatures(docs), "ngram-sets")
    known = measured.where(F.col("doc_id").isNotNull() & F.col("set_hash").isNotNull())
    classes = held(known.groupBy("set_hash", "set_id").agg(F.min("doc_id").alias("id")), "ngram-classes")
    # Keys move under the set's id; the classes of those that meet are looked up afterwards. Sets
    # of equal id and different hash would both be found.
    shared = _shared(known.select(F.explode("keys").alias("key"), F.col("set_id").alias("id")))
    own, pivot = classes.select(F.col("set_id").alias("of"), F.col("id").alias("own")), classes.select(F.col("set_id").alias("least"), F.col("id").alias("pivot"))
    shared = held(shared.withColumnRenamed("id", "of").join(own, "of").join(pivot, "least").select("key", F.col("own").alias("id"), F.col("pivot").alias("least")), "ngram-keys")
    sketch = known.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bits")
    star = shared.where("id != least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    possible = held(_possible(star, sketch), "ngram-pairs")
    n_possible = possible.count()
    first = held_narrow(possible.groupBy("b").agg(F.min("a").alias("a")), "ngram-pairs", n_possible)
    links = held(_verified(first, texts), "ngram-links")
    # Documents with the same id and different texts are one document.
    n_known = measured.count()
    several = known.groupBy("doc_id").agg(F.min("set_hash").alias("low"), F.max("set_hash").alias("high")).where("low != high").select("doc_id")
    several = held_narrow(several, "ngram-several", n_known)
    if not several.isEmpty():
        of_class = known.join(several, "doc_id").select("doc_id", "set_hash").join(classes, "set_hash").select("doc_id", "id").distinct()
        least = of_class.groupBy("doc_id").agg(F.min("id").alias("a"))
        links = held(links.unionByName(of_class.join(least, "doc_id").where("id != a").select("a", F.col("id").alias("b"))), "ngram-links")
    found = components(links)
    rest = apart(possible.join(first, ["a", "b"], "left_anti"), found).select("a", "b")
    rest = held_narrow(rest, "ngram-pairs", n_possible)
    if not rest.isEmpty():
        found = components(held(_verified(rest, texts), "ngram-links"), found)
    tested, most = None, 4
    while True:
        members = shared.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
        # Keys whose members are all in one component have nothing open.
        per_key = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low != high and size > 2")
        open_members = members.join(per_key.select("key", "size"), "key").join(sketch, "id")
        pairs = held(_open_pairs(open_members.select("key", "id", "least", "component", "n", "bits", "size"), most), "ngram-pairs")
        cut = not pairs.where("cut").isEmpty()
        fresh = pairs.select("a", "b") if tested is None else held(pairs.select("a", "b").join(tested, ["a", "b"], "left_anti"), "ngram-pairs")
        if not fresh.isEmpty():
            tested = fresh if tested is None else tested.unionByName(fresh)
            more = held(_verified(fresh, texts), "ngram-links")
            if not more.isEmpty():
                found = components(more, found)
        if not cut:
            break
        most *= 64
    # Through the classes to all documents. A class is known by its smallest doc_id.
    whole = classes.join(found, "id", "left").select("set_hash", F.coalesce("component", "id").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return measured.join(whole, "set_hash", "left").select("doc_id", "n_shingles", component.alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their component: those with its smallest doc_id, and
    all rows without an id; all columns as given."""
    gone = joined(docs).where("doc_id != component_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone"], "left_anti")
