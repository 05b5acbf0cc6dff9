"""Language identification: interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlight.llm.common import CUT_BYTES, arrow_map, blanks, cut, documents, exceeded, held, portions, remainder
from meterlight.session import workspace

ORDER = 5
#: A row of the model has a column for each language, and for each of those in each half of the rows.
#: With more columns than this, fewer words are looked at and remembered together, so that a task's
#: memory stays the same.
FEW_LANGS = 8
#: N-grams of the model that are moved together, at most.
CHUNK = 1 << 14
#: Documents of a language that its rejection bound needs, at least.
CALIBRATION_DOCS = 20
#: Temperatures of the scores, of which calibration takes the one of least loss.
TEMPERATURES = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)
#: Marks of a language's counts: over all rows, and over either half of them.
WHOLE, HALVES = "0:", ("1:", "2:")
#: Share of documents of a language whose cross-entropy may lie above its rejection bound.
REJECTED = 0.005
#: Entries of a task's tables of counted and of scored words.
CACHE_WORDS = 300_000
#: Words whose different windows are told apart together, those of them that are added up together,
#: and windows that are looked up together.
TOLD_WORDS, SCORED_WORDS, WINDOWS = 60_000, 20_000, 200_000

#: Runs of letters. Digits, marks and underscores part them.
LETTERS = re.compile(r"[^\W\d_]+")
BEGIN, END = "\x02", "\x03"
UNSEEN = np.float32(np.log(1e-6))


def word_counts(train: DataFrame) -> DataFrame:
    """(lang, word, n) over whole texts; words are added up in the task before they are sent."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counts: dict[str, Counter] = {}

        def rows() -> dict:
            # Chunks between blanks are counted first; their runs of letters are the words.
            flat = Counter()
            for lang, c in counts.items():
                for chunk, n in c.items():
                    for w in LETTERS.findall(chunk):
                        flat[lang, w] += n
            counts.clear()
            flat = [(lang, w, n) for (lang, w), n in flat.items()]
            return {k: [r[i] for r in flat] for i, k in enumerate(("lang", "word", "n"))}

        for b in batches:
            texts, langs = [(t or "").lower() for t in b.column("text").to_pylist()], b.column("lang").to_pylist()
            for first, end in portions(texts):
                chunks, index, offsets = cut([blanks(t) for t in texts[first:end]])
                number = {lang: i for i, lang in enumerate(sorted(set(langs[first:end])))}
                owner = np.repeat([number[x] for x in langs[first:end]], np.diff(offsets))
                for lang, i in number.items():
                    own = np.bincount(index[owner == i], minlength=len(chunks))
                    counts.setdefault(lang, Counter()).update({chunks[i]: int(own[i]) for i in np.flatnonzero(own)})
                if sum(map(len, counts.values())) > CACHE_WORDS:
                    yield rows()
        yield rows()

    return arrow_map(train, each, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def ngram_counts(words: DataFrame, order: int = ORDER, halved: bool = False) -> DataFrame:
    """(lang, n, gram, count): raw counts of the highest order, below it how many different
    characters precede the n-gram; n-grams at the start of a word keep their raw counts.

    ``halved`` words bear the mark of a half; the counts over all rows come beside theirs."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            out: Counter = Counter()
            for lang, word, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                padded = BEGIN * (order - 1) + word + END
                for i in range(len(padded) - order + 1):
                    out[lang, padded[i : i + order]] += n
            yield {"lang": [k[0] for k in out], "gram": [k[1] for k in out], "raw": list(out.values())}

    grams = arrow_map(words, each, "lang string, gram string, raw long").groupBy("lang", "gram").agg(F.sum("raw").alias("raw"))
    if halved:
        grams = held(grams, "langid-halves")
        grams = grams.unionByName(grams.groupBy(F.concat(F.lit(WHOLE), F.expr("substring(lang, 3)")).alias("lang"), "gram").agg(F.sum("raw").alias("raw")))
    level = held(grams.withColumn("count", F.col("raw")), "langid")
    levels = [level.select("lang", F.lit(order).alias("n"), "gram", "count")]
    for n in range(order - 1, 0, -1):
        lower = level.groupBy("lang", F.substring("gram", 2, n).alias("gram")).agg(F.sum("raw").alias("raw"), F.count("*").alias("before"))
        level = lower.select("lang", "gram", "raw", F.when(F.col("gram").startswith(BEGIN), F.col("raw")).otherwise(F.col("before")).alias("count"))
        # What only pads a word is a context, never a predicted character.
        levels.append(level.where(~F.col("gram").endswith(BEGIN)).select("lang", F.lit(n).alias("n"), "gram", "count"))
    whole = levels[0]
    for x in levels[1:]:
        whole = whole.unionByName(x)
    return whole


@dataclass
class Models:
    """For each order: sorted hashes with one column of log probabilities a language (nan: not
    seen), and sorted context hashes with log back-off weights (nan: unseen context). Where rows
    came in halves, the columns of all rows are followed by those of either half; ``halves`` tells
    which languages each of them has.

    The arrays hold every counted n-gram. They lie in one file that tasks map, so only what is
    looked up comes into memory; ``places`` has, for (context, order), the first byte and the rows.
    """

    langs: list[str]
    order: int
    path: str
    places: dict[tuple[bool, int], tuple[int, int]]
    bound: np.ndarray
    temperature: float = 1.0
    halves: np.ndarray | None = None

    @property
    def width(self) -> int:
        return len(self.langs) * (1 if self.halves is None else 1 + len(self.halves))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("grams", "contexts")}

    def _mapped(self, context: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        whole = np.memmap(_local(self.path), np.uint8, "r") if self.places else np.empty(0, np.uint8)
        for n in range(self.order + 1):
            at, rows = self.places.get((context, n), (0, 0))
            middle, end = at + 8 * rows, at + (8 + 4 * self.width) * rows
            out.append((np.asarray(whole[at:middle]).view(np.uint64), np.asarray(whole[middle:end]).view(np.float32).reshape(rows, self.width)))
        return out

    @cached_property
    def grams(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return self._mapped(False)

    @cached_property
    def contexts(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return self._mapped(True)


def _local(path: str) -> str:
    """Where this machine finds the model: in the shared folder, or as a file that Spark sent."""
    return path if os.path.isabs(path) else SparkFiles.get(path)


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
HALF = np.uint64(1 << 63)


def _hash(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the rows of a matrix of code points, by multiplication and shifts."""
    h = np.full(len(codes), 1469598103934665603, np.uint64)
    for column in codes.T:
        h = (h ^ column.astype(np.uint64)) * MULTIPLIER
        h ^= h >> np.uint64(29)
    return h


def _codes(grams: list[str]) -> np.ndarray:
    return np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(grams), -1)


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The rows of the wanted keys, nan for others; each different key is searched once, in order."""
    if not len(keys):
        return np.full((len(wanted), values.shape[1]), np.nan, np.float32)
    different, back = np.unique(wanted, return_inverse=True)
    at = np.minimum(np.searchsorted(keys, different), len(keys) - 1)
    found = values[at]
    found[keys[at] != different] = np.nan
    return found[back]


def probabilities(counts: DataFrame, order: int) -> DataFrame:
    """(lang, context, n, gram, value): log probabilities of all n-grams, interpolated with the next
    lower order's, and log back-off weights of all their contexts."""
    # Counts of counts, for the discounts of each language and order.
    small = counts.where("count <= 2").groupBy("lang", "n").agg(
        F.sum((F.col("count") == 1).cast("long")).alias("n1"), F.sum((F.col("count") == 2).cast("long")).alias("n2")
    )
    discount = [(r["lang"], r["n"], r["n1"] / (r["n1"] + 2 * r["n2"])) for r in small.collect() if r["n1"] and r["n2"]]
    discounts = F.broadcast(counts.sparkSession.createDataFrame(discount, "lang string, n int, d double"))
    given = counts.join(discounts, ["lang", "n"], "left").withColumn("d", F.coalesce("d", F.lit(0.5)))
    given = given.withColumn("before", F.expr("substring(gram, 1, n - 1)"))
    # What the discounts of a context's n-grams leave to the lower order.
    totals = given.groupBy("lang", "n", "before").agg(F.sum("count").alias("total"), (F.first("d") * F.count("*") / F.sum("count")).alias("left"))
    masses = held(given.join(totals, ["lang", "n", "before"]).select("lang", "n", "gram", "before", "left", ((F.col("count") - F.col("d")) / F.col("total")).alias("mass")), "langid")
    levels, lower = [], None
    for n in range(1, order + 1):
        level = masses.where(F.col("n") == n)
        if lower is None:
            level = level.withColumn("p", F.col("mass") + F.col("left") * 1e-6)
        else:
            below = lower.select("lang", F.col("gram").alias("after"), F.col("p").alias("q"))
            # The end of an n-gram is missing below only where it merely pads a word.
            level = level.withColumn("after", F.expr("substring(gram, 2)")).join(below, ["lang", "after"], "left").withColumn("p", F.col("mass") + F.col("left") * F.coalesce("q", F.lit(1e-6)))
        lower = held(level.select("lang", "gram", "p"), "langid")
        levels.append(lower.select("lang", F.lit(False).alias("context"), F.lit(n).alias("n"), "gram", F.log(F.greatest("p", F.lit(1e-12))).alias("value")))
    whole = levels[0]
    for x in levels[1:]:
        whole = whole.unionByName(x)
    weights = masses.where("n > 1").groupBy("lang", "n", F.col("before").alias("gram")).agg(F.first("left").alias("left"))
    return whole.unionByName(weights.select("lang", F.lit(True).alias("context"), "n", "gram", F.log(F.greatest("left", F.lit(1e-9))).alias("value")))


def fit(train: DataFrame, order: int = ORDER) -> Models:
    """Models of all languages of ``train`` (lang, text); words are counted over all its rows.

    With a column ``half`` (1 or 2) models of either half come beside those of all rows. Every
    n-gram that was counted is kept. The driver sees the languages and one chunk of the model at a
    time, which it writes to the file that the tasks map.
    """
    spark = train.sparkSession
    halved = "half" in train.columns
    if halved:
        train = train.select(F.concat(F.col("half").cast("string"), F.lit(":"), "lang").alias("lang"), "text")
    counts = held(ngram_counts(word_counts(train), order, halved), "langid")
    found = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    langs = [x[2:] for x in found if x.startswith(WHOLE)] if halved else found
    models = Models(langs, order, "", {}, np.full(len(langs), np.inf))
    if not langs:
        return models
    names = langs
    if halved:
        names = [mark + x for mark in (WHOLE, *HALVES) for x in langs]
        models.halves = np.isin(names[len(langs) :], found).reshape(len(HALVES), len(langs))
    column = {x: i for i, x in enumerate(names)}
    width, step = models.width, _fewer(CHUNK, models)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            lang, context, n, gram, value = (b.column(x).to_pylist() for x in ("lang", "context", "n", "gram", "value"))
            keys = np.empty(len(gram), np.uint64)
            size = np.array([len(g) for g in gram], np.int64)
            for k in np.unique(size):
                at = np.flatnonzero(size == k)
                keys[at] = _hash(_codes([gram[i] for i in at]))
            # Moved by half the range, so that signed numbers sort like the hashes.
            yield {"context": context, "n": n, "key": (keys ^ HALF).view(np.int64), "lang": [column[x] for x in lang], "value": value}

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            kind = np.array(b.column("context").to_pylist(), bool) * (order + 1) + np.array(b.column("n").to_pylist(), int)
            keys = np.array(b.column("key").to_pylist(), np.int64)
            lists = b.column("values")
            per = np.diff(np.asarray(lists.offsets))
            entries = lists.flatten()
            values = np.full((len(keys), width), np.nan, np.float32)
            values[np.repeat(np.arange(len(keys)), per), entries.field("lang").to_numpy()] = entries.field("value").to_numpy()
            borders = np.concatenate((np.flatnonzero(np.diff(kind)) + 1, [len(keys)]))
            first = 0
            for border in borders:
                for at in range(first, border, step):
                    end = min(at + step, border)
                    yield {"context": [bool(kind[at] > order)], "n": [int(kind[at] % (order + 1))], "first": [int(keys[at])], "rows": [end - at],
                           "keys": [(keys[at:end].view(np.uint64) ^ HALF).tobytes()], "values": [values[at:end].tobytes()]}
                first = border

    rows = arrow_map(probabilities(counts, order), hashed, "context boolean, n int, key long, lang int, value float")
    rows = rows.groupBy("context", "n", "key").agg(F.collect_list(F.struct("lang", "value")).alias("values")).orderBy("context", "n", "key")
    parts = held(arrow_map(rows, chunks, "context boolean, n int, first long, rows int, keys binary, values binary"), "langid")
    # A number or two for each chunk; its place follows from them.
    offsets: dict[tuple, int] = {}
    for r in parts.select("context", "n", "first", "rows").orderBy("context", "n", "first").collect():
        kind = r["context"], r["n"]
        offsets[*kind, r["first"]] = models.places.get(kind, (0, 0))[1]
        models.places[kind] = 0, offsets[*kind, r["first"]] + r["rows"]
    at = 0
    for kind, (_, n) in sorted(models.places.items()):
        models.places[kind] = at, n
        at += -(-(8 + 4 * width) * n // 8) * 8
    folder = workspace(spark, "langid-model")
    shared = re.fullmatch(r"(?:file:(?://)?)?(/[^:]*)", folder)
    own = shared[1] if shared else tempfile.mkdtemp()
    os.makedirs(own, exist_ok=True)
    models.path = os.path.join(own, f"{uuid.uuid4().hex}.model")
    with open(models.path, "wb") as file:
        file.truncate(at)
        for r in parts.toLocalIterator():
            begin, n = models.places[r["context"], r["n"]]
            before = offsets[r["context"], r["n"], r["first"]]
            file.seek(begin + 8 * before)
            file.write(r["keys"])
            file.seek(begin + 8 * n + 4 * width * before)
            file.write(r["values"])
    if not shared:
        # A store that only Spark reaches: Spark sends the file to each machine.
        spark.sparkContext.addFile(models.path)
        models.path = os.path.basename(models.path)
    return models


def score_words(models: Models, words: list[str]) -> np.ndarray:
    """Log probability of each word in each column of the model, its end included; each different
    window of characters is looked up once."""
    n = models.order
    padded = [BEGIN * (n - 1) + w + END for w in words]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(w) + 1 for w in words])
    ends = np.cumsum(lengths)
    starts = np.cumsum(lengths + n - 1) - (lengths + n - 1)
    at = np.repeat(starts - (ends - lengths), lengths) + np.arange(lengths.sum()) + n - 1
    window = np.stack([codes[at - i] for i in range(n - 1, -1, -1)], axis=1)
    index = pa.array(_hash(window)).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    first = np.empty(index.max() + 1, np.int64)
    first[index[::-1]] = np.arange(len(index))[::-1]
    step = _fewer(WINDOWS, models)
    scores = np.concatenate([_score_windows(models, window[first[i : i + step]]) for i in range(0, len(first), step)])
    out = np.empty((len(words), models.width), np.float32)
    step = _fewer(SCORED_WORDS, models)
    for i in range(0, len(words), step):
        begin, end = ends[i] - lengths[i], ends[min(i + step, len(words)) - 1]
        out[i : i + step] = np.add.reduceat(scores[index[begin:end]], (ends - lengths)[i : i + step] - begin, axis=0)
    return out


def _score_windows(models: Models, window: np.ndarray) -> np.ndarray:
    """Log probability of the last character of each window after the others, in each column of the model."""
    back, out = np.zeros((len(window), models.width), np.float32), np.full((len(window), models.width), np.nan, np.float32)
    for k in range(models.order, 0, -1):
        found = _lookup(*models.grams[k], _hash(window[:, -k:]))
        np.copyto(out, found + back, where=np.isnan(out))
        if k > 1:
            weights = _lookup(*models.contexts[k], _hash(window[:, -k:-1]))
            np.add(back, weights, out=back, where=~np.isnan(weights))
    return np.where(np.isnan(out), back + UNSEEN, out)


def _fewer(n: int, models: Models) -> int:
    return max(n * FEW_LANGS // max(FEW_LANGS, models.width), 1)


def _total(scores: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The sum of the rows at an index, each different one fetched once."""
    rows, times = np.unique(index, return_counts=True)
    out = np.zeros(scores.shape[1])
    for i in range(0, len(rows), 1_000):
        out += times[i : i + 1_000] @ scores[rows[i : i + 1_000]].astype(np.float64)
    return out


class Scorer:
    """Cross-entropy of texts in nats a character; every different chunk between blanks is scored once."""

    def __init__(self, models: Models) -> None:
        self.models, self.known = models, {}
        self._forget()

    def _forget(self) -> None:
        self.known.clear()
        self.scores, self.lengths = np.empty((0, self.models.width), np.float32), np.empty(0, np.int64)

    def _learn(self, chunks: list[str]) -> None:
        """A chunk's score and length are the sums of its runs of letters; without one, both are 0."""
        runs = [[c] if c.isalpha() else LETTERS.findall(c) for c in chunks]
        runs = [r if r and (r[0].isalpha() or any(map(str.isalpha, "".join(r)))) else [] for r in runs]
        coded = pa.array([w for r in runs for w in r], pa.large_string()).dictionary_encode()
        words, index = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        per = np.array([len(r) for r in runs])
        step = _fewer(TOLD_WORDS, self.models)
        parts = [score_words(self.models, words[i : i + step]) for i in range(0, len(words), step)]
        sums = np.zeros((len(chunks), self.models.width), np.float32)
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        chars = np.concatenate(([0], np.cumsum(sizes[index])))
        end = np.cumsum(per)
        if words:
            sums[per > 0] = np.add.reduceat(np.concatenate(parts)[index], (end - per)[per > 0], axis=0, dtype=np.float64)
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks))))
        self.scores = np.concatenate([self.scores, sums])
        self.lengths = np.concatenate([self.lengths, chars[end] - chars[end - per]])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy by column of the model, characters); nan and 0 for texts without a letter."""
        if len(self.known) > _fewer(CACHE_WORDS, self.models):
            self._forget()
        chunks, index, offsets = cut([blanks(t.lower()) for t in texts])
        new = [c for c in chunks if c not in self.known]
        if new:
            self._learn(new)
        index = np.array([self.known[c] for c in chunks], np.int64)[index]
        if self.models.width > FEW_LANGS:
            total = np.stack([_total(self.scores, index[first:end]) for first, end in zip(offsets, offsets[1:])]) if texts else np.empty((0, self.models.width))
        else:
            running = np.concatenate([np.zeros((1, self.models.width)), np.cumsum(self.scores[index], axis=0, dtype=np.float64)])
            total = running[offsets[1:]] - running[offsets[:-1]]
        length = np.concatenate(([0], np.cumsum(self.lengths[index])))
        chars = length[offsets[1:]] - length[offsets[:-1]]
        with np.errstate(invalid="ignore", divide="ignore"):
            return -total / chars[:, None], chars


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _scored(docs: DataFrame, models: Models, temperatures: tuple[float, ...]) -> DataFrame:
    """A row per document of ``docs`` (doc_id, text, lang, half): doc_id, lang_pred, cross_entropy, scores.

    ``scores`` has the probability of the predicted language at each temperature. Where ``lang`` is
    given, has a model in the other half than the row's and the text has letters, ``lang``, ``own``
    and ``losses`` say what the models of that other half, which have not seen the text, make of
    it: the cross-entropy in its language, and the log loss at each temperature.
    """
    n = len(models.langs)
    column = {x: i for i, x in enumerate(models.langs)}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        scorer = Scorer(models)
        for batch in batches:
            ids, texts, langs, halves = (batch.column(x).to_pylist() for x in ("doc_id", "text", "lang", "half"))
            texts = [t or "" for t in texts]
            for first, end in portions(texts, _fewer(CUT_BYTES, models)):
                rows = end - first
                out = {"doc_id": ids[first:end], "lang_pred": ["und"] * rows, "cross_entropy": [None] * rows, "scores": [[0.0] * len(temperatures)] * rows,
                       "lang": [None] * rows, "own": [None] * rows, "losses": [None] * rows}
                if n:
                    entropy, chars = scorer(texts[first:end])
                    entropy = np.nan_to_num(entropy)
                    best = entropy[:, :n].argmin(axis=1)
                    scores = np.stack([_softmax(-entropy[:, :n] * t)[np.arange(rows), best] for t in temperatures], axis=1)
                    for i in np.flatnonzero(chars):
                        out["lang_pred"][i], out["cross_entropy"][i], out["scores"][i] = models.langs[best[i]], float(entropy[i, best[i]]), scores[i].tolist()
                    if models.halves is not None:
                        other = np.array([2 - h for h in halves[first:end]])
                        truth = np.array([column.get(x, -1) for x in langs[first:end]])
                        use = np.flatnonzero((chars > 0) & (truth >= 0) & models.halves[other, truth])
                        other, truth = other[use], truth[use]
                        apart = np.where(models.halves[other], entropy[use].reshape(len(use), 1 + len(models.halves), n)[np.arange(len(use)), 1 + other], np.inf)
                        losses = np.stack([-np.log(np.maximum(_softmax(-apart * t)[np.arange(len(use)), truth], 1e-9)) for t in temperatures], axis=1)
                        for i, at, own, loss in zip(use, truth, apart[np.arange(len(use)), truth], losses):
                            out["lang"][i], out["own"][i], out["losses"][i] = models.langs[at], float(own), loss.tolist()
                yield out

    return arrow_map(docs.select("doc_id", "text", "lang", "half"), each, "doc_id long, lang_pred string, cross_entropy double, scores array<double>, lang string, own double, losses array<double>")


def calibrated(models: Models, scored: DataFrame, rejected: float = REJECTED) -> Models:
    """Adds the rejection bound of each language and the temperature, from all rows of :func:`_scored`
    that were learned from, at ``TEMPERATURES``.

    A bound is the least cross-entropy that at most the share ``rejected`` of a language's rows
    exceed; the driver sees one number a language. The temperature is that of least total loss.
    """
    known = scored.where(F.col("own").isNotNull())
    enough = {r["lang"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= CALIBRATION_DOCS).collect()}
    for r in exceeded(known.select("lang", F.col("own").alias("value"), F.lit(1).alias("n")), ["lang"], rejected).collect():
        if r["lang"] in enough:
            models.bound[models.langs.index(r["lang"])] = r["value"]
    # Decimals add up to the same in any order.
    losses = known.agg(*[F.sum(F.get("losses", F.lit(i)).cast("decimal(20,8)")).alias(str(i)) for i in range(len(TEMPERATURES))]).collect()[0]
    if losses[0] is not None:
        models.temperature = min(zip(losses, TEMPERATURES))[1]
    return models


def _told(scored: DataFrame, models: Models, temperatures: tuple[float, ...]) -> DataFrame:
    bounds = [(x, float(b)) for x, b in zip(models.langs, models.bound) if np.isfinite(b)]
    # A row a language.
    bounds = F.broadcast(scored.sparkSession.createDataFrame(bounds, "lang_pred string, bound double"))
    score = F.get("scores", F.lit(temperatures.index(models.temperature)))
    rejected = F.col("cross_entropy").isNull() | F.coalesce(F.col("cross_entropy") > F.col("bound"), F.lit(False))
    return scored.join(bounds, "lang_pred", "left").select("doc_id", "lang_pred", score.alias("score"), rejected.alias("rejected"), "cross_entropy")


def predict(docs: DataFrame, models: Models) -> DataFrame:
    """A row per document: doc_id, lang_pred, score, rejected, cross_entropy.

    The language of least cross-entropy a character; ``und`` without a letter (or without any
    learned language), with score 0. ``score`` is the calibrated probability of the language;
    ``rejected`` marks texts less likely than almost all known texts of it. Of languages with equal
    cross-entropy the first by name is taken. A null text is empty; repeated rows and null ids
    are scored like any other; whole texts are read, however long; no other column is read; an
    empty table gives an empty one.
    """
    given = documents(docs).select("*", F.lit(None).cast("string").alias("lang"), F.lit(1).alias("half"))
    return _told(_scored(given, models, (models.temperature,)), models, (models.temperature,))


def identified(docs: DataFrame) -> DataFrame:
    """Learns from labelled rows outside the held-out fourth and predicts all rows.

    Rows with crc32(doc_id) mod 4 = 2, or without an id or a language, are not learned from. All
    others are, and all of them calibrate: rejection bounds and temperature come from what
    models of one half of them say of the other, in the pass that predicts. Halves go by a hash of
    the text, so that copies stay together. A model of half of the rows finds texts a little less
    likely than that of all, so bounds reject rather fewer.
    """
    text = F.col("text").cast("string")
    learned = F.coalesce((remainder("doc_id", 4) != 2) & F.col("lang").isNotNull(), F.lit(False))
    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        F.when(learned, F.col("lang").cast("string")).alias("lang"),
        (1 + F.pmod(F.xxhash64(text), F.lit(2))).cast("int").alias("half"),
    )
    models = fit(given.where(F.col("lang").isNotNull()).select("lang", "text", "half"))
    scored = held(_scored(given, models, TEMPERATURES), "langid-scored")
    return _told(scored, calibrated(models, scored), TEMPERATURES)
