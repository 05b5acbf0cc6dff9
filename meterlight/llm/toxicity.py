"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlight.llm.common import Memo, arrow_map, blanks, cut, documents, filtered, freed, pairs, portions, remainder

BUCKETS = 1 << 18
DIMENSIONS = 6
#: Byte n-grams of a word with its boundaries; the whole word counts as one more.
SIZES = (3, 4, 5)
#: Words of a window; windows overlap. A document scores as its worst window.
WINDOW = 3
#: Weight of all windows of a clean document together, beside its worst one.
CLEAN_WINDOWS = 20.0
#: Labelled documents of each class that are learned from, at most, and their length in characters.
TRAIN_DOCS = 1_000
TRAIN_CHARS = 20_000
#: Of those, one in so many is kept apart to calibrate the score.
CALIBRATE = 4
EPOCHS = 24
RATE = 3.0
THRESHOLD = 0.7
#: Entries of each generation of a task's memory of words.
CACHE_WORDS = 100_000

#: Stripped off words before they are cut into n-grams.
EDGES = ".,;:!?\"'()[]{}<>|#*$%&"
#: Longer words, in bytes of UTF-8, are divided: at punctuation, and into overlapping parts of so many characters.
LONG, PART = 60, 16
JOINTS = re.compile("[!-/:-@\\[-`{-~\u2010-\u2027\u3000-\u303f\uff01-\uff0f\uff1a-\uff20]+")
PRIME = np.uint64(0x100000001B3)


def _long(word: str) -> bool:
    return 4 * len(word) > LONG and (len(word) > LONG or not word.isascii()) and len(word.encode("utf-8", "replace")) > LONG


def parts_of(word: str) -> list[str]:
    """What stands for a word in the windows: itself or, for a long one, the words between its
    punctuation and then overlapping parts that cover all of it."""
    if not _long(word) or not _long(word := word.strip(EDGES)):
        return [word]
    joined = [p for p in JOINTS.split(word) if p and not _long(p)]
    step = PART // 2
    return joined + [word[i : i + PART] for i in range(0, len(word) - step, step)]


def divided(words: list[str], index: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different words, their order and the texts' first ones, as from ``cut``, with long words divided."""
    if not any(map(_long, words)):
        return words, index, offsets
    parts = [parts_of(w) for w in words]
    known: dict[str, int] = {}
    flat = np.array([known.setdefault(p, len(known)) for some in parts for p in some], np.int64)
    size = np.array([len(some) for some in parts], np.int64)
    first, per = (np.cumsum(size) - size)[index], size[index]
    ends = np.concatenate(([0], np.cumsum(per)))
    return list(known), flat[np.repeat(first - ends[:-1], per) + np.arange(ends[-1])], ends[offsets]


def words_of(text: str) -> list[str]:
    return [p for w in blanks(text.lower()).split() for p in parts_of(w)]


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(start of each word's part, buckets): hashed byte n-grams of all words in one pass."""
    raw = [b"<" + w.strip(EDGES).encode("utf-8", "replace") + b">" for w in words]
    size = np.array([len(r) for r in raw], np.int64)
    ends = np.cumsum(size)
    codes = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), size)
    left = ends[owner] - np.arange(len(codes))  # bytes from here to the end of the word
    found, owners = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, max(SIZES) + 1):
        if n > 1 and len(codes) < n:
            break
        shifted = np.zeros(len(codes), np.uint64)
        shifted[: len(codes) - n + 1] = codes[n - 1 :]
        h = (h ^ (shifted + np.uint64(n))) * PRIME
        h ^= h >> np.uint64(31)
        if n in SIZES:
            fits = left >= n
            found.append(h[fits])
            owners.append(owner[fits])
    whole = np.add.reduceat(codes * (np.uint64(31) ** (np.arange(len(codes)) - (ends - size)[owner]).astype(np.uint64)), ends - size)
    found.append(whole * PRIME ^ np.uint64(77))
    owners.append(np.arange(len(raw)))
    owners, found = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owners, kind="stable")
    mixed = (found[order] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 18)
    counts = np.bincount(owners, minlength=len(raw))
    return np.concatenate(([0], np.cumsum(counts)))[:-1], mixed.astype(np.int64)


def windows(n: int, window: int = WINDOW) -> np.ndarray:
    """(first, end) of the windows over n words: overlapping by about half, all words covered."""
    step = max(window // 2, 1)
    starts = np.arange(0, max(n - window + step, 1), step)
    return np.stack([starts, np.minimum(starts + window, n)], axis=1)


@dataclass
class Model:
    """What is left of embeddings and softmax for two classes: a value a bucket, then a logistic map."""

    values: np.ndarray
    bias: float
    scale: float
    shift: float


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Embeddings and softmax weights by full-batch adaptive steps on each document's worst window.

    Only documents are labelled, and a few words make one toxic. So a toxic document's label goes
    to its windows by how bad the model finds them, first to all and with each epoch more to the
    worst; a clean document's goes to all its windows and once more to the worst.
    """
    none = Model(np.zeros(BUCKETS, np.float32), 0.0, 1.0, -3.0)
    apart = np.arange(len(texts)) % CALIBRATE == CALIBRATE - 1
    docs = [words_of(t) for t in texts]
    y = np.array(labels, int)
    learn = [i for i in range(len(docs)) if not apart[i] and docs[i]]
    if len(set(y[learn].tolist())) < 2:
        return none
    vocabulary = {w: i for i, w in enumerate(sorted({w for i in learn for w in docs[i]}))}
    starts, buckets = subwords(list(vocabulary))
    used, bucket = np.unique(buckets, return_inverse=True)
    per_word = np.diff(np.concatenate((starts, [len(buckets)])))
    by_bucket = np.argsort(bucket, kind="stable")
    word_of = np.repeat(np.arange(len(vocabulary)), per_word)[by_bucket]
    bucket_starts = np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=len(used)))))[:-1]
    ids, spans, owner = [], [], []
    offset = 0
    for k, i in enumerate(learn):
        ids += [vocabulary[w] for w in docs[i]]
        spans.append(windows(len(docs[i])) + offset)
        owner += [k] * len(spans[-1])
        offset += len(docs[i])
    ids, spans, owner = np.array(ids), np.concatenate(spans), np.array(owner)
    label = y[learn]
    balance = np.where(label == 1, 0.5 / max((label == 1).sum(), 1), 0.5 / max((label == 0).sum(), 1))
    rng = np.random.default_rng(seed)
    E = rng.normal(0, 0.1, (len(used), DIMENSIONS)).astype(np.float32)
    W = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
    b, gE, gW, gb = np.zeros(2, np.float32), np.zeros(len(used), np.float32), np.full(W.shape, 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    length = (spans[:, 1] - spans[:, 0]).astype(np.float32)
    first = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1))
    total = np.bincount(owner).astype(np.float32)
    parts = [slice(i, min(i + 50_000, len(starts))) for i in range(0, len(starts), 50_000)]

    def word_vectors() -> np.ndarray:
        out = np.empty((len(starts), DIMENSIONS), np.float32)
        for p in parts:
            end = starts[p.stop] if p.stop < len(starts) else len(bucket)
            out[p] = np.add.reduceat(E[bucket[starts[p.start] : end]], starts[p] - starts[p.start], axis=0)
        return out / per_word[:, None]

    for epoch in range(epochs):
        V = word_vectors()
        hidden = np.empty((len(spans), DIMENSIONS), np.float32)
        for k in range(DIMENSIONS):
            running = np.concatenate(([0.0], np.cumsum(V[ids, k], dtype=np.float64)))
            hidden[:, k] = (running[spans[:, 1]] - running[spans[:, 0]]) / length
        logits = hidden @ W + b
        margin = logits[:, 1] - logits[:, 0]
        worst = np.maximum.reduceat(margin, first)
        # Of a toxic document the windows near its worst one, of a clean document all.
        part = np.exp(np.minimum((margin - worst[owner]) * (epoch / 3), 0))
        share = part / np.add.reduceat(part, first)[owner]
        share = np.where(label[owner] == 1, share, 0.5 * share + 0.5 * CLEAN_WINDOWS / total[owner])
        chosen = np.flatnonzero(share > 0.02 / total[owner])
        weight = (balance[owner] * share)[chosen]
        p = 1 / (1 + np.exp(-np.clip(margin[chosen], -30, 30)))
        wrong = ((p - label[owner[chosen]]) * weight).astype(np.float32)
        d = np.stack([-wrong, wrong], axis=1)
        dW, db, dH = hidden[chosen].T @ d, d.sum(axis=0), d @ W.T / length[chosen][:, None]
        # Back to words: each word of a window gets the window's gradient.
        dV = np.empty((len(starts), DIMENSIONS), np.float32)
        for k in range(DIMENSIONS):
            steps = np.bincount(spans[chosen, 0], dH[:, k], minlength=len(ids) + 1) - np.bincount(spans[chosen, 1], dH[:, k], minlength=len(ids) + 1)
            dV[:, k] = np.bincount(ids, np.cumsum(steps)[:-1], minlength=len(starts)) / per_word
        dE = np.add.reduceat(dV[word_of], bucket_starts, axis=0)
        gE += (dE * dE).mean(axis=1)
        gW += dW * dW
        gb += db * db
        E -= RATE * dE / np.sqrt(gE + 1e-16)[:, None]
        W -= 0.1 * dW / np.sqrt(gW)
        b -= 0.1 * db / np.sqrt(gb)
    values = np.zeros(BUCKETS, np.float32)
    values[used] = E @ (W[:, 1] - W[:, 0])
    model = Model(values, float(b[1] - b[0]), 1.0, 0.0)
    scorer = Scorer(model)
    margins = scorer.margins([t for t, a, d in zip(texts, apart, docs) if a and d])
    truth = np.array([v for v, a, d in zip(y, apart, docs) if a and d], int)
    if len(set(truth.tolist())) < 2:
        margins, truth = scorer.margins([texts[i] for i in learn]), label
    model.scale, model.shift = _logistic(margins, truth)
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic map, classes weighted alike, with smoothed targets."""
    spread = x.std() + 1e-6
    z, n1 = x / spread, max(y.sum(), 1)
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    weight = np.where(y == 1, 0.5 / n1, 0.5 / max(len(y) - n1, 1))
    a, b = 1.0, -float(z[y == 1].mean() + z[y == 0].mean()) / 2
    for _ in range(500):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        d = (p - target) * weight
        a, b = max(a - 4 * float((d * z).sum()), 0.05), b - 4 * float(d.sum())
    return a / spread, b


class Scorer:
    """A value for each different word, kept between texts."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, Memo(self._values, CACHE_WORDS)

    def _values(self, words: list[str]) -> Iterator[float]:
        for i in range(0, len(words), 20_000):
            starts, buckets = subwords(words[i : i + 20_000])
            sums = np.add.reduceat(self.model.values[buckets].astype(np.float64), starts)
            yield from (sums / np.diff(np.concatenate((starts, [len(buckets)])))).tolist()

    def margins(self, texts: list[str]) -> np.ndarray:
        """Of the worst window of each text."""
        words, index, offsets = divided(*cut([blanks(t.lower()) for t in texts]))
        running = np.concatenate(([0.0], np.cumsum(np.array(self.known(words), float)[index])))
        out = np.full(len(texts), -np.inf)
        kept = np.array([w != "" for w in words], bool)[index]
        for i, (first, end) in enumerate(zip(offsets, offsets[1:])):
            # White space at the ends of a text leaves empty chunks there.
            first, end = first + (end > first and not kept[first]), end - (end > first and not kept[end - 1])
            if end > first:
                a, b = windows(end - first).T + first
                out[i] = ((running[b] - running[a]) / (b - a)).max() + self.model.bias
        return out

    def __call__(self, texts: list[str]) -> list[float]:
        out = []
        for first, end in portions(texts):
            z = self.model.scale * self.margins(texts[first:end]) + self.model.shift
            out += (1 / (1 + np.exp(-np.clip(z, -50, 50)))).tolist()
        return out


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS) -> Model:
    """Learns from a bounded sample of labelled rows whose crc32(doc_id) mod 3 is not 1.

    Of each class the ``max_docs`` ids of least hash are taken (a document labelled several
    times counts as toxic if any label says so) and their texts fetched; texts beyond
    ``TRAIN_CHARS`` characters are scored like any other but not learned from.
    """
    usable = labels.where(remainder("doc_id", 3) != 1).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    texts = documents(docs).where(F.length("text") <= TRAIN_CHARS)
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = usable.where("toxic = 1").orderBy(*order).limit(max_docs).unionAll(usable.where("toxic = 0").orderBy(*order).limit(max_docs))
    # At most 2 * max_docs ids; of rows with the same id the one with the least text.
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows = sorted(rows, key=lambda r: r["doc_id"])
    model = train([r["text"] for r in rows], [r["toxic"] for r in rows])
    freed()
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """A row per document: doc_id, score, predicted (1 from 0.7 on).

    The whole text is read in windows, long words in parts. A null or empty text scores near 0; repeated rows and
    null ids are scored like any other; an empty table gives an empty one. Without labels of
    both classes every text scores the same low value. No other column is read.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        scorer = Scorer(model)
        for batch in batches:
            rows = list(pairs(batch))
            scores = scorer([r[1] for r in rows])
            yield {"doc_id": [r[0] for r in rows], "score": scores, "predicted": [int(s >= THRESHOLD) for s in scores]}

    return arrow_map(documents(docs), each, "doc_id long, score double, predicted int")


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns as given.

    Rows are judged as by :func:`scored`: null and empty texts stay, repeated rows stay or go
    together, whole texts are read, an empty table gives an empty one.
    """

    def keep():
        scorer = Scorer(model)
        return lambda texts: [s < THRESHOLD for s in scorer(texts)]

    return filtered(docs, keep)
