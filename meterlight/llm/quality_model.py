"""Quality classifier from weak labels: heuristics vote, EM weighs them, a hashed linear scorer learns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlight.llm.common import arrow_map, documents, filtered, pairs

#: Dimensions of the hashed features.
DIMENSIONS = 1 << 13
#: Documents the scorer is trained on, at most; votes are counted over all documents.
TRAIN_DOCS = 6_000
STEPS = 400
#: Documents from this score on are kept.
THRESHOLD = 0.5

GOOD, BAD, ABSTAIN = 0, 1, 2

STATS = ("n_words", "repeats", "upper", "symbols", "bangs", "distinct", "dup_lines", "letters", "sentences", "separators")
# Classes of bytes; bytes beyond ASCII count as lower-case letters.
_CLASSES = {"\n": 5, " ": 4, "\t": 4, ".": 6, ",": 7, "!": 8, "?": 8, "|": 9, "-": 12, "_": 12, "\r": 5}
CLASS_OF = bytes(
    1 if b >= 128 or 97 <= b <= 122
    else 2 if 65 <= b <= 90
    else 3 if 48 <= b <= 57
    else _CLASSES.get(chr(b), 10 if chr(b) in "#*$%&<>~^=+@\\/" else 11 if chr(b) in "\"'()[]{}:;`" else 0)
    for b in range(256)
)
NOT_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())
BLANKS = b" \t\n\r\x0b\x0c"
#: Marks that part the entries of menus and tables when they stand alone.
SEPARATORS = tuple(f" {c} ".encode() for c in "|>/*~\u00b7\u2022\u00bb")


def measured(text: str) -> tuple[float, ...]:
    """The values of STATS for a whole text."""
    words, raw = text.split(), text.encode("utf-8", "replace")
    n = len(words)
    if not n:
        return (0.0,) * len(STATS)
    lines = [x for x in text.split("\n") if x.strip()]
    visible = len(raw.translate(None, BLANKS))
    return (
        float(n),
        sum(map(eq, words, words[1:])) / n,
        sum(map(str.isupper, words)) / n,
        sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">", b"~", b"^"))) / n,
        (raw.count(b"!!") + raw.count(b"??")) / n,
        len(set(words)) / n,
        1 - len(set(lines)) / len(lines),
        len(raw.translate(None, NOT_LETTERS)) / max(visible, 1),
        (raw.count(b". ") + raw.count(b".\n") + raw.count(b"? ") + raw.count(b"! ") + raw.endswith((b".", b"!", b"?"))) / n,
        sum(map(raw.count, SEPARATORS)) / n,
    )


def votes(stats: np.ndarray) -> np.ndarray:
    """One column a labeller: GOOD, BAD or ABSTAIN, from a row of STATS a document."""
    n, repeats, upper, symbols, bangs, distinct, dup, letters, sentences, separators = stats.T
    long = n >= 12

    def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(bad, BAD, np.where(good, GOOD, ABSTAIN))

    return np.stack(
        [
            vote(long & (repeats > 0.2), long & (repeats < 0.03)),
            vote(long & (upper > 0.3), long & (upper < 0.05)),
            vote(symbols > 0.25, long & (symbols < 0.02)),
            vote(bangs > 0.2, long & (bangs < 0.02)),
            vote((n >= 50) & (n < 3000) & (distinct < 0.2), (n >= 50) & (n < 3000) & (distinct > 0.35)),
            vote(long & (dup > 0.4), np.zeros(len(n), bool)),
            vote(letters < 0.7, long & (letters > 0.93)),
            vote(long & (sentences < 0.01), long & (sentences > 0.03) & (sentences < 0.35)),
            vote(n < 1, np.zeros(len(n), bool)),
            vote(separators > 0.1, long & (separators < 0.02)),
        ],
        axis=1,
    )


def pattern_of(rows: np.ndarray) -> np.ndarray:
    """Votes of a document as one number in base 3."""
    return rows @ (3 ** np.arange(rows.shape[1]))


def pattern_counts(docs: DataFrame) -> DataFrame:
    """(pattern, n) over all documents: at most one row for each combination of votes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            stats = np.array([measured(t) for _, t in pairs(b)]).reshape(-1, len(STATS))
            values, counts = np.unique(pattern_of(votes(stats)), return_counts=True)
            yield {"pattern": values.tolist(), "n": counts.tolist()}

    return arrow_map(documents(docs), each, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


@dataclass
class LabelModel:
    """What EM has found: the share of bad documents and P(vote | class) of each labeller that
    votes. To abstain says nothing about the class, so its chance is 1."""

    bad_share: float
    chances: np.ndarray  # labeller, class, vote

    def posterior(self, rows: np.ndarray) -> np.ndarray:
        """P(good | votes)."""
        at = np.arange(rows.shape[1])
        good = np.log(1 - self.bad_share) + np.log(self.chances[at, GOOD, rows]).sum(axis=1)
        bad = np.log(self.bad_share) + np.log(self.chances[at, BAD, rows]).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(bad - good, -50, 50)))

    def accuracies(self) -> np.ndarray:
        """P(right | a vote) of each labeller, were it to vote on every document."""
        return self.chances[:, GOOD, GOOD] * (1 - self.bad_share) + self.chances[:, BAD, BAD] * self.bad_share


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, labellers: int, rounds: int = 100) -> LabelModel:
    """Starts from the view that any vote for BAD is likely right."""
    rows = np.stack([(patterns // 3**i) % 3 for i in range(labellers)], axis=1)
    good = np.where((rows == BAD).any(axis=1), 0.1, 0.95)
    model = LabelModel(0.5, np.ones((labellers, 2, 3)))
    for _ in range(rounds):
        weight = np.stack([counts * good, counts * (1 - good)])
        chances = np.stack([[[weight[c][rows[:, i] == v].sum() for v in (GOOD, BAD)] for c in (0, 1)] for i in range(labellers)]) + 0.5
        chances = chances / chances.sum(axis=2, keepdims=True)
        share = (weight[1].sum() + 1) / (counts.sum() + 2)
        model = LabelModel(float(share), np.concatenate([chances, np.ones((labellers, 2, 1))], axis=2))
        new = model.posterior(rows)
        if np.abs(new - good).max(initial=0.0) < 1e-6:
            break
        good = new
    return model


_BUCKET = np.array([xxhash.xxh64_intdigest(f"shape:{i}") % DIMENSIONS for i in range(4096)])
_EDGES = np.array([0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.85, 0.95, 1.2, 2.0])
_STAT_BUCKET = np.array([[xxhash.xxh64_intdigest(f"{s}:{i}") % DIMENSIONS for i in range(64)] for s in STATS])


def features(text: str, stats: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values): trigrams of character classes by the root of their share, and each
    statistic by the interval it lies in. Both are hashed into DIMENSIONS buckets."""
    classes = np.frombuffer(text.encode("utf-8", "replace").translate(CLASS_OF), np.uint8).astype(np.int64)
    if len(classes) >= 3:
        counts = np.bincount(classes[:-2] * 256 + classes[1:-1] * 16 + classes[2:], minlength=4096)
        at = np.flatnonzero(counts)
        buckets, values = _BUCKET[at], np.sqrt(counts[at] / (len(classes) - 2))
    else:
        buckets, values = np.empty(0, np.int64), np.empty(0)
    bins = np.searchsorted(_EDGES, stats[1:])
    size = min(int(np.log2(stats[0] + 1)), 63)
    own = np.concatenate(([_STAT_BUCKET[0, size]], _STAT_BUCKET[np.arange(1, len(STATS)), bins]))
    return np.concatenate((buckets, own)), np.concatenate((values, np.full(len(own), 0.5)))


@dataclass
class Scorer:
    labels: LabelModel
    weights: np.ndarray
    bias: float

    def __call__(self, text: str) -> tuple[float, tuple[float, ...]]:
        stats = measured(text)
        if not stats[0]:
            return 0.0, stats
        buckets, values = features(text, stats)
        return float(1 / (1 + np.exp(-np.clip(self.weights[buckets] @ values + self.bias, -50, 50)))), stats


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, steps: int = STEPS) -> Scorer:
    """EM over the votes of all documents, then the scorer on posteriors of a bounded sample.

    The sample are the ``train_docs`` ids of least hash: one narrow pass over the ids finds them.
    """
    counted = pattern_counts(docs).toPandas().sort_values("pattern")
    labellers = votes(np.zeros((1, len(STATS)))).shape[1]
    labels = expectation_maximisation(counted["pattern"].to_numpy(np.int64), counted["n"].to_numpy(float), labellers)
    texts = documents(docs)
    chosen = texts.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            out = {"doc_id": [], "good": [], "buckets": [], "values": []}
            for doc_id, text in pairs(b):
                stats = measured(text)
                buckets, values = features(text, stats)
                good = labels.posterior(votes(np.array([stats])))[0]
                for name, v in zip(out, (doc_id, float(good), buckets, values.astype(np.float32))):
                    out[name].append(v)
            yield out

    # At most train_docs ids; of rows with the same id the one with the least text.
    one_each = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    sample = arrow_map(one_each, each, "doc_id long, good double, buckets array<int>, values array<float>")
    rows = sample.toPandas().sort_values("doc_id", kind="stable").reset_index(drop=True)
    if rows.empty:
        return Scorer(labels, np.zeros(DIMENSIONS), 0.0)
    weights, bias = logistic(list(rows["buckets"]), list(rows["values"]), rows["good"].to_numpy(float), steps)
    return Scorer(labels, weights, bias)


def logistic(buckets: list, values: list, target: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """Weights for soft targets, both classes weighted alike; adaptive full-batch steps."""
    row = np.repeat(np.arange(len(buckets)), [len(b) for b in buckets])
    at, x = np.concatenate(buckets).astype(np.int64), np.concatenate(values).astype(float)
    good, bad = max(target.sum(), 1e-3), max((1 - target).sum(), 1e-3)
    weight = target * 0.5 / good + (1 - target) * 0.5 / bad
    w, b, gw, gb = np.zeros(DIMENSIONS), 0.0, np.full(DIMENSIONS, 1e-10), 1e-10
    for _ in range(steps):
        z = np.bincount(row, x * w[at], minlength=len(target)) + b
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight
        grad = np.bincount(at, x * d[row], minlength=DIMENSIONS) + 1e-6 * w
        gw, gb = gw + grad * grad, gb + d.sum() ** 2
        w -= 0.3 * grad / np.sqrt(gw)
        b -= 0.3 * d.sum() / np.sqrt(gb)
    return w, float(b)


def scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """A row per document: doc_id, score, weak_score, kept.

    ``score`` is the linear scorer's probability of good quality, ``weak_score`` the posterior
    of the votes alone; from a score of 0.5 on a document is kept. Whole texts are read. A text
    without words (null, empty) scores 0 and goes. Repeated rows and null ids are scored like
    any other; no other column is read; an empty table gives an empty one.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            rows = list(pairs(b))
            found = [scorer(t) for _, t in rows]
            stats = np.array([s for _, s in found]).reshape(-1, len(STATS))
            yield {
                "doc_id": [r[0] for r in rows],
                "score": [s for s, _ in found],
                "weak_score": scorer.labels.posterior(votes(stats)).tolist(),
                "kept": [s >= THRESHOLD for s, _ in found],
            }

    return arrow_map(documents(docs), each, "doc_id long, score double, weak_score double, kept boolean")


def good(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as given.

    Rows are judged as by :func:`scored`: texts without words (null, empty) go, repeated rows stay
    or go together, whole texts are read, an empty table gives an empty one.
    """
    return filtered(docs, lambda: lambda texts: [scorer(t)[0] >= THRESHOLD for t in texts])
