"""Quality rules whose cutoffs are chosen under a guarantee; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlight.llm.common import held

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
REPEAT_WINDOW = 8

#: What is compared with a cutoff, in whole per mille.
SIGNALS = ("symbols", "dup_lines", "repeats", "long_words")
#: Cutoffs that are tried for each signal, per mille; fixed before any data are seen.
GRID = tuple(range(10, 100, 10)) + tuple(range(100, 1001, 50)) + (2000, 5000)
#: In each stratum at most this share of good documents is rejected ...
RISK = 0.04
#: ... in all strata at once with at least this certainty.
CONFIDENCE = 0.95


def _kept_apart(df: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """Columns that later expressions read as values. Merged into them, an array named inside a
    lambda would be computed again for each element; the optimizer does not merge over ``inline``."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and stratum (lang, empty if null or not given) with n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, n_lines (all long).

    Windows are compared by a 64-bit hash of their words' hashes. Only texts with a window that
    occurs again sort theirs; the positions they cover are then added up window by window.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("stratum"), text.alias("text"))
    cut = _kept_apart(
        given,
        "doc_id",
        "stratum",
        words=F.filter(F.split("text", SPACE), lambda w: w != ""),
        lines=F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        n_symbols=F.regexp_count("text", F.lit(SYMBOLS)).cast("long"),
    )
    counted = _kept_apart(
        cut,
        "doc_id",
        "stratum",
        "n_symbols",
        h=F.transform("words", lambda w: F.xxhash64(w)),
        word_chars=F.length(F.array_join("words", "")).cast("long"),
        n_words=F.size("words").cast("long"),
        n_lines=F.size("lines").cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
    )
    done = ("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines")
    # Hashes of two, four and then eight words, each from two of the step before.
    cut = counted
    for step in (1, 2, 4):
        rest = F.greatest(F.size("h") - step, F.lit(0))
        cut = _kept_apart(cut, *done, h=F.zip_with(F.slice("h", F.lit(1), rest), F.slice("h", F.lit(step + 1), rest), lambda a, b: F.xxhash64(a, b)))
    cut = cut.withColumnRenamed("h", "windows")
    # (hash, position) in order of the hash: equal windows are neighbours.
    ordered = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    cut = _kept_apart(cut, *done, ordered=F.when(F.size(F.array_distinct("windows")) < F.size("windows"), ordered))
    again = F.filter("ordered", lambda x, j: ((j > 0) & (F.get("ordered", j - 1)["h"] == x["h"])) | F.coalesce(F.get("ordered", j + 1)["h"] == x["h"], F.lit(False)))
    # Positions of windows that occur again, in order; each covers up to where the next one starts.
    covered = F.aggregate(
        F.sort_array(F.transform(again, lambda x: x["i"])),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-REPEAT_WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(i - a["last"], F.lit(REPEAT_WINDOW))).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    return cut.select(*done, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _signals() -> dict[str, Column]:
    """Per mille, rounded down: symbols a word, repeated lines and words, and mean word length over ten."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return {
        "symbols": F.expr("n_symbols * 1000") / words,
        "dup_lines": F.expr("n_dup_lines * 1000") / lines,
        "repeats": F.expr("n_repeat_words * 1000") / words,
        "long_words": F.expr("word_chars * 100") / words,
    }


def with_signals(df: DataFrame) -> DataFrame:
    return df.withColumns({f"s_{k}": F.floor(v) for k, v in _signals().items()})


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X binomial (n, p), exactly summed; terms by recurrence, in logarithms."""
    import math

    odds, none = math.log(p / (1 - p)), math.log(1 - p)
    step = lambda a, j: F.struct(
        (a["term"] + F.log(n - j + 1) - F.log(j.cast("double")) + F.lit(odds)).alias("term"),
        (a["sum"] + F.exp(a["term"] + F.log(n - j + 1) - F.log(j.cast("double")) + F.lit(odds))).alias("sum"),
    )
    start = F.struct((n * F.lit(none)).alias("term"), F.exp(n * F.lit(none)).alias("sum"))
    return F.when(k < 1, F.exp(n * F.lit(none))).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))), start, step, lambda a: a["sum"]))


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """(stratum, cut_<signal>...): the lowest cutoff of each signal that is proven safe, or null.

    ``measured`` has doc_id, stratum and the signals. The holdout are the labelled documents of
    quality 1. A cutoff rejects values above it. It is safe when, were the true share of good
    documents it rejects above ``risk / signals``, so few rejections in the holdout would have
    a probability (exact binomial) of at most ``(1 - confidence) / tests``; tests are all signals
    times cutoffs times strata. So every stratum loses at most ``risk`` of its good documents
    over all signals together. Documents labelled several times count once, as bad if any label
    says so. Without enough labels nothing is proven and nothing is rejected.
    """
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    holdout = measured.join(good, "doc_id", "left_semi")
    over = [F.sum((F.col(f"s_{s}") > g).cast("long")).alias(f"{s}_{g}") for s in SIGNALS for g in GRID]
    counted = holdout.groupBy("stratum").agg(F.count("*").alias("n"), *over)
    tests = F.count("*").over(_all()) * (len(SIGNALS) * len(GRID))
    flat = counted.withColumn("tests", tests).select(
        "stratum", "n", "tests", F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.lit(g).alias("cut"), F.col(f"{s}_{g}").alias("k")) for s in SIGNALS for g in GRID])).alias("t")
    ).select("stratum", "n", "tests", "t.*")
    share = risk / len(SIGNALS)
    # Beyond its expected count a tail is never small: no need to add it up.
    safe = flat.where(F.col("k") <= F.col("n") * share).where(binomial_tail(F.col("n"), F.col("k"), share) <= (1 - confidence) / F.col("tests"))
    return safe.groupBy("stratum").agg(*[F.min(F.when(F.col("signal") == s, F.col("cut"))).alias(f"cut_{s}") for s in SIGNALS])


def _all():
    from pyspark.sql import Window

    # Over one row a stratum, of which there are as many as languages.
    return Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def judged(docs: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """A row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept.

    A null text has no words and fails the base rules; a null lang is a stratum of its own.
    Repeated rows and null ids are judged like any other; an empty table gives an empty one.
    The texts are read once: the narrow counts are written and read again.
    """
    measured = held(with_signals(features(docs)), "quality-rules")
    cuts = cutoffs(measured, labels, risk, confidence)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rejected = F.lit(False)
    for s in SIGNALS:
        rejected = rejected | F.coalesce(F.col(f"s_{s}") > F.col(f"cut_{s}"), F.lit(False))
    return measured.join(cuts, "stratum", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~rejected).alias("kept")
    )
