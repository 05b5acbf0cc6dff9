"""Benchmark decontamination against a plain search over all words, and on odd rows."""

import random
import re

import numpy as np

from meterlight.llm import decontamination as d
from meterlight.llm.words import rolled, word_hashes, word_spans

WORDS = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {65 + i: 97 + i for i in range(26)}


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - 9, min(len(w), 1))):
            windows.setdefault(tuple(w[i : i + 10]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if own := windows.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= own
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(*r, 1, "w", 2) for r in docs], "doc_id long, text string, row long, words string, n_words long"),
        spark.createDataFrame([(*r, "w", 3) for r in items], "item_id long, text string, words string, window long"),
    )


def check(spark, docs, items):
    found = d.contaminated(*frames(spark, docs, items))
    assert sorted([(r[0], r[1], r[2], list(r[3])) for r in found.collect()], key=str) == plain(docs, items)


def test_against_plain_search(spark):
    rng = random.Random(1)
    few = [f"w{i}" for i in range(12)]
    many = [f"word{i}" for i in range(400)] + ["Straße", "naïve", "日本語", "x" * 30, "İ"]

    def text(n, of):
        return "".join(rng.choice(of) + rng.choice([" ", "  ", ", ", ".\n", " - "]) for _ in range(n))

    items = [(i, text(rng.randint(0, 30), many if i % 2 else few)) for i in range(40)]
    docs = []
    for i in range(120):
        parts = [text(rng.randint(0, 60), few if i % 3 else many)]
        for _ in range(rng.randint(0, 3)):
            own = words(rng.choice(items)[1])
            at = rng.randint(0, max(len(own) - 8, 0))
            parts += [" ".join(own[at : at + rng.randint(5, 25)]).upper(), text(rng.randint(0, 9), many)]
        docs.append((i, " ".join(parts)))
    check(spark, docs, items)


def test_odd_rows(spark):
    item = "The quick brown fox jumps over the lazy dog, and then it sleeps for a while."
    items = [(1, item), (1, item), (10, item), (2, "two words"), (3, "One"), (4, ""), (5, None), (None, "no id here"), (6, " .,: \t"), (7, "a a a a a a a a a a a a")]
    docs = [
        (1, item), (1, item), (None, item.lower()), (2, None), (3, ""), (4, " .. "), (5, "two   WORDS"), (6, "words two"), (7, "One"), (None, None),
        (8, "a " * 50), (9, "a " * 9), (10, "the quick brown fox jumps over the lazy dog and"), (11, "the quick brown fox jumps over the lazy dog an"),
        (12, "x" * 3_000_000 + " no id here"), (13, "word " * 30_000 + item + " word" * 30_000), (14, "no\x00id\x7fhere"), (15, "no id hereé"),
    ]
    check(spark, docs, items)


def test_empty_tables(spark):
    item, doc = [(1, "a b c")], [(1, "a b c"), (2, None)]
    check(spark, [], item)
    check(spark, doc, [])
    check(spark, doc, [(1, None), (2, "...")])
    check(spark, [], [])


def test_a_passage_most_documents_share(spark):
    passage = " ".join(f"common{i}" for i in range(60))
    docs = [(i, f"own{i} {passage} end{i}") for i in range(2_000)] + [(5_000, (passage + " ") * 50)]
    check(spark, docs, [(i, passage) for i in range(30)] + [(99, "own7 common0")])


def test_words_and_their_hashes():
    texts = ["", "a", "abcdefgh", "abcdefghi", "x" * 1_000, "é" * 5, "a b", "ab" * 20]
    data = " ".join(texts).encode()
    flags = np.array([b != 32 for b in range(256)])
    starts, ends = word_spans(data, flags)
    found = [data[s:e].decode() for s, e in zip(starts, ends)]
    assert found == " ".join(texts).split()
    hashes = word_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len(set(found))
    # The same wherever the word stands, and words of the Thue-Morse rule differ.
    morse = ["a", "b"]
    for _ in range(10):
        morse = [morse[0] + morse[1], morse[1] + morse[0]]
    data = " ".join([morse[0], "abcdefghi", morse[1], morse[0]]).encode()
    h = word_hashes(data, *word_spans(data, flags))
    assert h[1] in hashes and h[0] == h[3] != h[2]
    assert len(rolled(h, 5)) == 0 and len(rolled(h, 4)) == 1


def test_a_word_over_the_border_of_a_step():
    flags = np.array([b != 32 for b in range(256)])
    for n in (-2, -1, 0, 1, 2):
        data = b"a" * (d.STEP + n) + b" bb"
        starts, ends = word_spans(data, flags)
        assert list(zip(starts.tolist(), ends.tolist())) == [(0, d.STEP + n), (d.STEP + n + 1, d.STEP + n + 3)]
