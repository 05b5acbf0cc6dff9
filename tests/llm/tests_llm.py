"""Rows that every operator is tried on."""

import os

VOCABULARIES = "/opt/tokenizers"

# Nulls in every column, empty and blank texts, ties, repeated rows, a very long text.
ROWS = [
    (1, "the cat sat on the mat and looked at the dog all day long", "en", "a", 1.0),
    (2, "the cat sat on the mat and looked at the dog all day long", "en", "a", None),
    (2, "the cat sat on the mat and looked at the dog all day long", "en", "a", None),
    (3, "", "en", None, 0.0),
    (4, None, None, None, None),
    (None, "the cat sat on the mat and looked at the dog all day long", "en", "b", 2.0),
    (None, None, "de", "b", 2.0),
    (5, "  \t\n ", "de", "b", 2.0),
    (6, "Ein Hund\tund eine Katze  liefen\n\n über die Straße İ Σίσυφος ΑΣ", "de", "c", 3.0),
    (7, "short", "en", "c", 3.0),
    (8, "word " * 30_000, "en", "c", 3.0),
    (9, "12 345 <|endoftext|> don't we'll \u2003 x\x1cy\u0085z \u00a0 <|startoftext|>!", None, "c", 3.0),
]


def frame(spark, rows=ROWS):
    """Documents with columns whose names operators use themselves."""
    return spark.createDataFrame(
        [(*r, True, "h", "row") for r in rows],
        "doc_id long, text string, lang string, source string, score double, kept boolean, h string, `row` string",
    )


def sf(name="sf0.001"):
    return os.path.join("/root/testdata", name)
