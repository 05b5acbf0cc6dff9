"""Query text: literals hashed out, fingerprints, referenced tables, message templates.

These work on tokens found by regular expressions; there is no SQL grammar here, so the
table list is approximate for unusual syntax.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterlight.functions.timeops import to_col

# A literal with a doubled quote is two tokens side by side. No pattern repeats a group over
# the characters of a literal, so matching needs no stack however long the literal is.
STRING_TOKEN = r"'[^']*'"
WORD_TOKEN = r"[A-Za-z_][A-Za-z_0-9$]*"
NUMBER_TOKEN = r"[0-9]+(?:\.[0-9]+)?"
TOKENS = rf"({STRING_TOKEN}|{WORD_TOKEN}|{NUMBER_TOKEN}|[^'A-Za-z_0-9]+|')"
# Literals and quoted names come first, as group 1: what looks like a comment in them is none.
COMMENTS = r"""(?s)('[^']*'|"[^"]*")|/\*.*?\*/|--[^\n]*"""
# Functions whose arguments may hold FROM.
FROM_CALL = r"(?i)\b(?:extract|trim|substring|overlay)\s*\([^()]*\)"
NAME_PART = r'(?:"[^"]+"|[A-Za-z_][A-Za-z_0-9$]*)'
TABLE_NAME = rf"{NAME_PART}(?:\.{NAME_PART})*"
NO_ALIAS = r"(?!(?:where|join|inner|left|right|full|cross|natural|on|using|group|order|having|limit|union|qualify|window)\b)"
TABLE_ITEM = rf"{TABLE_NAME}(?:\s+(?:as\s+)?{NO_ALIAS}{NAME_PART})?"
TABLE_LIST = rf"(?i)\b(?:from|join)\s+({TABLE_ITEM}(?:\s*,\s*{TABLE_ITEM})*)"
LISTED_NAME = rf"(?:^|,)\s*({TABLE_NAME})"
CTE_NAME = r"(?i)(?:\bwith\s+|,\s*)([A-Za-z_][A-Za-z_0-9$]*)\s+as\s*\("


def strip_comments(text: Column | str) -> Column:
    return F.regexp_replace(to_col(text), COMMENTS, "$1")


def hash_literals(text: Column | str, include_comments: bool = True) -> Column:
    """Query text with every literal replaced by its hash: equal literals stay equal."""
    source = to_col(text) if include_comments else strip_comments(text)
    tokens = F.regexp_extract_all(source, F.lit(TOKENS), F.lit(1))

    def swap(t):
        inner = F.substring(t, F.lit(2), F.length(t) - 2)
        number = F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint") % 1_000_000_000
        return (
            F.when((F.length(t) > 1) & t.startswith("'"), F.concat(F.lit("'"), F.md5(inner), F.lit("'")))
            .when(F.substring(t, 1, 1).between("0", "9"), number.cast("string"))
            .otherwise(t)
        )

    return F.array_join(F.transform(tokens, swap), "")


def fingerprint(text: Column | str, include_comments: bool = False) -> Column:
    """Hash of the query text without literals, case and spacing: same shape, same value."""
    source = to_col(text) if include_comments else strip_comments(text)
    shape = F.regexp_replace(source, STRING_TOKEN, "?")
    shape = F.regexp_replace(shape, r"\b" + NUMBER_TOKEN + r"\b", "?")
    shape = F.regexp_replace(shape, r"\?+", "?")
    shape = F.lower(F.trim(F.regexp_replace(shape, r"\s+", " ")))
    return F.md5(shape)


def referenced_tables(
    text: Column | str,
    database: Column | str,
    schema: Column | str,
    exclude_cte: bool = True,
) -> Column:
    """Distinct ``database.schema.table`` names after FROM and JOIN, comma lists included.

    Plain names come in upper case, quoted ones as written. Missing parts are filled in; names defined by WITH are left out unless asked for.
    """
    source = F.regexp_replace(F.regexp_replace(strip_comments(text), STRING_TOKEN, "''"), FROM_CALL, "()")
    database, schema = F.coalesce(to_col(database), F.lit("")), F.coalesce(to_col(schema), F.lit(""))

    def qualify(name):
        given = F.transform(
            F.regexp_extract_all(name, F.lit(f"({NAME_PART})"), F.lit(1)),
            lambda p: F.when(p.startswith('"'), F.substring(p, F.lit(2), F.length(p) - 2)).otherwise(F.upper(p)),
        )
        missing = F.slice(F.array(F.upper(database), F.upper(schema)), F.lit(1), F.greatest(3 - F.size(given), F.lit(0)))
        return F.concat_ws(".", missing, given)

    lists = F.regexp_extract_all(source, F.lit(TABLE_LIST), F.lit(1))
    listed = F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(x, F.lit(LISTED_NAME), F.lit(1))))
    names = F.transform(listed, qualify)
    if exclude_cte:
        ctes = F.transform(F.regexp_extract_all(source, F.lit(CTE_NAME), F.lit(1)), qualify)
        return F.array_sort(F.array_except(F.array_distinct(names), ctes))
    return F.array_sort(F.array_distinct(names))


def render(template: str, values: dict[str, Column]) -> Column:
    """Text with each ``{name}`` replaced; an unknown name is an error before anything runs."""
    parts = []
    for literal, name in re.findall(r"([^{]+|\{(?=[^{}]*$))|\{([^{}]+)\}", template):
        if name:
            if name not in values:
                raise KeyError(f"value not found for variable: {name}")
            parts.append(F.coalesce(values[name].cast("string"), F.lit("null")))
        else:
            parts.append(F.lit(literal))
    return F.concat(*parts) if parts else F.lit("")
