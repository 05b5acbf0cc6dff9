"""Query tags: a list of (SOURCE, KEY, VALUE) entries and its map-of-maps form.

All of it is built-in map and array expressions; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterlight.functions.timeops import to_col

TAG_SCHEMA = "array<struct<SOURCE:string,KEY:string,VALUE:string>>"
TAG_COMMENT = r"/\*\s*(\[\s*\{.*?\}\s*\])\s*\*/"
UNDEFINED = "undefined"


def extract_tags(text: Column | str) -> Column:
    """Tag list written as a JSON array inside a SQL comment; NULL when absent or malformed."""
    payload = F.regexp_extract(to_col(text), "(?s)" + TAG_COMMENT, 1)
    return F.when(payload != "", F.from_json(payload, TAG_SCHEMA))


def tags_to_map(tags: Column | str) -> Column:
    """``source -> key -> value``; the last entry of a repeated key wins, NULL stays NULL.

    The list is walked once, so it may be an expression that parses text.
    """
    inner_type = "map<string,string>"
    outer_type = f"map<string,{inner_type}>"

    def put(acc, t):
        source = F.coalesce(t["SOURCE"], F.lit(UNDEFINED))
        key = F.coalesce(t["KEY"], F.lit(UNDEFINED))
        held = F.coalesce(F.try_element_at(acc, source), F.create_map().cast(inner_type))
        own = F.map_concat(F.map_filter(held, lambda k, _: k != key), F.create_map(key, t["VALUE"]))
        rest = F.map_filter(acc, lambda k, _: k != source)
        return F.map_concat(rest, F.create_map(source, own)).cast(outer_type)

    return F.aggregate(to_col(tags), F.create_map().cast(outer_type), put)


def tag_value(tag_map: Column | str, source: str, key: str) -> Column:
    return F.try_element_at(F.try_element_at(to_col(tag_map), F.lit(source)), F.lit(key))


def tag_exists(tag_map: Column | str, source: str, key: str) -> Column:
    entry = F.try_element_at(to_col(tag_map), F.lit(source))
    return F.coalesce(F.map_contains_key(entry, F.lit(key)), F.lit(False))


def tag_equals(tag_map: Column | str, source: str, key: str, value: str) -> Column:
    return F.coalesce(tag_value(tag_map, source, key) == value, F.lit(False))


def tag_matches(
    tag_map: Column | str, source: str, key: str, pattern: str, flags: str = ""
) -> Column:
    """Whole-value regular expression match; false when the tag is missing."""
    inline = f"(?{flags})" if flags else ""
    found = tag_value(tag_map, source, key).rlike(f"{inline}^(?:{pattern})$")
    return F.coalesce(found, F.lit(False))


def tag_keys(tag_map: Column | str, source: str) -> Column:
    """Sorted keys of a source, NULL when the source is missing."""
    return F.array_sort(F.map_keys(F.try_element_at(to_col(tag_map), F.lit(source))))


def tag_sources(tag_map: Column | str) -> Column:
    """Sorted sources of a tag map."""
    return F.array_sort(F.map_keys(to_col(tag_map)))
