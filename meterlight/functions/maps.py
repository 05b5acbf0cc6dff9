"""Merging of string maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterlight.functions.timeops import to_col


def merge_objects(a: Column | str, b: Column | str) -> Column:
    """Both maps; the second wins on a shared key."""
    return F.map_zip_with(
        to_col(a),
        to_col(b),
        lambda k, x, y: F.when(F.map_contains_key(to_col(b), k), y).otherwise(x),
    )


def merge_concat_objects(a: Column | str, b: Column | str) -> Column:
    """Both maps; values of a shared key are joined with a comma unless the first is empty."""
    b = to_col(b)

    def join(k, x, y):
        both = F.map_contains_key(b, k) & (F.coalesce(x, F.lit("")) != "")
        return (
            F.when(both, F.concat(x, F.lit(","), F.coalesce(y, F.lit("null"))))
            .when(F.map_contains_key(b, k), y)
            .otherwise(x)
        )

    return F.map_zip_with(to_col(a), b, join)
