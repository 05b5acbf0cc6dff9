"""Duration buckets used by the session histograms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterlight.functions.timeops import boundaries, to_col

# Upper bound in seconds and name of each duration bucket.
BUCKETS = (
    (180, "<3 minutes"),
    (600, "3-10 minutes"),
    (3_600, "10 minutes - 1 hour"),
    (14_400, "1 to 4 hours"),
    (86_400, "4-24 hours"),
    (604_800, "1-7 days"),
    (2_592_000, "7-30 days"),
)
LONGEST = ">30 days"


def _pick(amount: Column, per_second: int, results: list, last) -> Column:
    out = None
    for (bound, _), result in zip(BUCKETS, results):
        cond = amount < bound * per_second
        out = F.when(cond, F.lit(result)) if out is None else out.when(cond, F.lit(result))
    return out.otherwise(F.lit(last))


def friendly_duration(start: Column | str, end: Column | str | None = None) -> Column:
    """Bucket name of a duration in milliseconds, or of the span between two timestamps.

    A NULL duration falls through to the longest bucket, as the reports expect.
    """
    names = [name for _, name in BUCKETS]
    if end is None:
        return _pick(to_col(start), 1000, names, LONGEST)
    return _pick(boundaries("second", start, end), 1, names, LONGEST)


def friendly_duration_ordinal(ms: Column | str) -> Column:
    """Position of the bucket, 0 for the shortest."""
    return _pick(to_col(ms), 1000, list(range(len(BUCKETS))), len(BUCKETS))
