"""Streaming transformations: a streaming DataFrame in, a streaming DataFrame out.

None of them keeps a watermark on the time of an event: rows of a log arrive when they arrive,
and what a late one changes is decided by the tables in :mod:`meterlight.streaming.tables`.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlight.operators.monitors import Probe, match_probes


def stream_probe_matches(live: DataFrame, probes: Iterable[Probe]) -> DataFrame:
    """Rule matches of a live feed, every time the feed shows the query.

    The rules are one projection, so nothing is joined and no state is kept: that each fires
    once per query is left to the action log.
    """
    return match_probes(live, probes)


def stream_finished(queries: DataFrame) -> DataFrame:
    """The finished rows of a query log; running ones carry an end before their start."""
    return queries.filter(F.col("start_time") <= F.col("end_time"))
