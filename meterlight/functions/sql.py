"""The functions as SQL functions of a session, for use in rule texts and ad-hoc SQL.

They are SQL expressions that Spark inlines into the plan, so a predicate that calls them is
optimized like one written out.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from meterlight.config import (
    CREDITS_PER_HOUR,
    DEFAULT,
    OPTIMIZED_SIZES,
    SERVERLESS_ID_FLOOR,
    SERVERLESS_NAME_PREFIX,
    EngineConfig,
)
from meterlight.functions.durations import BUCKETS, LONGEST
from meterlight.functions.grades import BYTES_BOUNDS, GB, ROWS_BOUNDS, TIME_BOUNDS_MS, TIME_GRADES

TAG_MAP = "MAP<STRING, MAP<STRING, STRING>>"


def _ladder(value: str, bounds, results, last: str) -> str:
    steps = " ".join(f"WHEN {value} < {b} THEN {r}" for b, r in zip(bounds, results))
    return f"CASE {steps} ELSE {last} END"


def definitions(cfg: EngineConfig = DEFAULT) -> dict[str, tuple[str, str, str]]:
    """Name to (parameters, return type, body)."""
    sizes = " ".join(f"WHEN '{s}' THEN {c}" for s, c in CREDITS_PER_HOUR.items())
    rate = f"CASE size {sizes} END"
    optimized = ", ".join(f"'{s}'" for s in OPTIMIZED_SIZES)
    multiplier = (
        f"CASE WHEN kind = 'STANDARD' THEN {rate} * 1.0D"
        f" WHEN kind = 'SNOWPARK-OPTIMIZED' AND size IN ({optimized}) THEN {rate} * 1.5D END"
    )
    millis = [b * 1000 for b, _ in BUCKETS]
    entry = "try_element_at(try_element_at(tags, source), key)"
    return {
        "warehouse_multiplier": ("size STRING, kind STRING", "DOUBLE", multiplier),
        "warehouse_credits_per_milli": (
            "size STRING, kind STRING", "DOUBLE", f"coalesce({multiplier}, 0D) / 3600 / 1000",
        ),
        "is_serverless_warehouse": ("id BIGINT", "BOOLEAN", f"id > {SERVERLESS_ID_FLOOR}"),
        "is_serverless_warehouse_name": (
            "name STRING", "BOOLEAN", f"startswith(name, '{SERVERLESS_NAME_PREFIX}')",
        ),
        "get_credit_cost": (
            "id BIGINT", "DOUBLE",
            f"CASE WHEN id > {SERVERLESS_ID_FLOOR} THEN {cfg.serverless_price}D ELSE {cfg.compute_price}D END",
        ),
        "get_storage_cost": ("", "DOUBLE", f"{cfg.storage_price}D"),
        "friendly_duration": (
            "ms BIGINT", "STRING",
            _ladder("ms", millis, [f"'{n}'" for _, n in BUCKETS], f"'{LONGEST}'"),
        ),
        "friendly_duration_ordinal": (
            "ms BIGINT", "INT", _ladder("ms", millis, range(len(BUCKETS)), str(len(BUCKETS))),
        ),
        "emonth": ("ts TIMESTAMP_NTZ", "INT", "(year(ts) - 1970) * 12 + month(ts) - 1"),
        "qtag": (
            f"tags {TAG_MAP}, source STRING, key STRING, value STRING", "BOOLEAN",
            f"coalesce({entry} = value, false)",
        ),
        "qtag_exists": (
            f"tags {TAG_MAP}, source STRING, key STRING", "BOOLEAN",
            "coalesce(map_contains_key(try_element_at(tags, source), key), false)",
        ),
        "qtag_value": (f"tags {TAG_MAP}, source STRING, key STRING", "STRING", entry),
        "qtag_keys": (
            f"tags {TAG_MAP}, source STRING", "ARRAY<STRING>",
            "array_sort(map_keys(try_element_at(tags, source)))",
        ),
        "qtag_sources": (f"tags {TAG_MAP}", "ARRAY<STRING>", "array_sort(map_keys(tags))"),
        "qtag_matches": (
            f"tags {TAG_MAP}, source STRING, key STRING, pattern STRING", "BOOLEAN",
            f"coalesce(rlike({entry}, concat('^(?:', pattern, ')$')), false)",
        ),
        "model_run_time": (
            "ms BIGINT", "STRING",
            _ladder("ms", TIME_BOUNDS_MS, [f"'{g}'" for g in TIME_GRADES], f"'{TIME_GRADES[-1]}'"),
        ),
        "model_size_bytes": ("size BIGINT", "INT", _ladder("size", BYTES_BOUNDS, range(4), "4")),
        "model_size_rows": ("amount BIGINT", "INT", _ladder("amount", ROWS_BOUNDS, range(4), "4")),
        "model_size": (
            "by_rows INT, by_bytes INT", "STRING",
            "CASE WHEN by_rows IS NULL OR by_bytes IS NULL THEN 'XL'"
            " ELSE element_at(array('XS', 'S', 'M', 'L', 'XL'), greatest(by_rows, by_bytes) + 1) END",
        ),
        "model_efficiency": (
            "local BIGINT, remote BIGINT", "STRING",
            "CASE WHEN local = 0 AND remote = 0 THEN 'Good'"
            f" WHEN local <= {5 * GB} AND remote = 0 THEN 'Acceptable'"
            f" WHEN local > {5 * GB} AND remote = 0 THEN 'Poor' ELSE 'VeryPoor' END",
        ),
    }


def register_functions(spark: SparkSession, cfg: EngineConfig = DEFAULT) -> list[str]:
    """Creates the functions for this session and returns their names."""
    found = definitions(cfg)
    for name, (params, returns, body) in found.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")
    return sorted(found)
