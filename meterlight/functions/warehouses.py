"""Compute sizes, credits and prices.

The size table has ten fixed rows, so it is a constant map inside the projection: no join, no
exchange, and the size is looked at once per row in the stage of the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterlight.config import (
    CREDITS_PER_HOUR,
    DEFAULT,
    OPTIMIZED_SIZES,
    SERVERLESS_ID_FLOOR,
    SERVERLESS_NAME_PREFIX,
    UNITS_PER_CREDIT,
    EngineConfig,
)
from meterlight.functions.timeops import to_col


def credits_per_hour(size: Column | str) -> Column:
    """Whole credits per hour of a size, NULL when the size is unknown."""
    entries = [F.lit(x) for pair in CREDITS_PER_HOUR.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), to_col(size)).cast("bigint")


def warehouse_multiplier(size: Column | str, kind: Column | str | None = None) -> Column:
    """Credits per hour of a size and type; NULL when that combination does not exist."""
    rate = credits_per_hour(size).cast("double")
    if kind is None:
        return rate
    size, kind = to_col(size), to_col(kind)
    optimized = (kind == "SNOWPARK-OPTIMIZED") & size.isin(list(OPTIMIZED_SIZES))
    return F.when(kind == "STANDARD", rate).when(optimized, rate * 1.5)


def credits_per_milli(size: Column | str, kind: Column | str | None = None) -> Column:
    """Credits per millisecond, 0 for unknown sizes."""
    return F.coalesce(warehouse_multiplier(size, kind), F.lit(0.0)) / 3600 / 1000


def is_serverless_id(warehouse_id: Column | str) -> Column:
    return to_col(warehouse_id) > SERVERLESS_ID_FLOOR


def is_serverless_name(name: Column | str) -> Column:
    return to_col(name).startswith(SERVERLESS_NAME_PREFIX)


def credit_price(warehouse_id: Column | str | None = None, cfg: EngineConfig = DEFAULT) -> Column:
    """Price of one credit; serverless compute has its own."""
    if warehouse_id is None:
        return F.lit(cfg.compute_price)
    return F.when(is_serverless_id(warehouse_id), F.lit(cfg.serverless_price)).otherwise(
        F.lit(cfg.compute_price)
    )


def credit_units(ms: Column, load_percent: Column, size: Column, kind: Column) -> Column:
    """Work of a span in whole credit units.

    The type factor is 1 for STANDARD and 1.5 otherwise (NULL included); doubled here to stay
    whole. Unknown sizes cost nothing.
    """
    doubled = F.when(kind == "STANDARD", F.lit(2)).otherwise(F.lit(3)).cast("bigint")
    rate = F.coalesce(credits_per_hour(size), F.lit(0).cast("bigint"))
    return ms * load_percent.cast("bigint") * rate * doubled


def units_to_credits(units: Column | str) -> Column:
    return to_col(units).cast("double") / F.lit(float(UNITS_PER_CREDIT))


def row_cost(units: Column | str, warehouse_id: Column | str, cfg: EngineConfig = DEFAULT) -> Column:
    """Price of the work in one row."""
    units = to_col(units).cast("double")
    return units * credit_price(warehouse_id, cfg) / F.lit(float(UNITS_PER_CREDIT))


def total_cost(units: Column | str, warehouse_id: Column | str, cfg: EngineConfig = DEFAULT) -> Column:
    """Aggregate: price of all rows of a group, exact whatever the order of the rows.

    Units of both price classes are summed as integers and priced once.
    """
    units, serverless = to_col(units), is_serverless_id(warehouse_id)
    zero = F.lit(0).cast("bigint")
    compute = F.sum(F.when(serverless, zero).otherwise(units)).cast("double")
    other = F.sum(F.when(serverless, units).otherwise(zero)).cast("double")
    price = compute * F.lit(cfg.compute_price) + other * F.lit(cfg.serverless_price)
    return price / F.lit(float(UNITS_PER_CREDIT))
