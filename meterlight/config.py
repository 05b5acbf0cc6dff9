"""Prices, compute sizes and other settings the operators take as arguments."""

from __future__ import annotations

from dataclasses import dataclass

# Credits per hour of each compute size.
CREDITS_PER_HOUR = {
    "X-Small": 1,
    "Small": 2,
    "Medium": 4,
    "Large": 8,
    "X-Large": 16,
    "2X-Large": 32,
    "3X-Large": 64,
    "4X-Large": 128,
    "5X-Large": 256,
    "6X-Large": 512,
}

# Sizes that also exist in the memory-optimized type, at 1.5 times the price.
OPTIMIZED_SIZES = (
    "Medium",
    "Large",
    "X-Large",
    "2X-Large",
    "3X-Large",
    "4X-Large",
    "5X-Large",
    "6X-Large",
)

# How sizes are spelled when a warehouse is altered.
SIZE_KEYWORDS = {
    "X-Small": "XSMALL",
    "Small": "SMALL",
    "Medium": "MEDIUM",
    "Large": "LARGE",
    "X-Large": "XLARGE",
    "2X-Large": "XXLARGE",
    "3X-Large": "XXXLARGE",
    "4X-Large": "X4LARGE",
    "5X-Large": "X5LARGE",
    "6X-Large": "X6LARGE",
    "Medium Snowpark": "MEDIUM",
    "Large Snowpark": "LARGE",
    "X-Large Snowpark": "XLARGE",
    "2X-Large Snowpark": "XXLARGE",
    "3X-Large Snowpark": "XXXLARGE",
    "4X-Large Snowpark": "X4LARGE",
}

# Lateness allowance in minutes and timestamp column of each source (0 = none).
SETTLE_DELAYS = {
    "QUERY_HISTORY": (180, "end_time"),
    "WAREHOUSE_EVENTS_HISTORY": (180, "timestamp"),
    "WAREHOUSE_LOAD_HISTORY": (180, "end_time"),
    "WAREHOUSE_METERING_HISTORY": (360, "end_time"),
    "USERS": (120, "created_on"),
    "SERVERLESS_TASK_HISTORY": (180, "end_time"),
    "TASK_HISTORY": (180, "completed_time"),
    "SESSIONS": (180, "created_on"),
    "TAGS": (0, ""),
    "TAG_REFERENCES": (0, ""),
    "OBJECT_DEPENDENCIES": (0, ""),
    "MATERIALIZED_VIEW_REFRESH_HISTORY": (180, "end_time"),
    "HYBRID_TABLE_USAGE_HISTORY": (180, "end_time"),
    "HYBRID_TABLES": (0, ""),
    "TABLE_STORAGE_METRICS": (0, ""),
    "LOGIN_HISTORY": (120, "event_timestamp"),
}

# Work is counted in whole "credit units" so that sums are exact and do not depend on the
# order in which partitions arrive: 1 ms of 1 % load on a compute that costs half a credit
# per hour is one unit.
UNITS_PER_CREDIT = 2 * 100 * 3600 * 1000

SERVERLESS_ID_FLOOR = 700_000
SERVERLESS_NAME_PREFIX = "COMPUTE_SERVICE_WH_USER_TASKS_POOL_"
SERVERLESS_LABEL = "Serverless Task"


@dataclass(frozen=True)
class EngineConfig:
    """Prices in currency per credit, and the time zone in which schedules are written."""

    compute_price: float = 2.0
    serverless_price: float = 3.0
    storage_price: float = 40.0
    time_zone: str = "America/Los_Angeles"


DEFAULT = EngineConfig()
