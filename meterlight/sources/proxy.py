"""Log of the query proxy: raw record to typed columns, and the filter to one tenant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Cloud regions whose proxy spelling differs from the account's.
AZURE_REGIONS = {
    "AZURE_EASTUS2": "EAST-US-2",
    "AZURE_WESTEUROPE": "WEST-EUROPE",
    "AZURE_AUSTRALIAEAST": "AUSTRALIA-EAST",
    "AZURE_CANADACENTRAL": "CANADA-CENTRAL",
    "AZURE_SOUTHEASTASIA": "SOUTHEAST-ASIA",
    "AZURE_WESTUS2": "WEST-US-2",
    "AZURE_SWITZERLANDN": "SWITZERLAND-NORTH",
    "AZURE_CENTRALUS": "CENTRAL-US",
    "AZURE_JAPANEAST": "JAPAN-EAST",
    "AZURE_NORTHEUROPE": "NORTH-EUROPE",
    "AZURE_SOUTHCENTRALUS": "SOUTH-CENTRAL-US",
    "AZURE_UAENORTH": "UAE-NORTH",
    "AZURE_CENTRALINDIA": "CENTRAL-INDIA",
    "AZURE_UKSOUTH": "UK-SOUTH",
}

PASS_THROUGH = (
    "query_id", "proxy_query_id", "broker_name", "query_text_received", "query_text_final",
    "updated_warehouse_target", "status", "error_code", "error_message", "user_name",
    "role_name", "starting_warehouse", "workload_tag", "session_id", "account_id",
)


def proxy_log(raw: DataFrame) -> DataFrame:
    """Epoch microseconds to timestamps, and the nested action record picked apart.

    ``raw_actions`` is JSON text. A value that is not JSON gives NULLs, not an error.
    """
    actions = F.try_parse_json("raw_actions")

    def at(name):
        return F.timestamp_micros(F.col(name)).cast("timestamp_ntz")

    return raw.select(
        *[c for c in PASS_THROUGH if c in raw.columns],
        at("raw_start_time").alias("proxy_start_time"),
        at("raw_submission_time").alias("submission_time"),
        at("raw_end_time").alias("end_time"),
        F.to_json(F.variant_get(actions, "$.ACTIONS_APPLIED", "array<string>")).alias(
            "actions_executed"
        ),
        F.try_variant_get(actions, "$.ACTIONS_INPUT.SCHEMA_ONLY_REQUEST", "boolean").alias(
            "schema_only_request"
        ),
    )


def region_keys(regions: DataFrame) -> DataFrame:
    """Region table (account_region, cloud, region) with the proxy's spelling added."""
    fix = None
    for name, spelling in AZURE_REGIONS.items():
        cond = F.col("account_region") == name
        fix = F.when(cond, F.lit(spelling)) if fix is None else fix.when(cond, F.lit(spelling))
    return regions.select("account_region", "cloud", "region", fix.alias("azure_region"))


def tenant_filter(df: DataFrame, regions: DataFrame, account: str, region: str) -> DataFrame:
    """Rows whose tenant key equals the one built for this account and region.

    The region part after the last dot names the row of the region table. A region has one
    key, so the broadcast is of a single row.
    """
    wanted = region.split(".")[-1]
    spelled = F.col("azure_region") if region.startswith("AZURE") else F.col("region")
    key = (
        region_keys(regions)
        .filter(F.col("account_region") == wanted)
        .select(F.concat(F.lit(account), spelled, F.col("cloud")).alias("tenant_key"))
        .distinct()
    )
    return df.join(F.broadcast(key), "tenant_key", "left_semi")
