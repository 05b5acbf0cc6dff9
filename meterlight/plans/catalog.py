"""Imports every module that registers queries."""

from meterlight.plans import history, reports, rules, state, streams, upkeep, usage
from meterlight.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "history", "reports", "rules", "state", "streams", "upkeep", "usage"]
