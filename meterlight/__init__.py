"""Usage and cost analytics for a shared data platform, as Spark DataFrame operators."""

from meterlight.config import EngineConfig
from meterlight.session import build_session, workspace

__all__ = ["EngineConfig", "build_session", "workspace"]
