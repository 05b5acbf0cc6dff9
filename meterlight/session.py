"""Session settings and the shared folder for written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "meterlight", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on.

    Timestamps are wall-clock UTC, so the session time zone is pinned. Shuffle width, memory
    and the checkpoint folder belong to the cluster and are only passed through.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def workspace(spark: SparkSession, name: str) -> str:
    """A new, empty location for written tables and stream checkpoints.

    It lies in the folder the cluster shares between executors, ``spark.checkpoint.dir``. A
    machine-local folder is only used when that is unset and the session itself is local.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix=f"meterlight-{name}-")
