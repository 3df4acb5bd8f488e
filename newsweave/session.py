"""Session defaults and the folder shared by driver and executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job needs for right results, and settings that only tune.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}
TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set the session options results depend on; safe to call repeatedly."""
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "newsweave", **options: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**REQUIRED, **TUNING, **options}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name under the cluster's ``spark.checkpoint.dir``.

    Files written by one task must be readable by another, so a machine-local
    folder is used only when driver and executors are one local process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="newsweave-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
