"""A session with the settings that the operators assume."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build(app: str = "kineplate", master: str | None = None, **settings: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; shuffle partitions follow the local cores unless given. A cluster's own settings win where master is None."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if master and master.startswith("local"):
        defaults["spark.sql.shuffle.partitions"] = str(os.cpu_count() or 8)
    for key, value in (defaults | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
