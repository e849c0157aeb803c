"""Session settings that the engine is planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "cellframe", **settings: str) -> SparkSession:
    """A session with adaptive plans, skewed joins split, Arrow batches bounded and ANSI arithmetic."""
    builder = SparkSession.builder.appName(name)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
