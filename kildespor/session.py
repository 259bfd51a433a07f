"""A session with settings that suit these queries; any Spark session will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **settings: str) -> SparkSession:
    """Adaptive execution with skew handling; ``settings`` are Spark's, with __ for dots."""
    builder = SparkSession.builder.appName("kildespor")
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    given = {k.replace("__", "."): v for k, v in settings.items()}
    return builder.config(map=defaults | given).getOrCreate()
