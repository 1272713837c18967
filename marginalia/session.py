"""A session with the settings the plans count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "marginalia", **settings: str) -> SparkSession:
    """UTC, adaptive execution with skew handling; anything else by keyword, dots as double underscores."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
