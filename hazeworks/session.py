"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "hazeworks", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; everything else is the cluster's."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
