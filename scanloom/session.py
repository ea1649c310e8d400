"""Session settings that the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "scanloom", **settings: str) -> SparkSession:
    """A session with these settings; master, memory and partitions are the cluster's own."""
    return SparkSession.builder.appName(name).config(map=SETTINGS | settings).getOrCreate()
