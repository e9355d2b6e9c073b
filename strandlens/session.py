"""Session settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# UTC keeps wall-clock timestamps free of summer-time jumps; adaptive execution
# splits skewed joins and picks broadcasts by measured size.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(name: str = "strandlens", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
