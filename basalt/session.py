"""Session with the settings that the dataflows rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive plans split skewed joins and merge small partitions; ANSI mode stays on, casts are safe by expression.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.orc.filterPushdown": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "static",
    "spark.sql.sources.bucketing.enabled": "true",
}


def build_session(app: str = "basalt", **settings: str) -> SparkSession:
    """A session; ``settings`` are Spark's names with dots as double underscores."""
    builder = SparkSession.builder.appName(app)
    for name, value in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
