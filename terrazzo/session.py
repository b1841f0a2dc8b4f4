"""Session factory: UTC, ANSI and adaptive execution on; partitions follow the cores it is given."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "terrazzo", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {}) | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
