"""Session defaults: adaptive execution on, partitions sized by bytes rather than by a fixed count."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "terrane", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session tuned for the engine; on a cluster the master and memory come from spark-submit."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TERRANE_DRIVER_MEMORY", "8g"))
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()
