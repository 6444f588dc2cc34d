"""Sessions with the settings that the queries assume."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "marlspark", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """UTC, adaptive execution, partitions sized to the cores; on a cluster the submitted settings hold."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        cores = os.environ.get("BENCH_CPUS", "8")
        builder = builder.master(master).config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
    return builder.getOrCreate()
