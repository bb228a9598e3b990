"""Session settings that every entry point of the library shares."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that results depend on (time zone) or that suit any input size (AQE).
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, memory: str = "8g", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the one that is there."""
    os.environ.setdefault("TZ", "UTC")
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", memory)
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": str(shuffle_partitions), **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
