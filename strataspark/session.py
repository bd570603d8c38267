"""Session settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that results or scale depend on. Partition counts are the cluster's.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int = 8, memory: str = "8g", app: str = "strataspark") -> SparkSession:
    """A session on this machine, for tests, benchmarks and the command line."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    builder = builder.config("spark.driver.memory", memory).config("spark.ui.enabled", "false")
    builder = builder.config("spark.sql.shuffle.partitions", str(cores)).config("spark.ui.showConsoleProgress", "false")
    return builder.config(map=SETTINGS).getOrCreate()
