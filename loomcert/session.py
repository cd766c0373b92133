"""A session with the settings that the queries count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "loomcert", cores: int | None = None, memory: str = "8g", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution. With `cores`, a local one that shuffles into as many partitions."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    if cores:
        builder = builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(cores)).config("spark.driver.memory", memory)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
