"""A session with the settings that the library's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, *, app: str = "corvane", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution and Arrow transfer; everything else is the cluster's."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
