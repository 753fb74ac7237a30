"""Session defaults shared by the CLI, the bench and the tests."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "pulsegrid", master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; ``master`` is left to the cluster when None."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master).config("spark.driver.memory", "8g")
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
