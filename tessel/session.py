"""The Spark session that tests, the bench and local use share."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "tessel", cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "4g", **conf: str) -> SparkSession:
    """A local session: UTC, adaptive execution, Arrow. A cluster passes its own session instead; operators take any."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    out = builder.getOrCreate()
    out.sparkContext.setLogLevel("ERROR")
    return out
