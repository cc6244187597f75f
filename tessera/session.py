"""Session defaults for local runs, tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "tessera", **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the benchmark share.

    On a cluster the session is made by the deployment; nothing in the library
    depends on this builder.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
