"""Spark sessions with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What the SQL layer needs whatever the cluster: PostgreSQL's view of types and quoting.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Applies the required settings to a session that someone else has made."""
    for k, v in REQUIRED.items():
        spark.conf.set(k, v)
    return spark


def local_session(cores: int = 8, memory: str = "8g", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in this process, for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("brindle")
    settings = {
        **REQUIRED,
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(shuffle_partitions or cores),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.host": "127.0.0.1",
        **conf,
    }
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
