"""Session defaults shared by tests, benchmarks and jobs."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "codefacts", memory: str = "8g") -> SparkSession:
    """A local session with adaptive execution and a UTC clock."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
