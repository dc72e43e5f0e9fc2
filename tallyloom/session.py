"""Session factory. A cluster passes its own settings; only what is unset gets a default."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "tallyloom", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benches: shuffle partitions follow the cores."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app).config("spark.driver.memory", os.environ.get("TALLYLOOM_DRIVER_MEMORY", "6g"))
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": str(cpus), **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
