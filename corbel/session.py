"""Session defaults. Every entry point takes a SparkSession; this builder is for tests, the bench and the CLI."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cpus: int | str = "*", shuffle: int | None = None, **conf: str) -> SparkSession:
    n = shuffle or (os.cpu_count() if cpus == "*" else int(cpus))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("corbel")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
