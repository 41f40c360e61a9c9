"""Settings that suit these plans."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", **more: str) -> SparkSession:
    """A session on this machine, for tests and benches; a cluster brings its own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("lattiq").config("spark.sql.shuffle.partitions", partitions).config("spark.driver.memory", memory).config("spark.ui.enabled", "false")
    for k, v in (SETTINGS | more).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import this package, wherever the driver was started.

    On a cluster the package is shipped like any other; a path that an
    executor lacks does no harm.
    """
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
