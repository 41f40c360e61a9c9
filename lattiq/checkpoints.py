"""Cutting the lineage of iterative plans, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_folder(spark: SparkSession) -> None:
    """Uses ``spark.checkpoint.dir``; sets a temporary folder only where one machine runs everything."""
    if spark.sparkContext.getCheckpointDir():
        return
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lattiq-")
    spark.sparkContext.setCheckpointDir(base)


def cut(df: DataFrame) -> DataFrame:
    """``df`` as written to the shared folder, so a lost executor loses nothing."""
    ensure_folder(df.sparkSession)
    return df.checkpoint(eager=True)
