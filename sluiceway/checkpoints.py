"""Checkpoints in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept under spark.checkpoint.dir (a temporary folder only where that is unset, in local mode)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        if spark.conf.get("spark.checkpoint.dir", None) is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='sluiceway-')}")
    return df.checkpoint(eager=True)
