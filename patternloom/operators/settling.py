"""Intermediate tables that outlive an executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the folder of ``spark.checkpoint.dir``, which all executors share.

    A temporary folder is set only where the session runs on one machine and names none; a cluster without one is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))  # one machine: a temporary folder serves
    return df.checkpoint()
