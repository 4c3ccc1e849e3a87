"""The folder that driver and executors share, and tables written to it between stages."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where it is set, else a folder of our own, which only a local master can share with its executors."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or (sc.getCheckpointDir() or "").rpartition("/")[0]
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="skylattice-")
        sc.setCheckpointDir(where)
    return where


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder: lineage ends there, and lost executors do not matter."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
