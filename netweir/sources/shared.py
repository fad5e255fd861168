"""The folder that driver and executors share, and tables settled in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without it, as in tests, gets a folder of its own, a cluster an error."""
    sc, given = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not given and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return (given or sc.getCheckpointDir()).rstrip("/")


def scratch(spark: SparkSession, name: str = "stream") -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder, so that it is the same however often it is read, and outlives executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
