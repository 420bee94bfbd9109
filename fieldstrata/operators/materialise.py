"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def own_dir() -> str:
    folder = tempfile.mkdtemp(prefix="spark-shared-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or else the context's checkpoint folder. Only
    a local session may do without: it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        folder = own_dir()
    return folder.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """Written once and read again, so that partition numbers and random choices stay what they were if executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(df: DataFrame) -> int:
    """Partitions for joins whose work is in pairs: a number that is asked for is not lowered for want of bytes."""
    return max(32, 4 * df.sparkSession.sparkContext.defaultParallelism)
