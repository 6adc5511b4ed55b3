"""Cutting lineage between the steps of a loop, in storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_made: list[str] = []


def _ready(spark: SparkSession) -> None:
    """Sets spark.checkpoint.dir; where that is unset, on one machine, to a temporary folder."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        known = sc.getConf().get("spark.checkpoint.dir")
        if not known and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(known or tempfile.mkdtemp(prefix="ripplemark-"))


def cut(df: DataFrame) -> DataFrame:
    """A table written in the folder that driver and executors share, and read again: Spark knows its size, and lost executors cost nothing."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession) -> str:
    """A new folder's path in the one that driver and executors share; release() removes it."""
    _ready(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Removes all folders made in this process so far, and tells their number. Call it when no DataFrame that reads them is needed any more, such as after a result has been written."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    n = len(_made)
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)
    return n
