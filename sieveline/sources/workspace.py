"""Results that are needed more than once, written where driver and executors both reach them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset and all run in one process, a local one. On a cluster
    a local folder would lose rows, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sieveline-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_written: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which clear deletes with the others."""
    _written.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def clear(spark: SparkSession) -> None:
    """Delete what was written here for this process. Results that read it must have been computed."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def kept(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df written once as Parquet, in a folder for each value of the columns by, and read again: later plans scan the
    folders and columns they ask for, and a lost executor costs nothing that was done before."""
    path = new_folder(df.sparkSession, name)
    writer = df.write
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
