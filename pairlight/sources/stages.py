"""Tables between the stages of a longer job, stored in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local session may do without a named one."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="spark-")
    return f"{top.rstrip('/')}/{tag}-{uuid4().hex}"


def stored(df: DataFrame, tag: str, folder: str | None = None) -> DataFrame:
    """The table written and read back, so that what follows reads it instead of working it out again, and sees its size."""
    path = f"{folder.rstrip('/')}/{tag}" if folder else shared_folder(df.sparkSession, tag)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
