"""Tables in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; where all runs in one process and nothing is set, a temporary folder of this process."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="melisma-"))
    return _LOCAL[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A new path there, deleted when the session's file system closes."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """The table written there and read again: its lineage ends, and no lost executor takes it along."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
