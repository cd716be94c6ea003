"""The folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where that is unset, a temporary folder for each application, in local mode alone: on a cluster
    no folder of one machine will do, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _OWN[context.applicationId]


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there: what follows reads it and doesn't make it again, and lost executors lose
    nothing. Its folder bears the application's id, and drop_stored() deletes those of an application."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> int:
    """Delete what stored() wrote in this application, for callers whose results are all stored; returns how many tables."""
    top = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(top, f"stored-{spark.sparkContext.applicationId}-*")) or []
    return sum(files.delete(f.getPath(), True) for f in found)
