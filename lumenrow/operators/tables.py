"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder, but only in a local session, whose tasks share it.

    Checkpoints go when no plan refers to them any more.
    """
    context = spark.sparkContext._jsc.sc()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir().isEmpty():
        if named is None and spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="lumenrow-"))
        context.conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return named or context.getCheckpointDir().get()


def materialised(spark: SparkSession, frame: DataFrame) -> DataFrame:
    """``frame`` computed once and read back from the shared folder, so that lost executors lose nothing."""
    shared_folder(spark)
    return frame.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str) -> tuple:
    """The Hadoop file system of a path, and the path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where
