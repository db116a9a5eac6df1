"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder of this machine where it is unset and all runs on this machine, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = Path(tempfile.mkdtemp(prefix="graphloom-")).as_uri()
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """The folder of this application's tables."""
    return f"{shared_dir(spark)}/graphloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete all tables of this application: to be called when nothing reads their results any more."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def stacked(tables: list[DataFrame]) -> DataFrame:
    """Settled tables of the same columns as one: an iteration writes what is new alone, and reads all it has written."""
    return reduce(DataFrame.unionByName, tables)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
