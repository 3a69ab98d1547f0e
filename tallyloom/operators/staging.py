"""Intermediate results that several later steps read, and joins to lookup tables."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; without that setting a folder below the
    warehouse. Both are shared by the driver and all executors."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return folder.rstrip("/")


def staging_folder(spark: SparkSession) -> str:
    """The part of the shared folder that holds this application's staged tables and files."""
    return f"{shared_folder(spark)}/tallyloom/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession) -> str:
    """A path below ``staging_folder`` that nothing has used yet."""
    return f"{staging_folder(spark)}/{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Compute once, write to the shared folder, read from there: later passes do not repeat the
    work, read only the columns they need, and survive the loss of executors. ``clear_staged``
    deletes what an application has staged."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> None:
    """Delete everything this application has staged. Results that were built on staged tables
    and not written yet can't be computed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(staging_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lookup(df: DataFrame, table: DataFrame, on: Column, key: str) -> DataFrame:
    """Left join to a staged lookup table with one row per ``key``. The size of its files decides
    whether Spark broadcasts it; in a join by shuffle, adaptive execution splits the partitions
    of values that a large part of the rows holds."""
    joined = df.withColumn("_on", on).join(table, F.col("_on") == F.col(key), "left")
    return joined.drop("_on", key)
