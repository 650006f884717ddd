"""Session settings that the operators rely on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "saltmarsh", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings by keyword with _ for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints/saltmarsh"


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    at, files = _path(spark, path)
    files.delete(at, True)


def own_folder(spark: SparkSession, label: str) -> str:
    """A new path in this application's part of the shared folder, which goes with the application (or
    by sweep())."""
    home = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    at, files = _path(spark, home)
    if not files.exists(at):
        files.mkdirs(at)
        files.deleteOnExit(at)
    return f"{home}/{label}-{uuid.uuid4().hex}"


def settled(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: what follows doesn't repeat how it was made."""
    path = own_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Deletes what settled() and own_folder() left, once no result that reads it is used any more."""
    delete(spark, f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")
