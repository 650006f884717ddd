"""Observations stored by day and along a space-filling curve, with a list of what each file covers.

Neighbours in space lie in few files, and within a file in few row groups. A box or a radius reads the
files that the list says may hold any of it, and of these the row groups whose statistics do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.operators.observations import ObservationFilter
from saltmarsh.operators.space import hilbert

#: Files that are named to the scan one by one at most; a filter that meets more reads the folder.
NAMED = 5000
SIDES = ("latitude", "longitude", "timestamp")


def write_clustered(obs: DataFrame, path: str, rows_per_file: int = 1_000_000, tasks: int | None = None) -> None:
    """obs: with latitude, longitude and timestamp (ms). Rows without a position come last in their day; rows
    without a time are a partition of their own. A day of any size is written by as many tasks as it needs."""
    rows = obs.withColumn("obs_date", F.to_date(F.timestamp_millis("timestamp"))).withColumn("_curve", hilbert(F.col("latitude") / 90, F.col("longitude") / 180))
    by = ["obs_date", F.asc_nulls_last("_curve")]
    rows = rows.repartitionByRange(*([tasks] if tasks else []), *by).sortWithinPartitions(*by).drop("_curve")
    rows.write.option("maxRecordsPerFile", rows_per_file).partitionBy("obs_date").parquet(f"{path}/rows")
    written = obs.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
    cover = written.groupBy(F.col("_metadata.file_path").alias("file"), "obs_date").agg(F.count("*").alias("n"), *[f(c).alias(f"{side}_{c}") for c in SIDES for side, f in (("lo", F.min), ("hi", F.max))])
    cover.write.parquet(f"{path}/files")


def files_for(spark: SparkSession, path: str, where: ObservationFilter) -> DataFrame:
    """The files, and what they cover, that may hold rows of the filter."""
    files = spark.read.parquet(f"{path}/files")
    if where.start_ms is not None:
        files = files.filter(F.col("hi_timestamp") >= where.start_ms)
    if where.end_ms is not None:
        files = files.filter(F.col("lo_timestamp") <= where.end_ms)
    for south, north, sides in where.boxes():
        files = files.filter((F.col("lo_latitude") <= north) & (F.col("hi_latitude") >= south))
        if sides:
            files = files.filter(reduce(lambda a, b: a | b, [(F.col("lo_longitude") <= east) & (F.col("hi_longitude") >= west) for west, east in sides]))
    return files


def read_clustered(spark: SparkSession, path: str, where: ObservationFilter) -> DataFrame:
    """The rows of the filter, from the files that may hold them."""
    whole = spark.read.parquet(f"{path}/rows")
    named = [r[0] for r in files_for(spark, path, where).select("file").limit(NAMED + 1).collect()]
    if not named:
        return where.apply(whole.limit(0))
    rows = whole if len(named) > NAMED else spark.read.schema(whole.schema).option("basePath", f"{path}/rows").parquet(*named)
    return where.apply(rows)
