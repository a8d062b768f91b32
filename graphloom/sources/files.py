"""Choosing input files by age and size."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.ordering import prefix_sum


def running_size(files: DataFrame, total: int, size: str = "length", key: str = "_age", ties: str = "path") -> DataFrame:
    """Rows in ``key`` order until the sizes of the earlier rows reach ``total``."""
    summed = prefix_sum(files, size, key, ties=[ties]).withColumnRenamed("total", "_all")
    return summed.filter(F.col("before") < total).drop("_all")


def recent_files(spark: SparkSession, pattern: str, total_bytes: int, before: dt.datetime) -> DataFrame:
    """Newest files first, those modified at or after ``before`` skipped, until their size is enough."""
    depth = spark._jvm.org.apache.hadoop.fs.Path(pattern).depth()
    # the file content is never read: only listing columns are selected
    listed = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime", "length")
    bare = F.regexp_replace("path", "^[a-zA-Z0-9]+:(//[^/]*)?", "")
    own = listed.filter(F.size(F.split(bare, "/")) - 1 == depth)  # files of matched folders are not matches
    aged = own.filter(F.col("modificationTime") < F.lit(before)).withColumn("_age", -F.unix_micros("modificationTime"))
    return running_size(aged, total_bytes).drop("_age")


def select_recent_files(spark: SparkSession, pattern: str, total_bytes: int, before: dt.datetime) -> str:
    """The chosen paths, newest first, joined by commas; an empty text when there are none."""
    chosen = recent_files(spark, pattern, total_bytes, before)
    row = chosen.agg(F.sort_array(F.collect_list(F.struct("before", "path"))).alias("r")).first()
    return ",".join(r["path"] for r in row["r"])
