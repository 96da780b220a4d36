"""Files as rows: name, kind, age and size of what lies in a folder. Only metadata is read, never content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def entries(spark: SparkSession, path: str) -> DataFrame:
    """path, name, modified, size of every file below a folder."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return x.select("path", F.substring_index("path", "/", -1).alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def by_entry(files: DataFrame, root: str) -> DataFrame:
    """entry, modified, size: the direct children of ``root``, folders with the sum of their files and the latest change."""
    rest = F.substring_index("path", root.rstrip("/") + "/", -1)
    return files.groupBy(F.substring_index(rest, "/", 1).alias("entry")).agg(F.max("modified").alias("modified"), F.sum("size").alias("size"))


def backup_kind(name: Column) -> Column:
    """A backup's name without its date, time and extension."""
    bare = F.regexp_replace(name, r"-\d{8}(-\d{4,6})?.*$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), name)


def age_days(modified: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(modified.cast("timestamp"))) / 86_400_000_000
