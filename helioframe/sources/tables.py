"""Typed Parquet scans.  Column lists and day ranges reach the scan as ReadSchema / PushedFilters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import sized, use_utc


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def between_days(df: DataFrame, first: str | None, last: str | None, ts: str = "ts") -> DataFrame:
    """Rows of the UTC days ``first``..``last`` (both included) as a range on the stored timestamp."""
    kind = dict(df.dtypes)[ts]
    if first:
        df = df.where(F.col(ts) >= F.lit(first).cast(kind))
    if last:
        df = df.where(F.col(ts) < F.date_add(F.lit(last).cast("date"), 1).cast(kind))
    return df


def partitioned_days(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """A table written with ``partitionBy("day")``; the range prunes folders."""
    df = spark.read.parquet(path)
    if first:
        df = df.where(F.col("day") >= F.lit(first).cast("date"))
    if last:
        df = df.where(F.col("day") <= F.lit(last).cast("date"))
    return df


def columns_like(df: DataFrame, parts, always=()) -> DataFrame:
    """Keep the columns whose name contains one of ``parts`` (housekeeping projection)."""
    keep = [c for c in df.columns if c in always or any(p.lower() in c.lower() for p in parts)]
    return df.select(*keep)


def days_of(df: DataFrame, day: str = "day") -> DataFrame:
    return df.select(day).distinct()


def common_days(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("day").intersect(right.select("day"))


def without_days(df: DataFrame, excluded: DataFrame) -> DataFrame:
    return df.join(sized(excluded.select("day").distinct(), "days"), "day", "left_anti")


def merge_orbits(spark: SparkSession, folder: str, pattern: str, order: str, glob: str = "*.parquet") -> DataFrame:
    """Union the files of every day and order them.

    ``pattern`` has groups (day ``yyyyMMdd``, start, version) and is applied to the file path.  Rows
    come back range-sorted by (day, ``order``), so no day has to fit into one task.
    """
    df = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").parquet(folder)
    name = F.col("_metadata.file_path")
    return (
        df.withColumn("day", F.to_date(F.regexp_extract(name, pattern, 1), "yyyyMMdd"))
        .withColumn("orbit_start", F.regexp_extract(name, pattern, 2))
        .withColumn("version", F.regexp_extract(name, pattern, 3))
        .orderBy("day", order, "orbit_start", "version")
    )


def unmerged_orbits(merged: DataFrame) -> DataFrame:
    """Days that still consist of more than one orbit file."""
    return merged.groupBy("day").agg((F.countDistinct("orbit_start", "version") - 1).alias("extra_orbits"))
