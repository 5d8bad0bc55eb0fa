"""Flare truth catalogs in CSV or JSON form, and the fallback between sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import CLASS_BASE, choose, class_letter, parse_class
from ..operators.matching import keep_first

CSV_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()), T.StructField("begin_time", T.TimestampType()), T.StructField("peak_time", T.TimestampType()),
    T.StructField("end_time", T.TimestampType()), T.StructField("goes_class", T.StringType()), T.StructField("peak_flux", T.DoubleType()),
    T.StructField("active_region", T.IntegerType())])
JSON_SCHEMA = T.StructType([
    T.StructField("begin", T.StringType()), T.StructField("peak", T.StringType()), T.StructField("end", T.StringType()),
    T.StructField("class_type", T.StringType()), T.StructField("class_value", T.DoubleType()), T.StructField("active_region_num", T.IntegerType())])
COLUMNS = ["date", "begin_time", "peak_time", "end_time", "goes_class", "peak_flux", "active_region"]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return _standard(spark.read.schema(CSV_SCHEMA).option("header", True).csv(path))


def read_json(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """A JSON catalog: one record per line, or one list per file with ``multiline``."""
    raw = spark.read.schema(JSON_SCHEMA).option("multiLine", multiline).json(path)
    label = F.concat(F.col("class_type"), F.format_string("%.1f", F.col("class_value")))
    flux = choose([(F.col("class_type") == k, v) for k, v in CLASS_BASE.items()]) * F.col("class_value")  # the label has one decimal only
    return _standard(raw.select(
        F.to_date("peak").alias("date"), F.to_timestamp("begin").alias("begin_time"), F.to_timestamp("peak").alias("peak_time"), F.to_timestamp("end").alias("end_time"),
        label.alias("goes_class"), flux.alias("peak_flux"), F.col("active_region_num").alias("active_region")))


def _standard(df: DataFrame) -> DataFrame:
    label = F.coalesce(F.col("goes_class"), class_letter("peak_flux"))
    return df.select(F.coalesce("date", F.to_date("peak_time")).alias("date"), "begin_time", "peak_time", "end_time", label.alias("goes_class"),
                     F.coalesce("peak_flux", parse_class(label)).alias("peak_flux"), "active_region").where(F.col("peak_time").isNotNull())


def in_range(df: DataFrame, first=None, last=None) -> DataFrame:
    if first:
        df = df.where(F.col("date") >= F.lit(first).cast("date"))
    if last:
        df = df.where(F.col("date") <= F.lit(last).cast("date"))
    return df


def prefer(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Primary rows, plus fallback rows of days the primary does not cover; duplicates by
    (peak_time, class) keep the first source."""
    missing = fallback.join(primary.select("date").distinct(), "date", "left_anti")
    both = primary.withColumn("_src", F.lit(0)).unionByName(missing.withColumn("_src", F.lit(1)))
    return keep_first(both, ["peak_time", "goes_class"], ["_src", "begin_time"]).select(*COLUMNS)
