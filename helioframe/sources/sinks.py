"""Result sinks: day-partitioned Parquet, CSV and JSON reports, incremental day processing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.learning import pending_days
from ..session import sized


def write_days(df: DataFrame, path: str, mode: str = "overwrite", day: str = "day") -> None:
    """One folder per day.  Rows are spread over (day, hash) before writing, so a large day becomes
    several files instead of one task; replacing days only touches the days present in ``df``."""
    salt = F.pmod(F.hash(*[c for c in df.columns if c != day]), F.lit(8))
    df.repartition(F.col(day), salt).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def archive(light_curve: DataFrame, path: str, value: str = "v") -> None:
    """Cleaned archive of all light curves: missing counts become 0."""
    write_days(light_curve.withColumn(value, F.coalesce(F.col(value), F.lit(0.0))), path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def report_json(df: DataFrame, keys, sections: dict[str, list[str]]) -> DataFrame:
    """One nested JSON document per key; a section is a struct of report columns."""
    doc = F.struct(*[F.struct(*[F.col(c) for c in cols]).alias(name) for name, cols in sections.items()])
    return df.select(*keys, F.to_json(doc).alias("report"))


def nested_report(spine: DataFrame, sections: dict[str, DataFrame], lists: dict[str, tuple[DataFrame, list[str]]], keys) -> DataFrame:
    """One JSON document per key of ``spine``: a struct per section (one row a key), a total and an ordered array per list.

    Sections are few-row tables by key, written first so that joins are planned by their size.  A key without a section's row
    has the section with nulls in it, one without list entries an empty list.
    """
    keys = list(keys)
    out, doc = spine.select(*keys).distinct(), []
    for name, part in sections.items():
        fields = [c for c in part.columns if c not in keys]
        out = out.join(sized(part.select(*keys, F.struct(*fields).alias(f"_{name}")), "section"), keys, "left")
        doc.append(F.struct(*[F.col(f"_{name}.{c}").alias(c) for c in fields]).alias(name))
    for name, (entries, order) in lists.items():
        fields = [c for c in entries.columns if c not in (*keys, *order)]
        packed = F.sort_array(F.collect_list(F.struct(*order, *fields))).alias(f"_{name}")
        out = out.join(sized(entries.groupBy(*keys).agg(packed), "section"), keys, "left")
        whole = F.coalesce(F.col(f"_{name}"), F.array().cast(T.ArrayType(entries.select(*order, *fields).schema)))
        doc.append(F.struct(F.size(whole).alias("total"), whole.alias("entries")).alias(name))
    return out.select(*keys, F.to_json(F.struct(*doc), {"ignoreNullFields": "false"}).alias("report"))


def run_increment(spark: SparkSession, source: DataFrame, job: Callable[[DataFrame], DataFrame], path: str, day: str = "day") -> int:
    """Process the days that ``path`` does not hold yet and add them; returns how many were new."""
    days = source.select(day).distinct()
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    written = files.exists(held) and len(files.listStatus(held)) > 0
    done = spark.read.parquet(path).select(F.col(day).cast("date").alias("day")) if written else days.limit(0)
    todo = pending_days(days, done)
    count = todo.count()
    if count:
        write_days(job(source.join(todo, day, "left_semi")), path, mode="append")
    return count
