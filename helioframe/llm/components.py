"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and a join that adaptive execution may split, so a node with
very many links is no task's burden and neither links nor labels reach the driver.  Steps are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points to the smallest of the node and its neighbours."""
    both = links.union(links.select("v", "u")).toDF("u", "v")
    low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point to the smallest of them."""
    low = links.groupBy("u").agg(F.min("v").alias("low"))
    passed = links.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return passed.union(low).toDF("u", "v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id with a link: the smallest id that can be reached.  ``links`` has two long columns."""
    a, b = (F.col(f"`{c}`").cast("long") for c in links.columns[:2])
    now = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now, seen = cut_lineage(now, "links"), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        now = cut_lineage(_small_star(_large_star(now)), "star")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
