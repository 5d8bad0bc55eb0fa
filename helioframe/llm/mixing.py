"""Mixing sources to target weights: words per source, repetition rates, hash-seeded copies of whole documents.

Targets: ``share`` of all words is dealt by weight; a target stops at ``most`` times its source's words and the excess is
dealt again by weight among the others until none is above.  A source's rate is target / words; a document is taken
floor(rate) times and once more with probability equal to the fraction, by a coin hashed from its id (its text if the id
is null), so reruns agree and every copy of a row gets the same coin.

Only one row per source is shuffled after the map-side sum; rates come back over a join on the source that adaptive
execution broadcasts or splits, so a hot source costs no single task its rows.  Sources are numbered by range-partitioned
sort and per-part offsets, not by one global window.

Defined cases: null text has no words; null source is a source of its own, ordered last; a source without words has rate
0; empty tables give no rows; input columns travel inside ``row`` and cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

WEIGHTS = (3, 1, 2)
SHARE, MOST, SEED = 1.5, 2, "mix"
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(sources: DataFrame) -> DataFrame:
    """Adds ``pos``, the rank of ``source`` by code point with null last, from range parts and their offsets."""
    spread = cut_lineage(
        sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id()), "sources"
    )
    sizes = spread.groupBy("part").count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return spread.withColumn("inside", inside).join(offsets, "part").select("source", "source_size", (F.col("offset") + F.col("inside") - 1).alias("pos"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size) rows."""
    sums = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("pos") % len(weights) + 1).cast("int"))
    table = cut_lineage(numbered(sums).withColumn("w", w).withColumn("most", most * F.col("source_size")), "weights")
    total = table.agg(F.sum("source_size").alias("t")).first().t or 0
    level, full = 0.0, None
    while True:
        above = F.col("most") <= level * F.col("w")
        s = table.agg(F.sum(F.when(above, F.col("most"))).alias("most"), F.sum(F.when(~above, F.col("w"))).alias("w"), F.count_if(above).alias("n")).first()
        if s.n == full or not s.w:
            break
        full = s.n
        level = (share * total - (s.most or 0)) / s.w
    return table.select("source", "source_size", F.least(F.col("most").cast("double"), F.lit(float(level)) * F.col("w")).alias("target"))


def coin(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the first 52 bits of a hash of the seed and the id."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.md5(text.cast("binary")), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def rated(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, **rule) -> DataFrame:
    """One row per document: ``row`` (its columns), size, source_size, target, copies."""
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    at = lambda c: F.col(f"row.`{c}`")
    rows = rows.select("row", at(source).cast("string").alias("source"), n_words(at(text)).alias("size"))
    goal = cut_lineage(targets(rows.select("source", "size"), **rule), "targets").withColumnRenamed("source", "goal_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(rate) + (coin(at(doc_id), at(text), seed) < rate - F.floor(rate)).cast("long")
    return rows.join(goal, F.col("source").eqNullSafe(F.col("goal_source")), "left").select("row", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix(documents: DataFrame, **options) -> DataFrame:
    """The input columns, every document as often as it is taken."""
    taken = rated(documents, **options).where(F.col("copies") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
