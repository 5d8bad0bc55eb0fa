"""Ranks, quantiles and running totals over unbounded groups.

A window ordered over a whole group would put the group into one task.  Here values are first counted
(ties collapse on the map side), then split into balanced value buckets from a mergeable quantile
sketch; prefix sums run over the few buckets of a group and, separately, inside each bucket.  The
sketch only balances the work: results are exact whatever its boundaries.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage, sized


def with_totals(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Put the columns of an ungrouped aggregate on every row.  Such a table has exactly one row, which
    is what makes the broadcast safe."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(totals.withColumn("_one", F.lit(1))), "_one").drop("_one")


def bucket_count(df: DataFrame) -> int:
    """A power of two near four times the session's shuffle parallelism."""
    parallel = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 << max(3, math.ceil(math.log2(max(2, 4 * parallel))))


def value_buckets(df: DataFrame, by, value: str, buckets: int | None = None, out="bucket") -> DataFrame:
    """Monotone bucket number per row, balanced by an approximate quantile sketch per group.

    The boundaries are one bounded array per group; each row finds its place by binary search.
    """
    buckets = buckets or bucket_count(df)
    probs = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    key = F.col(value).cast("double")
    if by:
        bounds = df.groupBy(*by).agg(F.percentile_approx(key, probs, F.lit(max(1000, 10 * buckets))).alias("_bounds"))
        d = df.join(sized(bounds, "bounds"), list(by))
    else:
        bounds = df.agg(F.percentile_approx(key, probs, F.lit(max(1000, 10 * buckets))).alias("_bounds"))
        d = with_totals(df, bounds)
    d = d.withColumn("_at", F.lit(0))
    jump = buckets // 2
    while jump:
        step = F.when(F.coalesce(F.get("_bounds", F.col("_at") + jump - 1) < key, F.lit(False)), F.lit(jump)).otherwise(F.lit(0))
        d = d.withColumn("_at", F.col("_at") + step)
        jump //= 2
    return d.withColumn(out, F.col("_at")).drop("_at", "_bounds")


def prefix_sums(df: DataFrame, by, order, sums, bucket="bucket") -> DataFrame:
    """``<c>_before`` = sum of ``c`` over the rows that sort before, for rows already carrying a bucket
    number that is monotone in ``order`` (unique within the group)."""
    by, order = list(by), [order] if isinstance(order, str) else list(order)
    per = df.groupBy(*by, bucket).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    w = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1) if by else Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*by, bucket, *[F.coalesce(F.sum(f"_t_{c}").over(w), F.lit(0)).alias(f"_base_{c}") for c in sums])
    inner = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = df
    for c in sums:
        d = d.withColumn(f"_in_{c}", F.coalesce(F.sum(c).over(inner), F.lit(0)))
    d = d.join(per, [*by, bucket])
    for c in sums:
        d = d.withColumn(f"{c}_before", F.col(f"_base_{c}") + F.col(f"_in_{c}")).drop(f"_base_{c}", f"_in_{c}")
    return d


def ordered_counts(df: DataFrame, by, value: str, sums: dict[str, Column] | None = None, buckets: int | None = None) -> DataFrame:
    """Distinct values with their count ``n``, extra sums, and everything ``_before`` them."""
    sums = sums or {}
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), *[e.alias(k) for k, e in sums.items()])
    counts = cut_lineage(counts, "counts")  # read twice: for the bounds and for the sums
    return prefix_sums(value_buckets(counts, by, value, buckets), by, value, ["n", *sums]).drop("bucket")


def average_rank(df: DataFrame, by, value: str, out="rank") -> DataFrame:
    """(by, value, n, rank): average rank of each distinct value within its group."""
    return ordered_counts(df, by, value).select(*by, value, "n", (F.col("n_before") + (F.col("n") + 1) / 2).alias(out))


def exact_quantiles(df: DataFrame, by, value: str, probs) -> DataFrame:
    """Interpolated quantiles (by, q, quantile), exact on any group size.

    The two order statistics around each target position are picked from the running counts.
    """
    by = list(by)
    counts = ordered_counts(df, by, value)
    total = counts.groupBy(*by).agg(F.sum("n").alias("_N"))
    if by:
        d = counts.join(total, by)
    else:
        d = with_totals(counts, total)
    d = d.select(*by, value, "n", "n_before", "_N", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("q"))
    pos = F.col("q") * (F.col("_N") - 1)
    lo, hi = F.floor(pos), F.ceil(pos)
    holds = lambda k: (F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n"))
    d = d.where(holds(lo) | holds(hi))
    agg = d.groupBy(*by, "q").agg(F.max(F.when(holds(lo), F.col(value))).alias("_a"), F.max(F.when(holds(hi), F.col(value))).alias("_b"), F.max(pos - lo).alias("_f"))
    return agg.select(*by, "q", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias("quantile"))


def spearman(df: DataFrame, by, x: str, y: str) -> DataFrame:
    """Spearman correlation per group with pair count ``n`` and t statistic.

    Pairs are counted first, so repeated values shrink before the rank joins; ranks have the known
    mean (N+1)/2, and the weighted sums need no further pass.
    """
    by = list(by)
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("w"))
    pairs = cut_lineage(pairs, "pairs")
    # counts per value come from the (smaller) pair table
    def ranks(v, out):
        c = cut_lineage(pairs.groupBy(*by, v).agg(F.sum("w").alias("n")), "counts")
        r = prefix_sums(value_buckets(c, by, v), by, v, ["n"])
        return sized(r.select(*by, v, (F.col("n_before") + (F.col("n") + 1) / 2).alias(out)), "ranks")

    d = pairs.join(ranks(x, "_rx"), [*by, x]).join(ranks(y, "_ry"), [*by, y])
    rx, ry, w = F.col("_rx"), F.col("_ry"), F.col("w")
    s = d.groupBy(*by).agg(F.sum(w).alias("n"), F.sum(w * rx * ry).alias("_xy"), F.sum(w * rx * rx).alias("_xx"), F.sum(w * ry * ry).alias("_yy"))
    m = (F.col("n") + 1) / 2
    cov, vx, vy = F.col("_xy") - F.col("n") * m * m, F.col("_xx") - F.col("n") * m * m, F.col("_yy") - F.col("n") * m * m
    rho = F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))
    s = s.withColumn("rho", rho)
    t = F.when((F.col("n") > 2) & (F.abs("rho") < 1), F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho"))))
    return s.select(*by, "n", "rho", t.alias("t_stat"))


def global_index(df: DataFrame, bucket: str, order, out="idx") -> DataFrame:
    """0-based row number of the whole table for a bucket column that is monotone in the order
    (a day, an hour): bucket offsets plus a row number inside the bucket."""
    order = [order] if isinstance(order, str) else list(order)
    per = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    per = per.select(bucket, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(bucket).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(inner)).join(per, bucket).withColumn(out, F.col("_base") + F.col("_rn") - 1).drop("_base", "_rn")
