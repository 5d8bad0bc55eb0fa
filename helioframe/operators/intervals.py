"""Range joins: good-time intervals, event-in-window labels, nearest samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import sized


def cover_buckets(intervals: DataFrame, start: str, stop: str, width: int, name="bucket") -> DataFrame:
    """One row per time bucket an interval touches: the equality key of a range join."""
    lo = F.floor(F.col(start) / F.lit(width)).cast("bigint")
    hi = F.floor(F.col(stop) / F.lit(width)).cast("bigint")
    return intervals.withColumn(name, F.explode(F.sequence(lo, F.greatest(lo, hi))))


def bucket_of(t: str | Column, width: int) -> Column:
    t = F.col(t) if isinstance(t, str) else t
    return F.floor(t / F.lit(width)).cast("bigint")


def range_join(points: DataFrame, intervals: DataFrame, t: str, start: str, stop: str, width: int,
               on=(), closed="both", how="inner") -> DataFrame:
    """Points inside intervals as a hash join on (``on``, time bucket).

    ``closed`` is one of both / left / right.  Pick ``width`` near the typical interval length: an
    interval then meets one or two buckets and a point exactly one, so a pair appears at most once.
    """
    left = points.withColumn("bucket", bucket_of(t, width))
    right = cover_buckets(intervals, start, stop, width)
    lower = left[t] >= right[start] if closed in ("both", "left") else left[t] > right[start]
    upper = left[t] <= right[stop] if closed in ("both", "right") else left[t] < right[stop]
    cond = (left["bucket"] == right["bucket"]) & lower & upper
    for key in on:
        cond = cond & (left[key] == right[key])
    joined = left.join(right, cond, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("bucket")
    return joined.drop(left["bucket"]).drop(right["bucket"]).drop(*[right[k] for k in on])


def merge_intervals(intervals: DataFrame, keys, start="start", stop="stop", gap: float = 0) -> DataFrame:
    """Union of overlapping (or ``gap``-close) intervals per key group."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*keys).orderBy(start, stop)
    reach = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0)
    marked = intervals.withColumn("_new", fresh)
    grouped = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "_run").agg(
        F.min(start).alias(start), F.max(stop).alias(stop), F.count(F.lit(1)).alias("parts")
    ).drop("_run")


def covered(points: DataFrame, intervals: DataFrame, t="t", start="start", stop="stop", width=3600, on=()) -> DataFrame:
    """Points with a boolean ``inside``: within any closed interval.

    Intervals are merged first, so a point meets at most one of them and the left join cannot
    multiply rows.
    """
    merged = merge_intervals(cut_to_buckets(intervals, start, stop, width), [*on, "bucket"], start, stop)
    left = points.withColumn("bucket", bucket_of(t, width))
    right = merged.select(*on, "bucket", F.col(start).alias("_a"), F.col(stop).alias("_b"))
    spans = sized(right.groupBy(*on, "bucket").agg(F.collect_list(F.struct("_a", "_b")).alias("_spans")), "spans")
    hit = F.exists("_spans", lambda s: (F.col(t) >= s["_a"]) & (F.col(t) <= s["_b"]))
    return left.join(spans, [*on, "bucket"], "left").withColumn("inside", F.coalesce(hit, F.lit(False))).drop("_spans", "bucket")


def cut_to_buckets(intervals: DataFrame, start: str, stop: str, width: int) -> DataFrame:
    """Pieces of the intervals, cut at bucket borders (merged pieces per bucket are few)."""
    pieces = cover_buckets(intervals, start, stop, width)
    lo = F.greatest(F.col(start), (F.col("bucket") * width).cast("bigint"))
    hi = F.least(F.col(stop), ((F.col("bucket") + 1) * width - 1).cast("bigint"))
    return pieces.withColumn(start, lo).withColumn(stop, hi).distinct()


def flag_upcoming(windows: DataFrame, events: DataFrame, t="t", event_t="te", horizon=1800, bounds="(0,H]", on=()) -> DataFrame:
    """``label`` = 1 if an event starts within the horizon after ``t``.

    ``bounds`` is ``(0,H]`` for feature rows and ``[0,H)`` for sequences.  Events are spread over the
    one or two buckets they can label and pre-aggregated to their extremes there.
    """
    right = events.select(*on, F.col(event_t).alias("_te")).distinct()
    buckets = F.sequence(bucket_of(F.col("_te") - horizon, horizon), bucket_of("_te", horizon))
    spread = right.withColumn("bucket", F.explode(buckets))
    per_bucket = spread.groupBy(*on, "bucket").agg(F.sort_array(F.collect_set("_te")).alias("_tes"))
    left = windows.withColumn("bucket", bucket_of(t, horizon))
    if bounds == "(0,H]":
        test = lambda e: (e > F.col(t)) & (e <= F.col(t) + horizon)
    else:
        test = lambda e: (e >= F.col(t)) & (e < F.col(t) + horizon)
    hit = F.coalesce(F.exists("_tes", test), F.lit(False))
    return left.join(per_bucket, [*on, "bucket"], "left").withColumn("label", hit.cast("bigint")).drop("_tes", "bucket")


def gaps(intervals: DataFrame, keys, start="start", stop="stop") -> DataFrame:
    """Gap to the next interval of the same day."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*keys).orderBy(start, stop)
    nxt = F.lead(start).over(w)
    return (
        intervals.withColumn("gap_start", F.col(stop))
        .withColumn("gap", nxt - F.col(stop))
        .where(F.col("gap").isNotNull())
        .withColumn("gap_hour", F.floor((F.col("gap_start") % 86400) / F.lit(3600)).cast("bigint"))
    )
