"""Per-flare measures, catalog statistics and data-quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import corr
from .intervals import range_join
from .ranking import exact_quantiles


def flare_rows(grid: DataFrame, flares: DataFrame, before: int, width: int, on=("day",)) -> DataFrame:
    """Grid rows of each flare and of the ``before`` seconds ahead of it; ``inside`` marks the flare."""
    span = flares.withColumn("_a", F.col("start_t") - before)
    rows = range_join(grid, span, "t", "_a", "end_t", width, on=on)
    return rows.withColumn("inside", F.col("t") >= F.col("start_t")).drop("_a")


def flare_metrics(rows: DataFrame, keys, ref: str, soft: str, hard: str, deriv: str, excess: str, smooth=11, cadence=1, least=10, edge=0.1) -> DataFrame:
    """Peak in the central part of the smoothed reference, pre-flare background, threshold crossings,
    rise / decay, steepest slope, hard-soft peak lag and hard fluence per flare.

    ``rows`` come from :func:`flare_rows`; a flare is bounded by its day.
    """
    keys = list(keys)
    per = Window.partitionBy(*keys, "inside")
    flare = Window.partitionBy(*keys)
    order = per.orderBy("t")
    d = rows.withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", F.count(F.lit(1)).over(per))
    d = d.withColumn("_sm", F.avg(F.col(ref)).over(order.rowsBetween(-(smooth // 2), smooth // 2)))
    margin = F.greatest(F.floor(F.col("_n") / F.lit(5)), F.lit(1))
    central = F.col("inside") & ((F.col("_n") <= 2 * margin) | ((F.col("_i") >= margin) & (F.col("_i") < F.col("_n") - margin)))
    d = d.withColumn("_top", F.max(F.when(central, F.struct(F.col("_sm").alias("v"), (-F.col("t")).alias("nt")))).over(flare))
    d = d.withColumn("t_peak", -F.col("_top.nt"))
    d = d.withColumn("peak_flux", F.max(F.when(F.col("inside") & (F.col("t") == F.col("t_peak")), F.col(ref))).over(flare))
    quiet = F.when(~F.col("inside"), F.col(ref))
    bg = F.when(F.count(F.when(~F.col("inside"), F.lit(1))).over(flare) > least, F.percentile(quiet, F.lit(0.5)).over(flare)).otherwise(F.min(F.when(F.col("inside"), F.col(ref))).over(flare))
    d = d.withColumn("bg_flux", bg)
    over = F.col("inside") & (F.col("_sm") >= F.col("bg_flux") + edge * (F.col("peak_flux") - F.col("bg_flux")))
    i = F.col("inside")
    first = lambda c: F.max(F.when(i & F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), (-F.col("t")).alias("nt"))))
    out = d.groupBy(*keys).agg(
        F.first("t_peak").alias("t_peak"), F.first("peak_flux").alias("peak_flux"), F.first("bg_flux").alias("bg_flux"),
        F.coalesce(F.min(F.when(over, F.col("t"))), F.min(F.when(i, F.col("t")))).alias("t_start"),
        F.coalesce(F.max(F.when(over, F.col("t"))), F.max(F.when(i, F.col("t")))).alias("t_end"),
        F.max(F.when(i, F.abs(F.col(deriv)))).alias("max_deriv"), first(soft).alias("_s"), first(hard).alias("_h"),
        F.sum(F.when(i, F.col(excess))).alias("_fl"))
    out = out.withColumn("rise_time", F.col("t_peak") - F.col("t_start")).withColumn("decay_time", F.col("t_end") - F.col("t_peak")).withColumn("duration", F.col("t_end") - F.col("t_start"))
    out = out.withColumn("peak_sxr", F.col("_s.v")).withColumn("peak_hxr", F.col("_h.v")).withColumn("dt_peak", F.col("_s.nt") - F.col("_h.nt"))
    return out.withColumn("hxr_fluence", F.when(F.col("_h").isNotNull(), F.coalesce("_fl", F.lit(0.0)) * cadence)).drop("_s", "_h", "_fl")


def spread_back(rows: DataFrame, metrics: DataFrame, keys) -> DataFrame:
    """Per-flare scalars on every member row."""
    return rows.where("inside").join(metrics, list(keys), "left")


def temperature_peaks(rows: DataFrame, keys, temp="temp", em="em") -> DataFrame:
    """Times of the temperature and emission-measure maxima and their lead."""
    t = F.max_by(F.col("t"), F.struct(F.col(temp), -F.col("t")))
    known = rows.where(F.col(temp).isNotNull() & F.col(em).isNotNull())
    out = known.groupBy(*keys).agg(t.alias("t_temp"), F.max_by(F.col("t"), F.struct(F.col(em), -F.col("t"))).alias("t_em"))
    return out.withColumn("lead", F.col("t_em") - F.col("t_temp"))


def trajectory(rows: DataFrame, keys, temp="temp", em="em", least=10, tail=20) -> DataFrame:
    """Shape code of the T-EM track: 4 = several maxima; else by the late slope of ln EM on ln T
    (3 steep, 2 flat, 1 between); 0 = peak too late or too few points."""
    w = Window.partitionBy(*keys).orderBy("t")
    g = rows.where(F.col(temp).isNotNull() & F.col(em).isNotNull()).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    g = g.where(F.col("_n") >= least).withColumn("_i", F.row_number().over(w))
    hill = lambda c: F.when((F.col(c) > F.lag(c).over(w)) & (F.col(c) > F.lead(c).over(w)), 1).otherwise(0)
    g = g.withColumn("_ht", hill(temp)).withColumn("_he", hill(em))
    late = F.col("_n") - F.col("_i") < tail
    out = g.groupBy(*keys).agg(
        F.sum("_ht").alias("_a"), F.sum("_he").alias("_b"), F.max("_n").alias("points"), F.max(F.struct(F.col(temp).alias("v"), (-F.col("_i")).alias("n"))).alias("_p"),
        F.regr_slope(F.when(late, F.ln(em)), F.when(late, F.ln(temp))).alias("zeta"))
    z = F.col("zeta")
    shape = F.when(z > 1.5, 3).when(z < 0.5, 2).when(z.isNotNull(), 1).otherwise(0)
    code = F.when((F.col("_a") >= 2) | (F.col("_b") >= 2), 4).when((-F.col("_p.n") - 1 < F.col("points") - 3) & (F.col("points") > 5), shape).otherwise(0)
    return out.select(*keys, "points", "zeta", code.cast("bigint").alias("code"))


def loop_length(rows: DataFrame, keys, temp="temp", em="em", least=10, decay_least=5) -> DataFrame:
    """Loop length (cm) from the decay time of ln T and the slope of the decay path."""
    w = Window.partitionBy(*keys)
    g = rows.where(F.col(temp).isNotNull() & F.col(em).isNotNull())
    g = g.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= least)
    g = g.withColumn("_i", F.row_number().over(w.orderBy("t"))).withColumn("_pk", -F.max(F.struct(F.col(temp).alias("v"), (-F.col("_i")).alias("n"))).over(w)["n"])
    g = g.where((F.col("_i") >= F.col("_pk")) & (F.col("_pk") - 1 < F.col("_n") - 3))
    d = g.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), F.regr_slope(F.ln(temp), F.col("_i").cast("double")).alias("_s"),
                             F.regr_slope(F.ln(em), F.ln(temp)).alias("_z"), F.avg(F.col(temp) * 1e6).alias("_t")).where(F.col("points") >= decay_least)
    tau = F.when(F.col("_s") < 0, -1.0 / F.col("_s")).otherwise(500.0)
    z = F.least(F.greatest(F.col("_z"), F.lit(0.1)), F.lit(3.0))
    f = F.when(z < 0.35, 0.63 * z / 0.35).when(z < 0.7, 0.63 + (z - 0.35) * 0.37 / 0.35).when(z < 1.6, 1.0 + (z - 0.7) * 0.6 / 0.9).otherwise(1.6)
    return d.select(*keys, "points", tau.alias("tau"), z.alias("zeta"), (tau * F.sqrt("_t") / (3.7e-4 * f)).alias("loop_cm"))


# -- catalog statistics --------------------------------------------------------------------------------------
def catalog_cube(events: DataFrame, dims) -> DataFrame:
    """Counts and peak statistics for every combination of the dimensions and their totals.

    The grand total is there without events, too: a row that counts nothing joins every cell, and of the cells that hold
    nothing else only the total stays (a Spark cube of no rows has none).
    """
    dims = list(dims)
    rows = events.select(*dims, "peak_flux", F.lit(1).alias("_w"))
    blank = events.sparkSession.range(0, 1, 1, 1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields[:-1]], F.lit(0).alias("_w"))
    cells = rows.unionByName(blank).cube(*dims).agg(F.sum("_w").alias("n"), F.max("peak_flux").alias("max_peak"), F.grouping_id().alias("level"))
    return cells.where((F.col("n") > 0) | (F.col("level") == (1 << len(dims)) - 1))


def daily_rates(events: DataFrame, by=()) -> DataFrame:
    """Flares per active day: mean, median, maximum and number of days."""
    per = events.groupBy(*by, "day").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*by).agg(F.count(F.lit(1)).alias("days"), F.avg("n").alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"), F.max("n").alias("top"))


def coverage_timeline(soft_days: DataFrame, hard_days: DataFrame) -> DataFrame:
    """Every calendar date between the first and last observation with both instrument flags."""
    every = soft_days.select("day", F.lit(1).alias("s"), F.lit(0).alias("h")).unionByName(hard_days.select("day", F.lit(0).alias("s"), F.lit(1).alias("h")))
    seen = every.groupBy("day").agg(F.max("s").alias("soft"), F.max("h").alias("hard"))
    # one row per date: gaps are filled from each date up to its successor
    w = Window.orderBy("day")
    seen = seen.withColumn("_upto", F.coalesce(F.date_sub(F.lead("day").over(w), 1), F.col("day")))
    spread = seen.select(F.col("day").alias("own"), "soft", "hard", F.explode(F.sequence("day", "_upto")).alias("day"))
    here = F.col("day") == F.col("own")
    flag = lambda c: F.when(here, F.col(c)).otherwise(0)
    return spread.select("day", flag("soft").alias("soft"), flag("hard").alias("hard"), (flag("soft") * flag("hard")).alias("combined"))


def expected_classes(days: DataFrame, expected: DataFrame, classify) -> DataFrame:
    """Known events against the class of the day's strongest rate."""
    d = expected.join(days, "day", "left").withColumn("found_class", classify(F.col("day_max")))
    return d.withColumn("match", F.coalesce((F.col("found_class") == F.col("expected_class")).cast("bigint"), F.lit(0)))


# -- quality reports -------------------------------------------------------------------------------------------
def compare_detectors(grid: DataFrame, a: str, b: str, keys=("day",)) -> DataFrame:
    """Correlation where both count, ratio of means, first/last offsets, non-zero shares, row ratio."""
    x, y = F.col(a), F.col(b)
    both = (x > 0) & (y > 0)
    edge = lambda c, f: f(F.when(c > 0, F.col("t")))
    out = grid.groupBy(*keys).agg(
        corr(F.when(both, x), F.when(both, y)).alias("corr"), (F.avg(x) / F.avg(y)).alias("mean_ratio"),
        (edge(x, F.min) - edge(y, F.min)).alias("start_offset"), (edge(x, F.max) - edge(y, F.max)).alias("end_offset"),
        F.avg((F.coalesce(x, F.lit(0.0)) > 0).cast("double")).alias("a_nonzero"), F.avg((F.coalesce(y, F.lit(0.0)) > 0).cast("double")).alias("b_nonzero"),
        F.avg(F.when(y > 0, x / y)).alias("row_ratio"))
    return out.withColumn("shifted", ((F.abs("start_offset") > 1) | (F.abs("end_offset") > 1)).cast("bigint"))


def band_summary(df: DataFrame, bands, reference: str, by=(), upper=100.0) -> DataFrame:
    """Hardness of each band against a reference band: mean, median, deviation of ratios in (0, upper)."""
    opts = F.array(*[F.struct(F.lit(b).alias("band"), F.when(F.col(reference) > 0, F.col(b) / F.col(reference)).alias("ratio")) for b in bands])
    long = df.select(*by, F.inline(opts)).where((F.col("ratio") > 0) & (F.col("ratio") < upper))
    stats = long.groupBy(*by, "band").agg(F.count(F.lit(1)).alias("n"), F.avg("ratio").alias("mean"), F.stddev_pop("ratio").alias("std"))
    return stats.join(median_of(long, [*by, "band"], "ratio"), [*by, "band"]).select(*by, "band", "n", "mean", "median", "std")


def median_of(df: DataFrame, by, value: str) -> DataFrame:
    """(by, median): exact on groups of any size, never ordered in one task."""
    return exact_quantiles(df, by, value, [0.5]).select(*by, F.col("quantile").alias("median"))


def numeric_summary(df: DataFrame, columns, by=()) -> DataFrame:
    """mean / deviation / extremes of many columns as rows (housekeeping report)."""
    long = df.unpivot([F.col(c) for c in by], [F.col(c).cast("double").alias(c) for c in columns], "name", "value")
    return long.groupBy(*by, "name").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def missing_report(df: DataFrame, columns, by=()) -> DataFrame:
    """Missing, zero and non-zero share of each column, in one aggregate."""
    long = df.unpivot([F.col(c) for c in by], [F.col(c).cast("double").alias(c) for c in columns], "name", "value")
    v = F.col("value")
    return long.groupBy(*by, "name").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(v.isNull().cast("double")).alias("missing"), F.avg((F.coalesce(v, F.lit(0.0)) != 0).cast("double")).alias("nonzero"),
        F.max(F.abs(F.coalesce(v, F.lit(0.0)))).alias("top")).withColumn("all_zero", (F.col("top") == 0).cast("bigint")).drop("top")


def zero_share(df: DataFrame, value: str, by=("day",), limit=0.1) -> DataFrame:
    """Share of zeros among the non-missing samples and a flag above the limit."""
    return df.groupBy(*by).agg(F.avg((F.col(value) == 0).cast("double")).alias("zero_share")).withColumn("degraded", (F.col("zero_share") > limit).cast("bigint"))


def around_peak(df: DataFrame, value: str, half: int, keys=("day",)) -> DataFrame:
    """Missing share within ``half`` rows of the day's maximum."""
    w = Window.partitionBy(*keys)
    d = df.withColumn("_top", F.max(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), (-F.col("bin")).alias("nb")))).over(w))
    d = d.where(F.abs(F.col("bin") + F.col("_top.nb")) <= half)
    return d.groupBy(*keys).agg(F.max("_top.v").alias("peak"), F.avg(F.col(value).isNull().cast("double")).alias("missing"), F.count(F.lit(1)).alias("rows"))


def periods(day: Column, start: str, end: str) -> Column:
    """before / during / after an anomaly interval."""
    d = day.cast("date")
    return F.when(d < F.lit(start).cast("date"), "before").when(d > F.lit(end).cast("date"), "after").otherwise("during")


def signal_to_noise(df: DataFrame, value: str, by) -> DataFrame:
    stats = df.groupBy(*by).agg(F.max(value).alias("peak"), F.stddev_pop(value).alias("std")).join(median_of(df, by, value), list(by), "left")
    return stats.withColumn("snr", F.when(F.col("std") > 0, (F.col("peak") - F.col("median")) / F.col("std")))


def group_activity(values: DataFrame, groups: DataFrame, keys, top=5) -> DataFrame:
    """Per key and feature group: available, non-zero, activity label and the first features by name.

    ``values`` is long (keys, feature, x); ``groups`` maps feature -> grp (the fixed dictionary of at
    most a few hundred names).
    """
    j = values.join(groups, "feature")
    names = F.slice(F.sort_array(F.collect_set("feature")), 1, top)
    out = j.groupBy(*keys, "grp").agg(F.count(F.lit(1)).alias("available"), F.count(F.when(F.abs("x") > 1e-10, 1)).alias("nonzero"), names.alias("details"))
    share = F.col("nonzero") / F.col("available")
    return out.withColumn("activity", F.when(share > 0.8, "active").when(share > 0.3, "partial").otherwise("inactive"))
