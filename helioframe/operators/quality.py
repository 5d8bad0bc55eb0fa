"""Quality flags and signal-to-noise for the per-second table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import MASTER_FLAGS, choose, col
from ..session import sized
from ..sources.lightcurve import KEYS, day_window
from .rolling import gradient, whole


def master_flag(soft_ok, hard_ok, gap_type, is_saa) -> Column:
    """Priority: SAA 3, soft gap 1, no hard data 2, instrumental gap (type 3) 1, else GOOD 0."""
    return choose(
        [(col(is_saa), 3), (~col(soft_ok), 1), (~col(hard_ok), 2), (col(gap_type) == 3, 1)], 0
    )


def flag_text(flag) -> Column:
    return choose([(col(flag) == k, v) for k, v in MASTER_FLAGS.items()], "UNKNOWN")


def escalate(flag, condition, level: int) -> Column:
    return F.when(col(condition), F.greatest(col(flag), F.lit(level))).otherwise(col(flag))


def isolated_gap(value, longest: int, keys=KEYS) -> Column:
    """Missing row whose gap is at most ``longest`` rows, with data on both sides."""
    w = day_window(keys)
    from pyspark.sql.window import Window

    seen = F.when(col(value).isNotNull(), F.col("bin"))
    before = F.last(seen, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    behind = F.first(seen, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return col(value).isNull() & F.coalesce(behind - before - 1 <= longest, F.lit(False))


def dilate(flag, before: int, after: int, keys=KEYS) -> Column:
    frame = day_window(keys).rowsBetween(-after, before)
    return F.coalesce(F.max(F.when(col(flag), 1).otherwise(0)).over(frame), F.lit(0)) == 1


def particle_events(df: DataFrame, soft: str, hard: str, good="good", kappa=5.0, spread=30, undo=5, keys=KEYS) -> DataFrame:
    """Soft-band gradient outliers that the hard band does not share, widened by ``spread`` rows;
    rows around a simultaneous hard-band spike are taken out again."""
    day = whole(keys)
    d = df.withColumn("_s", F.coalesce(col(soft), F.lit(0.0))).withColumn("_h", F.coalesce(col(hard), F.lit(0.0)))
    d = d.withColumn("_gs", gradient("_s", keys)).withColumn("_gh", gradient("_h", keys))
    ok = col(good)
    d = d.withColumn("_ss", F.stddev_pop(F.when(ok, F.col("_gs"))).over(day))
    d = d.withColumn("_sh", F.when(F.count(F.when(ok, F.lit(1))).over(day) > 10, F.stddev_pop(F.when(ok, F.col("_gh"))).over(day)).otherwise(1.0))
    out = F.coalesce(F.abs(F.col("_gs")) > kappa * F.col("_ss"), F.lit(False))
    flat = F.abs(F.col("_gh")) < 2 * F.col("_sh")
    present = col(hard).isNotNull()
    d = d.withColumn("_cand", out & (~present | flat) & ok)
    d = d.withColumn("_both", out & present & (F.abs(F.col("_gh")) > 3 * F.col("_sh")))
    mask = dilate("_cand", spread, spread, keys) & ~dilate("_both", undo, undo, keys)
    return d.withColumn("particle", mask.cast("bigint")).drop("_s", "_h", "_gs", "_gh", "_ss", "_sh", "_cand", "_both")


def saturation_ceiling(df: DataFrame, value: str, by=("channel",), edges=60, share=0.01, least=100) -> DataFrame:
    """Upper end of the populated part of a log histogram, per group: (by..., n, top, ceiling).

    Two partial aggregates (range, then counts per histogram cell); the only rows that meet in one
    task are the ``edges`` cells of a group.
    """
    pos = df.where(F.col(value) > 0)
    span = pos.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("top"), F.count(F.lit(1)).alias("n"))
    span = sized(span, "ranges")
    step = F.log10(F.col("top") * 1.05 / F.col("lo")) / (edges - 1)
    cell = F.least(F.floor(F.log10(F.col(value) / F.col("lo")) / step), F.lit(edges - 2)).cast("bigint")
    counts = pos.join(span, list(by)).groupBy(*by, "lo", "top", "n", cell.alias("cell")).agg(F.count(F.lit(1)).alias("c"))
    from pyspark.sql.window import Window

    w = Window.partitionBy(*by)
    counts = counts.withColumn("_max", F.max("c").over(w))
    best = counts.groupBy(*by, "lo", "top", "n").agg(
        F.max(F.when((F.col("c") >= F.col("_max") * share) & (F.col("cell") >= 1), F.col("cell"))).alias("cell"))
    edge = F.col("lo") * F.pow(F.lit(10.0), step * F.col("cell"))
    ceiling = F.when((F.col("n") < least) | F.col("cell").isNull() | (F.col("cell") < 2), F.col("top")).otherwise(edge)
    return best.select(*by, "n", "top", ceiling.alias("ceiling"))


def saturated(value, ceiling, n, least=100) -> Column:
    return (col(n) >= least) & (col(value) >= 0.95 * col(ceiling))


def excess(df: DataFrame, value: str, bg="bg", sigma="sigma", good="good") -> DataFrame:
    """Background-subtracted value on GOOD rows, its clipped form and its significance."""
    e = F.when(col(good), col(value) - col(bg))
    return df.withColumn("excess", e).withColumn("excess_pos", F.greatest(F.col("excess"), F.lit(0.0))).withColumn(
        "snr", F.when(col(sigma) > 0, F.col("excess") / col(sigma)))


def cross_calibration(df: DataFrame, counts: str, flux: str, lo=1e-8, hi=1e-6, least=100, by=()) -> DataFrame:
    """Linear counts -> flux fit over quiet rows (slope, intercept, r2); a median ratio when there are
    too few of them."""
    from .ranking import exact_quantiles, with_totals

    quiet = (F.col(flux) > lo) & (F.col(flux) < hi) & F.col(counts).isNotNull()
    y, x = F.when(quiet, F.col(flux)), F.when(quiet, F.col(counts))
    stats = df.groupBy(*by).agg(F.count(y).alias("n"), F.regr_slope(y, x).alias("_s"), F.regr_intercept(y, x).alias("_i"), F.regr_r2(y, x).alias("_r2"))
    ratios = df.where(quiet & (F.col(counts) > 0)).withColumn("_ratio", F.col(flux) / F.col(counts))
    middle = exact_quantiles(ratios, by, "_ratio", [0.5]).select(*by, F.col("quantile").alias("_ratio"))
    # without groups both sides have one row; the maximum keeps it where there is no ratio at all
    stats = stats.join(sized(middle, "ratios"), list(by), "left") if by else with_totals(stats, middle.agg(F.max("_ratio").alias("_ratio")))
    enough = F.col("n") >= least
    return stats.select(*by, "n", F.when(enough, F.col("_s")).otherwise(F.col("_ratio")).alias("slope"),
                        F.when(enough, F.col("_i")).otherwise(0.0).alias("intercept"), F.when(enough, F.col("_r2")).alias("r2"))


def calibrated(counts, slope, intercept) -> Column:
    return F.greatest(col(slope) * col(counts) + col(intercept), F.lit(0.0))


# -- files and versions -----------------------------------------------------------------------------------
def content_checksums(df: DataFrame, keys, columns) -> DataFrame:
    """(keys, rows, checksum, total) whatever the order of the rows: xor and sum over hashes of the row texts.

    Both combine on the map side.  The xor alone would not see a row that occurs twice, the sum does; columns should be integers
    or texts, whose text form is the same everywhere."""
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])
    mark = F.md5(row.cast("binary"))
    number = lambda a, n: F.conv(F.substring(mark, a, n), 16, 10).cast("bigint")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(number(1, 15)).alias("checksum"), F.sum(number(16, 8)).alias("total"))


def version_consistency(checksums: DataFrame, keys, version="version") -> DataFrame:
    """Do all versions of a key hold the same rows?  (keys, versions, fewest, most, contents, consistent)"""
    content = F.struct("rows", "checksum", "total")
    out = checksums.groupBy(*keys).agg(F.countDistinct(version).alias("versions"), F.min("rows").alias("fewest"), F.max("rows").alias("most"), F.countDistinct(content).alias("contents"))
    return out.withColumn("consistent", (F.col("contents") == 1).cast("bigint"))


def version_summary(df: DataFrame, value: str, version="version", day="day") -> DataFrame:
    """Per version: days, rows, missing values, exact median and maximum (do versions share a count scale?)."""
    from .ranking import exact_quantiles

    stats = df.groupBy(version).agg(F.countDistinct(day).alias("days"), F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col(value).isNull(), 1)).alias("missing"), F.max(value).alias("top"))
    middle = exact_quantiles(df, [version], value, [0.5]).select(version, F.col("quantile").alias("median"))
    return stats.join(middle, version, "left")


def band_mismatch(df: DataFrame, bands, keys=("day",), t="t", short=2.0, long=20.0) -> DataFrame:
    """Per key: covered hours (flags for short and long coverage), filled rows of the emptiest and fullest band, their difference."""
    some = F.coalesce(*[F.col(b) for b in bands]).isNotNull()
    seen = F.when(some, F.col(t))
    counts = F.array(*[F.count(b) for b in bands])
    out = df.groupBy(*keys).agg(((F.max(seen) - F.min(seen)) / 3600.0).alias("coverage_h"), F.array_min(counts).alias("fewest"), F.array_max(counts).alias("most"))
    return out.withColumns({
        "difference": F.col("most") - F.col("fewest"), "mismatch": (F.col("most") != F.col("fewest")).cast("bigint"),
        "is_short": (F.col("coverage_h") < short).cast("bigint"), "is_long": (F.col("coverage_h") > long).cast("bigint")})
