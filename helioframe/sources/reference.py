"""The reference instrument's flux series and the channel layout of the sequence tensor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import SECONDS_PER_DAY, mjd_to_unix
from ..operators.rolling import linear_fill, step
from .lightcurve import fill_grid

# The epoch of the series (MJD), and where each band of a detector stands among the twelve channels
EPOCH_MJD = 51544.5
LAYOUT = [
    ("sxr", 0, 0), ("czt", 0, 1), ("czt", 1, 2), ("czt", 2, 3), ("czt", 3, 4), ("cdte", 0, 5), ("cdte", 1, 6), ("cdte", 2, 7),
    ("czt", 4, 8), ("xrsb", 0, 9), ("xrsa", 0, 10),
]
DERIVATIVE = 11


def reference_flux(df: DataFrame, seconds="time", long="xrsb_flux", short="xrsa_flux") -> DataFrame:
    """(day, t, mjd, xrsb, xrsa) of the stored series: Unix time from its own epoch; negative and non-finite flux is missing."""
    known = lambda c: F.when((F.col(c) >= 0) & (F.col(c) < float("inf")), F.col(c).cast("double"))  # noqa: E731 - NaN sorts last
    mjd = EPOCH_MJD + F.col(seconds) / float(SECONDS_PER_DAY)
    rows = df.select(mjd.alias("mjd"), known(long).alias("xrsb"), known(short).alias("xrsa"))
    rows = rows.withColumn("t", F.round(mjd_to_unix("mjd")).cast("bigint"))
    return rows.select(F.date_from_unix_date(F.floor(F.col("t") / SECONDS_PER_DAY).cast("int")).alias("day"), "t", "mjd", "xrsb", "xrsa")


def on_grid(flux: DataFrame, cadence: int, columns=("xrsb", "xrsa")) -> DataFrame:
    """The series on the cadence grid of its days: means per bin, gaps interpolated, 0 outside the covered range."""
    slot = F.floor(F.pmod(F.col("t"), F.lit(SECONDS_PER_DAY)) / F.lit(cadence)).cast("bigint")
    grid = fill_grid(flux.groupBy("day", slot.alias("bin")).agg(*[F.avg(c).alias(c) for c in columns]), cadence, ("day",))
    for c in columns:
        grid = linear_fill(grid, c, f"{c}_filled", ("day",), outside=0)
    return grid.select("day", "bin", "t", *[F.col(f"{c}_filled").alias(c) for c in columns])


def channel_dimension(spark: SparkSession) -> DataFrame:
    """(detector, band, ch) of the eleven measured channels."""
    return spark.createDataFrame(LAYOUT, "detector string, band int, ch int")


def channel_layout(bands: DataFrame, keys=("day",)) -> DataFrame:
    """Long band rows (keys, bin, detector, band, v) -> ch0 ... ch11 per bin.

    The band map is a dimension of eleven rows; the pivot is one partial aggregate.  Missing and negative values are 0,
    the last channel is the step of the first one (0 at the start of a day).
    """
    keys = list(keys)
    placed = bands.join(channel_dimension(bands.sparkSession), ["detector", "band"])
    value = lambda k: F.greatest(F.coalesce(F.max(F.when(F.col("ch") == k, F.col("v"))), F.lit(0.0)), F.lit(0.0))
    wide = placed.groupBy(*keys, "bin").agg(*[value(k).alias(f"ch{k}") for k in range(DERIVATIVE)])
    return wide.withColumn(f"ch{DERIVATIVE}", F.coalesce(step("ch0", tuple(keys)), F.lit(0.0)))
