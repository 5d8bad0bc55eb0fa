"""Raw samples -> fixed-cadence light curves.

Binning is what makes everything downstream scale: raw rows are reduced by a map-side partial
aggregate, and afterwards a (channel, day) group can never hold more than ``86400 / cadence`` rows,
however many raw rows its channel has.  Per-day windows are therefore bounded by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import SECONDS_PER_DAY, epoch_seconds

KEYS = ("channel", "day")


def bins_per_day(cadence: int) -> int:
    return SECONDS_PER_DAY // cadence


def day_window(keys=KEYS):
    return Window.partitionBy(*keys).orderBy("bin")


def _clock(ts: str, cadence: int) -> tuple[Column, Column]:
    sec = epoch_seconds(ts)
    day = F.date_from_unix_date((sec / F.lit(SECONDS_PER_DAY)).cast("bigint").cast("int"))
    return day.alias("day"), F.floor((sec % SECONDS_PER_DAY) / F.lit(cadence)).cast("bigint").alias("bin")


def bin_samples(df: DataFrame, cadence: int, ts="ts", channel="event_type", value="value") -> DataFrame:
    """(channel, day, bin) -> mean value ``v``, sample count ``n``, extremes ``lo`` / ``hi``."""
    day, slot = _clock(ts, cadence)
    return df.groupBy(F.col(channel).alias("channel"), day, slot).agg(
        F.avg(value).alias("v"),
        F.count(value).alias("n"),
        F.min(value).alias("lo"),
        F.max(value).alias("hi"),
    )


def bin_wide(df: DataFrame, cadence: int, channels, ts="ts", channel="event_type", value="value") -> DataFrame:
    """(day, bin) -> one mean column per channel: a pivot in a single partial aggregate."""
    day, slot = _clock(ts, cadence)
    return df.groupBy(day, slot).agg(
        *[F.avg(F.when(F.col(channel) == c, F.col(value))).alias(c) for c in channels]
    )


def fill_grid(binned: DataFrame, cadence: int, keys=KEYS) -> DataFrame:
    """Every bin of every (channel, day) that has data; empty bins carry NULL.

    Each bin expands up to its successor (``lead``), so the gap rows are generated inside the task
    that already holds the day: no spine table and no join.
    """
    w = day_window(keys)
    values = [c for c in binned.columns if c not in (*keys, "bin")]
    last = bins_per_day(cadence) - 1
    first_bin = F.when(F.lag("bin").over(w).isNull(), F.lit(0)).otherwise(F.col("bin")).cast("bigint")
    stop = F.coalesce(F.lead("bin").over(w) - 1, F.lit(last)).cast("bigint")
    spread = binned.select(*keys, F.col("bin").alias("own"), *values, first_bin.alias("a"), stop.alias("b"))
    rows = spread.select(*keys, "own", *values, F.explode(F.sequence("a", "b")).alias("bin"))
    return rows.select(
        *keys,
        "bin",
        grid_time(cadence).alias("t"),
        *[F.when(F.col("bin") == F.col("own"), F.col(c)).alias(c) for c in values],
    )


def grid_time(cadence: int, day="day", slot="bin") -> Column:
    return F.unix_date(day).cast("bigint") * SECONDS_PER_DAY + F.col(slot) * cadence


def light_curve(events: DataFrame, cadence: int, **kw) -> DataFrame:
    return fill_grid(bin_samples(events, cadence, **kw), cadence).select(*KEYS, "bin", "t", "v")


def wide_curve(events: DataFrame, cadence: int, channels, **kw) -> DataFrame:
    return fill_grid(bin_wide(events, cadence, channels, **kw), cadence, keys=("day",))


def band_order(df: DataFrame, keys, band: str, order: str) -> DataFrame:
    """Truncate all bands of a detector to the row count of the shortest one (unequal band tables).

    Positions come from a per-(detector, day) window, bounded by the cadence.
    """
    w = Window.partitionBy(*keys, band).orderBy(order)
    numbered = df.withColumn("pos", F.row_number().over(w))
    shortest = numbered.groupBy(*keys, band).agg(F.max("pos").alias("n")).groupBy(*keys).agg(F.min("n").alias("shortest"))
    return numbered.join(shortest, list(keys)).where(F.col("pos") <= F.col("shortest")).drop("shortest")


def spectra(df: DataFrame, counts="embedding", ident="vec_id", scale: float = 100.0) -> DataFrame:
    """Array spectra -> long (id, ch, counts) rows; counts are scaled magnitudes, as exact as the input."""
    keep = [c for c in df.columns if c not in (counts, ident)]
    return df.select(
        F.col(ident).alias("id"), *keep, F.posexplode(F.col(counts)).alias("ch", "raw")
    ).select("id", *keep, F.col("ch").cast("bigint").alias("ch"), (F.abs(F.col("raw").cast("double")) * scale).alias("counts"))


def linear_energy(ch="ch", first: float = 1.0, step: float = 1.0) -> Column:
    return F.lit(first) + F.col(ch) * F.lit(step)


def photon_spectra(photons: DataFrame, cadence: int, width: float, channels: int, ts="ts", channel="event_type", value="value") -> DataFrame:
    """Photon list -> counts per (channel, day, bin, ch); ch is the pulse height in steps of ``width``, others are out of range.

    One partial aggregate on the map side; afterwards a (channel, day) holds at most bins * channels rows."""
    day, slot = _clock(ts, cadence)
    ch = F.floor(F.col(value) / F.lit(float(width))).cast("bigint")
    inside = photons.where(ch.between(0, channels - 1))
    return inside.groupBy(F.col(channel).alias("channel"), day, slot, ch.alias("ch")).agg(F.count(F.lit(1)).cast("double").alias("counts"))
