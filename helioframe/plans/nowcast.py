"""Day list -> flare catalog: mask, fill, correct, calibrate, detect per band, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import intervals as iv
from ..operators import islands as isl
from ..operators import matching as ma
from ..operators import rolling as ro
from ..session import cut_lineage

DEFAULTS = dict(threshold=1e-6, window=600, min_run=10, min_duration=240, short_duration=10, merge_gap=60)


def soft_flux(lc: DataFrame, good: DataFrame, cadence: int, tau: float = 13.65e-6, factor: float = sc.COUNTS_TO_IRRADIANCE, width: int = 3600) -> DataFrame:
    """Masked, gap-filled, dead-time corrected irradiance."""
    masked = iv.covered(lc, good, width=width).withColumn("v", F.when(F.col("inside"), F.col("v"))).drop("inside")
    filled = ro.forward_fill(masked)
    true = F.coalesce(sc.deadtime_true_rate("filled", tau), F.col("filled"))
    return filled.withColumn("flux", sc.counts_to_irradiance(true, factor)).drop("filled")


def hard_rate(lc: DataFrame, good: DataFrame, background: dict[str, float], width: int = 3600) -> DataFrame:
    """Background-subtracted hard rates, 0 outside good times."""
    level = sc.choose([(F.col("channel") == k, v) for k, v in background.items()], 0.0)
    marked = iv.covered(lc, good, width=width)
    return marked.withColumn("rate", F.when(F.col("inside"), sc.subtract_floor(F.coalesce("v", F.lit(0.0)), level)).otherwise(0.0)).drop("inside")


def nowcast(lc: DataFrame, good: DataFrame, soft: str, hard: dict[str, float], cadence: int = 1, tolerance: int = 60, factor: float = sc.COUNTS_TO_IRRADIANCE,
            tau: float = 13.65e-6, burst=None, classify=sc.class_letter, **detection) -> DataFrame:
    """Merged catalog of all days.

    The binned light curve is written once to the shared folder: soft and hard branches, the matching
    and the orphan search all read that small table instead of rescanning the raw samples.
    """
    opts = {**DEFAULTS, **detection}
    grid = cut_lineage(lc, "light-curve")
    s = soft_flux(grid.where(F.col("channel") == soft), good, cadence, tau, factor)
    flares = isl.detect_swpc(s, cadence=cadence, value="flux", classify=classify, **opts)
    h = hard_rate(grid.where(F.col("channel").isin(*hard)), good, hard)
    bursts = isl.detect_burst(h, value="rate", cadence=cadence, **(burst or {}))
    left = cut_lineage(flares.withColumn("lid", F.concat_ws("-", "channel", "peak_t")).withColumn("lt", F.col("peak_t")), "soft-events")
    right = cut_lineage(bursts.withColumn("rid", F.concat_ws("-", "channel", "peak_t")).withColumn("rt", F.col("peak_t")), "hard-events")
    pairs = ma.greedy_pairs(left, right, tolerance)
    return ma.merge_catalogs(left, right, pairs)
