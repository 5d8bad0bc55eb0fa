"""Spectral operators on long spectra (keys, ch, energy, counts): sums, log-linear fits, folding."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import BOLTZMANN_KEV_PER_MK, KEV_TO_ERG, col
from ..session import sized
from . import intervals

# Distance in cm and the calibration of the emission measure
DISTANCE_CM = 1.496e13
EM_SCALE = 9.0e12


def sum_spectrum(df: DataFrame, keys, ch="ch", counts="counts") -> DataFrame:
    """Element-wise sum of many spectra: a partial aggregate per (keys, channel)."""
    return df.groupBy(*keys, ch).agg(F.sum(counts).alias("counts"), F.count(F.lit(1)).alias("n_spectra"))


def to_array(df: DataFrame, keys, ch="ch", counts="counts") -> DataFrame:
    """Back to one ordered array per key (at most as long as the instrument has channels)."""
    packed = F.sort_array(F.collect_list(F.struct(ch, counts)))
    return df.groupBy(*keys).agg(F.transform(packed, lambda x: x[counts]).alias("counts"))


def rebin(df: DataFrame, keys, parts: int, channels: int, ch="ch", counts="counts") -> DataFrame:
    """Sum into ``parts`` equal channel ranges; the last one takes the remainder."""
    width = channels // parts
    part = F.least(F.floor(F.col(ch) / F.lit(width)), F.lit(parts - 1)).cast("bigint")
    return df.groupBy(*keys, part.alias("part")).agg(F.sum(counts).alias("counts"))


# -- fits -------------------------------------------------------------------------------------------------
def spectral_index(energy, rate, least=3, lo: float | None = 1.5, hi: float | None = 10.0, default=0.0) -> Column:
    """Aggregate: photon index -d ln(rate) / d ln(energy) over positive bins.

    ``default`` unless ``least`` bins are positive and the index lies in [lo, hi].
    """
    ok = (col(rate) > 0) & (col(energy) > 0)
    ln_r, ln_e = F.when(ok, F.ln(col(rate))), F.when(ok, F.ln(col(energy)))
    gamma = -F.regr_slope(ln_r, ln_e)
    good = F.count(ln_r) >= least
    if lo is not None:
        good = good & gamma.between(lo, hi)
    return F.when(good, gamma).otherwise(F.lit(default).cast("double"))


def isothermal_fit(df: DataFrame, keys, energy="energy", rate="counts", lo=2.0, hi=10.0, least=3,
                   t_range=(1.0, 100.0), em_range=(1e-10, 1e10), power=1.0) -> DataFrame:
    """Temperature (MK), emission measure and reduced chi-square of EM/E**power * exp(-E/kT).

    ln(rate * E**power) is linear in E, so the fit is one regression aggregate; parameters are clipped to
    their bounds and chi-square (variance = max(rate, 1)) follows from the same sums in a second pass.
    """
    e, r = F.col(energy), F.col(rate)
    used = df.where(e.between(lo, hi))
    ok = r > 0
    y = F.when(ok, F.ln(r) + power * F.ln(e))
    x = F.when(ok, e)
    fit = used.groupBy(*keys).agg(F.regr_slope(y, x).alias("_s"), F.regr_intercept(y, x).alias("_i"), F.count(y).alias("bins"))
    fit = fit.where(F.col("bins") >= least)
    hot = F.when(F.col("_s") < 0, -1.0 / (F.col("_s") * BOLTZMANN_KEV_PER_MK)).otherwise(t_range[1])
    fit = fit.withColumn("temp_mk", F.least(F.greatest(hot, F.lit(t_range[0])), F.lit(t_range[1])))
    fit = fit.withColumn("em", F.least(F.greatest(F.exp("_i"), F.lit(em_range[0])), F.lit(em_range[1]))).drop("_s", "_i")
    model = F.col("em") / F.pow(e, F.lit(float(power))) * F.exp(-e / (BOLTZMANN_KEV_PER_MK * F.col("temp_mk")))
    chi = used.join(fit, list(keys)).where(r > 0).groupBy(*keys, "temp_mk", "em", "bins").agg(
        F.sum((r - model) * (r - model) / F.greatest(r, F.lit(1.0))).alias("_c"))
    return chi.withColumn("chi2_red", F.col("_c") / F.greatest(F.col("bins") - 2, F.lit(1))).drop("_c")


def non_thermal_fit(df: DataFrame, keys, cutoffs, energy="energy", rate="counts", least=5) -> DataFrame:
    """Power law above a low-energy cutoff: (gamma, ec, norm, delta = gamma + 1, n_nth).

    Every candidate cutoff is a regression over the bins above it; the smallest mean squared log
    residual wins (ties: lower cutoff).  A bin joins each candidate below it inside its own task.
    """
    e, r = F.col(energy), F.col(rate)
    grid = F.explode(F.filter(F.array(*[F.lit(float(c)) for c in cutoffs]), lambda c: c <= e)).alias("ec")
    rows = df.where((r > 0) & (e > 0)).select(*keys, F.ln(r).alias("y"), F.ln(e).alias("x"), grid)
    per = rows.groupBy(*keys, "ec").agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("s"), F.regr_intercept("y", "x").alias("i"),
        F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"), F.regr_sxx("y", "x").alias("sxx"))
    per = per.where((F.col("n") >= least) & (F.col("sxx") > 0))
    per = per.withColumn("mse", (F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")) / F.col("n"))
    best = per.groupBy(*keys).agg(F.min(F.struct("mse", "ec", "s", "i", "n")).alias("b"))
    out = best.select(*keys, F.col("b.ec").alias("ec"), (-F.col("b.s")).alias("gamma"), F.exp("b.i").alias("norm"), F.col("b.n").alias("bins"))
    return out.withColumn("delta", F.col("gamma") + 1).withColumn(
        "n_nth", F.when(F.col("gamma") > 0, F.col("norm") * F.pow("ec", -F.col("gamma")) / F.col("gamma")).otherwise(0.0))


def thermal_split(df: DataFrame, keys, cutoffs, thermal=(2.0, 10.0), share=(5.0, 20.0), energy="energy", rate="counts", least=3) -> DataFrame:
    """Isothermal fit below, residual power law above, and the thermal share of the ``share`` range."""
    e, r = F.col(energy), F.col(rate)
    hot = isothermal_fit(df, keys, energy, rate, *thermal, least=least)
    model = F.col("em") / e * F.exp(-e / (BOLTZMANN_KEV_PER_MK * F.col("temp_mk")))
    both = df.join(hot.select(*keys, "temp_mk", "em"), list(keys)).withColumn("_model", model)
    residual = both.select(*keys, e.alias(energy), F.greatest(r - F.col("_model"), F.lit(0.0)).alias(rate))
    cold = non_thermal_fit(residual.where(F.col(energy) > thermal[1]), keys, cutoffs, energy, rate, least)
    inside = e.between(*share)
    part = both.groupBy(*keys, "temp_mk", "em").agg(
        F.sum(F.when(inside, F.least(F.col("_model"), r))).alias("_t"), F.sum(F.when(inside, r)).alias("_a"))
    part = part.withColumn("thermal_fraction", F.when(F.col("_a") > 0, F.col("_t") / F.col("_a")).otherwise(0.0)).drop("_t", "_a")
    return part.join(cold, list(keys), "left")


def index_track(df: DataFrame, keys, order: str, seconds: float = 900.0) -> DataFrame:
    """Soft-hard-soft change of ``gamma`` to the previous window and the rate per second."""
    w = Window.partitionBy(*keys).orderBy(order)
    shs = F.col("gamma") - F.lag("gamma").over(w)
    return df.withColumn("shs", F.coalesce(shs, F.lit(0.0))).withColumn("hardening_rate", F.coalesce(-shs / seconds, F.lit(0.0)))


# -- time-tagged spectra -----------------------------------------------------------------------------------
def hopping_spectra(spectra: DataFrame, keys, rows_per_day: int, lookback: int, step: int) -> DataFrame:
    """Channel sums of every hopping window of a day: (keys, win, ch, energy, counts) from (keys, bin, ch, energy, counts).

    Rows are first summed into blocks of ``step`` bins, which all windows share, so a window adds up lookback / step blocks."""
    if lookback % step:
        raise ValueError("the window must be a whole number of steps")
    top, wide = (rows_per_day - 1 - lookback) // step, lookback // step
    blocks = spectra.groupBy(*keys, F.floor(F.col("bin") / F.lit(step)).cast("bigint").alias("_b"), "ch", "energy").agg(F.sum("counts").alias("counts"))
    lo, hi = F.greatest(F.col("_b") - (wide - 1), F.lit(0)), F.least(F.col("_b"), F.lit(top))
    spread = blocks.where(lo <= hi).withColumn("win", F.explode(F.sequence(lo, hi)))
    return spread.groupBy(*keys, "win", "ch", "energy").agg(F.sum("counts").alias("counts"))


def window_spectral(spectra: DataFrame, keys, soft: str, hard: str, second: str, cutoffs, detector="channel", order="win", seconds=900.0, **fit) -> DataFrame:
    """The eight spectral features of every window from the summed spectra of its detectors; 0 where a fit has too few channels.

    Temperature, emission measure and index of the soft detector, an index for either hard one, the change of the first
    positive of hard, second and soft index to the window before and its rate, and the share of the hard spectrum (of
    the soft one where there is none) that the isothermal model leaves over.
    """
    keys = list(keys)
    both = [*keys, detector]
    gamma = spectra.groupBy(*both).agg(spectral_index("energy", "counts").alias("g"))
    of = lambda name: F.coalesce(F.max(F.when(F.col(detector) == name, F.col("g"))), F.lit(0.0))
    out = gamma.groupBy(*keys).agg(of(soft).alias("sxr_gamma_window"), of(hard).alias("hxr_gamma_window_czt1"), of(second).alias("hxr_gamma_window_cdte1"))
    split = thermal_split(spectra.where(F.col(detector).isin(soft, hard)), both, cutoffs, **fit)
    own = lambda name, c: F.max(F.when(F.col(detector) == name, F.col(c)))
    part = split.groupBy(*keys).agg(own(soft, "temp_mk").alias("sxr_temp_window"), own(soft, "em").alias("sxr_em_window"),
                                    F.coalesce(own(hard, "thermal_fraction"), own(soft, "thermal_fraction")).alias("_t"))
    out = out.join(part, keys, "left").fillna(0.0, ["sxr_temp_window", "sxr_em_window"])
    share = F.least(F.greatest(1 - F.col("_t"), F.lit(0.0)), F.lit(1.0))
    out = out.withColumn("nonthermal_fraction_window", F.coalesce(share, F.lit(0.0))).drop("_t")
    first = lambda *names: F.coalesce(*[F.when(F.col(n) > 0, F.col(n)) for n in names], F.lit(0.0))
    out = out.withColumn("gamma", first("hxr_gamma_window_czt1", "hxr_gamma_window_cdte1", "sxr_gamma_window"))
    track = index_track(out, [k for k in keys if k != order], order, seconds)
    return track.withColumnsRenamed({"shs": "shs_index", "hardening_rate": "spectral_hardening_rate"}).drop("gamma")


def flare_spectra(spectra: DataFrame, flares: DataFrame, keys=("day",), t="t", start="start_t", end="end_t", width=3600, ch="ch", cadence=1.0) -> DataFrame:
    """Spectra accumulated over every flare: (keys, start, end, ch, counts, bins, exposure, total).

    A range join of time-tagged spectra with the flares; channel sums combine on the map side.  ``bins`` counts the time
    bins of the flare that have a spectrum, ``total`` all counts of the flare.
    """
    keys = list(keys)
    flare = [*keys, start, end]
    inside = intervals.range_join(spectra.select(*keys, t, ch, "counts"), flares.select(*flare), t, start, end, width, on=tuple(keys))
    sums = inside.groupBy(*flare, ch).agg(F.sum("counts").alias("counts"))
    seen = inside.select(*flare, t, "counts").groupBy(*flare, t).agg(F.sum("counts").alias("_n")).groupBy(*flare).agg(F.count(F.lit(1)).alias("bins"), F.sum("_n").alias("total"))
    return sums.join(seen, flare).withColumn("exposure", F.col("bins") * F.lit(float(cadence)))


def flare_temperatures(accumulated: DataFrame, channels: DataFrame, flare, least_bins=5, least=10, smallest_area=1e-6) -> DataFrame:
    """Isothermal fit of accumulated flare spectra: (flare, temp_mk, log_em, chi2_red, channels, bins, exposure, total).

    ``channels`` is the instrument table (ch, energy, area, de): counts over area and channel width follow the photon model
    norm * exp(-E/kT) / sqrt(E).  Flares of fewer than ``least_bins`` time bins or ``least`` usable channels are not fitted.
    """
    flare = list(flare)
    known = channels.where((F.col("area") > smallest_area) & (F.col("de") > 0) & (F.col("energy") > 0))
    rows = accumulated.where(F.col("bins") >= least_bins).join(known, "ch")
    fit = isothermal_fit(rows.select(*flare, "energy", (F.col("counts") / (F.col("area") * F.col("de"))).alias("rate")), flare, rate="rate", lo=0.0, hi=float("inf"), least=least, power=0.5)
    fit = fit.withColumn("log_em", F.log10(F.col("em") * (4 * math.pi * DISTANCE_CM**2 * EM_SCALE) + 1e-10))
    whole = accumulated.select(*flare, F.col("bins").alias("time_bins"), "exposure", "total").distinct()
    return fit.withColumnRenamed("bins", "channels").drop("em").join(whole, flare)


def temperature_difference(samples: DataFrame, fits: DataFrame, keys=("day",), t="t", temp="temp", width=3600, start="start_t", end="end_t") -> DataFrame:
    """Every sample with its flare's fitted temperature and emission measure, and the sample's own temperature minus it.

    Samples outside fitted flares have NULL; flares of a day do not overlap."""
    keys = list(keys)
    inside = intervals.range_join(samples.select(*keys, t), fits.select(*keys, start, end, "temp_mk", "log_em"), t, start, end, width, on=tuple(keys))
    inside = inside.select(*keys, t, F.col("temp_mk").alias("flare_temp_mk"), F.col("log_em").alias("flare_log_em"))
    return samples.join(inside, [*keys, t], "left").withColumn("temp_diff", F.col(temp) - F.col("flare_temp_mk"))


# -- instrument response -------------------------------------------------------------------------------------
def fold_response(matrix: DataFrame, area: DataFrame, flux: DataFrame, keys=()) -> DataFrame:
    """counts[ch] = sum_e R[ch, e] * area[e] * flux[e] with R as (ch, e, value) rows.

    Area and flux combine first into a table of known size, so the response rows stay where they are unless that table is
    too large to broadcast; channel sums are pre-aggregated on the map side.
    """
    source = sized(flux.join(area, "e").select(*keys, "e", (F.col("flux") * F.col("area")).alias("w")), "source")
    return matrix.join(source, "e").groupBy(*keys, "ch").agg(F.sum(F.col("value") * F.col("w")).alias("counts"))


def channel_energies(spark: SparkSession, channels: int, first: float, step: float) -> DataFrame:
    """The instrument's channel table (ch, emin, emax, energy, de); energies are channel centres."""
    low = F.lit(first) + F.col("id") * F.lit(step)
    return spark.range(channels).select(F.col("id").alias("ch"), (low - step / 2).alias("emin"), (low + step / 2).alias("emax"), low.alias("energy"), F.lit(float(step)).alias("de"))


def compress_response(matrix: DataFrame, smallest: float = 0.0) -> DataFrame:
    """(ch, e, value) -> one row per energy: runs of neighbouring channels (first channel, length) and all their values in order.

    Values up to ``smallest`` are left out.  An energy has at most as many values as the instrument has channels.
    """
    kept = matrix.where(F.col("value") > smallest)
    run = F.col("ch") - F.row_number().over(Window.partitionBy("e").orderBy("ch"))
    runs = kept.withColumn("_r", run).groupBy("e", "_r").agg(F.min("ch").alias("first"), F.count(F.lit(1)).alias("length"), F.sort_array(F.collect_list(F.struct("ch", "value"))).alias("_v"))
    parts = F.sort_array(F.collect_list(F.struct("first", "length", "_v")))
    rows = runs.groupBy("e").agg(parts.alias("_p"))
    pick = lambda c: F.transform("_p", lambda x: x[c]).alias(c)
    return rows.select("e", pick("first"), pick("length"), F.flatten(F.transform("_p", lambda x: F.transform(x["_v"], lambda v: v["value"]))).alias("values"))


def expand_response(rows: DataFrame) -> DataFrame:
    """The (ch, e, value) rows of a compressed response, made in place."""
    channels = F.flatten(F.transform(F.arrays_zip("first", "length"), lambda x: F.sequence(x["first"], x["first"] + x["length"] - 1)))
    return rows.select("e", F.inline(F.arrays_zip(channels.alias("ch"), F.col("values").alias("value"))))


def fold_compressed(rows: DataFrame, area: DataFrame, flux: DataFrame, keys=()) -> DataFrame:
    """``fold_response`` of a compressed response: the flux meets one row per energy, whose values are expanded afterwards."""
    source = sized(flux.join(area, "e").select(*keys, "e", (F.col("flux") * F.col("area")).alias("w")), "source")
    met = rows.join(source, "e")
    channels = F.flatten(F.transform(F.arrays_zip("first", "length"), lambda x: F.sequence(x["first"], x["first"] + x["length"] - 1)))
    spread = met.select(*keys, "w", F.inline(F.arrays_zip(channels.alias("ch"), F.col("values").alias("value"))))
    return spread.groupBy(*keys, "ch").agg(F.sum(F.col("value") * F.col("w")).alias("counts"))


def area_lookup(points: DataFrame, curve: DataFrame, x="energy", cx="ex", cy="area", width=1.0) -> DataFrame:
    """Linear interpolation in a tabulated curve, 0 outside.

    ``curve`` is an instrument table (one row per energy bin).  Its segments are intervals closed on
    the left, the last one on both sides, and points find theirs through a bucketed range join.
    """
    w = Window.orderBy(cx)
    seg = curve.select(F.col(cx).alias("_x0"), F.col(cy).alias("_y0"), F.lead(cx).over(w).alias("_x1"), F.lead(cy).over(w).alias("_y1"),
                       F.lead(cx, 2).over(w).isNull().alias("_end")).where(F.col("_x1").isNotNull())
    lo, hi = F.floor(F.col("_x0") / F.lit(width)).cast("bigint"), F.floor(F.col("_x1") / F.lit(width)).cast("bigint")
    seg = seg.withColumn("_b", F.explode(F.sequence(lo, hi)))
    pts = points.withColumn("_b", F.floor(F.col(x) / F.lit(width)).cast("bigint"))
    below_end = (F.col(x) < F.col("_x1")) | (F.col("_end") & (F.col(x) == F.col("_x1")))
    joined = pts.join(seg, (pts["_b"] == seg["_b"]) & (F.col(x) >= F.col("_x0")) & below_end, "left")
    value = F.col("_y0") + (F.col("_y1") - F.col("_y0")) * (F.col(x) - F.col("_x0")) / (F.col("_x1") - F.col("_x0"))
    return joined.select(*[F.col(c) for c in points.columns], F.coalesce(value, F.lit(0.0)).alias(cy))


def energy_flux(df: DataFrame, keys, lo: float, hi: float, energy="energy", photons="photons") -> DataFrame:
    """Trapezoid integral of E * F(E) over [lo, hi] in erg."""
    w = Window.partitionBy(*keys).orderBy(energy)
    d = df.where(F.col(energy).between(lo, hi)).withColumn("_y", F.col(energy) * F.col(photons))
    area = (F.lead(energy).over(w) - F.col(energy)) * (F.lead("_y").over(w) + F.col("_y")) / 2
    d = d.withColumn("_a", area)
    return d.groupBy(*keys).agg((F.coalesce(F.sum("_a"), F.lit(0.0)) * KEV_TO_ERG).alias("flux"))
