"""Scalar expressions: clocks, unit conversions, corrections, flare classes, spectral models.

Every function takes and returns Columns, so all of it stays inside whole-stage code generation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values ---------------------------------------------------------------------------------
MJD_UNIX_EPOCH = 40587
SECONDS_PER_DAY = 86400
COUNTS_TO_IRRADIANCE = 2.5e-8
SPURIOUS_COUNTS = 500.0
DEADTIME_CDTE = 10e-6
DEADTIME_CZT = 5e-6
CLASS_FLOORS = {"X": 1e-4, "M": 1e-5, "C": 1e-6, "B": 1e-7}
CLASS_BASE = {"A": 1e-8, "B": 1e-7, "C": 1e-6, "M": 1e-5, "X": 1e-4}
CLASS_SCALE = {"A": 1e-3, "B": 1e-1, "C": 1.0, "M": 10.0, "X": 100.0}
HARD_BACKGROUND = {"czt": [15.0, 12.0, 8.0, 5.0, 70.0], "cdte": [0.15, 0.15, 0.15, 0.15, 0.15]}
BOLTZMANN_KEV_PER_MK = 0.08617
KEV_TO_ERG = 1.602e-9
RATIO_TO_LOG_TEMPERATURE = (0.051, 0.979, 0.184, -0.010)  # powers of log10(long / short)
RATIO_LIMITS = (1.05, 35.0)
TEMPERATURE_LIMITS_MK = (3.0, 50.0)
MASTER_FLAGS = {
    0: "GOOD", 1: "GTI_GAP", 2: "HXR_NO_DATA", 3: "SAA",
    4: "PARTICLE_EVENT", 5: "SATURATED", 6: "INSTRUMENTAL", 7: "MARGINAL",
}
# ----------------------------------------------------------------------------------------------


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def choose(pairs, default=None) -> Column:
    """CASE over ``(condition, value)`` pairs."""
    expr = None
    for cond, value in pairs:
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr.otherwise(default)


# -- missing values ------------------------------------------------------------------------------
def finite(c) -> Column:
    """NaN and infinities become NULL."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def zero_if_missing(c) -> Column:
    return F.coalesce(finite(c), F.lit(0.0))


def ratio(num, den, default=None) -> Column:
    """``num / den`` where the denominator is positive."""
    return F.when(col(den) > 0, col(num) / col(den)).otherwise(default)


def clipped_ratio(num, den, lo: float = 1e-3, hi: float = 1e3) -> Column:
    """Hardness ratio limited to [lo, hi]; NULL unless den > 0 and num >= 0."""
    ok = (col(den) > 0) & (col(num) >= 0)
    return F.when(ok, F.least(F.greatest(col(num) / col(den), F.lit(lo)), F.lit(hi)))


def clip(c, lo, hi) -> Column:
    return F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi))


# -- clocks --------------------------------------------------------------------------------------
def epoch_seconds(ts) -> Column:
    """Whole Unix seconds of a TIMESTAMP or TIMESTAMP_NTZ column (session clock: UTC)."""
    return F.unix_seconds(col(ts).cast("timestamp"))


def epoch_micros(ts) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def met_to_mjd(met, ref_int=MJD_UNIX_EPOCH, ref_frac=0.0) -> Column:
    return F.lit(ref_int) + F.lit(ref_frac) + col(met) / SECONDS_PER_DAY


def mjd_to_unix(mjd) -> Column:
    return (col(mjd) - MJD_UNIX_EPOCH) * SECONDS_PER_DAY


def unix_to_mjd(t) -> Column:
    return col(t) / SECONDS_PER_DAY + MJD_UNIX_EPOCH


def mjd_to_timestamp(mjd) -> Column:
    return F.timestamp_seconds(mjd_to_unix(mjd))


# -- detector corrections ------------------------------------------------------------------------
def deadtime_true_rate(measured, tau: float, steps: int = 6) -> Column:
    """Solve n*exp(-n*tau) = m for the true rate n (the branch below the paralysable maximum).

    With a = n*tau this is a = -W(-m*tau).  Cubic (Halley) updates from a series start reach double
    precision in a handful of steps everywhere, so the fold stays short; it runs in the JVM.  Results
    are limited to [m, 0.999/tau].  Rates above the maximum 1/(e*tau) have no solution and come back
    NULL; :func:`deadtime_saturated` flags them.
    """
    m = col(measured).cast("double")
    y = m * tau
    p = F.sqrt(F.greatest(2 * (1 - math.e * y), F.lit(0.0)))
    start = F.when(y < 0.2, y * (1 + y * (1 + 1.5 * y))).otherwise(1 - p * (1 - p * (1 / 3 - p * 11 / 72)))

    def halley(a, _):
        f = a * F.exp(-a) - y
        first, second = F.exp(-a) * (1 - a), F.exp(-a) * (a - 2)
        below = 2 * first * first - f * second
        return F.when(F.abs(below) > 1e-30, a - 2 * f * first / below).otherwise(a)

    solved = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halley) / tau
    limited = F.least(F.greatest(solved, m), F.lit(0.999 / tau))
    return F.when(m <= 0, F.lit(0.0)).when(~deadtime_saturated(m, tau), limited)


def deadtime_saturated(measured, tau: float) -> Column:
    return col(measured) > 1.0 / (math.e * tau)


def subtract_floor(c, level) -> Column:
    """max(value - level, 0); NULL stays NULL."""
    return F.greatest(col(c) - level, F.lit(0.0))


def counts_to_irradiance(counts, factor: float = COUNTS_TO_IRRADIANCE) -> Column:
    return col(counts) * factor


# -- flare classes -------------------------------------------------------------------------------
def class_letter(flux) -> Column:
    return choose([(col(flux) >= floor, letter) for letter, floor in CLASS_FLOORS.items()], "A")


def class_label(flux, digits: int = 1) -> Column:
    """Flux as text such as ``M6.3``."""
    letter = class_letter(flux)
    base = choose([(letter == k, v) for k, v in CLASS_BASE.items()])
    return F.concat(letter, F.format_string(f"%.{digits}f", col(flux) / base))


def parse_class(text, standard: bool = True) -> Column:
    """``M6.3`` -> flux.  ``standard=False`` adds the decade base once more (legacy catalogs)."""
    s = F.upper(F.trim(col(text)))
    base = choose([(s.startswith(k), v) for k, v in CLASS_BASE.items()])
    flux = base * F.coalesce(_try_number(s), F.lit(1.0))
    return flux if standard else base + flux


def _try_number(s: Column) -> Column:
    body = F.regexp_extract(s, r"^[A-Z]\s*([0-9]*\.?[0-9]+)", 1)
    return F.when(body != "", body.cast("double"))


def class_number(text, default=None) -> Column:
    """Class on a linear scale with C1 = 1 (A/1000, B/10, M*10, X*100)."""
    s = F.upper(F.trim(col(text)))
    scale = choose([(s.startswith(k), v) for k, v in CLASS_SCALE.items()])
    return F.coalesce(scale * _try_number(s), F.lit(default).cast("double"))


def event_class(peak_counts) -> Column:
    return class_letter(counts_to_irradiance(peak_counts))


def alert_level(prob, precursor, nowcast) -> Column:
    """Traffic-light alert from a flare probability, a precursor index and a nowcast flag."""
    return (
        F.when(col(nowcast), "FLARE NOW")
        .when(col(prob) > 0.9, "RED")
        .when(col(prob) > 0.7, "ORANGE")
        .when(col(precursor) > 0.6, "YELLOW")
        .otherwise("GREEN")
    )


# -- temperature and emission measure -----------------------------------------------------------
def ratio_temperature(flux_a, flux_b) -> Column:
    """Temperature in MK from the short/long band ratio (cubic in log10 of the ratio)."""
    fa = F.greatest(col(flux_a), F.lit(2e-8))
    fb = F.greatest(col(flux_b), F.lit(5e-8))
    w = F.log10(clip(fb / fa, *RATIO_LIMITS))
    c0, c1, c2, c3 = RATIO_TO_LOG_TEMPERATURE
    hot = clip(F.pow(F.lit(10.0), c0 + c1 * w + c2 * w * w + c3 * w * w * w), *TEMPERATURE_LIMITS_MK)
    return F.when(~quiet_pair(flux_a, flux_b), hot)


def ratio_emission_measure(flux_a, flux_b) -> Column:
    """Emission measure in units of 1e48 cm^-3 for the temperature of the same pair."""
    t = ratio_temperature(flux_a, flux_b)
    fb = F.greatest(col(flux_b), F.lit(5e-8))
    return clip(fb * 1e5 * F.sqrt(t) * F.exp(17.0 / t), 0.001, 1e4) + t * 0


def quiet_pair(flux_a, flux_b) -> Column:
    return (col(flux_a) < 5e-8) | (col(flux_b) < 1e-7)


# -- photon models -------------------------------------------------------------------------------
def isothermal_photons(energy, em, temp_mk) -> Column:
    return col(em) / col(energy) * F.exp(-col(energy) / (BOLTZMANN_KEV_PER_MK * col(temp_mk)))


def power_law_photons(energy, norm, gamma) -> Column:
    return col(norm) * F.pow(col(energy), -col(gamma))


def thick_target_photons(energy, norm, gamma, cutoff) -> Column:
    """Power law above the cutoff, exponential roll-over below it."""
    e, c = col(energy), col(cutoff)
    above = power_law_photons(e, norm, gamma)
    below = power_law_photons(c, norm, gamma) * F.exp(-(c - e) / c)
    return F.when(e >= c, above).otherwise(below)


def electron_column(norm, delta, cutoff) -> Column:
    """Integral of a power law of index delta above the cutoff."""
    d = col(delta)
    return F.when(d > 1, col(norm) * F.pow(col(cutoff), 1 - d) / (d - 1)).otherwise(0.0)


# -- feature output ------------------------------------------------------------------------------
TIE_NUDGE = 1.3e-10


def tidy(c, digits: int = 6) -> Column:
    """Rounded, NaN-free, without negative zero.

    Means of decimal data often sit exactly between two rounded values, where the last bit of a
    distributed sum would decide; the nudge settles such ties upwards whatever the summation order.
    """
    return F.round(finite(c) + F.lit(TIE_NUDGE), digits) + F.lit(0.0)
