"""Hopping-window features, feature matrix and training sequences.

A day of one channel sits in one partition (bounded by the cadence).  Hopping windows are exploded
inside that partition, and ``groupBy(keys, win)`` then needs no further shuffle because the data is
already hash-partitioned by a subset of the grouping keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import col, zero_if_missing
from ..functions.stats import shape, slope
from ..sources.lightcurve import day_window
from .ranking import exact_quantiles
from .rolling import up_to

DAY = ("day",)

# The feature schema, by family -------------------------------------------------------
FAMILIES: dict[str, list[str]] = {
    "sxr": ["sxr_mean", "sxr_std", "sxr_max", "sxr_min", "sxr_median", "sxr_skew", "sxr_kurtosis", "sxr_range", "sxr_cv",
            "sxr_rise_rate", "sxr_fall_rate", "sxr_abs_slope", "sxr_iqr", "sxr_spec_entropy", "sxr_peak_freq"],
    "hxr": [f"hxr_b{b}_{s}" for b in range(10) for s in ("mean", "std", "max")]
    + ["hxr_hardness_ratio", "hxr_total_mean", "soft_hard_ratio", "cdte_thermal_ratio", "cdte_boundary_ratio"],
    "pi": ["sxr_temperature_mk", "sxr_emission_measure", "sxr_chi2_red"],
    "spectra": ["hxr_spectral_index_gamma", "hxr_gamma_czt2", "hxr_gamma_cdte1", "hxr_gamma_cdte2"],
    "goes": ["goes_xrsb_flux", "goes_xrsa_flux", "goes_xrsa_xrsb_ratio"],
    "czt2": ["czt2_total_mean", "czt2_total_max", "czt2_total_std"],
    "cdte2": ["cdte2_total_mean", "cdte2_total_max", "cdte2_total_std"],
    "information": ["transfer_entropy_hxr_to_sxr", "mutual_information_sxr_hxr", "sample_entropy_sxr", "sample_entropy_hxr",
                    "lagged_cross_corr", "lagged_cross_corr_lag"],
    "neupert": ["neupert_rho_mean", "neupert_rho_std"],
    "hardness": ["hardness_ratio_slope", "hardness_ratio_mean", "hardness_ratio_std"],
    "housekeeping": ["hk_czt1temp", "hk_czt2temp", "hk_cdte1temp", "hk_cdte2temp", "hk_czthvmon", "hk_cdtehvmon", "hk_czt1satctr", "hk_cdte1pilectr"],
    "nonthermal": ["nonthermal_gamma", "nonthermal_ec", "nonthermal_n_nth", "thermal_fraction"],
    "qpp": ["qpp_detected", "qpp_period", "qpp_amplitude", "qpp_significance"],
    "corrections": ["deadtime_max_pct", "bg_fraction_pct"],
    "meta": ["window_len"],
    "causal": ["causal_network_density", "avg_in_degree", "avg_out_degree", "avg_centrality", "n_feedback_loops", "cycle_detected",
               "hxr_to_sxr_lag", "hxr_to_sxr_strength", "sxr_to_hxr_lag", "sxr_to_hxr_strength",
               "neupert_granger_improvement", "neupert_best_lag", "max_mediation_proportion"],
    "derivatives": ["dsxr_dt_mean", "dsxr_dt_std", "dsxr_dt_max", "dsxr_dt_min", "d2sxr_dt2_mean", "d2sxr_dt2_std",
                    "dhxr_dt_mean", "dhxr_dt_std", "dhxr_dt_max", "dhr_dt_mean", "dhr_dt_max", "dsxr_dhxr_ratio_mean"],
    "multiscale": [f"{x}_{s}_{w}" for x in ("sxr", "hxr") for w in ("5m", "15m", "30m") for s in ("mean", "std", "max")]
    + ["sxr_5m_to_60m_ratio", "hxr_5m_to_60m_ratio", "sxr_acceleration_trend", "hxr_acceleration_trend", "sxr_15m_slope", "hxr_15m_slope"],
    "goes_series": ["goes_xrsb_ddt_max", "goes_xrsb_rolling_std_300s", "goes_xrsb_rolling_std_1800s", "goes_xrsa_rolling_mean_300s",
                    "goes_class_current", "goes_xrsb_gradient_1h", "goes_flare_history_24h", "goes_xrsb_prev_peak_ratio"],
    "window_spectra": ["sxr_temp_window", "sxr_em_window", "sxr_gamma_window", "hxr_gamma_window_czt1", "hxr_gamma_window_cdte1",
                       "shs_index", "spectral_hardening_rate", "nonthermal_fraction_window"],
    "wavelet": ["wavelet_energy_10_30s", "wavelet_energy_30_60s", "wavelet_energy_60_120s", "wavelet_energy_120_300s", "wavelet_energy_300_600s",
                "wavelet_peak_period", "wavelet_peak_significance", "wavelet_spectral_entropy", "wavelet_hxr_energy_30_120s", "wavelet_cross_power_sxr_hxr"],
    "acf": ["sxr_acf_5s", "sxr_acf_10s", "sxr_acf_30s", "sxr_acf_60s"],
    "percentiles": ["sxr_p5", "sxr_p25", "sxr_p75", "sxr_p95"],
}
ACF_LAGS = (5, 10, 30, 60)
PERCENTILES = (5, 25, 75, 95)
SCALES = {"5m": 300, "15m": 900, "30m": 1800}
PI_BANDS = {"pi_2_5kev": (0, 30), "pi_5_8kev": (30, 80), "pi_8_12kev": (80, 140), "pi_12_18kev": (140, 220), "pi_18_22kev": (220, 340)}
LINE_CHANNELS, CONTINUUM_CHANNELS = (100, 130), (200, 300)
# -----------------------------------------------------------------------------------------------------
FEATURE_NAMES: list[str] = sorted(n for names in FAMILIES.values() for n in names)


def hop(df: DataFrame, rows_per_day: int, lookback=3600, step=300, include_last=False) -> DataFrame:
    """Repeat every row once per window that contains it: adds ``win`` (0-based) and ``pos`` in it.

    Window k covers bins [k*step, k*step+lookback).  A day has one window per start whose end lies
    before the last row (276 at the defaults); ``include_last`` adds the one that ends there.
    """
    top = (rows_per_day - lookback) // step if include_last else (rows_per_day - 1 - lookback) // step
    lo = F.greatest(F.ceil((F.col("bin") + 1 - lookback) / F.lit(step)), F.lit(0)).cast("bigint")
    hi = F.least(F.floor(F.col("bin") / F.lit(step)), F.lit(top)).cast("bigint")
    ranged = df.withColumn("_lo", lo).withColumn("_hi", hi).where(F.col("_lo") <= F.col("_hi"))
    out = ranged.withColumn("win", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")
    return out.withColumn("pos", F.col("bin") - F.col("win") * step)


def window_end(cadence: int, step: int, lookback: int, day="day") -> Column:
    """Epoch second at which window ``win`` ends (the first row after it)."""
    return F.unix_date(day).cast("bigint") * 86400 + (F.col("win") * step + lookback) * cadence


def prepare(df: DataFrame, soft: str, bands: list[str], keys=DAY) -> DataFrame:
    """Per-row ingredients that need the neighbouring rows: differences over valid samples, lagged
    values for the autocorrelation, band totals and hardness."""
    w = day_window(keys)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    s = col(soft)
    known = F.when(s.isNotNull(), F.struct(F.col("bin").alias("b"), s.alias("v")))
    d = df.withColumn("soft", s).withColumn("_p", F.last(known, ignorenulls=True).over(past))
    d = d.withColumn("vi", F.count("soft").over(up_to(keys)))
    d = d.withColumn("d1", F.when(F.col("soft").isNotNull(), F.col("soft") - F.col("_p.v"))).withColumn("pb", F.col("_p.b"))
    before = F.when(F.col("d1").isNotNull(), F.struct(F.col("d1").alias("d"), F.col("pb").alias("b")))
    d = d.withColumn("_q", F.last(before, ignorenulls=True).over(past))
    d = d.withColumn("d2", F.col("d1") - F.col("_q.d")).withColumn("ppb", F.col("_q.b"))
    parts = [F.coalesce(F.col(b), F.lit(0.0)) for b in bands[:5]]
    d = d.withColumn("hard", sum(parts[1:], parts[0]))
    b0, b1 = F.col(bands[0]), F.col(bands[1])
    d = d.withColumn("hr_guarded", F.when(b0 > 0, F.coalesce(b1, F.lit(0.0)) / b0).otherwise(0.0))
    d = d.withColumn("dh", F.col("hard") - F.lag("hard").over(w)).withColumn("dhr", F.col("hr_guarded") - F.lag("hr_guarded").over(w))
    return d.drop("_p", "_q")


def _lagged(df: DataFrame, lags, keys) -> DataFrame:
    """k-th next valid sample and its bin, for every lag (NULLs are skipped)."""
    over = f"(PARTITION BY {', '.join(keys)} ORDER BY bin)"
    for k in lags:
        df = df.withColumn(f"_v{k}", F.expr(f"CASE WHEN soft IS NOT NULL THEN lead(soft, {k}) IGNORE NULLS OVER {over} END"))
        df = df.withColumn(f"_b{k}", F.expr(f"lead(CASE WHEN soft IS NOT NULL THEN bin END, {k}) IGNORE NULLS OVER {over}"))
    return df


def window_features(df: DataFrame, soft: str, bands: list[str], rows_per_day: int, lookback=3600, step=300, keys=DAY, include_last=False,
                    acf_lags=ACF_LAGS, scales=None, xrsb: str | None = None, xrsa: str | None = None, short=300, long=1800,
                    min_valid=5, arrays=()) -> DataFrame:
    """All statistical window features in one aggregation: level and shape, rates, percentiles, ACF,
    bands and ratios, hardness evolution, derivatives, multiscale and reference-flux series.

    ``arrays`` names columns to keep as ordered arrays per window for the spectral operators.
    """
    scales = scales or SCALES
    acf_lags, scale_items = list(acf_lags), list(scales.items())
    d = _lagged(prepare(df, soft, bands, keys), acf_lags, keys)
    if xrsb:
        d = d.withColumn("_xb", F.col(xrsb)).withColumn("_dxb", F.col(xrsb) - F.lag(F.col(xrsb)).over(day_window(keys)))
        d = d.withColumn("_xa", F.col(xrsa))
    rows = hop(d, rows_per_day, lookback, step, include_last)
    wkeys = [*keys, "win"]
    rows = rows.withColumn("_tail", F.max("vi").over(Window.partitionBy(*wkeys)) - F.col("vi"))
    begin, end = F.col("win") * step, F.col("win") * step + lookback
    s, h = F.col("soft"), F.col("hard")
    rise = F.when(F.col("pb") >= begin, F.col("d1"))
    curve = F.when(F.col("ppb") >= begin, F.col("d2"))
    inner = F.col("pos") > 0
    htail = (lookback - 1) - F.col("pos")
    zero = lambda e: F.coalesce(e, F.lit(0.0))

    pct = F.percentile(s, F.array(*[F.lit(p / 100) for p in (5, 25, 50, 75, 95)]))
    aggs: list[Column] = [
        F.count(s).cast("double").alias("window_len"),
        F.avg(s).alias("sxr_mean"), F.stddev_pop(s).alias("sxr_std"), F.max(s).alias("sxr_max"), F.min(s).alias("sxr_min"),
        shape(F.skewness(s)).alias("sxr_skew"), shape(F.kurtosis(s)).alias("sxr_kurtosis"), pct.alias("_pct"),
        zero(F.avg(F.when(rise > 0, rise))).alias("sxr_rise_rate"), zero(F.avg(F.when(rise < 0, rise))).alias("sxr_fall_rate"),
        F.avg(F.abs(rise)).alias("sxr_abs_slope"),
    ]
    # autocorrelation: sums of products of the raw values, centred afterwards
    for k in acf_lags:
        ok = F.col(f"_b{k}") < end
        aggs += [F.sum(F.when(ok, s * F.col(f"_v{k}"))).alias(f"_xy{k}"), F.sum(F.when(ok, s + F.col(f"_v{k}"))).alias(f"_sum{k}"),
                 F.count(F.when(ok, F.col(f"_v{k}"))).alias(f"_n{k}")]
    for i, b in enumerate(bands):
        v = F.col(b)
        some = F.count(v) >= 3
        aggs += [F.when(some, F.avg(v)).otherwise(0.0).alias(f"hxr_b{i}_mean"), F.when(some, F.stddev_pop(v)).otherwise(0.0).alias(f"hxr_b{i}_std"),
                 F.when(some, F.max(v)).otherwise(0.0).alias(f"hxr_b{i}_max")]
    pair = lambda num, den: F.when(num.isNotNull() & den.isNotNull(), num / F.greatest(den, F.lit(1e-6))).otherwise(0.0)
    b = [F.col(x) for x in bands]
    aggs += [F.avg(pair(b[1], b[0])).alias("hxr_hardness_ratio"), F.avg(h).alias("hxr_total_mean"),
             zero(F.avg(F.when(s.isNotNull(), F.when(h > 0, s / (h + 1e-6)).otherwise(0.0)))).alias("soft_hard_ratio")]
    if len(bands) >= 10:
        aggs += [F.avg(pair(b[5], b[4])).alias("cdte_thermal_ratio"), F.avg(pair(b[6], b[5])).alias("cdte_boundary_ratio")]
    hr = F.when(F.coalesce(b[1] > 0, F.lit(False)), F.when(b[0].isNotNull(), b[1] / F.greatest(b[0], F.lit(1e-6)))).otherwise(0.0)
    many = F.count(hr) > 10
    aggs += [F.when(many, F.avg(hr)).otherwise(0.0).alias("hardness_ratio_mean"), F.when(many, F.stddev_pop(hr)).otherwise(0.0).alias("hardness_ratio_std"),
             F.when(many, zero(slope(hr, "pos"))).otherwise(0.0).alias("hardness_ratio_slope")]
    dh, dhr = F.when(inner, F.col("dh")), F.when(inner, F.col("dhr"))
    aggs += [zero(F.avg(rise)).alias("dsxr_dt_mean"), zero(F.stddev_pop(rise)).alias("dsxr_dt_std"), zero(F.max(rise)).alias("dsxr_dt_max"),
             zero(F.min(rise)).alias("dsxr_dt_min"), zero(F.avg(curve)).alias("d2sxr_dt2_mean"), zero(F.stddev_pop(curve)).alias("d2sxr_dt2_std"),
             F.avg(dh).alias("dhxr_dt_mean"), F.stddev_pop(dh).alias("dhxr_dt_std"), F.max(dh).alias("dhxr_dt_max"),
             F.avg(dhr).alias("dhr_dt_mean"), F.max(dhr).alias("dhr_dt_max"),
             (zero(F.avg(rise)) / (F.avg(h) + 1e-10)).alias("dsxr_dhxr_ratio_mean")]
    for label, n in scale_items:
        late, hlate = F.when(F.col("_tail") < n, s), F.when(htail < n, h)
        for name, x in (("sxr", late), ("hxr", hlate)):
            aggs += [zero(F.avg(x)).alias(f"{name}_mean_{label}"), zero(F.stddev_pop(x)).alias(f"{name}_std_{label}"), zero(F.max(x)).alias(f"{name}_max_{label}")]
    mid = scale_items[1][1]
    aggs += [zero(slope(F.when(F.col("_tail") < mid, s), "vi")).alias("sxr_15m_slope"), zero(slope(F.when(htail < mid, h), "pos")).alias("hxr_15m_slope")]
    if xrsb:
        xb, xa = F.col("_xb"), F.col("_xa")
        last_s, last_l = F.when(htail < short, xb), F.when(htail < long, xb)
        aggs += [zero(F.max(F.when(inner, F.col("_dxb")))).alias("goes_xrsb_ddt_max"), zero(F.stddev_pop(last_s)).alias("goes_xrsb_rolling_std_300s"),
                 zero(F.stddev_pop(last_l)).alias("goes_xrsb_rolling_std_1800s"), zero(F.avg(F.when(htail < short, xa))).alias("goes_xrsa_rolling_mean_300s"),
                 zero(F.log10(F.max(xb) + 1e-10)).alias("goes_class_current"), zero(slope(xb, "pos")).alias("goes_xrsb_gradient_1h"),
                 F.count(F.when(xb > 1e-6, 1)).cast("double").alias("goes_flare_history_24h"),
                 zero(F.max_by(xb, F.when(xb.isNotNull(), F.col("pos"))) / F.max(xb)).alias("goes_xrsb_prev_peak_ratio")]
    for name in arrays:
        packed = F.sort_array(F.collect_list(F.struct(F.col("pos"), F.col(name).alias("v"))))
        aggs.append(F.filter(F.transform(packed, lambda x: x["v"]), lambda x: x.isNotNull()).alias(f"arr_{name}"))
    out = rows.groupBy(*wkeys).agg(*aggs).where(F.col("window_len") >= min_valid)

    for i, p in enumerate((5, 25, 50, 75, 95)):
        out = out.withColumn("sxr_median" if p == 50 else f"sxr_p{p}", F.col("_pct")[i])
    total = F.col("window_len") * F.col("sxr_std") * F.col("sxr_std") + 1e-10
    for k in acf_lags:
        m = F.col("sxr_mean")
        acf = (F.col(f"_xy{k}") - m * F.col(f"_sum{k}") + F.col(f"_n{k}") * m * m) / total
        out = out.withColumn(f"sxr_acf_{k}s", F.when((F.col("window_len") > 20) & (F.col(f"_n{k}") > 0), acf).otherwise(0.0))
    first, second = scale_items[0][0], scale_items[1][0]
    out = out.withColumn("sxr_range", F.col("sxr_max") - F.col("sxr_min")).withColumn("sxr_cv", F.col("sxr_std") / F.greatest("sxr_mean", F.lit(1e-6)))
    out = out.withColumn("sxr_iqr", F.col("sxr_p75") - F.col("sxr_p25"))
    for x, whole_mean in (("sxr", "sxr_mean"), ("hxr", "hxr_total_mean")):
        a, c = F.col(f"{x}_mean_{first}"), F.col(f"{x}_mean_{second}")
        out = out.withColumn(f"{x}_5m_to_60m_ratio", a / (F.col(whole_mean) + 1e-10)).withColumn(f"{x}_acceleration_trend", (a - c) / (c + 1e-10))
    temp = [c for c in out.columns if c.startswith("_")]
    return out.drop(*temp)


def canonical(df: DataFrame, keys, names=None) -> DataFrame:
    """Fixed feature schema: every name present, missing and non-finite values 0."""
    names = names or FEATURE_NAMES
    have = set(df.columns)
    return df.select(*keys, *[zero_if_missing(F.col(n).cast("double")).alias(n) if n in have else F.lit(0.0).alias(n) for n in names])


# -- day-level scalars ------------------------------------------------------------------------------------
def band_totals(df: DataFrame, totals: dict[str, str], keys=DAY, positive_only=False) -> DataFrame:
    """mean / max / std of the full band of each detector."""
    aggs = []
    for name, column in totals.items():
        v = F.when(F.col(column) > 0, F.col(column)) if positive_only else F.col(column)
        aggs += [F.avg(v).alias(f"{name}_total_mean"), F.max(v).alias(f"{name}_total_max"), F.stddev_pop(v).alias(f"{name}_total_std")]
    return df.groupBy(*keys).agg(*aggs)


def cross_ratio(lo, hi) -> Column:
    return F.avg(col(lo) / F.greatest(col(hi), F.lit(1e-6)))


def housekeeping(df: DataFrame, averages: dict[str, str], counters: dict[str, str], keys=DAY, robust=False) -> DataFrame:
    """Mean (or median) of temperatures and voltages, maximum of counters."""
    keys = list(keys)
    measures = [*[F.avg(c).alias(n) for n, c in averages.items() if not robust], *[F.max(c).alias(n) for n, c in counters.items()]]
    out = df.groupBy(*keys).agg(*measures) if measures else df.select(*keys).distinct()
    for name, c in averages.items() if robust else ():
        out = out.join(exact_quantiles(df, keys, c, [0.5]).select(*keys, F.col("quantile").alias(name)), keys, "left")
    return out.select(*keys, *averages, *counters)


def reference_flux(df: DataFrame, xrsb: str, xrsa: str, keys=DAY, first_rows: int | None = 3600) -> DataFrame:
    """Day value of the two reference bands: mean of the first rows, or the day maximum."""
    if first_rows:
        head = F.col("bin") < first_rows
        b, a = F.avg(F.when(head, F.col(xrsb))), F.avg(F.when(head, F.col(xrsa)))
    else:
        b, a = F.max(xrsb), F.max(xrsa)
    out = df.groupBy(*keys).agg(b.alias("goes_xrsb_flux"), a.alias("goes_xrsa_flux"))
    return out.withColumn("goes_xrsa_xrsb_ratio", F.when(F.col("goes_xrsb_flux") > 0, F.col("goes_xrsa_flux") / F.col("goes_xrsb_flux")).otherwise(0.0))


def background_share(value: str, keys=DAY) -> list[Column]:
    """Share of rows under 1.1 * median (two window passes over the bounded day)."""
    med = F.percentile(F.col(value), F.lit(0.5)).over(Window.partitionBy(*keys))
    return [(F.col(value) < F.greatest(med * 1.1, F.lit(0.1))).alias("below")]


def channel_bands(df: DataFrame, counts: str = "counts", bands=None, line=LINE_CHANNELS, continuum=CONTINUUM_CHANNELS) -> DataFrame:
    """Channel-range statistics of array spectra, row-local (no explode, no shuffle).

    Adds mean / std (ddof 1) / max per range, line and continuum means with their ratio, and the total.
    """
    out = df
    size = F.size(counts)

    def part(lo, hi):
        return F.slice(F.col(counts), F.lit(lo + 1), F.lit(hi - lo))

    def total(a):
        return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)

    def squares(a, centre):
        return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + (x - centre) * (x - centre))

    for name, (lo, hi) in (bands or PI_BANDS).items():
        a, n = part(lo, hi), hi - lo
        fits = size >= hi
        mean = total(a) / n
        dev = squares(a, mean)
        out = out.withColumn(f"{name}_mean", F.when(fits, mean)).withColumn(f"{name}_std", F.when(fits, F.greatest(F.sqrt(dev / (n - 1)), F.lit(1e-10))))
        out = out.withColumn(f"{name}_max", F.when(fits, F.array_max(a)))
    level = total(part(*continuum)) / (continuum[1] - continuum[0])
    flux = total(part(*line)) / (line[1] - line[0])
    fits = size >= max(continuum[1], line[1])
    out = out.withColumn("fe_xxv_line_flux", F.when(fits, flux)).withColumn("continuum_level", F.when(fits, level))
    out = out.withColumn("line_to_continuum", F.col("fe_xxv_line_flux") / F.greatest(F.col("continuum_level"), F.lit(1e-10)))
    return out.withColumn("pi_total_flux", total(F.col(counts)))


# -- sequences ---------------------------------------------------------------------------------------------
def sequences(df: DataFrame, channels: list[str], rows_per_day: int, lookback=3600, step=300, keys=DAY, soft: str | None = None) -> DataFrame:
    """One row per window with one ARRAY<FLOAT> per channel (clamped at 0), plus the first difference
    of the soft channel as the last one."""
    soft = soft or channels[0]
    w = day_window(keys)
    d = df.select(*keys, "bin", *[F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0)).alias(c) for c in channels])
    d = d.withColumn("d_soft", F.coalesce(F.col(soft) - F.lag(soft).over(w), F.lit(0.0)))
    rows = hop(d, rows_per_day, lookback, step)
    every = [*channels, "d_soft"]
    packed = F.sort_array(F.collect_list(F.struct("pos", *every)))
    out = rows.groupBy(*keys, "win").agg(packed.alias("_rows"))

    def channel(name):
        if name == "d_soft":  # no predecessor inside the window
            return F.transform("_rows", lambda x: F.when(x["pos"] == 0, 0.0).otherwise(x[name]).cast("float"))
        return F.transform("_rows", lambda x: x[name].cast("float"))

    return out.select(*keys, "win", *[channel(c).alias(c) for c in every])


def block_means(df: DataFrame, channels: list[str], rows_per_day: int, factor: int, lookback=3600, step=300, keys=DAY) -> DataFrame:
    """Windows shortened by averaging ``factor`` samples (an incomplete tail block is dropped)."""
    rows = hop(df.select(*keys, "bin", *[F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0)).alias(c) for c in channels]), rows_per_day, lookback, step)
    rows = rows.where(F.col("pos") < (lookback // factor) * factor)
    return rows.groupBy(*keys, "win", F.floor(F.col("pos") / F.lit(factor)).cast("bigint").alias("block")).agg(*[F.avg(c).alias(c) for c in channels])


def every_kth(df: DataFrame, k: int, index="bin") -> DataFrame:
    """Stride decimation before a costly operator."""
    return df.where(F.col(index) % k == 0)


def representative(df: DataFrame, keys=DAY, flag="in_event", peak="sxr_max", order="win") -> DataFrame:
    """Per day: the event window with the highest peak, else the middle window."""
    w = Window.partitionBy(*keys)
    best = F.max(F.when(F.col(flag) == 1, F.struct(F.col(peak).alias("p"), (-F.col(order)).alias("o")))).over(w)
    d = df.withColumn("_best", best)
    d = d.withColumn("_rn", F.row_number().over(w.orderBy(order))).withColumn("_n", F.count(F.lit(1)).over(w))
    pick = F.when(F.col("_best").isNotNull(), -F.col("_best.o") == F.col(order)).otherwise(F.col("_rn") == F.floor(F.col("_n") / F.lit(2)) + 1)
    return d.where(pick).drop("_best", "_rn", "_n")
