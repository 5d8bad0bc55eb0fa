"""Wavelets, periodograms, autocorrelation periods, quasi-periodic pulsations.

Fast transforms run as small NumPy kernels on one bounded array per key (a day or a window); peaks,
band sums, matching and everything else downstream is DataFrame work.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.scalars import col

# Fixed values
OMEGA0 = 6.0
ENERGY_BANDS = {"10_30s": (10, 30), "30_60s": (30, 60), "60_120s": (60, 120), "120_300s": (120, 300), "300_600s": (300, 600)}

#: Values of a trigonometric matrix that are held at a time.
PIECE = 2_000_000


def arrays_of(df: DataFrame, keys, values, order="bin") -> DataFrame:
    """One row per key with ordered arrays (missing = 0); a key is a day or a window, so the arrays
    are bounded by the cadence."""
    packed = F.sort_array(F.collect_list(F.struct(order, *[F.coalesce(F.col(v), F.lit(0.0)).cast("double").alias(v) for v in values])))
    rows = df.groupBy(*keys).agg(packed.alias("_rows"))

    def one(v):
        return F.transform("_rows", lambda x: x[v]).alias(v)

    return rows.select(*keys, *[one(v) for v in values])


# -- continuous wavelet transform -----------------------------------------------------------------------------
def scale_grid(s_min: float, s_max: float, dj: float = 0.125) -> list[float]:
    count = int(math.log2(s_max / s_min) / dj)
    return [s_min * 2.0 ** (j * dj) for j in range(count + 1)]


def geometric_periods(lo=10.0, hi=500.0, count=40) -> list[float]:
    return [lo * (hi / lo) ** (i / (count - 1)) for i in range(count)]


def _power(x: np.ndarray, dt: float, scales, kind: str) -> np.ndarray:
    """Power of one signal on all scales, coefficients centred on their sample."""
    n = len(x)
    if kind == "real":
        x = x - x.mean()
        sd = x.std()
        if sd < 1e-10:
            return np.zeros((len(scales), n))
        x = x / sd
    size = 1 << int(np.ceil(np.log2(2 * n)))
    tau = (np.arange(n) - n // 2) * dt
    spectrum = np.fft.fft(x, size)
    out = np.empty((len(scales), n))
    for i, s in enumerate(scales):
        if kind == "real":
            kernel = np.pi ** -0.25 / np.sqrt(s) * np.cos(OMEGA0 * tau / s) * np.exp(-0.5 * (tau / s) ** 2)
        else:
            u = tau / s
            kernel = np.exp(-u * u / 1.5) / np.sqrt(np.pi * 1.5) * np.exp(2j * np.pi * u) * (dt / np.sqrt(s * dt))
        full = np.fft.ifft(spectrum * np.conj(np.fft.fft(kernel, size)))
        centred = np.concatenate([full[size - n // 2:], full[: n - n // 2]])
        out[i] = np.real(centred) ** 2 if kind == "real" else np.abs(centred) ** 2
    return out


def wavelet_power(arrays: DataFrame, keys, signals, dt: float, scales, kind="real", least=16) -> DataFrame:
    """(keys, scale_no, scale, period, p_<signal> ARRAY, med_<signal>) - one row per key and scale.

    ``kind='real'`` is the standardised Morlet power of the real part, period 4*pi*s/6;
    ``kind='complex'`` is the modulus squared, with scales given as periods.
    """
    scales = [float(s) for s in scales]
    fields = [arrays.schema[k] for k in keys]
    fields += [T.StructField("scale_no", T.LongType()), T.StructField("scale", T.DoubleType()), T.StructField("period", T.DoubleType())]
    for s in signals:
        fields += [T.StructField(f"p_{s}", T.ArrayType(T.DoubleType())), T.StructField(f"med_{s}", T.DoubleType())]
    keys, signals = list(keys), list(signals)

    def transform(batches):
        for pdf in batches:
            for rec in pdf.to_dict("records"):
                x = [np.asarray(rec[s], dtype=float) for s in signals]
                if len(x[0]) < least:
                    continue
                powers = [_power(v, dt, scales, kind) for v in x]
                frame = {k: [rec[k]] * len(scales) for k in keys}
                frame["scale_no"] = range(len(scales))
                frame["scale"] = scales
                frame["period"] = [4 * math.pi * s / OMEGA0 if kind == "real" else s for s in scales]
                for s, p in zip(signals, powers):
                    frame[f"p_{s}"] = list(p)
                    frame[f"med_{s}"] = float(np.median(p))
                yield pd.DataFrame(frame)

    return arrays.select(*keys, *signals).mapInPandas(transform, T.StructType(fields))


def _total(array):
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def band_features(power: DataFrame, keys, soft: str, hard: str | None = None, bands=None, cross=(30, 120)) -> DataFrame:
    """Energy per period band, global-spectrum peak, peak over median, entropy, and cross power.

    Array reductions happen per scale row; only a handful of numbers per scale is shuffled.
    """
    bands = bands or ENERGY_BANDS
    p = F.col(f"p_{soft}")
    rows = power.withColumn("_e", _total(p)).withColumn("_g", F.col("_e") / F.size(p)).withColumn("_m", F.array_max(p))
    if hard:
        rows = rows.withColumn("_h", _total(F.col(f"p_{hard}"))).withColumn("_c", _total(F.zip_with(p, F.col(f"p_{hard}"), lambda a, b: a * b)))
    per, g = F.col("period"), F.col("_g")
    aggs = [F.coalesce(F.sum(F.when(per.between(lo, hi), F.col("_e"))), F.lit(0.0)).alias(f"wavelet_energy_{n}") for n, (lo, hi) in bands.items()]
    aggs += [F.max(F.struct(g.alias("g"), (-F.col("scale_no")).alias("n"), per.alias("p"))).alias("_top"),
             (F.max("_m") / (F.first(f"med_{soft}") + 1e-10)).alias("wavelet_peak_significance"),
             F.sum("_g").alias("_s"), F.sum(F.when(g > 0, g * F.ln(g))).alias("_gl")]
    if hard:
        inside = per.between(*cross)
        aggs += [F.coalesce(F.sum(F.when(inside, F.col("_h"))), F.lit(0.0)).alias("wavelet_hxr_energy_30_120s"),
                 F.coalesce(F.sum(F.when(inside, F.col("_c"))), F.lit(0.0)).alias("wavelet_cross_power_sxr_hxr")]
    out = rows.groupBy(*keys).agg(*aggs)
    out = out.withColumn("wavelet_peak_period", F.when(F.col("_top.g") > 0, F.col("_top.p")).otherwise(0.0))
    out = out.withColumn("wavelet_spectral_entropy", F.when(F.col("_s") > 0, F.ln("_s") - F.col("_gl") / F.col("_s")).otherwise(0.0))
    return out.drop("_top", "_s", "_gl")


def window_band_features(arrays: DataFrame, keys, soft: str, hard: str | None, dt: float, scales, bands=None, cross=(30, 120), least=16) -> DataFrame:
    """``band_features`` straight from the arrays of each key: the transform is reduced where it is made, one row per key."""
    bands, keys, grid = bands or ENERGY_BANDS, list(keys), np.asarray(scales, dtype=float)
    periods = 4 * math.pi * grid / OMEGA0
    within = {n: (periods >= lo) & (periods <= hi) for n, (lo, hi) in bands.items()}
    crossed = (periods >= cross[0]) & (periods <= cross[1])
    names = [f"wavelet_energy_{n}" for n in bands] + ["wavelet_peak_significance", "wavelet_peak_period", "wavelet_spectral_entropy"] + (["wavelet_hxr_energy_30_120s", "wavelet_cross_power_sxr_hxr"] if hard else [])
    schema = T.StructType([*[arrays.schema[k] for k in keys], *[T.StructField(n, T.DoubleType()) for n in names]])

    def reduce(batches):
        for pdf in batches:
            out = []
            for rec in pdf.to_dict("records"):
                if len(rec[soft]) < least:
                    continue
                p = _power(np.asarray(rec[soft], dtype=float), dt, grid, "real")
                g = p.mean(1)
                total, some = g.sum(), g[g > 0]
                row = [p[m].sum() for m in within.values()]
                row += [p.max() / (np.median(p) + 1e-10), periods[g.argmax()] if g.max() > 0 else 0.0, np.log(total) - (some * np.log(some)).sum() / total if total > 0 else 0.0]
                if hard:
                    h = _power(np.asarray(rec[hard], dtype=float), dt, grid, "real")
                    row += [h[crossed].sum(), (p[crossed] * h[crossed]).sum()]
                out.append([*(rec[k] for k in keys), *map(float, row)])
            yield pd.DataFrame(out, columns=schema.names)

    return arrays.select(*keys, soft, *([hard] if hard else [])).mapInPandas(reduce, schema)


SAMPLE = ["band_power", "ridge_period", "peak_power", "lim_max", "lim_mean", "mean_power"]
SAMPLE_BOTH = ["cross_power", "coherence", "cross_lim_max"]


def per_sample(arrays: DataFrame, keys, soft: str, hard: str | None, dt: float, scales, band=(30, 300), least=16) -> DataFrame:
    """Wavelet features of every sample: band mean, ridge, local intermittency, mean power; cross power and coherence.

    The reduction over scales happens where the transform is made: one row per sample leaves the task, never one per
    scale and sample.  ``arrays`` has one row per key (``arrays_of``); keys of fewer than ``least`` samples have no rows.
    """
    keys, grid = list(keys), np.asarray(scales, dtype=float)
    periods = 4 * math.pi * grid / OMEGA0
    inside = (periods >= band[0]) & (periods <= band[1])
    names = SAMPLE + (SAMPLE_BOTH if hard else [])
    schema = T.StructType([*[arrays.schema[k] for k in keys], T.StructField("bin", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names]])
    floor = 1e-30

    def reduce(batches):
        for pdf in batches:
            for rec in pdf.to_dict("records"):
                if len(rec[soft]) < least:
                    continue
                p = _power(np.asarray(rec[soft], dtype=float), dt, grid, "real")
                lim = p / (p.mean(1, keepdims=True) + floor)
                out = {k: rec[k] for k in keys} | {"bin": np.arange(p.shape[1]), "band_power": p[inside].mean(0) if inside.any() else np.nan, "ridge_period": periods[p.argmax(0)]}
                out |= {"peak_power": p.max(0), "lim_max": lim.max(0), "lim_mean": lim.mean(0), "mean_power": p.mean(0)}
                if hard:
                    h = _power(np.asarray(rec[hard], dtype=float), dt, grid, "real")
                    common = np.sqrt(p * h)
                    out |= {"cross_power": common.mean(0), "coherence": np.minimum(lim, h / (h.mean(1, keepdims=True) + floor)).mean(0),
                            "cross_lim_max": (common / (common.mean(1, keepdims=True) + floor)).max(0)}
                yield pd.DataFrame(out)[schema.names]

    rows = arrays.select(*keys, soft, *([hard] if hard else [])).mapInPandas(reduce, schema)
    return rows.withColumn("lim_flag", (F.col("lim_max") > 3).cast("bigint"))


def scalegram(power: DataFrame, keys, soft: str, band=(30, 300)) -> DataFrame:
    """Slope of log10 total power against log10 period inside the band, and the strongest period."""
    rows = power.withColumn("_e", _total(F.col(f"p_{soft}")))
    inside = F.col("period").between(*band)
    y = F.when(inside, F.log10(F.greatest("_e", F.lit(1e-30))))
    x = F.when(inside, F.log10("period"))
    top = F.max(F.struct(F.col("_e").alias("v"), (-F.col("scale_no")).alias("n"), F.col("period").alias("p")))
    out = rows.groupBy(*keys).agg(F.when(F.count(y) > 3, F.regr_slope(y, x)).alias("beta"), top.alias("_top"))
    return out.select(*keys, "beta", F.col("_top.p").alias("t_min"))


def ridge_chirp(samples: DataFrame, keys, ridge="ridge_period") -> DataFrame:
    """Gradient of ln(ridge period)."""
    from .rolling import gradient

    d = samples.withColumn("_l", F.ln(F.greatest(F.coalesce(F.col(ridge), F.lit(100.0)), F.lit(10.0))))
    return d.withColumn("chirp_rate", gradient("_l", tuple(keys))).drop("_l")


def phase_power(samples: DataFrame, flares: DataFrame, keys, pre: int, onset: int, t="t", least=10) -> DataFrame:
    """Mean band power before, at the onset of and after the peak of each flare."""
    j = samples.join(flares, list(keys))
    x = F.col(t)
    s, p, e = F.col("start_t"), F.col("peak_t"), F.col("end_t")
    j = j.where((x >= s - pre) & (x < F.greatest(e, s + onset)))
    part = lambda cond: F.when(F.count(F.when(cond, 1)) >= least, F.avg(F.when(cond, F.col("band_power"))))
    return j.groupBy(*keys, "start_t", "peak_t", "end_t").agg(
        part((x >= s - pre) & (x < s)).alias("power_pre"), part((x >= s) & (x < s + onset)).alias("power_onset"),
        part((x >= p) & (x < e)).alias("power_decay"))


def red_noise(df: DataFrame, keys, value: str) -> DataFrame:
    """Lag-1 autocorrelation per key, clipped to [0, 0.99]."""
    w = Window.partitionBy(*keys).orderBy("bin")
    d = df.where(F.col(value).isNotNull())
    d = d.withColumn("_c", F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))
    d = d.withColumn("_l", F.lag("_c").over(w))
    r = F.sum(F.col("_c") * F.col("_l")) / F.sum(F.col("_c") * F.col("_c"))
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_c") * F.col("_l")).alias("_x"), F.sum(F.col("_c") * F.col("_c")).alias("_y")).select(
        *keys, "n", F.when(F.col("_y") > 0, F.least(F.greatest(F.col("_x") / F.col("_y"), F.lit(0.0)), F.lit(0.99))).alias("r1"))


def red_noise_power(r1, freq, dt: float = 1.0):
    return 1.0 / (1 + F.col(r1) * F.col(r1) - 2 * F.col(r1) * F.cos(2 * math.pi * freq * dt))


def red_noise_level(r1, periods, dt: float = 1.0) -> Column:
    """Power of an AR(1) process at every period, as an array."""
    return F.transform(F.array(*[F.lit(float(p)) for p in periods]), lambda p: 1.0 / (1 + col(r1) * col(r1) - 2 * col(r1) * F.cos(2 * math.pi * dt / p)))


def scale_significance(power: DataFrame, noise: DataFrame, keys, soft: str, dt: float = 1.0, limit=3.0) -> DataFrame:
    """Mean power of every scale over the red noise of the key's lag-1 autocorrelation at that period, flagged over ``limit``."""
    p = F.col(f"p_{soft}")
    mean = power.select(*keys, "scale_no", "period", (_total(p) / F.size(p)).alias("_g"))
    level = red_noise_power("r1", 1.0 / F.col("period"), dt)
    out = mean.join(noise.select(*keys, "r1"), list(keys)).withColumn("significance", F.col("_g") / (level + 1e-30))
    return out.select(*keys, "scale_no", "period", "r1", "significance", (F.col("significance") > limit).cast("bigint").alias("significant"))


def sample_significance(samples: DataFrame, noise: DataFrame, keys, periods, dt: float = 1.0, limit=3.0) -> DataFrame:
    """``qpp_sig_score``: mean power of a sample over all scales against the mean red noise; ``qpp_significant`` over ``limit``."""
    level = _total(red_noise_level("r1", periods, dt)) / len(periods)
    out = samples.join(noise.select(*keys, "r1"), list(keys), "left").withColumn("qpp_sig_score", F.col("mean_power") / (level + 1e-30))
    return out.withColumn("qpp_significant", F.coalesce(F.col("qpp_sig_score") > limit, F.lit(False)).cast("bigint"))


def oscillation_cycles(samples: DataFrame, flares: DataFrame, keys, t="t", band=(30, 300), least=30, most=20, local=3, width=3600) -> DataFrame:
    """Cycles per flare: half the times that the ridge enters or leaves ``band`` (at most ``most``), 0 for flares of fewer than
    ``least`` samples; ``is_localized`` under ``local`` cycles."""
    from .intervals import range_join

    names = [c for c in flares.columns if c not in keys]
    rows = range_join(samples.select(*keys, t, F.col("ridge_period").between(*band).alias("_in")), flares, t, "start_t", "end_t", width, on=tuple(keys))
    turn = F.lag("_in").over(Window.partitionBy(*keys, *names).orderBy(t))  # a flare lies inside a day
    rows = rows.withColumn("_turn", F.coalesce(turn != F.col("_in"), F.lit(False)).cast("long"))
    seen = rows.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("samples"), F.least(F.floor(F.sum("_turn") / 2), F.lit(most)).alias("_c"))
    out = flares.join(seen, [*keys, *names], "left").withColumn("samples", F.coalesce("samples", F.lit(0).cast("long")))
    out = out.withColumn("cycles", F.when(F.col("samples") >= least, F.col("_c")).otherwise(0).cast("long")).drop("_c")
    return out.withColumn("is_localized", (F.col("cycles") < local).cast("long"))


# -- periodograms -------------------------------------------------------------------------------------------------
def frequency_grid(lo: float, hi: float, count: int) -> list[float]:
    return [lo + (hi - lo) * i / (count - 1) for i in range(count)]


def lomb_scargle(df: DataFrame, keys, value: str, t: str, freqs) -> DataFrame:
    """Normalised Lomb-Scargle power on a frequency grid: (keys, f_no, freq, power).

    A key is a day, a window or a flare, whose rows the cadence bounds, so it is one Arrow group: its five trigonometric
    sums are matrix products over pieces of the grid, and one row per (key, frequency) leaves the task.
    """
    keys, grid = list(keys), np.asarray(freqs, dtype=float)
    d = df.where(F.col(value).isNotNull()).select(*keys, F.col(t).cast("double").alias("_t"), F.col(value).cast("double").alias("_v"))
    schema = T.StructType([*[d.schema[k] for k in keys], T.StructField("f_no", T.LongType()), T.StructField("freq", T.DoubleType()), T.StructField("power", T.DoubleType())])

    def periodogram(table: pa.Table) -> pa.Table:
        time, y = table.column("_t").to_numpy(), table.column("_v").to_numpy()
        order = np.lexsort((y, time))
        time, y = time[order], y[order] - y.mean()
        yy, power, step = float(y @ y), np.zeros(len(grid)), max(1, PIECE // max(1, len(time)))
        for at in range(0, len(grid) if yy > 1e-12 else 0, step):
            arg = 2 * np.pi * grid[at : at + step, None] * time
            c, s = np.cos(arg), np.sin(arg)
            cc, ss, cs = (c * c).sum(1), (s * s).sum(1), (c * s).sum(1)
            phase = 0.5 * np.arctan2(2 * cs, cc - ss)
            a, b, yc, ys = np.cos(phase), np.sin(phase), c @ y, s @ y
            for num, den in ((a * yc + b * ys, a * a * cc + 2 * a * b * cs + b * b * ss), (a * ys - b * yc, a * a * ss - 2 * a * b * cs + b * b * cc)):
                power[at : at + step] += np.where(den > 1e-12, num * num / np.where(den > 1e-12, den, 1.0), 0.0) / yy
        own = [table.column(k).take(np.zeros(len(grid), np.int64)) for k in keys]
        return pa.Table.from_arrays([*own, pa.array(np.arange(len(grid))), pa.array(grid), pa.array(power)], names=schema.names)

    return d.groupBy(*keys).applyInArrow(periodogram, schema)


def top_periods(spectrum: DataFrame, keys, k: int = 3) -> DataFrame:
    """The k strongest periods per key."""
    w = Window.partitionBy(*keys).orderBy(F.col("power").desc(), F.col("f_no"))
    return spectrum.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*keys, "rank", (1.0 / F.col("freq")).alias("period"), "power")


def local_peaks(df: DataFrame, keys, order: str, value: str, floor) -> DataFrame:
    """Rows higher than both neighbours and at least ``floor``."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("_u", F.lag(value).over(w)).withColumn("_d", F.lead(value).over(w))
    return d.where((F.col(value) > F.col("_u")) & (F.col(value) > F.col("_d")) & (F.col(value) >= floor)).drop("_u", "_d")


def detect_pulsations(df: DataFrame, keys, value: str, dt: float, min_period=10.0, max_period=600.0, significance=0.95, least=50, phase_bins=20,
                      n_freqs=500, order="pos") -> DataFrame:
    """Quasi-periodic pulsations per key (day, window or flare): detrend, Lomb-Scargle peaks, wavelet
    confirmation within 20 %, duplicates within 10 % dropped, phase-folded amplitude.

    ``order`` is the 0-based sample number within the key.  Keys of fewer than ``least`` samples stay: nothing detected, zeros.
    """
    keys = list(keys)
    whole = Window.partitionBy(*keys)
    d = df.select(*keys, F.col(order).cast("bigint").alias("bin"), F.coalesce(F.col(value), F.lit(0.0)).alias("v"))
    d = d.withColumn("_n", F.count(F.lit(1)).over(whole))
    short = d.where(F.col("_n") < least).select(*keys).distinct()
    d = d.where(F.col("_n") >= least)
    width = max(2, int(3 * max_period / dt))
    frame = whole.orderBy("bin").rowsBetween(-(width // 2), width - width // 2 - 1)
    d = d.withColumn("x", F.col("v") - F.avg("v").over(frame)).withColumn("time", F.col("bin") * F.lit(float(dt)))

    floor = significance * 0.3
    spec = lomb_scargle(d, keys, "x", "time", frequency_grid(1 / max_period, 1 / min_period, n_freqs))
    w = Window.partitionBy(*keys).orderBy("f_no")
    p = F.col("power")
    spec = spec.withColumn("_pk", (p > F.lag("power").over(w)) & (p > F.lead("power").over(w)) & (p >= floor))
    spec = spec.withColumn("_any", F.max(F.coalesce(F.col("_pk"), F.lit(False)).cast("int")).over(whole))
    spec = spec.withColumn("_top", F.max(F.struct(p.alias("v"), (-F.col("f_no")).alias("n"))).over(whole))
    single = (F.col("_any") == 0) & (-F.col("_top.n") == F.col("f_no")) & (p > floor)
    ls = spec.groupBy(*keys).agg(
        F.max("power").alias("ls_max"),
        F.sort_array(F.collect_list(F.when(F.coalesce(F.col("_pk"), F.lit(False)) | single, 1.0 / F.col("freq")))).alias("ls_periods"))

    cwt = wavelet_power(arrays_of(d, keys, ["x"]), keys, ["x"], dt, scale_grid(min_period / 4, max_period))
    gws = cwt.select(*keys, "scale_no", "period", (_total(F.col("p_x")) / F.size("p_x")).alias("g"))
    gw = Window.partitionBy(*keys).orderBy("scale_no")
    gws = gws.withColumn("_u", F.lag("g").over(gw)).withColumn("_d", F.lead("g").over(gw)).withColumn("_mx", F.max("g").over(whole))
    is_peak = (F.col("g") > F.col("_u")) & (F.col("g") > F.col("_d")) & (F.col("g") >= 0.3 * F.col("_mx"))
    in_range = F.col("period").between(min_period, max_period)
    best = F.max(F.when(in_range, F.struct(F.col("g").alias("g"), (-F.col("scale_no")).alias("n"), F.col("period").alias("p"))))
    wv = gws.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(is_peak, F.col("period")))).alias("wv_periods"), best.alias("_best"))

    both = ls.join(wv, keys, "left")
    near = lambda l, q: F.abs(l - q) / F.greatest(l, q) < 0.2
    confirm = lambda l: F.coalesce((l + F.try_element_at(F.filter("wv_periods", lambda q: near(l, q)), F.lit(1))) / 2, l)
    both = both.withColumn("_all", F.sort_array(F.transform("ls_periods", confirm)))
    empty = F.array().cast("array<double>")
    fresh = lambda acc, q: (F.size(acc) == 0) | (F.abs(q - F.try_element_at(acc, F.lit(-1))) / q > 0.1)
    unique = F.aggregate("_all", empty, lambda acc, q: F.when(fresh(acc, q), F.concat(acc, F.array(q))).otherwise(acc))
    both = both.withColumn("periods", F.filter(unique, lambda q: q <= 0.9 * max_period))
    both = both.withColumn("detected", (F.size("periods") > 0).cast("bigint"))
    both = both.withColumn("period", F.coalesce(F.try_element_at("periods", F.lit(1)), F.col("_best.p"), F.lit(0.0)))

    # phase folding at the chosen period; a missing phase bin counts as 0
    folded = d.join(both.select(*keys, "period"), keys).where(F.col("period") > 0)
    phase = F.pmod(F.col("time"), F.col("period")) / F.col("period")
    folded = folded.groupBy(*keys, F.pmod(F.floor(phase * phase_bins), F.lit(phase_bins)).cast("bigint").alias("_ph")).agg(F.avg("x").alias("f"), F.sum("v").alias("_sv"), F.count(F.lit(1)).alias("_c"))
    lo = F.when(F.count(F.lit(1)) < phase_bins, F.least(F.min("f"), F.lit(0.0))).otherwise(F.min("f"))
    hi = F.when(F.count(F.lit(1)) < phase_bins, F.greatest(F.max("f"), F.lit(0.0))).otherwise(F.max("f"))
    amp = folded.groupBy(*keys).agg(((hi - lo) / F.greatest(F.sum("_sv") / F.sum("_c"), F.lit(1e-10))).alias("amplitude"))
    out = both.join(amp, keys, "left")
    out = out.select(*keys, "detected", "period", F.greatest(F.coalesce("amplitude", F.lit(0.0)), F.lit(0.0)).alias("amplitude"),
                     F.col("ls_max").alias("significance"), F.size("periods").cast("bigint").alias("n_periods"))
    none, zero = F.lit(0).cast("bigint"), F.lit(0.0)
    return out.unionByName(short.select(*keys, none.alias("detected"), zero.alias("period"), zero.alias("amplitude"), zero.alias("significance"), none.alias("n_periods")))


def best_per_group(df: DataFrame, keys) -> DataFrame:
    """The most significant pulsation among the flares of a day."""
    names = [c for c in df.columns if c not in keys]
    top = F.max_by(F.struct(*names), F.struct("detected", "significance"))
    return df.groupBy(*keys).agg(top.alias("_b")).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in names])


def with_fallback(best: DataFrame, whole: DataFrame, keys) -> DataFrame:
    """The best flare pulsation of every key; where no flare shows one, the search over the whole series if it is more significant.

    ``whole`` has one row per key; ``from_series`` marks what it decided."""
    names = [c for c in whole.columns if c not in keys]
    both = whole.select(*keys, F.struct(*names).alias("_w")).join(best.select(*keys, F.struct(*names).alias("_b")), list(keys), "left")
    found = F.coalesce(F.col("_b.detected") == 1, F.lit(False))
    series = ~found & (F.coalesce(F.col("_w.significance"), F.lit(0.0)) > F.coalesce(F.col("_b.significance"), F.lit(-1.0)))
    pick = F.when(series, F.col("_w")).otherwise(F.coalesce("_b", "_w"))
    return both.select(*keys, pick.alias("_p"), series.cast("bigint").alias("from_series")).select(*keys, "_p.*", "from_series")


# -- power spectral density and autocorrelation -------------------------------------------------------------------
@F.pandas_udf(T.StructType([T.StructField("entropy", T.DoubleType()), T.StructField("peak_freq", T.DoubleType())]))
def welch_shape(arr: pd.Series, cap: pd.Series) -> pd.DataFrame:
    """Entropy of the normalised Welch spectrum and relative position of its maximum (0, 0 if short)."""
    out = []
    for x, limit in zip(arr, cap):
        n = len(x)
        m = min(int(limit), n // 2)
        if m < 4:
            out.append((0.0, 0.0))
            continue
        x = np.asarray(x, dtype=float)
        seg = np.lib.stride_tricks.sliding_window_view(x, m)[:: m - m // 2]
        taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(m) / m)
        psd = (np.abs(np.fft.rfft((seg - seg.mean(axis=1, keepdims=True)) * taper, axis=1)) ** 2).mean(axis=0) / (taper**2).sum()
        psd[1 : (m + 1) // 2] *= 2
        share = psd / (psd.sum() + 1e-10)
        out.append((float(-(share * np.log(share + 1e-30)).sum()), float(psd.argmax() / (len(psd) + 1e-10))))
    return pd.DataFrame(out, columns=["entropy", "peak_freq"])


@F.pandas_udf(T.LongType())
def _acf_lag(arr: pd.Series, height: pd.Series, fallback: pd.Series) -> pd.Series:
    """First local minimum of the autocorrelation up to ``height`` in the first half of the lags, else its first zero crossing."""
    def one(x, height, fallback):
        x = np.asarray(x, dtype=float)
        x, n = x - x.mean(), len(x)
        a = np.fft.irfft(np.abs(np.fft.rfft(x, 2 * n)) ** 2, 2 * n)[:n]  # twice the length: no lag wraps around
        a = a / a[0] if x.any() else np.zeros(n)
        k = np.arange(1, n // 2 - 1)
        minimum = k[(a[k] < a[k - 1]) & (a[k] < a[k + 1]) & (a[k] <= height)]
        cross = 1 + np.flatnonzero(a[1:] * a[:-1] <= 0)
        return int(minimum[0] if len(minimum) else cross[0] if len(cross) else fallback)

    return pd.Series([one(x, h, f) for x, h, f in zip(arr, height, fallback)])


def acf_period(df: DataFrame, keys, value: str, order="bin", least=50, height=0.5, floor=5, fallback=100) -> DataFrame:
    """Dominant period per flare: first local minimum of the autocorrelation (deeper than -height is
    not required: any minimum below ``height``), else the first zero crossing.  One FFT a key."""
    rows = arrays_of(df.where(F.col(value).isNotNull()), keys, [value], order).where(F.size(value) >= least)
    pick = _acf_lag(value, F.lit(float(height)), F.lit(int(fallback)))
    return rows.select(*keys, F.greatest(pick, F.lit(floor)).cast("bigint").alias("period"))
