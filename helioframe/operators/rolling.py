"""Moving-window operators over fixed-cadence series.

All windows are partitioned by a (channel, day) key whose size is bounded by the cadence, and all of
them share one hash partitioning, so chains of these operators run in the same stage.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.scalars import col
from ..functions.stats import corr
from ..sources.lightcurve import KEYS, day_window

MAD_TO_SIGMA = 1.4826


def centred(size: int, keys=KEYS):
    """Frame of ``size`` rows around the current one; even sizes lean one row back."""
    return day_window(keys).rowsBetween(-(size // 2), size - size // 2 - 1)


def trailing(size: int, keys=KEYS):
    return day_window(keys).rowsBetween(-(size - 1), 0)


def whole(keys=KEYS):
    return Window.partitionBy(*keys)


def up_to(keys=KEYS):
    return day_window(keys).rowsBetween(Window.unboundedPreceding, 0)


def after(keys=KEYS):
    return day_window(keys).rowsBetween(0, Window.unboundedFollowing)


# -- backgrounds ---------------------------------------------------------------------------------
def rolling_quantile(df: DataFrame, value: str, q: float, size: int, out: str, keys=KEYS, min_count: int = 1) -> DataFrame:
    """Interpolated quantile of the non-missing values in a centred frame (truncated at day edges).

    A quantile has no sliding update in SQL frames, so every (channel, day), which the cadence bounds, is one Arrow group.
    """
    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, T.DoubleType())])

    def per_day(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin", kind="stable")
        return pdf.assign(**{out: _sliding_quantile(pdf[value].astype("float64"), q, size, min_count)})

    return df.groupBy(*keys).applyInPandas(per_day, schema)


def _sliding_quantile(values: pd.Series, q: float, size: int, min_count: int = 1) -> np.ndarray:
    """A trailing window over the series extended by the rows ahead is the centred frame."""
    ahead = size - size // 2 - 1
    padded = pd.concat([values, pd.Series([float("nan")] * ahead)], ignore_index=True)
    moved = padded.rolling(size, min_periods=min_count).quantile(q, interpolation="linear").shift(-ahead)
    return moved.iloc[: len(values)].to_numpy()


def median_residual(df: DataFrame, value="v", size=600, keys=KEYS) -> DataFrame:
    """Rolling-median background ``bg`` and the residual above it."""
    out = rolling_quantile(df, value, 0.5, size, "bg", keys)
    return out.withColumn("residual", F.col(value) - F.col("bg"))


def mad_sigma(df: DataFrame, value: str, out: str, keys=KEYS) -> DataFrame:
    """Robust day scatter 1.4826 * median(|x - median(x)|)."""
    day = whole(keys)
    centre = df.withColumn("_med", F.percentile(col(value), F.lit(0.5)).over(day))
    mad = F.percentile(F.abs(F.col(value) - F.col("_med")), F.lit(0.5)).over(day)
    return centre.withColumn(out, mad * MAD_TO_SIGMA).drop("_med")


def iterative_background(df: DataFrame, value="v", size=600, passes=3, q=0.1, kappa=3.0, keys=KEYS) -> DataFrame:
    """Low-quantile background ``bg``, re-estimated with outliers above kappa * MAD masked out, and the ``residual`` above it.

    All passes of a day run in one group.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("bg", T.DoubleType()), T.StructField("residual", T.DoubleType())])

    def per_day(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin", kind="stable")
        values = pdf[value].astype("float64").reset_index(drop=True)
        used = values
        for _ in range(passes):
            bg = _sliding_quantile(used, q, size)
            residual = values - bg
            sigma = MAD_TO_SIGMA * (residual - residual.median()).abs().median()
            used = values.where(residual < kappa * sigma)
        return pdf.assign(bg=bg, residual=residual.to_numpy())

    return df.groupBy(*keys).applyInPandas(per_day, schema)


def multiscale_background(df: DataFrame, value="v", good="good", long_size=3600, short_size=600, keys=KEYS) -> DataFrame:
    """Slow median plus fast low quantile of its residual, from GOOD rows only; other rows take the
    nearest good estimate.  ``sigma`` is the scatter of the quiet rows of the day."""
    df = df.withColumn("_g", F.when(F.col(good), F.col(value)))
    df = rolling_quantile(df, "_g", 0.5, long_size, "_slow", keys, min_count=5)
    df = df.withColumn("_r", F.col("_g") - F.col("_slow"))
    df = rolling_quantile(df, "_r", 0.1, short_size, "_fast", keys, min_count=5)
    df = df.withColumn("_raw", F.when(F.col("_g").isNotNull(), F.col("_slow") + F.col("_fast")))
    df = nearest_fill(df, "_raw", "bg", keys)
    quiet = F.when(F.col("_g") - F.col("bg") <= F.percentile(F.col("_g") - F.col("bg"), F.lit(0.5)).over(whole(keys)), F.col("_g") - F.col("bg"))
    df = df.withColumn("_quiet", quiet)
    df = df.withColumn("sigma", F.stddev_pop("_quiet").over(whole(keys)))
    return df.drop("_g", "_slow", "_r", "_fast", "_raw", "_quiet")


# -- gap filling and derivatives --------------------------------------------------------------------
def forward_fill(df: DataFrame, value="v", out="filled", keys=KEYS) -> DataFrame:
    """Last observation carried forward; a leading gap takes the day median; an empty day 0."""
    median = F.percentile(F.col(value), F.lit(0.5)).over(whole(keys))
    return df.withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(up_to(keys)), median, F.lit(0.0)))


def median_fill(df: DataFrame, value="v", out="filled", keys=KEYS) -> DataFrame:
    return df.withColumn(out, F.coalesce(F.col(value), F.percentile(F.col(value), F.lit(0.5)).over(whole(keys))))


def neighbours(df: DataFrame, value: str, keys=KEYS, x="bin") -> DataFrame:
    """Nearest non-missing sample on both sides (the row itself when present)."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(x).alias("x"), F.col(value).alias("y")))
    return df.withColumn("_prev", F.last(known, ignorenulls=True).over(up_to(keys))).withColumn(
        "_next", F.first(known, ignorenulls=True).over(after(keys))
    )


def linear_fill(df: DataFrame, value="v", out="filled", keys=KEYS, outside=None, x="bin") -> DataFrame:
    """Linear interpolation over gaps; ``outside`` the covered range (NULL or 0)."""
    df = neighbours(df, value, keys, x)
    a, b = F.col("_prev"), F.col("_next")
    blend = a["y"] + (b["y"] - a["y"]) * (F.col(x) - a["x"]) / (b["x"] - a["x"])
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(a.isNotNull() & b.isNotNull(), blend)
    return df.withColumn(out, filled.otherwise(F.lit(outside).cast("double"))).drop("_prev", "_next")


def nearest_fill(df: DataFrame, value: str, out: str, keys=KEYS, x="bin") -> DataFrame:
    """Nearest non-missing value; a tie takes the earlier one."""
    df = neighbours(df, value, keys, x)
    a, b = F.col("_prev"), F.col("_next")
    pick = F.when(b.isNull() | ((a.isNotNull()) & (F.col(x) - a["x"] <= b["x"] - F.col(x))), a["y"]).otherwise(b["y"])
    return df.withColumn(out, pick).drop("_prev", "_next")


def gradient(value, keys=KEYS) -> Column:
    """Central difference; one-sided at the ends of the day."""
    w = day_window(keys)
    v = col(value)
    ahead, behind = F.lead(v).over(w), F.lag(v).over(w)
    first, last = F.lag(F.col("bin")).over(w).isNull(), F.lead(F.col("bin")).over(w).isNull()
    return F.when(first, ahead - v).when(last, v - behind).otherwise((ahead - behind) / 2)


def step(value, keys=KEYS) -> Column:
    """First difference to the previous row."""
    return col(value) - F.lag(col(value)).over(day_window(keys))


# -- moving statistics -------------------------------------------------------------------------------
def full_frame(expr: Column, size: int, frame) -> Column:
    return F.when(F.count(F.lit(1)).over(frame) == size, expr)


def trailing_mean(value, size, keys=KEYS) -> Column:
    f = trailing(size, keys)
    return full_frame(F.avg(col(value)).over(f), size, f)


def trailing_std(value, size, keys=KEYS) -> Column:
    f = trailing(size, keys)
    return full_frame(F.stddev_pop(col(value)).over(f), size, f)


def padded_mean(value, size, keys=KEYS) -> Column:
    """Centred mean with zeros for missing and out-of-day rows; NULL if >99 % of the frame is missing."""
    f = centred(size, keys)
    seen = F.count(col(value)).over(f)
    inside = F.count(F.lit(1)).over(f)
    mean = F.coalesce(F.sum(col(value)).over(f), F.lit(0.0)) / size
    return F.when((inside - seen) / F.lit(size) <= 0.99, mean)


def padded_max(value, size, keys=KEYS) -> Column:
    return F.max(col(value)).over(centred(size, keys))


def rolling_corr(x, y, size, keys=KEYS) -> Column:
    return corr(x, y, centred(size, keys))


def rolling_slope(value, size, keys=KEYS, x="bin") -> Column:
    return F.regr_slope(col(value), F.col(x).cast("double")).over(centred(size, keys))


def rolling_spearman(df: DataFrame, x: str, y: str, size: int, out="rho", keys=KEYS) -> DataFrame:
    """Spearman correlation of the ``size`` rows before each row (missing = 0, at least 3 distinct each).

    Ranks have no sliding update, so every (channel, day), which the cadence bounds, is one Arrow group and no sample is
    copied to its windows in the plan.
    """
    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, T.DoubleType())])

    def per_day(pdf: pd.DataFrame) -> pd.DataFrame:
        bins = pdf["bin"].to_numpy()
        dense = np.full((2, bins.max() + 1), np.nan)
        for k, name in enumerate((x, y)):
            dense[k, bins] = pdf[name].astype("float64").fillna(0.0)
        return pdf.assign(**{out: _sliding_spearman(*dense, size)[bins]})

    return df.groupBy(*keys).applyInPandas(per_day, schema)


def _sliding_ranks(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Average ranks inside every row of ``windows`` (NaN where it has NaN) and the number of distinct values."""
    order = np.argsort(windows, axis=1, kind="stable")
    v = np.take_along_axis(windows, order, 1)
    new = np.concatenate([np.ones((len(v), 1), bool), v[:, 1:] != v[:, :-1]], 1)
    place = np.arange(v.shape[1])
    low = np.maximum.accumulate(np.where(new, place, 0), 1)
    ends = np.concatenate([new[:, 1:], np.ones((len(v), 1), bool)], 1)
    high = np.minimum.accumulate(np.where(ends, place, v.shape[1])[:, ::-1], 1)[:, ::-1]
    ranks = np.empty(v.shape)
    np.put_along_axis(ranks, order, np.where(np.isnan(v), np.nan, (low + high) / 2), 1)
    return ranks, (new & ~np.isnan(v)).sum(1)


def _sliding_spearman(x: np.ndarray, y: np.ndarray, size: int, chunk: int = 4096) -> np.ndarray:
    rho = np.full(len(x), np.nan)
    if len(x) <= size:
        return rho
    views = [np.lib.stride_tricks.sliding_window_view(v, size)[:-1] for v in (x, y)]
    for at in range(0, len(views[0]), chunk):
        (rx, nx), (ry, ny) = (_sliding_ranks(v[at : at + chunk]) for v in views)
        k = np.flatnonzero((nx >= 3) & (ny >= 3))
        dx, dy = (r[k] - np.nanmean(r[k], 1, keepdims=True) for r in (rx, ry))
        rho[size + at + k] = np.nansum(dx * dy, 1) / np.sqrt(np.nansum(dx * dx, 1) * np.nansum(dy * dy, 1))
    return rho


# -- soft/hard coupling -----------------------------------------------------------------------------
def hopping_corr(df: DataFrame, x: str, y: str, size=300, hop=60, keys=KEYS) -> DataFrame:
    """corr(x, y) per complete hopping window, placed at the window centre."""
    first = F.greatest(F.ceil((F.col("bin") - (size - 1)) / F.lit(hop)), F.lit(0)).cast("bigint")
    win = F.explode(F.sequence(first, F.floor(F.col("bin") / F.lit(hop)).cast("bigint"))).alias("win")
    per = df.select(*keys, "bin", col(x).alias("_x"), col(y).alias("_y"), win).groupBy(*keys, "win").agg(
        corr("_x", "_y").alias("rho"), F.count(F.lit(1)).alias("rows")
    )
    return per.where(F.col("rows") == size).select(*keys, (F.col("win") * hop + size // 2).alias("bin"), "rho")


def cumulative_corr(df: DataFrame, soft: str, hard: str, smooth: int, keys=KEYS) -> DataFrame:
    """Correlation of the smoothed soft series with the smoothed running integral of (hard - mean)."""
    zero = df.withColumn("_s", F.coalesce(col(soft), F.lit(0.0))).withColumn("_h", F.coalesce(col(hard), F.lit(0.0)))
    zero = zero.withColumn("_d", F.col("_h") - F.avg("_h").over(whole(keys)))
    zero = zero.withColumn("_i", F.sum("_d").over(up_to(keys)))
    f = centred(smooth, keys)
    zero = zero.withColumn("_ss", F.avg("_s").over(f)).withColumn("_si", F.avg("_i").over(f))
    return zero.groupBy(*keys).agg(corr("_ss", "_si").alias("rho"))


def zscore(value, keys=KEYS) -> Column:
    w = whole(keys)
    return (col(value) - F.avg(col(value)).over(w)) / F.greatest(F.stddev_pop(col(value)).over(w), F.lit(1e-10))


def coupling_residuals(df: DataFrame, soft: str, hard: str, size: int, keys=KEYS) -> DataFrame:
    """Smoothed d(soft) minus smoothed hard, raw and as a difference of z-scores."""
    df = df.withColumn("_s0", F.coalesce(col(soft), F.lit(0.0)))
    df = df.withColumn("d_soft", gradient("_s0", keys))
    df = df.withColumn("_ms", padded_mean("d_soft", size, keys)).withColumn("_mh", padded_mean(hard, size, keys))
    df = df.withColumn("residual", F.col("_ms") - F.col("_mh"))
    return df.withColumn("deviation", zscore("_ms", keys) - zscore("_mh", keys)).drop("_s0", "_ms", "_mh")


def soft_hard_soft(index, flux, half=15, keys=KEYS) -> Column:
    """corr(spectral index, ln flux) over +-half rows with more than 5 valid pairs."""
    f = day_window(keys).rowsBetween(-half, half)
    lf = F.when((col(flux) > 0) & col(index).isNotNull(), F.ln(col(flux)))
    ix = F.when(lf.isNotNull(), col(index))
    return F.when(F.count(lf).over(f) > 5, corr(ix, lf, f))


# -- precursors and recency -----------------------------------------------------------------------------
def hope_score(df: DataFrame, temp: str, em: str, size=60, keys=KEYS) -> DataFrame:
    """Heating without evaporation: temperature rises while emission measure stays flat.

    Adds ``hope`` in [0, 1], ``hope_flag`` (above the day's 90th percentile) and ``fai`` (61-row mean).
    """
    day = whole(keys)
    f = centred(size, keys)
    d = df.withColumn("_t0", F.coalesce(col(temp), F.percentile(col(temp), F.lit(0.5)).over(day), F.lit(3.0)))
    d = d.withColumn("_e0", F.coalesce(col(em), F.lit(0.0)))
    d = d.withColumn("_ts", F.avg("_t0").over(f)).withColumn("_es", F.avg("_e0").over(f))
    d = d.withColumn("_dt", gradient("_ts", keys)).withColumn("_de", F.abs(gradient("_es", keys)))
    d = d.withColumn("_p75", F.percentile("_de", F.lit(0.75)).over(day) + 1e-10)
    d = d.withColumn("_raw", F.greatest(F.col("_dt"), F.lit(0.0)) * F.exp(-F.col("_de") / F.col("_p75")))
    d = d.withColumn("_p95", F.percentile("_raw", F.lit(0.95)).over(day) + 1e-10)
    known = col(temp).isNotNull() & col(em).isNotNull()
    d = d.withColumn("hope", F.when(known, F.least(F.col("_raw") / F.col("_p95"), F.lit(1.0))))
    d = d.withColumn("hope_flag", (F.col("hope") > F.percentile("hope", F.lit(0.9)).over(day)).cast("bigint"))
    d = d.withColumn("fai", F.avg("hope").over(centred(size + 1, keys)))
    return d.drop("_t0", "_e0", "_ts", "_es", "_dt", "_de", "_p75", "_raw", "_p95")


def robust_scale(value, keys=KEYS, lo=0.05, hi=0.95) -> Column:
    """(x - p5) / (p95 - p5) clipped to [0, 1]."""
    day = whole(keys)
    p = F.percentile(col(value), F.array(F.lit(lo), F.lit(hi))).over(day)
    span = p[1] - p[0]
    return F.when(span > 0, F.least(F.greatest((col(value) - p[0]) / span, F.lit(0.0)), F.lit(1.0))).otherwise(
        F.when(col(value).isNotNull(), F.lit(0.0))
    )


def since_event(flag, keys=KEYS, t="t") -> Column:
    return F.col(t) - F.last(F.when(col(flag), F.col(t)), ignorenulls=True).over(up_to(keys))


def until_event(flag, keys=KEYS, t="t") -> Column:
    return F.first(F.when(col(flag), F.col(t)), ignorenulls=True).over(after(keys)) - F.col(t)


def running_count(flag, keys=KEYS) -> Column:
    return F.sum(F.when(col(flag), 1).otherwise(0)).over(up_to(keys))


def starts(flag, keys=KEYS) -> Column:
    """True on the first row of each run of ``flag``."""
    before = F.coalesce(F.lag(col(flag)).over(day_window(keys)), F.lit(False))
    return col(flag) & ~before


def count_between(flag, lo: int, hi: int, keys=KEYS, t="t") -> Column:
    """Flagged rows whose time lies in [t+lo, t+hi]."""
    frame = Window.partitionBy(*keys).orderBy(t).rangeBetween(lo, hi)
    return F.sum(F.when(col(flag), 1).otherwise(0)).over(frame)


def precursor(elevated, in_event, start, horizon: int, keys=KEYS, t="t") -> Column:
    """Elevated row outside an event with an event start within the next ``horizon`` seconds."""
    frame = Window.partitionBy(*keys).orderBy(t).rangeBetween(1, horizon)
    soon = F.max(F.when(col(start), 1).otherwise(0)).over(frame)
    return (col(elevated) & ~col(in_event) & (F.coalesce(soon, F.lit(0)) == 1)).cast("bigint")


def burst_trigger(df: DataFrame, hard: str, long=5, base=600, kappa=5.0, keys=KEYS) -> DataFrame:
    """Sample over its short centred mean (0-10) and a binary trigger against the first ``base`` rows."""
    v = F.coalesce(col(hard), F.lit(0.0))
    mean = F.sum(v).over(centred(long, keys)) / long
    day = whole(keys)
    head = F.when(F.col("bin") < base, col(hard))
    df = df.withColumn("_mean", mean)
    df = df.withColumn("trigger_ratio", F.when(F.col("_mean") > 0.1, F.least(F.greatest(v / F.col("_mean"), F.lit(0.0)), F.lit(10.0))))
    df = df.withColumn("_bg", F.percentile(head, F.lit(0.5)).over(day)).withColumn("_sd", F.stddev_pop(head).over(day))
    sd = F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
    hit = (F.coalesce(F.col("trigger_ratio"), F.lit(0.0)) > 2) | F.coalesce(col(hard) > F.col("_bg") + kappa * sd, F.lit(False))
    return df.withColumn("trigger", hit.cast("bigint")).drop("_mean", "_bg", "_sd")


def forecast_targets(df: DataFrame, in_event, horizons, quiet: int, keys=KEYS, t="t") -> DataFrame:
    """In-event flag, event start within each horizon, and rows further than ``quiet`` from any event."""
    df = df.withColumn("_in", F.coalesce(col(in_event), F.lit(False)))
    df = df.withColumn("_start", starts("_in", keys))
    for name, h in horizons.items():
        frame = Window.partitionBy(*keys).orderBy(t).rangeBetween(1, h)
        hit = F.coalesce(F.max(F.when(F.col("_start"), 1).otherwise(0)).over(frame), F.lit(0))
        df = df.withColumn(name, F.when(F.col("_in"), 0).otherwise(hit).cast("bigint"))
    back, ahead = since_event("_in", keys, t), until_event("_in", keys, t)
    far = (F.coalesce(back, F.lit(2**40)) > quiet) & (F.coalesce(ahead, F.lit(2**40)) > quiet)
    return df.withColumn("quiet", far.cast("bigint")).withColumn("in_event", F.col("_in").cast("bigint")).drop("_in", "_start")


def distinct_blocks(block: str, span: int, keys=KEYS, t="t") -> Column:
    """Distinct block ids in the trailing ``span`` seconds; ids grow with time, so max - min + 1."""
    frame = Window.partitionBy(*keys).orderBy(t).rangeBetween(-span, 0)
    return F.max(block).over(frame) - F.min(block).over(frame) + 1
