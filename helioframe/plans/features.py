"""Samples -> 179-column window feature matrix with labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import causal as ca
from ..operators import information as inf
from ..operators import intervals as iv
from ..operators import periodicity as pe
from ..operators import rolling as ro
from ..operators import windows as wi
from ..functions.scalars import deadtime_true_rate
from ..operators.matching import first_covering
from ..session import cut_lineage, sized

DAY = ["day"]


def window_families(grid: DataFrame, bands: list[str], rows_per_day: int, cadence: int, lookback: int, step: int, scales, lags, short: int, long: int,
                    coupling=(300, 60), max_lag=100, periods=(10.0, 300.0), period_bands=None, cross=(30, 120)) -> DataFrame:
    """Every per-window family joined on (day, win)."""
    keys = [*DAY, "win"]
    soft_hard = wi.prepare(grid, "soft", bands).select("day", "bin", F.coalesce("soft", F.lit(0.0)).alias("s"), F.col("hard").alias("h"))
    rows = wi.hop(soft_hard, rows_per_day, lookback, step)

    base = wi.window_features(grid, "soft", bands, rows_per_day, lookback, step, acf_lags=lags, scales=scales, xrsb="xb", xrsa="xa", short=short, long=long)
    base = base.withColumnsRenamed({f"sxr_acf_{a}s": f"sxr_acf_{b}s" for a, b in zip(lags, wi.ACF_LAGS)})

    arr = cut_lineage(pe.arrays_of(rows, keys, ["s", "h"], "pos"), "arrays")  # read by both kernels
    bands_out = pe.window_band_features(arr, keys, "s", "h", 1.0, pe.scale_grid(2.0, lookback / 4.0), period_bands, cross)
    arr = arr.withColumn("_w", pe.welch_shape("s", F.lit(256))).withColumn("_es", inf.sample_entropy("s", F.lit(2), F.lit(0.2)))
    arr = arr.withColumn("_eh", inf.sample_entropy("h", F.lit(2), F.lit(0.2))).withColumn("_l", inf.lag_scan("h", "s", F.lit(max_lag)))
    shapes = arr.select(*keys, F.col("_w.entropy").alias("sxr_spec_entropy"), F.col("_w.peak_freq").alias("sxr_peak_freq"), F.col("_es").alias("sample_entropy_sxr"),
                        F.col("_eh").alias("sample_entropy_hxr"), F.col("_l.r").alias("lagged_cross_corr"), F.col("_l.lag").cast("double").alias("lagged_cross_corr_lag"))
    te = inf.transfer_entropy(rows, keys, "h", "s", bins=8, order="pos", out="transfer_entropy_hxr_to_sxr")
    mi = inf.mutual_information(rows, keys, "s", "h", bins=8, out="mutual_information_sxr_hxr")

    size, hopn = coupling
    grad = soft_hard.withColumn("ds", ro.gradient("s", ("day",)))
    rho = ro.hopping_corr(grad, "ds", "h", size, hopn, ("day",))
    inside = wi.hop(rho, rows_per_day, lookback, step).where((F.col("pos") >= size // 2) & (F.col("pos") + size - size // 2 <= lookback))
    neupert = inside.groupBy(*keys).agg(F.avg("rho").alias("neupert_rho_mean"), F.stddev_pop("rho").alias("neupert_rho_std"))

    qpp = pe.detect_pulsations(rows, keys, "h", 1.0, *periods).select(
        *keys, F.col("detected").cast("double").alias("qpp_detected"), F.col("period").alias("qpp_period"), F.col("amplitude").alias("qpp_amplitude"), F.col("significance").alias("qpp_significance"))
    out = base
    for family in (shapes, bands_out, te, mi, neupert, qpp):
        out = out.join(family, keys, "left")
    return out


def causal_families(grid: DataFrame, columns: dict[str, str], soft: str, hard: str, mediator: str, max_lag=30, granger_lags=ca.GRANGER_LAGS, granger_max=60) -> DataFrame:
    """Day-level causal features on every sample of ``grid`` (thin it with ``every_kth`` first where that is wanted); ``columns`` maps band name -> column."""
    bands = list(columns)
    thin = grid.select("day", "bin", *[F.coalesce(F.col(c), F.lit(0.0)).alias(b) for b, c in columns.items()])
    edges = ca.lag_edges(thin, DAY, bands, max_lag)
    net = ca.network_features(edges, DAY, bands, soft, hard)
    med = ca.mediation(thin, DAY, hard, mediator, soft).select("day", F.col("mediation_proportion").alias("max_mediation_proportion"))
    gr = ca.granger(thin.withColumn("d", ro.step(soft, ("day",))), DAY, hard, "d", lags=granger_lags, max_lag=granger_max).select(
        "day", F.col("improvement").alias("neupert_granger_improvement"), F.col("best_lag").cast("double").alias("neupert_best_lag"))
    return net.join(med, "day", "left").join(gr, "day", "left")


def feature_matrix(grid: DataFrame, bands: list[str], events: DataFrame, day_tables: list[DataFrame], rows_per_day: int, cadence: int, lookback=3600, step=300, horizon=1800,
                   window_tables: list[DataFrame] = (), **families) -> DataFrame:
    """(day, win, t, label, 179 features).

    ``grid`` is materialised once: a dozen families read the binned table, none rescans the raw data.
    Day-level tables have one row per day and join on it, window tables one row per (day, win).
    """
    base = cut_lineage(grid, "grid")
    out = window_families(base, bands, rows_per_day, cadence, lookback, step, **families)
    for table in window_tables:
        out = out.join(table, ["day", "win"], "left")
    for table in day_tables:
        out = out.join(table, "day", "left")
    out = out.withColumn("t", wi.window_end(cadence, step, lookback))
    full = wi.canonical(out, ["day", "win", "t"])
    return iv.flag_upcoming(full, events, horizon=horizon)


def master_columns(windows: DataFrame, grid: DataFrame, flares: DataFrame, cadence: int, lookback: int, step: int, raw: dict[str, str], soft="soft", tau=13.65e-6) -> DataFrame:
    """Windows (day, win, ...) with what the master table adds: the clock at the window's end, the samples there, the flare that
    covers it, and the soft level of the day.

    ``raw`` maps output names to columns of ``grid``; ``flares`` has (day, start_t, end_t, class).  The sample after the window
    comes by an equality join on (day, bin), the flare by a bucketed range join.
    """
    at = windows.withColumn("t", wi.window_end(cadence, step, lookback)).withColumn("bin", F.col("win") * step + lookback)
    sample = grid.select("day", "bin", *[F.coalesce(F.col(c), F.lit(0.0)).alias(n) for n, c in raw.items()], F.coalesce(deadtime_true_rate(soft, tau), F.lit(0.0)).alias("sxr_counts_corrected"))
    out = at.join(sample, ["day", "bin"], "left").fillna(0.0, [*raw, "sxr_counts_corrected"])
    level = grid.groupBy("day").agg(F.max(soft).alias("day_sxr_peak"), F.avg(soft).alias("day_sxr_mean"))
    out = out.join(sized(level, "days"), "day", "left")
    out = first_covering(out, flares, width=4 * 3600)
    out = out.withColumnRenamed("in_event", "in_flare").withColumn("flare_class", F.coalesce("class", F.lit("none"))).drop("class", "bin")
    return out.withColumn("time_utc", F.date_format(F.timestamp_seconds("t"), "HH:mm:ss"))
