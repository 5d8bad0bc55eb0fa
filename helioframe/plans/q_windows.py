"""Queries: hopping-window features, day scalars, sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions.output import present
from ..operators import windows as wi
from ..sources.lightcurve import bin_samples, fill_grid
from ..sources.tables import table
from .fixtures import BINS, CADENCE, READOUT, WIDE, big, final, wide
from .q_scalar import SPEC, spec
from .registry import query

LOOK, STEP = 36, 6
TOP = (BINS - 1 - LOOK) // STEP
BANDS = [f"b{i}" for i in range(10)]
MAXED = ["click", "purchase", "signup", "error"]
SCALES = {"5m": 4, "15m": 12, "30m": 20}
LAGS = (2, 4, 8, 12)


def banded(spark, sf):
    """day, bin, soft, b0..b9: four hard means, their sum, four hard maxima, their sum; xb / xa."""
    from ..sources.lightcurve import _clock

    ev = table(spark, sf, "events")
    day, slot = _clock("ts", CADENCE)
    pick = lambda c: F.when(F.col("event_type") == c, F.col("value"))
    cells = ev.groupBy(day, slot).agg(
        sc.tidy(F.avg(pick("view")), READOUT).alias("soft"),
        *[sc.tidy(F.avg(pick(c)), READOUT).alias(f"b{i}") for i, c in enumerate(MAXED)],
        *[F.max(pick(c)).alias(f"b{i + 5}") for i, c in enumerate(MAXED)])
    g = fill_grid(cells, CADENCE, ("day",))
    add = lambda cols: F.when(F.coalesce(*cols).isNotNull(), sum([F.coalesce(c, F.lit(0.0)) for c in cols[1:]], F.coalesce(cols[0], F.lit(0.0))))
    g = g.withColumn("b4", add([F.col(f"b{i}") for i in range(4)])).withColumn("b9", add([F.col(f"b{i}") for i in range(5, 9)]))
    return g.withColumn("xb", F.col("soft") * 1e-8).withColumn("xa", F.col("b0") * 1e-9)


def _sum_sql(cols):
    return f"CASE WHEN coalesce({', '.join(cols)}) IS NOT NULL THEN {' + '.join(f'coalesce({c}, 0)' for c in cols)} END"


BANDED = WIDE + f""",
mx AS (SELECT day, bin, {', '.join(f"max(CASE WHEN channel = '{c}' THEN hi END) AS m{i}" for i, c in enumerate(MAXED))} FROM binned GROUP BY day, bin),
bd AS (SELECT w.day, w.bin, w.t, w.view AS soft, {', '.join(f'w.{c} AS b{i}' for i, c in enumerate(MAXED))}, {_sum_sql([f'w.{c}' for c in MAXED])} AS b4,
  {', '.join(f'm{i} AS b{i + 5}' for i in range(4))}, {_sum_sql([f'm{i}' for i in range(4)])} AS b9, w.view * 1e-8 AS xb, w.click * 1e-9 AS xa
  FROM wide w LEFT JOIN mx ON mx.day = w.day AND mx.bin = w.bin),
wn AS (SELECT CAST(range AS BIGINT) AS win FROM range({TOP + 1})),
hp AS (SELECT bd.*, win, bin - win * {STEP} AS pos, {' + '.join(f'coalesce(b{i}, 0)' for i in range(5))} AS hard,
  CASE WHEN b0 > 0 THEN coalesce(b1, 0) / b0 ELSE 0 END AS hrg FROM bd JOIN wn ON bin >= win * {STEP} AND bin < win * {STEP} + {LOOK}),
vd AS (SELECT day, win, pos, soft, row_number() OVER o AS k, count(*) OVER (PARTITION BY day, win) AS n, soft - lag(soft) OVER o AS d1,
  avg(soft) OVER (PARTITION BY day, win) AS m FROM hp WHERE soft IS NOT NULL WINDOW o AS (PARTITION BY day, win ORDER BY pos)),
ve AS (SELECT *, d1 - lag(d1) OVER (PARTITION BY day, win ORDER BY pos) AS d2 FROM vd)"""


def features(spark, sf, **kw):
    opts = dict(rows_per_day=BINS, lookback=LOOK, step=STEP, acf_lags=LAGS, scales=SCALES, xrsb="xb", xrsa="xa", short=6, long=18)
    opts.update(kw)
    return wi.window_features(banded(spark, sf), "soft", BANDS, **opts)


def keep(df, names, digits=6):
    return present(df.select("day", "win", *names), digits)


_STATS = "window_len sxr_mean sxr_std sxr_max sxr_min sxr_median sxr_skew sxr_kurtosis sxr_range sxr_cv sxr_iqr sxr_p5 sxr_p25 sxr_p75 sxr_p95"


@query("window_stats", final(
    """SELECT *, sxr_max - sxr_min AS sxr_range, sxr_std / greatest(sxr_mean, 1e-6) AS sxr_cv, sxr_p75 - sxr_p25 AS sxr_iqr, CASE WHEN sxr_std > 0 THEN m3 / pow(sxr_std, 3) ELSE 0 END AS sxr_skew, CASE WHEN sxr_std > 0 THEN m4 / pow(sxr_std, 4) - 3 ELSE 0 END AS sxr_kurtosis FROM (
  SELECT day, win, CAST(count(*) AS DOUBLE) AS window_len, avg(soft) AS sxr_mean, stddev_pop(soft) AS sxr_std, max(soft) AS sxr_max, min(soft) AS sxr_min, quantile_cont(soft, 0.5) AS sxr_median,
  quantile_cont(soft, 0.05) AS sxr_p5, quantile_cont(soft, 0.25) AS sxr_p25, quantile_cont(soft, 0.75) AS sxr_p75, quantile_cont(soft, 0.95) AS sxr_p95, avg(pow(soft - m, 3)) AS m3, avg(pow(soft - m, 4)) AS m4
  FROM ve GROUP BY day, win HAVING count(*) >= 5)""", "day, win", _STATS, BANDED))
def _stats(spark, sf):
    return keep(features(spark, sf), _STATS.split())


_RATES = "sxr_rise_rate sxr_fall_rate sxr_abs_slope dsxr_dt_mean dsxr_dt_std dsxr_dt_max dsxr_dt_min d2sxr_dt2_mean d2sxr_dt2_std"


@query("window_rates", final(
    """SELECT day, win, coalesce(avg(d1) FILTER (d1 > 0), 0) AS sxr_rise_rate, coalesce(avg(d1) FILTER (d1 < 0), 0) AS sxr_fall_rate, avg(abs(d1)) AS sxr_abs_slope, avg(d1) AS dsxr_dt_mean, stddev_pop(d1) AS dsxr_dt_std,
  max(d1) AS dsxr_dt_max, min(d1) AS dsxr_dt_min, coalesce(avg(d2), 0) AS d2sxr_dt2_mean, coalesce(stddev_pop(d2), 0) AS d2sxr_dt2_std FROM ve GROUP BY day, win HAVING count(*) >= 5""", "day, win", _RATES, BANDED))
def _rates(spark, sf):
    return keep(features(spark, sf), _RATES.split())


@query("window_hard_rates", final(
    """SELECT h.*, r.ds / (hm + 1e-10) AS dsxr_dhxr_ratio_mean FROM (SELECT day, win, avg(dh) AS dhxr_dt_mean, stddev_pop(dh) AS dhxr_dt_std, max(dh) AS dhxr_dt_max, avg(dr) AS dhr_dt_mean, max(dr) AS dhr_dt_max, avg(hard) AS hm FROM (
  SELECT *, hard - lag(hard) OVER o AS dh, hrg - lag(hrg) OVER o AS dr FROM hp WINDOW o AS (PARTITION BY day, win ORDER BY pos)) GROUP BY day, win) h
  JOIN (SELECT day, win, coalesce(avg(d1), 0) AS ds FROM ve GROUP BY day, win HAVING count(*) >= 5) r USING (day, win)""",
    "day, win", "dhxr_dt_mean dhxr_dt_std dhxr_dt_max dhr_dt_mean dhr_dt_max dsxr_dhxr_ratio_mean", BANDED))
def _hard_rates(spark, sf):
    return keep(features(spark, sf), "dhxr_dt_mean dhxr_dt_std dhxr_dt_max dhr_dt_mean dhr_dt_max dsxr_dhxr_ratio_mean".split())


_OKW = "(SELECT day, win FROM ve GROUP BY day, win HAVING count(*) >= 5) okw"
_BANDCOLS = " ".join(f"hxr_b{i}_{s}" for i in range(10) for s in ("mean", "std", "max"))


@query("band_stats", final(
    "SELECT hp.day, hp.win, " + ", ".join(
        f"CASE WHEN count(b{i}) >= 3 THEN avg(b{i}) ELSE 0 END AS hxr_b{i}_mean, CASE WHEN count(b{i}) >= 3 THEN stddev_pop(b{i}) ELSE 0 END AS hxr_b{i}_std, CASE WHEN count(b{i}) >= 3 THEN max(b{i}) ELSE 0 END AS hxr_b{i}_max" for i in range(10))
    + f" FROM hp JOIN {_OKW} USING (day, win) GROUP BY hp.day, hp.win", "day, win", _BANDCOLS, BANDED))
def _bands(spark, sf):
    return keep(features(spark, sf), _BANDCOLS.split())


_RATIOS = "hxr_hardness_ratio hxr_total_mean soft_hard_ratio cdte_thermal_ratio cdte_boundary_ratio hardness_ratio_mean hardness_ratio_std hardness_ratio_slope"


@query("band_ratios", final(
    f"""SELECT hp.day, hp.win, avg(CASE WHEN b0 IS NOT NULL AND b1 IS NOT NULL THEN b1 / greatest(b0, 1e-6) ELSE 0 END) AS hxr_hardness_ratio, avg(hard) AS hxr_total_mean,
  avg(CASE WHEN soft IS NOT NULL THEN CASE WHEN hard > 0 THEN soft / (hard + 1e-6) ELSE 0 END END) AS soft_hard_ratio,
  avg(CASE WHEN b5 IS NOT NULL AND b4 IS NOT NULL THEN b5 / greatest(b4, 1e-6) ELSE 0 END) AS cdte_thermal_ratio, avg(CASE WHEN b6 IS NOT NULL AND b5 IS NOT NULL THEN b6 / greatest(b5, 1e-6) ELSE 0 END) AS cdte_boundary_ratio,
  CASE WHEN count(hr) > 10 THEN avg(hr) ELSE 0 END AS hardness_ratio_mean, CASE WHEN count(hr) > 10 THEN stddev_pop(hr) ELSE 0 END AS hardness_ratio_std, CASE WHEN count(hr) > 10 THEN coalesce(regr_slope(hr, pos), 0) ELSE 0 END AS hardness_ratio_slope
  FROM (SELECT *, CASE WHEN b1 > 0 THEN CASE WHEN b0 IS NOT NULL THEN b1 / greatest(b0, 1e-6) END ELSE 0 END AS hr FROM hp) hp JOIN {_OKW} USING (day, win) GROUP BY hp.day, hp.win""", "day, win", _RATIOS, BANDED))
def _ratios(spark, sf):
    return keep(features(spark, sf), _RATIOS.split())


_MULTI = [n for n in wi.FAMILIES["multiscale"]]


@query("multiscale", final(
    """SELECT *, sxr_mean_5m / (sm + 1e-10) AS sxr_5m_to_60m_ratio, hxr_mean_5m / (hm + 1e-10) AS hxr_5m_to_60m_ratio, (sxr_mean_5m - sxr_mean_15m) / (sxr_mean_15m + 1e-10) AS sxr_acceleration_trend, (hxr_mean_5m - hxr_mean_15m) / (hxr_mean_15m + 1e-10) AS hxr_acceleration_trend FROM
  (SELECT day, win, avg(soft) AS sm, coalesce(regr_slope(soft, k) FILTER (n - k < 12), 0) AS sxr_15m_slope, """
    + ", ".join(f"avg(soft) FILTER (n - k < {n}) AS sxr_mean_{l}, stddev_pop(soft) FILTER (n - k < {n}) AS sxr_std_{l}, max(soft) FILTER (n - k < {n}) AS sxr_max_{l}" for l, n in SCALES.items())
    + " FROM ve GROUP BY day, win HAVING count(*) >= 5) JOIN (SELECT day, win, avg(hard) AS hm, regr_slope(hard, pos) FILTER (pos >= 24) AS hxr_15m_slope, "
    + ", ".join(f"avg(hard) FILTER (pos >= {LOOK - n}) AS hxr_mean_{l}, stddev_pop(hard) FILTER (pos >= {LOOK - n}) AS hxr_std_{l}, max(hard) FILTER (pos >= {LOOK - n}) AS hxr_max_{l}" for l, n in SCALES.items())
    + " FROM hp GROUP BY day, win) USING (day, win)", "day, win", " ".join(_MULTI), BANDED, digits=5))
def _multi(spark, sf):
    return keep(features(spark, sf), _MULTI, 5)


@query("window_acf", final(
    "SELECT a.day, a.win, " + ", ".join(f"CASE WHEN max(a.n) > 20 THEN coalesce(sum((a.soft - a.m) * (b{k}.soft - a.m)), 0) / (sum((a.soft - a.m) * (a.soft - a.m)) + 1e-10) ELSE 0 END AS sxr_acf_{k}s" for k in LAGS)
    + " FROM vd a " + " ".join(f"LEFT JOIN vd b{k} ON b{k}.day = a.day AND b{k}.win = a.win AND b{k}.k = a.k + {k}" for k in LAGS) + " GROUP BY a.day, a.win HAVING count(*) >= 5",
    "day, win", " ".join(f"sxr_acf_{k}s" for k in LAGS), BANDED))
def _acf(spark, sf):
    return keep(features(spark, sf), [f"sxr_acf_{k}s" for k in LAGS])


_GOES = "ddt std_short std_long xa_mean level grad above last_ratio"


@query("reference_series", final(
    f"""SELECT hp.day, hp.win, coalesce(max(dx), 0) * 1e8 AS ddt, coalesce(stddev_pop(xb) FILTER (pos >= {LOOK - 6}), 0) * 1e8 AS std_short, coalesce(stddev_pop(xb) FILTER (pos >= {LOOK - 18}), 0) * 1e8 AS std_long,
  coalesce(avg(xa) FILTER (pos >= {LOOK - 6}), 0) * 1e9 AS xa_mean, coalesce(log10(max(xb) + 1e-10), 0) AS level, coalesce(regr_slope(xb, pos), 0) * 1e8 AS grad, count(*) FILTER (xb > 1e-6) AS above,
  coalesce(arg_max(xb, pos) FILTER (xb IS NOT NULL) / max(xb), 0) AS last_ratio FROM (SELECT *, CASE WHEN pos > 0 THEN xb - lag(xb) OVER (PARTITION BY day, win ORDER BY pos) END AS dx FROM hp) hp JOIN {_OKW} USING (day, win) GROUP BY hp.day, hp.win""",
    "day, win", _GOES, BANDED))
def _goes(spark, sf):
    f = features(spark, sf)
    return present(f.select(
        "day", "win", (F.col("goes_xrsb_ddt_max") * 1e8).alias("ddt"), (F.col("goes_xrsb_rolling_std_300s") * 1e8).alias("std_short"),
        (F.col("goes_xrsb_rolling_std_1800s") * 1e8).alias("std_long"), (F.col("goes_xrsa_rolling_mean_300s") * 1e9).alias("xa_mean"),
        F.col("goes_class_current").alias("level"), (F.col("goes_xrsb_gradient_1h") * 1e8).alias("grad"),
        F.col("goes_flare_history_24h").alias("above"), F.col("goes_xrsb_prev_peak_ratio").alias("last_ratio")))


@query("detector_totals", final(
    """SELECT day, avg(b4) AS czt1_total_mean, max(b4) AS czt1_total_max, stddev_pop(b4) AS czt1_total_std, avg(CASE WHEN b9 > 0 THEN b9 END) AS cdte1_total_mean, max(b9) AS cdte1_total_max, stddev_pop(CASE WHEN b9 > 0 THEN b9 END) AS cdte1_total_std,
  avg(b0 / greatest(b1, 1e-6)) AS czt_cross_detector_ratio FROM bd GROUP BY day""", "day",
    "czt1_total_mean czt1_total_max czt1_total_std cdte1_total_mean cdte1_total_max cdte1_total_std czt_cross_detector_ratio", BANDED))
def _totals(spark, sf):
    b = banded(spark, sf)
    first = wi.band_totals(b, {"czt1": "b4"})
    second = wi.band_totals(b, {"cdte1": "b9"}, positive_only=True)
    return present(first.join(second, "day").join(b.groupBy("day").agg(wi.cross_ratio("b0", "b1").alias("czt_cross_detector_ratio")), "day"))


@query("day_scalars", final(
    """SELECT day, avg(xb) FILTER (bin < 36) * 1e8 AS xb_head, avg(xa) FILTER (bin < 36) * 1e8 AS xa_head, avg(xa) FILTER (bin < 36) / avg(xb) FILTER (bin < 36) AS ratio_head, max(xb) * 1e8 AS xb_max, max(xa) * 1e8 AS xa_max,
  100.0 * avg(CASE WHEN b4 IS NOT NULL THEN CASE WHEN b4 < greatest(1.1 * md, 0.1) THEN 1.0 ELSE 0.0 END END) AS bg_fraction_pct FROM (SELECT *, quantile_cont(b4, 0.5) OVER (PARTITION BY day) AS md FROM bd) GROUP BY day""",
    "day", "xb_head xa_head ratio_head xb_max xa_max bg_fraction_pct", BANDED))
def _scalars(spark, sf):
    b = banded(spark, sf)
    head = wi.reference_flux(b, "xb", "xa", first_rows=36)
    top = wi.reference_flux(b, "xb", "xa", first_rows=None)
    below = b.select("day", *wi.background_share("b4")).groupBy("day").agg((100.0 * F.avg(F.col("below").cast("double"))).alias("bg_fraction_pct"))
    return present(head.select("day", (F.col("goes_xrsb_flux") * 1e8).alias("xb_head"), (F.col("goes_xrsa_flux") * 1e8).alias("xa_head"), F.when(F.col("goes_xrsb_flux") > 0, F.col("goes_xrsa_xrsb_ratio")).alias("ratio_head"))
                   .join(top.select("day", (F.col("goes_xrsb_flux") * 1e8).alias("xb_max"), (F.col("goes_xrsa_flux") * 1e8).alias("xa_max")), "day").join(below, "day"))


@query("channel_bands", final(
    """SELECT vec_id AS id, list_avg(x[1:16]) AS low_mean, list_stddev_samp(x[1:16]) AS low_std, list_max(x[1:16]) AS low_max, list_avg(x[17:64]) AS high_mean, list_stddev_samp(x[17:64]) AS high_std, list_max(x[17:64]) AS high_max,
  list_avg(x[21:26]) AS line, list_avg(x[41:60]) AS continuum, list_avg(x[21:26]) / greatest(list_avg(x[41:60]), 1e-10) AS ratio, list_sum(x) AS total FROM (SELECT vec_id, [round(abs(CAST(e AS DOUBLE)) * 100.0, 2) FOR e IN embedding] AS x FROM embeddings)""",
    "id", "low_mean low_std low_max high_mean high_std high_max line continuum ratio total"))
def _channel_bands(spark, sf):
    s = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.round(F.abs(x.cast("double")) * 100.0, 2)).alias("counts"))
    d = wi.channel_bands(s, bands={"low": (0, 16), "high": (16, 64)}, line=(20, 26), continuum=(40, 60))
    return present(d.select("id", "low_mean", "low_std", "low_max", "high_mean", "high_std", "high_max", F.col("fe_xxv_line_flux").alias("line"),
                            F.col("continuum_level").alias("continuum"), F.col("line_to_continuum").alias("ratio"), F.col("pi_total_flux").alias("total")))


@query("housekeeping_stats", final(
    "SELECT s_nationkey, avg(s_acctbal) AS mean_temp, quantile_cont(s_acctbal, 0.5) AS median_temp, max(s_suppkey) AS counter FROM supplier GROUP BY s_nationkey",
    big("s_nationkey") + ", counter", "mean_temp median_temp"))
def _hk(spark, sf):
    s = table(spark, sf, "supplier")
    a = wi.housekeeping(s, {"mean_temp": "s_acctbal"}, {"counter": "s_suppkey"}, ("s_nationkey",))
    b = wi.housekeeping(s, {"median_temp": "s_acctbal"}, {}, ("s_nationkey",), robust=True)
    return present(a.join(b, "s_nationkey"))


@query("sequences", final(
    "SELECT day, win, count(*) AS length, sum(CAST(CAST(coalesce(soft, 0) AS FLOAT) AS DOUBLE)) AS soft_sum, sum(CAST(CAST(coalesce(b0, 0) AS FLOAT) AS DOUBLE)) AS b0_sum, sum(CAST(CAST(CASE WHEN pos > 0 THEN coalesce(soft, 0) - coalesce(lagged, 0) ELSE 0 END AS FLOAT) AS DOUBLE)) AS diff_sum FROM (SELECT *, lag(soft) OVER (PARTITION BY day, win ORDER BY pos) AS lagged FROM hp) GROUP BY day, win",
    "day, win, length", "soft_sum b0_sum diff_sum", BANDED, digits=4))
def _sequences(spark, sf):
    s = wi.sequences(banded(spark, sf), ["soft", *BANDS], BINS, LOOK, STEP)
    total = lambda c: F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return present(s.select("day", "win", F.size("soft").alias("length"), total("soft").alias("soft_sum"), total("b0").alias("b0_sum"), total("d_soft").alias("diff_sum")), 4)


@query("downsample", final(
    "SELECT day, win, pos // 5 AS block, avg(coalesce(soft, 0)) AS soft, avg(coalesce(b0, 0)) AS b0 FROM hp WHERE pos < 35 GROUP BY ALL", "day, win, CAST(block AS BIGINT) AS block", "soft b0", BANDED))
def _down(spark, sf):
    return present(wi.block_means(banded(spark, sf), ["soft", "b0"], BINS, 5, LOOK, STEP))


@query("stride_sample", final("SELECT day, bin, soft, b0 FROM bd WHERE bin % 6 = 0", "day, bin", "soft b0", BANDED))
def _stride(spark, sf):
    return present(wi.every_kth(banded(spark, sf), 6).select("day", "bin", "soft", "b0"))
