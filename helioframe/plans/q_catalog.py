"""Queries: per-flare measures, catalog statistics, quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as sc
from ..functions.output import present
from ..operators import catalog as cg
from ..operators import intervals as iv
from ..operators import islands as isl
from ..operators import rolling as ro
from ..session import cut_lineage
from ..sources.sinks import report_json
from ..sources.tables import table, without_days
from .fixtures import BINS, CADENCE, CHANNELS, LC, WIDE, big, final, lc, wide
from .q_detect import grade, grade_sql, swpc, swpc_sql
from .q_match import EV, GTI, _MERGED, good_times, merged_times
from .q_rolling import TEM, _grad_sql, temps
from .q_scalar import TAU
from .q_windows import BANDED, banded
from .registry import query

D = ("day",)
E0 = "CAST(epoch(day) AS BIGINT)"


def flare_table(spark, sf):
    return swpc(spark, sf, only="view", min_run=1, min_duration=2, short_duration=None, merge_gap=8).select("day", F.col("start_t").alias("fid"), "start_t", "end_t")


FL = swpc_sql(1.5, 1, 2, None, 8) + f", fl AS (SELECT day, {E0} + start_bin * {CADENCE} AS fid, {E0} + start_bin * {CADENCE} AS start_t, {E0} + end_bin * {CADENCE} AS end_t FROM swpc WHERE channel = 'view')"
_WIDE_ONLY = WIDE[len(LC) + 2:]


def metric_rows(spark, sf):
    w = wide(spark, sf).select("day", "bin", "t", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("view", "purchase")], "click")
    w = w.withColumn("d", ro.gradient("view", D)).withColumn("x", F.greatest(F.col("click") - 20, F.lit(0.0)))
    return cut_lineage(cg.flare_rows(w, flare_table(spark, sf), 7200, 21600), "flare-rows")


ROWS = FL + ", " + _WIDE_ONLY + f""",
wq AS (SELECT day, bin, t, coalesce(view, 0) AS view, coalesce(purchase, 0) AS purchase, click FROM wide), wr AS (SELECT *, {_grad_sql('view')} AS d, greatest(click - 20, 0) AS x FROM wq),
fr AS (SELECT wr.*, fid, start_t, end_t, wr.t >= start_t AS inside FROM wr JOIN fl ON fl.day = wr.day AND wr.t >= start_t - 7200 AND wr.t <= end_t),
f1 AS (SELECT *, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY day, fid, inside) AS n, avg(purchase) OVER (PARTITION BY day, fid, inside ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS sm FROM fr WINDOW o AS (PARTITION BY day, fid, inside ORDER BY t)),
f2 AS (SELECT *, inside AND (n <= 2 * greatest(n // 5, 1) OR (i >= greatest(n // 5, 1) AND i < n - greatest(n // 5, 1))) AS central FROM f1),
f3 AS (SELECT day, fid, arg_max(t, sm * 1e6 - (t - start_t) / 1e4) FILTER (central) AS t_peak, CASE WHEN count(*) FILTER (NOT inside) > 3 THEN quantile_cont(purchase, 0.5) FILTER (NOT inside) ELSE min(purchase) FILTER (inside) END AS bg_flux FROM f2 GROUP BY day, fid),
f4 AS (SELECT f2.*, t_peak, bg_flux, max(CASE WHEN inside AND t = t_peak THEN purchase END) OVER (PARTITION BY f2.day, f2.fid) AS peak_flux FROM f2 JOIN f3 USING (day, fid)),
f5 AS (SELECT day, fid, t_peak, peak_flux, bg_flux, coalesce(min(t) FILTER (inside AND sm >= bg_flux + 0.1 * (peak_flux - bg_flux)), min(t) FILTER (inside)) AS t_start, coalesce(max(t) FILTER (inside AND sm >= bg_flux + 0.1 * (peak_flux - bg_flux)), max(t) FILTER (inside)) AS t_end,
  max(abs(d)) FILTER (inside) AS max_deriv, max(view) FILTER (inside) AS peak_sxr, arg_max(t, view * 1e6 - (t - start_t) / 1e4) FILTER (inside) AS ts, max(click) FILTER (inside) AS peak_hxr, arg_max(t, click * 1e6 - (t - start_t) / 1e4) FILTER (inside AND click IS NOT NULL) AS th,
  CASE WHEN count(click) FILTER (inside) > 0 THEN coalesce(sum(x) FILTER (inside), 0) * 600 END AS hxr_fluence FROM f4 GROUP BY day, fid, t_peak, peak_flux, bg_flux)"""


@query("flare_metrics", final("SELECT *, t_peak - t_start AS rise_time, t_end - t_peak AS decay_time, t_end - t_start AS duration, th - ts AS dt_peak FROM f5",
                              "day, fid, t_peak, t_start, t_end, rise_time, decay_time, duration, dt_peak", "peak_flux bg_flux max_deriv peak_sxr peak_hxr hxr_fluence", ROWS))
def _metrics(spark, sf):
    return present(cg.flare_metrics(metric_rows(spark, sf), ["day", "fid"], "purchase", "view", "click", "d", "x", 3, CADENCE, 3))


@query("flare_broadcast", final("SELECT day, bin, fid, peak_sxr, t_end - t_start AS duration FROM fr JOIN f5 USING (day, fid) WHERE inside", "day, bin, fid, duration", "peak_sxr", ROWS))
def _spread(spark, sf):
    rows = metric_rows(spark, sf)
    m = cg.flare_metrics(rows, ["day", "fid"], "purchase", "view", "click", "d", "x", 3, CADENCE, 3).select("day", "fid", "peak_sxr", "duration")
    return present(cg.spread_back(rows.select("day", "bin", "fid", "inside"), m, ["day", "fid"]).select("day", "bin", "fid", "duration", "peak_sxr"))


# Temperature tracks use whole days split into six-hour blocks as flare ids.
def tracks(spark, sf):
    return temps(spark, sf).withColumn("fid", F.floor(F.col("bin") / F.lit(36)).cast("bigint"))


TR = TEM + ", tr AS (SELECT *, bin // 36 AS fid FROM tem WHERE temp IS NOT NULL AND em IS NOT NULL), tk AS (SELECT *, row_number() OVER (PARTITION BY day, fid ORDER BY t) AS i, count(*) OVER (PARTITION BY day, fid) AS n FROM tr)"


@query("temperature_peaks", final("SELECT day, fid, t_temp, t_em, t_em - t_temp AS lead FROM (SELECT day, fid, min(t) FILTER (temp = mt) AS t_temp, min(t) FILTER (em = me) AS t_em FROM (SELECT *, max(temp) OVER (PARTITION BY day, fid) AS mt, max(em) OVER (PARTITION BY day, fid) AS me FROM tr) GROUP BY day, fid)",
                                  "day, CAST(fid AS BIGINT) AS fid, t_temp, t_em, lead", "", TR))
def _tpeaks(spark, sf):
    return present(cg.temperature_peaks(tracks(spark, sf), ["day", "fid"]))


@query("trajectory_code", final(
    """SELECT day, fid, points, zeta, CASE WHEN a >= 2 OR b >= 2 THEN 4 WHEN pk - 1 < points - 3 AND points > 5 THEN CASE WHEN zeta > 1.5 THEN 3 WHEN zeta < 0.5 THEN 2 WHEN zeta IS NOT NULL AND NOT isnan(zeta) THEN 1 ELSE 0 END ELSE 0 END AS code FROM (
  SELECT day, fid, max(n) AS points, sum(ht) AS a, sum(he) AS b, min(i) FILTER (temp = mt) AS pk, regr_slope(ln(em), ln(temp)) FILTER (n - i < 20) AS zeta FROM (
  SELECT *, max(temp) OVER (PARTITION BY day, fid) AS mt, CASE WHEN temp > lag(temp) OVER w AND temp > lead(temp) OVER w THEN 1 ELSE 0 END AS ht, CASE WHEN em > lag(em) OVER w AND em > lead(em) OVER w THEN 1 ELSE 0 END AS he FROM tk WHERE n >= 8 WINDOW w AS (PARTITION BY day, fid ORDER BY t)) GROUP BY day, fid)""",
    "day, CAST(fid AS BIGINT) AS fid, points, " + big("code"), "zeta", TR))
def _trajectory(spark, sf):
    return present(cg.trajectory(tracks(spark, sf), ["day", "fid"], least=8))


@query("loop_length", final(
    """SELECT day, fid, points, tau, z AS zeta, log10(tau * sqrt(tm) / (3.7e-4 * CASE WHEN z < 0.35 THEN 0.63 * z / 0.35 WHEN z < 0.7 THEN 0.63 + (z - 0.35) * 0.37 / 0.35 WHEN z < 1.6 THEN 1.0 + (z - 0.7) * 0.6 / 0.9 ELSE 1.6 END)) AS log_loop FROM (
  SELECT day, fid, count(*) AS points, CASE WHEN regr_slope(ln(temp), i) < 0 THEN -1.0 / regr_slope(ln(temp), i) ELSE 500.0 END AS tau, least(greatest(regr_slope(ln(em), ln(temp)), 0.1), 3.0) AS z, avg(temp * 1e6) AS tm FROM (
  SELECT *, min(CASE WHEN temp = mt THEN i END) OVER (PARTITION BY day, fid) AS pk FROM (SELECT *, max(temp) OVER (PARTITION BY day, fid) AS mt FROM tk WHERE n >= 8)) WHERE i >= pk AND pk - 1 < n - 3 GROUP BY day, fid HAVING count(*) >= 5)""",
    "day, CAST(fid AS BIGINT) AS fid, points", "tau zeta log_loop", TR, digits=5))
def _loop(spark, sf):
    l = cg.loop_length(tracks(spark, sf), ["day", "fid"], least=8)
    return present(l.select("day", "fid", "points", "tau", "zeta", F.log10("loop_cm").alias("log_loop")), 5)


# -- catalog statistics ----------------------------------------------------------------------------------------------
def catalog(spark, sf):
    return swpc(spark, sf).withColumn("month", F.date_format("day", "yyyy-MM"))


@query("catalog_cube", final(f"SELECT class, channel, month, count(*) AS n, max(peak_flux) AS max_peak, grouping_id(class, channel, month) AS level FROM (SELECT *, {grade_sql('peak_flux')} AS class, strftime(day, '%Y-%m') AS month FROM swpc) GROUP BY CUBE (class, channel, month)",
                             "class, channel, month, n, " + big("level"), "max_peak", swpc_sql()))
def _cube(spark, sf):
    return present(cg.catalog_cube(catalog(spark, sf), ["class", "channel", "month"]))


@query("daily_rates", final("SELECT channel, count(*) AS days, avg(n) AS mean, quantile_cont(n, 0.5) AS median, max(n) AS top FROM (SELECT channel, day, count(*) AS n FROM swpc GROUP BY channel, day) GROUP BY channel", "channel, days, top", "mean median", swpc_sql()))
def _daily(spark, sf):
    return present(cg.daily_rates(swpc(spark, sf), ["channel"]))


@query("monthly_orders", final(
    "SELECT o_orderstatus AS class, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, max(o_totalprice) AS max_peak, grouping_id(o_orderstatus, strftime(o_orderdate, '%Y-%m')) AS level FROM orders GROUP BY CUBE (o_orderstatus, strftime(o_orderdate, '%Y-%m'))",
    "class, month, n, " + big("level"), "max_peak"))
def _monthly(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("class"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_totalprice").alias("peak_flux"))
    return present(cg.catalog_cube(o, ["class", "month"]))


@query("coverage_timeline", final(
    """SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS day, CASE WHEN EXISTS (SELECT 1 FROM sd WHERE sd.day = CAST(d AS DATE)) THEN 1 ELSE 0 END AS soft, CASE WHEN EXISTS (SELECT 1 FROM hd WHERE hd.day = CAST(d AS DATE)) THEN 1 ELSE 0 END AS hard,
  CASE WHEN EXISTS (SELECT 1 FROM sd WHERE sd.day = CAST(d AS DATE)) AND EXISTS (SELECT 1 FROM hd WHERE hd.day = CAST(d AS DATE)) THEN 1 ELSE 0 END AS combined FROM (SELECT unnest(generate_series((SELECT CAST(least(min(s.day), (SELECT min(day) FROM hd)) AS TIMESTAMP) FROM sd s), (SELECT CAST(greatest(max(s.day), (SELECT max(day) FROM hd)) AS TIMESTAMP) FROM sd s), INTERVAL 1 DAY)) AS d)""",
    "day, " + big("soft", "hard", "combined"), "", "sd AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus = 'P'), hd AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)"))
def _timeline(spark, sf):
    soft = table(spark, sf, "orders").where(F.col("o_orderstatus") == "P").select(F.to_date("o_orderdate").alias("day")).distinct()
    hard = table(spark, sf, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).select(F.to_date("l_shipdate").alias("day")).distinct()
    return present(cg.coverage_timeline(soft, hard))


# Expected classes: the grade each day's click maximum would have, judged on the view maximum.
@query("calibration_check", final(
    f"SELECT e.day, e.expected_class, v.day_max, CASE WHEN v.day_max IS NULL THEN NULL ELSE {grade_sql('v.day_max')} END AS found_class, CASE WHEN v.day_max IS NOT NULL AND {grade_sql('v.day_max')} = e.expected_class THEN 1 ELSE 0 END AS match FROM (SELECT day, {grade_sql('max(value)')} AS expected_class FROM ev WHERE channel = 'click' GROUP BY day) e LEFT JOIN (SELECT day, max(value) AS day_max FROM ev WHERE channel = 'view' GROUP BY day) v ON v.day = e.day",
    "day, expected_class, found_class, " + big("match"), "day_max", EV))
def _calibration(spark, sf):
    ev = table(spark, sf, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("channel"), "value")
    top = lambda c: ev.where(F.col("channel") == c).groupBy("day").agg(F.max("value").alias("day_max"))
    expected = top("click").select("day", grade(F.col("day_max")).alias("expected_class"))
    return present(cg.expected_classes(top("view"), expected, lambda x: F.when(x.isNotNull(), grade(x))))


# -- quality reports --------------------------------------------------------------------------------------------------
@query("detector_compare", final(
    """SELECT day, CASE WHEN stddev_pop(CASE WHEN click > 0 AND purchase > 0 THEN click END) > 0 THEN corr(CASE WHEN click > 0 AND purchase > 0 THEN click END, CASE WHEN click > 0 AND purchase > 0 THEN purchase END) END AS corr, avg(click) / avg(purchase) AS mean_ratio, min(t) FILTER (click > 0) - min(t) FILTER (purchase > 0) AS start_offset, max(t) FILTER (click > 0) - max(t) FILTER (purchase > 0) AS end_offset,
  avg(CASE WHEN click > 0 THEN 1.0 ELSE 0 END) AS a_nonzero, avg(CASE WHEN purchase > 0 THEN 1.0 ELSE 0 END) AS b_nonzero, avg(CASE WHEN purchase > 0 THEN click / purchase END) AS row_ratio,
  CASE WHEN abs(min(t) FILTER (click > 0) - min(t) FILTER (purchase > 0)) > 1 OR abs(max(t) FILTER (click > 0) - max(t) FILTER (purchase > 0)) > 1 THEN 1 ELSE 0 END AS shifted FROM wide GROUP BY day""",
    "day, start_offset, end_offset, " + big("shifted"), "corr mean_ratio a_nonzero b_nonzero row_ratio", WIDE))
def _detectors(spark, sf):
    return present(cg.compare_detectors(wide(spark, sf), "click", "purchase"))


@query("hardness_summary", final(
    "SELECT band, count(*) AS n, avg(ratio) AS mean, quantile_cont(ratio, 0.5) AS median, stddev_pop(ratio) AS std FROM (" + " UNION ALL ".join(f"SELECT '{b}' AS band, {b} / view AS ratio FROM wide WHERE view > 0" for b in CHANNELS[1:]) + ") WHERE ratio > 0 AND ratio < 100 GROUP BY band",
    "band, n", "mean median std", WIDE))
def _hardness(spark, sf):
    return present(cg.band_summary(wide(spark, sf), CHANNELS[1:], "view"))


@query("rate_percentiles", final(
    f"SELECT channel, count(v) AS n, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.9) AS p90, quantile_cont(v, 0.99) AS p99, quantile_cont(v, 0.999) AS p999, 100.0 * avg(CASE WHEN v IS NOT NULL THEN CASE WHEN v * {TAU} > 0.05 THEN 1.0 ELSE 0 END END) AS corrected_pct FROM lc GROUP BY channel", "channel, n", "p50 p90 p99 p999 corrected_pct", LC))
def _percentiles(spark, sf):
    from ..operators.ranking import exact_quantiles

    g = lc(spark, sf)
    q = exact_quantiles(g, ["channel"], "v", [0.5, 0.9, 0.99, 0.999])
    pick = lambda p: F.max(F.when(F.col("q") == p, F.col("quantile")))
    q = q.groupBy("channel").agg(pick(0.5).alias("p50"), pick(0.9).alias("p90"), pick(0.99).alias("p99"), pick(0.999).alias("p999"))
    share = g.groupBy("channel").agg(F.count("v").alias("n"), (100.0 * F.avg((F.col("v") * TAU > 0.05).cast("double"))).alias("corrected_pct"))
    return present(share.join(q, "channel"))


_SUPP = "s_suppkey s_acctbal s_nationkey"


@query("housekeeping_report", final("SELECT name, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS lo, max(value) AS hi FROM (UNPIVOT (SELECT CAST(s_suppkey AS DOUBLE) AS s_suppkey, CAST(s_acctbal AS DOUBLE) AS s_acctbal, CAST(s_nationkey AS DOUBLE) AS s_nationkey FROM supplier) ON s_suppkey, s_acctbal, s_nationkey INTO NAME name VALUE value) GROUP BY name", "name, n", "mean std lo hi"))
def _hk(spark, sf):
    return present(cg.numeric_summary(table(spark, sf, "supplier"), _SUPP.split()))


@query("feature_coverage", final(
    "SELECT name, count(*) AS rows, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0 END) AS missing, avg(CASE WHEN coalesce(value, 0) <> 0 THEN 1.0 ELSE 0 END) AS nonzero, CASE WHEN max(abs(coalesce(value, 0))) = 0 THEN 1 ELSE 0 END AS all_zero FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS name, {c} AS value FROM wide" for c in CHANNELS) + ") GROUP BY name",
    "name, rows, " + big("all_zero"), "missing nonzero", WIDE))
def _coverage(spark, sf):
    return present(cg.missing_report(wide(spark, sf), CHANNELS))


@query("zero_share", final("SELECT day, avg(CASE WHEN coalesce(view, 0) = 0 THEN 1.0 ELSE 0 END) AS zero_share, CASE WHEN avg(CASE WHEN coalesce(view, 0) = 0 THEN 1.0 ELSE 0 END) > 0.1 THEN 1 ELSE 0 END AS degraded FROM wide GROUP BY day", "day, " + big("degraded"), "zero_share", WIDE))
def _zero(spark, sf):
    return present(cg.zero_share(wide(spark, sf).withColumn("z", F.coalesce("view", F.lit(0.0))), "z"))


@query("around_peak", final(
    "SELECT w.day, max(pk) AS peak, avg(CASE WHEN view IS NULL THEN 1.0 ELSE 0 END) AS missing, count(*) AS rows FROM wide w JOIN (SELECT day, max(view) AS pk, arg_max(bin, view * 1e6 - bin) AS pb FROM wide WHERE view IS NOT NULL GROUP BY day) p ON p.day = w.day AND abs(bin - pb) <= 12 GROUP BY w.day", "day, rows", "peak missing", WIDE))
def _around(spark, sf):
    return present(cg.around_peak(wide(spark, sf), "view", 12))


@query("anomaly_periods", final(
    "SELECT channel, CASE WHEN day < DATE '2024-01-10' THEN 'before' WHEN day > DATE '2024-01-20' THEN 'after' ELSE 'during' END AS period, max(v) AS peak, quantile_cont(v, 0.5) AS median, stddev_pop(v) AS std, (max(v) - quantile_cont(v, 0.5)) / stddev_pop(v) AS snr FROM lc GROUP BY ALL",
    "channel, period", "peak median std snr", LC))
def _anomaly(spark, sf):
    d = lc(spark, sf).withColumn("period", cg.periods(F.col("day"), "2024-01-10", "2024-01-20"))
    return present(cg.signal_to_noise(d, "v", ["channel", "period"]))


@query("days_without_anomalies", final(
    "SELECT day, count(*) AS n FROM (SELECT CAST(ts AS DATE) AS day FROM events) WHERE day NOT IN (SELECT CAST(ts AS DATE) FROM events WHERE value > 350) GROUP BY day", "day, n"))
def _clean_days(spark, sf):
    ev = table(spark, sf, "events").select(F.to_date("ts").alias("day"), "value")
    return present(without_days(ev, ev.where(F.col("value") > 350)).groupBy("day").agg(F.count(F.lit(1)).alias("n")))


@query("common_days", final("SELECT day FROM (SELECT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_returnflag = 'R')", "day"))
def _common(spark, sf):
    from ..sources.tables import common_days

    a = table(spark, sf, "orders").where(F.col("o_orderstatus") == "P").select(F.to_date("o_orderdate").alias("day"))
    b = table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(F.to_date("l_shipdate").alias("day"))
    return present(common_days(a, b))


@query("json_report", final(
    "SELECT CAST(day AS VARCHAR) AS day, '{\"series\":{\"rows\":' || n || ',\"filled\":' || f || '},\"gti\":{\"intervals\":' || k || ',\"total\":' || CAST(tot AS BIGINT) || '}}' AS report FROM (SELECT day, count(*) AS n, count(view) AS f FROM wide GROUP BY day) JOIN (SELECT day, count(*) AS k, sum(stop - start) AS tot FROM mg GROUP BY day) USING (day)",
    "day, report", "", WIDE + ", " + GTI + _MERGED))
def _report(spark, sf):
    series = wide(spark, sf).groupBy("day").agg(F.count(F.lit(1)).alias("rows"), F.count("view").alias("filled"))
    times = merged_times(spark, sf).groupBy("day").agg(F.count(F.lit(1)).alias("intervals"), F.sum(F.col("stop") - F.col("start")).alias("total"))
    return present(report_json(series.join(times, "day"), ["day"], {"series": ["rows", "filled"], "gti": ["intervals", "total"]}))
