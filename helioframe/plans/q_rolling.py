"""Queries: backgrounds, gap filling, moving statistics, precursors, targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions.output import present
from ..operators import islands as isl
from ..operators import rolling as ro
from .fixtures import BINS, CADENCE, LC, WIDE, big, final, frame, lc, mad, tail, wide
from .q_match import FLAGS, _grad_sql, flagged
from .registry import query

D = ("day",)
Z = f"{LC}, z AS (SELECT channel, day, bin, t, v, coalesce(v, 0.0) AS v0 FROM lc)"


def zeroed(spark, sf):
    return lc(spark, sf).withColumn("v0", F.coalesce("v", F.lit(0.0)))


@query("rolling_median_bg", final(f"SELECT channel, day, bin, quantile_cont(v0, 0.5) {frame(36)} AS bg, v0 - quantile_cont(v0, 0.5) {frame(36)} AS residual FROM z",
                                  "channel, day, bin", "bg residual", Z))
def _median(spark, sf):
    return present(ro.median_residual(zeroed(spark, sf), "v0", 36).select("channel", "day", "bin", "bg", "residual"))


@query("rolling_p10_bg", final(f"SELECT channel, day, bin, quantile_cont(v, 0.1) {frame(24)} AS bg, CASE WHEN count(v) {frame(18)} >= 5 THEN quantile_cont(v, 0.1) {frame(18)} END AS band_bg FROM lc",
                               "channel, day, bin", "bg band_bg", LC))
def _p10(spark, sf):
    d = ro.rolling_quantile(lc(spark, sf), "v", 0.1, 24, "bg")
    d = ro.rolling_quantile(d, "v", 0.1, 18, "band_bg", min_count=5)
    return present(d.select("channel", "day", "bin", "bg", "band_bg"))


@query("rolling_median_day", final(f"SELECT channel, day, bin, quantile_cont(v0, 0.5) OVER (PARTITION BY channel, day ORDER BY bin ROWS BETWEEN 70 PRECEDING AND 69 FOLLOWING) AS bg FROM z",
                                   "channel, day, bin", "bg", Z))
def _median_day(spark, sf):
    """The Arrow-group form that long frames use."""
    return present(ro.rolling_quantile(zeroed(spark, sf), "v0", 0.5, 140, "bg").select("channel", "day", "bin", "bg"))


@query("adaptive_threshold", final("SELECT channel, day, bin, residual, 3.0 * sd AS threshold FROM s", "channel, day, bin", "residual threshold",
                                   f"{Z}, r AS (SELECT *, v0 - quantile_cont(v0, 0.5) {frame(24)} AS residual FROM z), {mad('residual', 'r', 's')}"))
def _threshold(spark, sf):
    d = ro.mad_sigma(ro.median_residual(zeroed(spark, sf), "v0", 24), "residual", "sd")
    return present(d.select("channel", "day", "bin", "residual", (3.0 * F.col("sd")).alias("threshold")))


def _iter_sql():
    ctes, src, used = [Z], "z", "v0"
    for k in range(3):
        ctes.append(f"a{k} AS (SELECT *, quantile_cont({used}, 0.1) {frame(24)} AS bg{k} FROM {src})")
        ctes.append(f"b{k} AS (SELECT *, v0 - bg{k} AS res{k} FROM a{k})")
        ctes.append(f"c{k} AS (SELECT *, quantile_cont(res{k}, 0.5) OVER (PARTITION BY channel, day) AS me{k} FROM b{k})")
        ctes.append(f"d{k} AS (SELECT *, 1.4826 * quantile_cont(abs(res{k} - me{k}), 0.5) OVER (PARTITION BY channel, day) AS sd{k} FROM c{k})")
        ctes.append(f"e{k} AS (SELECT *, CASE WHEN res{k} < 3.0 * sd{k} THEN v0 END AS u{k} FROM d{k})")
        src, used = f"e{k}", f"u{k}"
    return ", ".join(ctes)


@query("iterative_bg", final("SELECT channel, day, bin, bg2 AS bg, res2 AS residual FROM e2", "channel, day, bin", "bg residual", _iter_sql()))
def _iterative(spark, sf):
    return present(ro.iterative_background(zeroed(spark, sf), "v0", 24).select("channel", "day", "bin", "bg", "residual"))


@query("multiscale_bg", final(
    """SELECT day, bin, bg, stddev_pop(CASE WHEN g - bg <= md THEN g - bg END) OVER (PARTITION BY day) AS sigma FROM (SELECT *, quantile_cont(g - bg, 0.5) OVER (PARTITION BY day) AS md FROM m5)""",
    "day, bin", "bg sigma", FLAGS + f""",
m1 AS (SELECT day, bin, CASE WHEN flag = 0 THEN view END AS g FROM fl),
m2 AS (SELECT *, CASE WHEN count(g) {frame(72, 'day')} >= 5 THEN quantile_cont(g, 0.5) {frame(72, 'day')} END AS slow FROM m1),
m3 AS (SELECT *, CASE WHEN count(g - slow) {frame(24, 'day')} >= 5 THEN quantile_cont(g - slow, 0.1) {frame(24, 'day')} END AS fast FROM m2),
m4 AS (SELECT *, CASE WHEN g IS NOT NULL THEN slow + fast END AS raw FROM m3),
m5 AS (SELECT a.day, a.bin, a.g, (SELECT b.raw FROM m4 b WHERE b.day = a.day AND b.raw IS NOT NULL ORDER BY abs(b.bin - a.bin), b.bin LIMIT 1) AS bg FROM m4 a)"""))
def _multiscale(spark, sf):
    return present(ro.multiscale_background(flagged(spark, sf), "view", "good", 72, 24, D).select("day", "bin", "bg", "sigma"))


_PREV = "last_value(v IGNORE NULLS) OVER (PARTITION BY channel, day ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("forward_fill", final(f"SELECT channel, day, bin, coalesce({_PREV}, quantile_cont(v, 0.5) OVER (PARTITION BY channel, day), 0) AS filled, coalesce(v, quantile_cont(v, 0.5) OVER (PARTITION BY channel, day)) AS median_filled FROM lc",
                             "channel, day, bin", "filled median_filled", LC))
def _ffill(spark, sf):
    d = ro.median_fill(ro.forward_fill(lc(spark, sf)), out="median_filled")
    return present(d.select("channel", "day", "bin", "filled", "median_filled"))


_INTERP = f"""{LC}, n AS (SELECT *, {_PREV} AS pv, last_value(CASE WHEN v IS NOT NULL THEN bin END IGNORE NULLS) OVER (PARTITION BY channel, day ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pb,
  first_value(v IGNORE NULLS) OVER (PARTITION BY channel, day ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
  first_value(CASE WHEN v IS NOT NULL THEN bin END IGNORE NULLS) OVER (PARTITION BY channel, day ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nb FROM lc)"""


@query("linear_interp", final(
    "SELECT channel, day, bin, CASE WHEN v IS NOT NULL THEN v ELSE pv + (nv - pv) * (bin - pb) / (nb - pb) END AS filled, coalesce(CASE WHEN v IS NOT NULL THEN v ELSE pv + (nv - pv) * (bin - pb) / (nb - pb) END, 0) AS filled_zero FROM n",
    "channel, day, bin", "filled filled_zero", _INTERP))
def _interp(spark, sf):
    d = ro.linear_fill(ro.linear_fill(lc(spark, sf), out="filled"), out="filled_zero", outside=0.0)
    return present(d.select("channel", "day", "bin", "filled", "filled_zero"))


@query("gradient", final(
    f"SELECT channel, day, bin, g, {_grad_sql('g', 'channel, day')} AS g2, d FROM (SELECT channel, day, bin, {_grad_sql('v0', 'channel, day')} AS g, v0 - lag(v0) OVER (PARTITION BY channel, day ORDER BY bin) AS d FROM z)",
    "channel, day, bin", "g g2 d", Z))
def _gradient(spark, sf):
    d = zeroed(spark, sf).withColumn("g", ro.gradient("v0")).withColumn("d", ro.step("v0"))
    return present(d.select("channel", "day", "bin", "g", ro.gradient("g").alias("g2"), "d"))


def _padded(x, size, part="day"):
    f = frame(size, part)
    return f"CASE WHEN (count(*) {f} - count({x}) {f}) / {size}.0 <= 0.99 THEN coalesce(sum({x}) {f}, 0.0) / {size} END"


@query("rolling_stats", final(
    f"""SELECT channel, day, bin, CASE WHEN count(*) {tail(12)} = 12 THEN avg(v) {tail(12)} END AS t_mean, CASE WHEN count(*) {tail(12)} = 12 THEN stddev_pop(v) {tail(12)} END AS t_std,
  {_padded('v', 18, 'channel, day')} AS c_mean, max(v) {frame(18)} AS c_max FROM lc""", "channel, day, bin", "t_mean t_std c_mean c_max", LC))
def _stats(spark, sf):
    d = lc(spark, sf)
    return present(d.select("channel", "day", "bin", ro.trailing_mean("v", 12).alias("t_mean"), ro.trailing_std("v", 12).alias("t_std"),
                            ro.padded_mean("v", 18).alias("c_mean"), ro.padded_max("v", 18).alias("c_max")))


WZ = WIDE + ", wz AS (SELECT day, bin, t, coalesce(view, 0) AS s, coalesce(click, 0) AS h FROM wide), wg AS (SELECT *, %s AS ds FROM wz)" % _grad_sql("s")


def soft_hard(spark, sf):
    w = wide(spark, sf).select("day", "bin", "t", F.coalesce("view", F.lit(0.0)).alias("s"), F.coalesce("click", F.lit(0.0)).alias("h"))
    return w.withColumn("ds", ro.gradient("s", D))


@query("rolling_slope_corr", final(
    f"""SELECT day, bin, regr_slope(s, CAST(bin AS DOUBLE)) {frame(13, 'day')} AS slope, CASE WHEN stddev_pop(ds) {frame(25, 'day')} > 0 AND stddev_pop(h) {frame(25, 'day')} > 0 THEN corr(ds, h) {frame(25, 'day')} END AS rho,
  CASE WHEN quantile_cont(s, 0.5) {frame(13, 'day')} > 0 THEN s / sqrt(quantile_cont(s, 0.5) {frame(13, 'day')}) END AS snr FROM wg""", "day, bin", "slope rho snr", WZ))
def _slope_corr(spark, sf):
    d = ro.rolling_quantile(soft_hard(spark, sf), "s", 0.5, 13, "med", D)
    return present(d.select("day", "bin", ro.rolling_slope("s", 13, D).alias("slope"), ro.rolling_corr("ds", "h", 25, D).alias("rho"),
                            F.when(F.col("med") > 0, F.col("s") / F.sqrt("med")).alias("snr")))


@query("rolling_spearman", final(
    """SELECT day, bin, rho FROM wg LEFT JOIN (SELECT day, e AS bin, CASE WHEN count(DISTINCT ds) >= 3 AND count(DISTINCT h) >= 3 THEN corr(rx, ry) END AS rho FROM (
  SELECT a.day, e.bin AS e, a.ds, a.h, rank() OVER (PARTITION BY a.day, e.bin ORDER BY a.ds) + (count(*) OVER (PARTITION BY a.day, e.bin, a.ds) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY a.day, e.bin ORDER BY a.h) + (count(*) OVER (PARTITION BY a.day, e.bin, a.h) - 1) / 2.0 AS ry
  FROM wg e JOIN wg a ON a.day = e.day AND a.bin >= e.bin - 18 AND a.bin < e.bin WHERE e.bin >= 18) GROUP BY day, e) USING (day, bin)""", "day, bin", "rho", WZ))
def _spearman(spark, sf):
    return present(ro.rolling_spearman(soft_hard(spark, sf), "ds", "h", 18, keys=D).select("day", "bin", "rho"))


@query("neupert_windows", final(
    """SELECT day, win * 6 + 18 AS bin, rho FROM (SELECT w.day, k.win, corr(w.ds, w.h) AS rho, count(*) AS n FROM wg w JOIN (SELECT CAST(range AS BIGINT) AS win FROM range(24)) k ON w.bin >= k.win * 6 AND w.bin < k.win * 6 + 36 GROUP BY ALL) WHERE n = 36""",
    "day, bin", "rho", WZ))
def _neupert(spark, sf):
    return present(ro.hopping_corr(soft_hard(spark, sf), "ds", "h", 36, 6, D))


@query("neupert_integral", final(
    f"""SELECT day, corr(ss, si) AS rho FROM (SELECT day, avg(s) {frame(6, 'day')} AS ss, avg(ii) {frame(6, 'day')} AS si FROM (
  SELECT *, sum(h - mh) OVER (PARTITION BY day ORDER BY bin) AS ii FROM (SELECT *, avg(h) OVER (PARTITION BY day) AS mh FROM wz))) GROUP BY day""", "day", "rho", WZ))
def _integral(spark, sf):
    return present(ro.cumulative_corr(wide(spark, sf), "view", "click", 6, D))


@query("neupert_residual", final(
    """SELECT day, bin, ms - mh AS residual, (ms - avg(ms) OVER (PARTITION BY day)) / greatest(stddev_pop(ms) OVER (PARTITION BY day), 1e-10) - (mh - avg(mh) OVER (PARTITION BY day)) / greatest(stddev_pop(mh) OVER (PARTITION BY day), 1e-10) AS deviation FROM nr""",
    "day, bin", "residual deviation", WZ + f", nj AS (SELECT wg.*, click FROM wg JOIN wide USING (day, bin)), nr AS (SELECT day, bin, {_padded('ds', 6)} AS ms, {_padded('click', 6)} AS mh FROM nj)"))
def _residual(spark, sf):
    return present(ro.coupling_residuals(wide(spark, sf), "view", "click", 6, D).select("day", "bin", "residual", "deviation"))


@query("shs_correlation", final(
    """SELECT day, bin, CASE WHEN count(lf) OVER w > 5 AND stddev_pop(ix) OVER w > 0 THEN corr(ix, lf) OVER w END AS shs FROM (SELECT day, bin, CASE WHEN view > 0 AND click IS NOT NULL THEN ln(view) END AS lf, CASE WHEN view > 0 THEN click END AS ix FROM wide)
  WINDOW w AS (PARTITION BY day ORDER BY bin ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)""", "day, bin", "shs", WIDE))
def _shs(spark, sf):
    return present(wide(spark, sf).select("day", "bin", ro.soft_hard_soft("click", "view", 6, D).alias("shs")))


def temps(spark, sf):
    w = wide(spark, sf).withColumn("fa", F.col("click") * 1e-8).withColumn("fb", F.col("view") * 1e-7)
    return w.select("day", "bin", "t", sc.ratio_temperature("fa", "fb").alias("temp"), sc.ratio_emission_measure("fa", "fb").alias("em"))


TEM = WIDE + """, t0 AS (SELECT day, bin, t, click * 1e-8 AS fa, view * 1e-7 AS fb FROM wide),
t1 AS (SELECT *, log10(least(greatest(greatest(fb, 5e-8) / greatest(fa, 2e-8), 1.05), 35.0)) AS w FROM t0),
t2 AS (SELECT *, CASE WHEN fa IS NULL OR fb IS NULL OR fa < 5e-8 OR fb < 1e-7 THEN NULL ELSE least(greatest(pow(10.0, 0.051 + 0.979 * w + 0.184 * w * w - 0.010 * w * w * w), 3.0), 50.0) END AS temp FROM t1),
tem AS (SELECT day, bin, t, temp, CASE WHEN temp IS NOT NULL THEN least(greatest(greatest(fb, 5e-8) * 1e5 * sqrt(temp) * exp(17.0 / temp), 0.001), 1e4) END AS em FROM t2)"""


@query("hope_score", final(
    f"""SELECT day, bin, hope, CASE WHEN hope > quantile_cont(hope, 0.9) OVER (PARTITION BY day) THEN 1 WHEN hope IS NOT NULL THEN 0 END AS hope_flag, avg(hope) {frame(13, 'day')} AS fai FROM h5""",
    "day, bin, " + big("hope_flag"), "hope fai", TEM + f""",
h1 AS (SELECT *, coalesce(temp, quantile_cont(temp, 0.5) OVER (PARTITION BY day), 3.0) AS t00, coalesce(em, 0) AS e0 FROM tem),
h2 AS (SELECT *, avg(t00) {frame(12, 'day')} AS ts, avg(e0) {frame(12, 'day')} AS es FROM h1),
h3 AS (SELECT *, {_grad_sql('ts')} AS dt, abs({_grad_sql('es')}) AS de FROM h2),
h4 AS (SELECT *, greatest(dt, 0) * exp(-de / (quantile_cont(de, 0.75) OVER (PARTITION BY day) + 1e-10)) AS raw FROM h3),
h5 AS (SELECT *, CASE WHEN temp IS NOT NULL AND em IS NOT NULL THEN least(raw / (quantile_cont(raw, 0.95) OVER (PARTITION BY day) + 1e-10), 1.0) END AS hope FROM h4)"""))
def _hope(spark, sf):
    return present(ro.hope_score(temps(spark, sf), "temp", "em", 12, D).select("day", "bin", "hope", "hope_flag", "fai"))


@query("robust_norm", final(
    """SELECT day, bin, (a + b + c) / 3 AS consistency, a AS norm FROM (SELECT day, bin, """
    + ", ".join(f"least(greatest((coalesce({c}, 0) - quantile_cont(coalesce({c}, 0), 0.05) OVER (PARTITION BY day)) / (quantile_cont(coalesce({c}, 0), 0.95) OVER (PARTITION BY day) - quantile_cont(coalesce({c}, 0), 0.05) OVER (PARTITION BY day)), 0), 1) AS {n}" for c, n in [("view", "a"), ("click", "b"), ("error", "c")])
    + " FROM wide)", "day, bin", "consistency norm", WIDE))
def _robust(spark, sf):
    w = wide(spark, sf)
    parts = [ro.robust_scale(F.coalesce(F.col(c), F.lit(0.0)), D) for c in ("view", "click", "error")]
    return present(w.select("day", "bin", ((parts[0] + parts[1] + parts[2]) / 3).alias("consistency"), parts[0].alias("norm")))


EVF = 80.0
RECENT = f"""{LC}, x AS (SELECT channel, day, bin, t, coalesce(v, 0) > {EVF} AS ev FROM lc),
y AS (SELECT *, ev AND NOT coalesce(lag(ev) OVER (PARTITION BY channel, day ORDER BY bin), false) AS st FROM x)"""


@query("event_recency", final(
    """SELECT channel, day, bin, t - max(CASE WHEN ev THEN t END) OVER (PARTITION BY channel, day ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since,
  min(CASE WHEN ev THEN t END) OVER (PARTITION BY channel, day ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - t AS until,
  sum(CASE WHEN ev THEN 1 ELSE 0 END) OVER (PARTITION BY channel, day ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_events,
  sum(CASE WHEN st THEN 1 ELSE 0 END) OVER (PARTITION BY channel, day ORDER BY t RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS last_1h,
  sum(CASE WHEN st THEN 1 ELSE 0 END) OVER (PARTITION BY channel, day ORDER BY t RANGE BETWEEN 10800 PRECEDING AND CURRENT ROW) AS last_3h,
  sum(CASE WHEN st THEN 1 ELSE 0 END) OVER (PARTITION BY channel, day ORDER BY t RANGE BETWEEN 10800 PRECEDING AND 10799 FOLLOWING) AS around_6h FROM y""",
    "channel, day, bin, since, until, " + big("n_events", "last_1h", "last_3h", "around_6h"), "", RECENT))
def _recency(spark, sf):
    d = lc(spark, sf).withColumn("ev", F.coalesce(F.col("v"), F.lit(0.0)) > EVF)
    d = d.withColumn("st", ro.starts("ev"))
    return present(d.select("channel", "day", "bin", ro.since_event("ev").alias("since"), ro.until_event("ev").alias("until"),
                            ro.running_count("ev").alias("n_events"), ro.count_between("st", -3600, 0).alias("last_1h"),
                            ro.count_between("st", -10800, 0).alias("last_3h"), ro.count_between("st", -10800, 10799).alias("around_6h")))


@query("precursor_flag", final(
    f"""SELECT channel, day, bin, CASE WHEN el AND NOT ev AND coalesce(max(CASE WHEN st THEN 1 ELSE 0 END) OVER (PARTITION BY channel, day ORDER BY t RANGE BETWEEN 1 FOLLOWING AND 3600 FOLLOWING), 0) = 1 THEN 1 ELSE 0 END AS precursor,
  CASE WHEN d2 > 0 AND d1 > 0 THEN 1 ELSE 0 END AS accelerating FROM (SELECT *, {_grad_sql('d1', 'channel, day')} AS d2 FROM (SELECT y.*, coalesce(v, 0) > 60 AS el, {_grad_sql('coalesce(v, 0)', 'channel, day')} AS d1 FROM y JOIN lc USING (channel, day, bin, t)))""",
    "channel, day, bin, " + big("precursor", "accelerating"), "", RECENT))
def _precursor(spark, sf):
    d = lc(spark, sf).withColumn("v", F.coalesce(F.col("v"), F.lit(0.0)))
    d = d.withColumn("ev", F.col("v") > EVF).withColumn("st", ro.starts("ev")).withColumn("d1", ro.gradient("v"))
    d = d.withColumn("d2", ro.gradient("d1"))
    return present(d.select("channel", "day", "bin", ro.precursor(F.col("v") > 60, "ev", "st", 3600).alias("precursor"),
                            ((F.col("d2") > 0) & (F.col("d1") > 0)).cast("bigint").alias("accelerating")))


@query("triggers", final(
    f"""SELECT day, bin, tr AS trigger_ratio, CASE WHEN coalesce(tr, 0) > 2 OR coalesce(click > bg + 5 * CASE WHEN sd > 0 THEN sd ELSE 1 END, false) THEN 1 ELSE 0 END AS trigger FROM (
  SELECT *, CASE WHEN m > 0.1 THEN least(greatest(coalesce(click, 0) / m, 0), 10) END AS tr FROM (SELECT *, sum(coalesce(click, 0)) {frame(5, 'day')} / 5 AS m,
  quantile_cont(CASE WHEN bin < 60 THEN click END, 0.5) OVER (PARTITION BY day) AS bg, stddev_pop(CASE WHEN bin < 60 THEN click END) OVER (PARTITION BY day) AS sd FROM wide))""",
    "day, bin, " + big("trigger"), "trigger_ratio", WIDE))
def _triggers(spark, sf):
    return present(ro.burst_trigger(wide(spark, sf), "click", 5, 60, keys=D).select("day", "bin", "trigger_ratio", "trigger"))


@query("forecast_targets", final(
    """SELECT channel, day, bin, CASE WHEN ev THEN 1 ELSE 0 END AS in_event, CASE WHEN ev THEN 0 ELSE coalesce(max(CASE WHEN st THEN 1 ELSE 0 END) OVER (PARTITION BY channel, day ORDER BY t RANGE BETWEEN 1 FOLLOWING AND 1800 FOLLOWING), 0) END AS next_30m,
  CASE WHEN ev THEN 0 ELSE coalesce(max(CASE WHEN st THEN 1 ELSE 0 END) OVER (PARTITION BY channel, day ORDER BY t RANGE BETWEEN 1 FOLLOWING AND 3600 FOLLOWING), 0) END AS next_60m,
  CASE WHEN coalesce(t - max(CASE WHEN ev THEN t END) OVER (PARTITION BY channel, day ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 99999999) > 1800
   AND coalesce(min(CASE WHEN ev THEN t END) OVER (PARTITION BY channel, day ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - t, 99999999) > 1800 THEN 1 ELSE 0 END AS quiet FROM y""",
    "channel, day, bin, " + big("in_event", "next_30m", "next_60m", "quiet"), "", RECENT))
def _targets(spark, sf):
    d = lc(spark, sf).withColumn("ev", F.coalesce(F.col("v"), F.lit(0.0)) > EVF)
    d = ro.forecast_targets(d, "ev", {"next_30m": 1800, "next_60m": 3600}, 1800)
    return present(d.select("channel", "day", "bin", "in_event", "next_30m", "next_60m", "quiet"))
