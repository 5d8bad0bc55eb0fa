"""Queries: interval joins, labels, matching, quality flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions.output import present
from ..operators import intervals as iv
from ..operators import islands as isl
from ..operators import matching as ma
from ..operators import quality as qu
from ..operators import rolling as ro
from ..session import cut_lineage
from ..session import sized
from ..sources.tables import table
from .fixtures import BINS, CADENCE, LC, WIDE, big, final, frame, lc, mad, wide
from .q_detect import _burst_sql, described_sql, grade_sql, swpc, swpc_sql
from .registry import query

GTI_LEN = 900
TRUTH = 150.0


def samples(spark, sf, *kinds):
    ev = table(spark, sf, "events").where(F.col("event_type").isin(*kinds))
    t = sc.epoch_seconds("ts")
    return ev.select("event_id", F.col("event_type").alias("channel"), F.to_date("ts").alias("day"), t.alias("t"), "value")


def good_times(spark, sf):
    s = samples(spark, sf, "signup")
    return s.select("day", F.col("t").alias("start"), (F.col("t") + GTI_LEN).alias("stop"))


EV = "ev AS (SELECT event_id, event_type AS channel, CAST(ts AS DATE) AS day, CAST(floor(epoch(ts)) AS BIGINT) AS t, value FROM events)"
GTI = EV + f", gti AS (SELECT day, t AS start, t + {GTI_LEN} AS stop FROM ev WHERE channel = 'signup')"


@query("gti_filter", final(
    """SELECT day, channel, count(*) AS n, count(*) FILTER (inside) AS n_inside, avg(value) FILTER (inside) AS mean_inside FROM (
  SELECT ev.*, EXISTS (SELECT 1 FROM gti WHERE ev.t BETWEEN gti.start AND gti.stop AND gti.start >= ev.t - 900) AS inside FROM ev WHERE channel <> 'signup') GROUP BY ALL""",
    "day, channel, n, n_inside", "mean_inside", GTI))
def _gti(spark, sf):
    pts = samples(spark, sf, "view", "click", "purchase", "error")
    hit = iv.covered(pts, good_times(spark, sf).drop("day"), width=3600)
    return present(hit.groupBy("day", "channel").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("inside"), 1)).alias("n_inside"),
        F.avg(F.when(F.col("inside"), F.col("value"))).alias("mean_inside")))


@query("gti_mask", final(
    """SELECT channel, day, bin, CASE WHEN inside THEN v END AS soft, CASE WHEN inside THEN coalesce(v, 0) ELSE 0 END AS hard FROM (
  SELECT lc.*, EXISTS (SELECT 1 FROM gti WHERE lc.t BETWEEN gti.start AND gti.stop) AS inside FROM lc)""",
    "channel, day, bin", "soft hard", LC + ", " + GTI))
def _gti_mask(spark, sf):
    hit = iv.covered(lc(spark, sf), good_times(spark, sf).drop("day"), width=3600)
    return present(hit.select("channel", "day", "bin", F.when(F.col("inside"), F.col("v")).alias("soft"),
                              F.when(F.col("inside"), F.coalesce("v", F.lit(0.0))).otherwise(0.0).alias("hard")))


_MERGED = """, u AS (SELECT DISTINCT day, start, stop FROM gti),
r AS (SELECT *, max(stop) OVER (PARTITION BY day ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM u),
m AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY start, stop) AS grp FROM r),
mg AS (SELECT day, min(start) AS start, max(stop) AS stop FROM m GROUP BY day, grp)"""


def merged_times(spark, sf):
    return iv.merge_intervals(good_times(spark, sf).distinct(), ["day"]).select("day", "start", "stop")


@query("gti_coverage", final(
    "SELECT day, count(*) AS intervals, sum(stop - start) AS total, max(stop - start) AS longest, avg(stop - start) AS mean_len, least(greatest(100 * (1 - sum(stop - start) / 86400.0), 0), 100) AS dead_pct FROM mg GROUP BY day",
    "day, intervals, CAST(total AS BIGINT) AS total, longest", "mean_len dead_pct", GTI + _MERGED))
def _coverage(spark, sf):
    span = F.col("stop") - F.col("start")
    return present(merged_times(spark, sf).groupBy("day").agg(
        F.count(F.lit(1)).alias("intervals"), F.sum(span).alias("total"), F.max(span).alias("longest"), F.avg(span).alias("mean_len"),
        sc.clip(100 * (1 - F.sum(span) / 86400.0), 0.0, 100.0).alias("dead_pct")))


@query("gti_gaps", final(
    """SELECT gap_hour, count(*) AS gaps, avg(gap) AS mean_gap, max(gap) AS longest, count(*) FILTER (gap_hour IN (23, 0)) AS near_0, count(*) FILTER (gap_hour IN (11, 12)) AS near_12 FROM (
  SELECT (stop % 86400) // 3600 AS gap_hour, lead(start) OVER (PARTITION BY day ORDER BY start, stop) - stop AS gap FROM mg) WHERE gap IS NOT NULL GROUP BY 1""",
    "CAST(gap_hour AS BIGINT) AS gap_hour, gaps, longest, near_0, near_12", "mean_gap", GTI + _MERGED))
def _gaps(spark, sf):
    g = iv.gaps(merged_times(spark, sf), ["day"])
    near = lambda *h: F.count(F.when(F.col("gap_hour").isin(*h), 1))
    return present(g.groupBy("gap_hour").agg(
        F.count(F.lit(1)).alias("gaps"), F.avg("gap").alias("mean_gap"), F.max("gap").alias("longest"),
        near(23, 0).alias("near_0"), near(11, 12).alias("near_12")))


def truth(spark, sf):
    return samples(spark, sf, "error").where(F.col("value") >= TRUTH)


for _name, _bounds, _cond in [("label_upcoming", "(0,H]", "te.t > lc.t AND te.t <= lc.t + 3600"), ("label_sequence", "[0,H)", "te.t >= lc.t AND te.t < lc.t + 3600")]:
    def _label(spark, sf, bounds=_bounds):
        rows = lc(spark, sf).where(F.col("channel") == "view").select("day", "bin", "t")
        ev = truth(spark, sf).select(F.col("t").alias("te"))
        return present(iv.flag_upcoming(rows, ev, horizon=3600, bounds=bounds))

    query(_name, final(
        f"SELECT day, bin, t, CASE WHEN EXISTS (SELECT 1 FROM ev te WHERE te.channel = 'error' AND te.value >= {TRUTH} AND {_cond}) THEN 1 ELSE 0 END AS label FROM lc WHERE channel = 'view'",
        "day, bin, t, " + big("label"), "", LC + ", " + EV))(_label)


@query("in_flare_label", final(
    f"""SELECT channel, day, bin, CASE WHEN class IS NULL THEN 0 ELSE 1 END AS in_event, class FROM (
  SELECT lc.channel, lc.day, lc.bin, (SELECT {grade_sql('s.peak_flux')} FROM swpc s WHERE s.channel = lc.channel AND s.day = lc.day AND lc.bin BETWEEN s.start_bin AND s.end_bin ORDER BY s.start_bin LIMIT 1) AS class FROM lc)""",
    "channel, day, bin, class, " + big("in_event"), "", swpc_sql()))
def _in_flare(spark, sf):
    rows = lc(spark, sf).select("channel", "day", "bin", "t")
    hit = ma.first_covering(rows, swpc(spark, sf), on=("channel", "day"))
    return present(hit.select("channel", "day", "bin", "class", "in_event"))


# -- event matching -------------------------------------------------------------------------------------
TOL = 3600


def soft_events(spark, sf):
    """Event lists are small; written once, so matching and the catalog do not repeat the detection."""
    found = swpc(spark, sf, only="view")
    return cut_lineage(found.select(F.col("peak_t").alias("lid"), "day", F.col("peak_t").alias("lt"), "peak_t", "peak_flux", "class"), "soft-events")


def hard_events(spark, sf):
    found = isl.detect_burst(lc(spark, sf).where(F.col("channel") == "click"), sigma=3.0, min_duration=1, window=12, cadence=CADENCE)
    return cut_lineage(found.select(F.col("peak_t").alias("rid"), "day", F.col("peak_t").alias("rt"), "peak_t", "peak_flux"), "hard-events")




def _both_sql() -> str:
    hard = _burst_sql(3.0, 1, 12)[len(LC) + 2:]
    for old in ("z", "r", "s_m", "s", "g", "p"):
        hard = hard.replace(f"{old} AS (SELECT", f"h_{old} AS (SELECT").replace(f"FROM {old} ", f"FROM h_{old} ").replace(f"FROM {old})", f"FROM h_{old})")
    e = "CAST(epoch(day) AS BIGINT)"
    return swpc_sql() + ",\n" + hard + f""",
so AS (SELECT day, {e} + peak_bin * {CADENCE} AS lt, peak_flux, {grade_sql('peak_flux')} AS class FROM swpc WHERE channel = 'view'),
ho AS (SELECT day, {e} + peak_bin * {CADENCE} AS rt, peak_flux FROM burst WHERE channel = 'click'),
pairs AS (SELECT so.day, lt, rt, so.peak_flux AS soft_flux, ho.peak_flux AS hard_flux,
  row_number() OVER (PARTITION BY lt ORDER BY abs(lt - rt), rt) AS rl, row_number() OVER (PARTITION BY rt ORDER BY abs(lt - rt), lt) AS rr
  FROM so JOIN ho ON abs(lt - rt) <= {TOL}),
mutual AS (SELECT * FROM pairs WHERE rl = 1 AND rr = 1)"""


BOTH = _both_sql()


def mutual(soft, hard):
    return ma.mutual_nearest(soft.select("lid", "day", "lt", F.col("peak_flux").alias("soft_flux")),
                             hard.select("rid", "rt", F.col("peak_flux").alias("hard_flux")), TOL)


@query("coincidence_mutual", final("SELECT *, rt - lt AS dt FROM mutual", "day, lt, rt, dt", "soft_flux hard_flux", BOTH))
def _mutual(spark, sf):
    return present(mutual(soft_events(spark, sf), hard_events(spark, sf)).select("day", "lt", "rt", "dt", "soft_flux", "hard_flux"))


@query("coincidence_catalog", final(
    """SELECT so.day, so.lt AS peak_t, so.peak_flux, class, CASE WHEN m.rt IS NULL THEN 0 ELSE 1 END AS has_hxr, coalesce(hard_flux, 0) AS hxr_peak_flux, m.rt AS hxr_peak_t, 'swpc_peak' AS method
  FROM so LEFT JOIN mutual m ON m.lt = so.lt WHERE m.rt IS NOT NULL OR class IN ('C', 'M', 'X')
  UNION ALL SELECT day, rt, peak_flux, 'HXR', 1, peak_flux, rt, 'hxr_only' FROM ho WHERE peak_flux > 0 AND rt NOT IN (SELECT rt FROM mutual)""",
    "day, peak_t, class, method, hxr_peak_t, " + big("has_hxr"), "peak_flux hxr_peak_flux", BOTH))
def _catalog(spark, sf):
    soft, hard = soft_events(spark, sf), hard_events(spark, sf)
    return present(ma.merge_catalogs(soft, hard, mutual(soft, hard)))


def _greedy_sql(right: str, rule: str) -> str:
    """Left events one after the other, each taking the best free right event: (lt, rt)."""
    best = "abs(r.rt - l.lt) * 1e12 + r.rt" if rule == "nearest" else "r.rt"
    return f"""lo AS (SELECT day, lt, row_number() OVER (ORDER BY lt) AS k FROM so),
gm AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS lt, CAST(NULL AS BIGINT) AS rt, CAST([] AS BIGINT[]) AS used
  UNION ALL SELECT l.k, l.lt, arg_min(r.rt, {best}), CASE WHEN count(r.rt) = 0 THEN any_value(gm.used) ELSE list_append(any_value(gm.used), arg_min(r.rt, {best})) END
  FROM gm JOIN lo l ON l.k = gm.k + 1 LEFT JOIN {right} r ON abs(r.rt - l.lt) <= {TOL} AND NOT list_contains(gm.used, r.rt) GROUP BY l.k, l.lt),
greedy AS (SELECT so.day, gm.lt, gm.rt FROM gm JOIN so USING (lt) WHERE gm.rt IS NOT NULL)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("coincidence_greedy", _recursive(final(
    """SELECT so.day, so.lt AS peak_t, so.peak_flux, class, CASE WHEN m.rt IS NULL THEN 0 ELSE 1 END AS has_hxr, coalesce(ho.peak_flux, 0) AS hxr_peak_flux, m.rt AS hxr_peak_t, 'swpc_peak' AS method
  FROM so LEFT JOIN greedy m ON m.lt = so.lt LEFT JOIN ho ON ho.rt = m.rt WHERE m.rt IS NOT NULL OR class IN ('C', 'M', 'X')
  UNION ALL SELECT day, rt, peak_flux, 'HXR', 1, peak_flux, rt, 'hxr_only' FROM ho WHERE peak_flux > 0 AND rt NOT IN (SELECT rt FROM greedy)""",
    "day, peak_t, class, method, hxr_peak_t, " + big("has_hxr"), "peak_flux hxr_peak_flux", BOTH + ",\n" + _greedy_sql("ho", "nearest"))))
def _greedy(spark, sf):
    soft, hard = soft_events(spark, sf), hard_events(spark, sf)
    return present(ma.merge_catalogs(soft, hard, ma.greedy_pairs(soft, hard, TOL)))


@query("coincidence_only_right", final(
    "SELECT day, rt, peak_flux FROM ho WHERE NOT EXISTS (SELECT 1 FROM so WHERE abs(so.lt - ho.rt) <= 3600)", "day, rt", "peak_flux", BOTH))
def _only_right(spark, sf):
    soft, hard = soft_events(spark, sf), hard_events(spark, sf)
    near = ma.candidate_pairs(soft.select("lt"), hard.select("rt"), TOL, "lt", "rt")
    return present(hard.join(near.select("rt").distinct(), "rt", "left_anti").select("day", "rt", "peak_flux"))


@query("validate_prf", final(
    """SELECT day, tp, fp, fn, p AS precision, r AS recall, 2 * p * r / greatest(p + r, 1e-10) AS f1 FROM (
  SELECT *, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r FROM (
  SELECT day, coalesce(m, 0) AS tp, coalesce(d, 0) - coalesce(m, 0) AS fp, coalesce(h, 0) - coalesce(m, 0) AS fn FROM
   (SELECT day, count(*) AS d FROM so GROUP BY day) FULL JOIN (SELECT day, count(*) AS h FROM ho GROUP BY day) USING (day) FULL JOIN (SELECT day, count(*) AS m FROM mutual GROUP BY day) USING (day)))""",
    "day, tp, fp, fn", "precision recall f1", BOTH))
def _prf(spark, sf):
    soft, hard = soft_events(spark, sf), hard_events(spark, sf)
    return present(ma.score_matches(soft, hard, mutual(soft, hard)))


@query("validate_greedy", _recursive(final(
    """SELECT day, tp, fp, fn, p AS precision, r AS recall, 2 * p * r / greatest(p + r, 1e-10) AS f1 FROM (
  SELECT *, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r FROM (
  SELECT day, coalesce(m, 0) AS tp, coalesce(d, 0) - coalesce(m, 0) AS fp, coalesce(h, 0) - coalesce(m, 0) AS fn FROM
   (SELECT day, count(*) AS d FROM so GROUP BY day) FULL JOIN (SELECT day, count(*) AS h FROM tr GROUP BY day) USING (day) FULL JOIN (SELECT day, count(*) AS m FROM greedy GROUP BY day) USING (day)))""",
    "day, tp, fp, fn", "precision recall f1", BOTH + f", te AS (SELECT CAST(ts AS DATE) AS day, CAST(floor(epoch(ts)) AS BIGINT) AS rt FROM events WHERE event_type = 'error' AND value >= {TRUTH}), tr AS (SELECT * FROM te),\n" + _greedy_sql("tr", "first"))))
def _validate(spark, sf):
    tr = truth(spark, sf).select(F.col("event_id").alias("rid"), "day", F.col("t").alias("rt"))
    det = soft_events(spark, sf)
    return present(ma.score_matches(det, tr, ma.greedy_pairs(det, tr, TOL, rule="first")))


@query("hxr_confirm", final(
    f"""SELECT day, peak_t, class, peak_flux, mx AS max_value, mt AS max_t, CASE WHEN coalesce(mx, 0) > 50 THEN 1 ELSE 0 END AS confirmed FROM (
  SELECT day, peak_t, class, peak_flux, (SELECT max(value) FROM ev WHERE channel = 'purchase' AND ev.day = f.day AND ev.t >= f.peak_t - 900 AND ev.t < f.peak_t + 900) AS mx,
  (SELECT arg_max(ev.t, ev.value * 1e6 - (ev.t - f.peak_t) / 1e4) FROM ev WHERE channel = 'purchase' AND ev.day = f.day AND ev.t >= f.peak_t - 900 AND ev.t < f.peak_t + 900) AS mt
  FROM (SELECT day, CAST(epoch(day) AS BIGINT) + peak_bin * {CADENCE} AS peak_t, peak_flux, {grade_sql('peak_flux')} AS class FROM swpc WHERE channel = 'view') f)""",
    "day, peak_t, class, max_t, " + big("confirmed"), "peak_flux max_value", swpc_sql().replace("ev AS (", "evs AS (").replace("FROM ev)", "FROM evs)").replace("FROM ev WHERE", "FROM evs WHERE") + ", " + EV))
def _confirm(spark, sf):
    fl = swpc(spark, sf, only="view").select(F.col("peak_t").alias("fid"), "day", "peak_t", "class", "peak_flux")
    hit = ma.peak_in_window(fl, samples(spark, sf, "purchase"), 900, value="value", on=("day",))
    return present(hit.select("day", "peak_t", "class", "max_t", "peak_flux", "max_value",
                              F.when(F.coalesce("max_value", F.lit(0.0)) > 50, 1).otherwise(0).alias("confirmed")))


@query("pixel_coincidence", final(
    """SELECT day, second, count(DISTINCT user_id) AS pixels FROM (SELECT CAST(ts AS DATE) AS day, user_id, CAST(floor((epoch_us(ts) + 500000) / 1000000.0) AS BIGINT) AS second,
  epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY ts, event_id) AS gap FROM events) WHERE gap < 600 * 1e6 GROUP BY ALL""",
    "day, second, pixels"))
def _pixels(spark, sf):
    ev = table(spark, sf, "events").select(F.to_date("ts").alias("day"), F.col("user_id").alias("pix"), sc.epoch_micros("ts").alias("us"))
    return present(ma.coincident_seconds(ev, 600.0))


@query("dedup_first", final(
    "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1",
    "user_id, event_type, event_id", "value"))
def _dedup(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return present(ma.keep_first(ev, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value"))


# -- quality flags -----------------------------------------------------------------------------------------
def flagged(spark, sf):
    w = wide(spark, sf)
    hard_ok = F.col("click").isNotNull() | F.col("purchase").isNotNull()
    gap = F.when(F.col("signup").isNull() & F.col("error").isNull(), 3).otherwise(0)
    w = w.withColumn("saa", qu.isolated_gap("view", 1, ("day",)))
    w = w.withColumn("flag", qu.master_flag(F.col("view").isNotNull(), hard_ok, gap, F.col("saa")))
    return w.withColumn("good", F.col("flag") == 0)


FLAGS = WIDE + """,
fl0 AS (SELECT *, view IS NULL AND (max(CASE WHEN view IS NOT NULL THEN bin END) OVER (PARTITION BY day ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) IS NOT NULL
   AND (min(CASE WHEN view IS NOT NULL THEN bin END) OVER (PARTITION BY day ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
     - (max(CASE WHEN view IS NOT NULL THEN bin END) OVER (PARTITION BY day ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1 <= 1 AS saa FROM wide),
fl AS (SELECT *, CASE WHEN coalesce(saa, false) THEN 3 WHEN view IS NULL THEN 1 WHEN click IS NULL AND purchase IS NULL THEN 2 WHEN signup IS NULL AND error IS NULL THEN 1 ELSE 0 END AS flag FROM fl0)"""


@query("quality_flags", final(
    "SELECT day, bin, flag, CASE flag WHEN 0 THEN 'GOOD' WHEN 1 THEN 'GTI_GAP' WHEN 2 THEN 'HXR_NO_DATA' WHEN 3 THEN 'SAA' END AS text, CASE WHEN view > 150 THEN greatest(flag, 6) ELSE flag END AS raised FROM fl",
    "day, bin, text, " + big("flag", "raised"), "", FLAGS))
def _flags(spark, sf):
    f = flagged(spark, sf)
    return present(f.select("day", "bin", qu.flag_text("flag").alias("text"), "flag", qu.escalate("flag", F.coalesce(F.col("view") > 150, F.lit(False)), 6).alias("raised")))


def _grad_sql(x, part="day"):
    w = f"OVER (PARTITION BY {part} ORDER BY bin)"
    return f"CASE WHEN bin = 0 THEN lead({x}) {w} - {x} WHEN bin = {BINS - 1} THEN {x} - lag({x}) {w} ELSE (lead({x}) {w} - lag({x}) {w}) / 2 END"


@query("particle_mask", final(
    """SELECT day, bin, CASE WHEN max(cand) OVER (PARTITION BY day ORDER BY bin ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 1
   AND max(both_) OVER (PARTITION BY day ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 0 THEN 1 ELSE 0 END AS particle FROM pc""",
    "day, bin, " + big("particle"), "", FLAGS + f""",
pa AS (SELECT *, coalesce(view, 0) AS s, coalesce(click, 0) AS h FROM fl),
pb AS (SELECT *, {_grad_sql('s')} AS gs, {_grad_sql('h')} AS gh FROM pa),
pd AS (SELECT *, stddev_pop(CASE WHEN flag = 0 THEN gs END) OVER (PARTITION BY day) AS ss,
  CASE WHEN count(CASE WHEN flag = 0 THEN 1 END) OVER (PARTITION BY day) > 10 THEN stddev_pop(CASE WHEN flag = 0 THEN gh END) OVER (PARTITION BY day) ELSE 1.0 END AS sh FROM pb),
pc AS (SELECT *, CASE WHEN coalesce(abs(gs) > 1.5 * ss, false) AND (click IS NULL OR abs(gh) < 2 * sh) AND flag = 0 THEN 1 ELSE 0 END AS cand,
  CASE WHEN coalesce(abs(gs) > 1.5 * ss, false) AND click IS NOT NULL AND abs(gh) > 3 * sh THEN 1 ELSE 0 END AS both_ FROM pd)"""))
def _particle(spark, sf):
    p = qu.particle_events(flagged(spark, sf), "view", "click", kappa=1.5, spread=3, undo=1, keys=("day",))
    return present(p.select("day", "bin", "particle"))


@query("saturation", final(
    """SELECT channel, n, top, ceiling, (SELECT count(*) FROM events e WHERE e.event_type = c.channel AND value >= 0.95 * ceiling AND n >= 100) AS n_saturated FROM (
  SELECT channel, n, top, CASE WHEN n < 100 OR cell IS NULL OR cell < 2 THEN top ELSE lo * pow(10.0, log10(top * 1.05 / lo) / 59 * cell) END AS ceiling FROM (
  SELECT channel, lo, top, n, max(CASE WHEN c >= mx * 0.01 AND cell >= 1 THEN cell END) AS cell FROM (SELECT *, max(c) OVER (PARTITION BY channel) AS mx FROM (
    SELECT event_type AS channel, lo, top, n, least(floor(log10(value / lo) / (log10(top * 1.05 / lo) / 59)), 58) AS cell, count(*) AS c
    FROM events JOIN (SELECT event_type AS et, min(value) AS lo, max(value) AS top, count(*) AS n FROM events WHERE value > 0 GROUP BY 1) ON et = event_type WHERE value > 0 GROUP BY ALL)) GROUP BY ALL)) c""",
    "channel, n, n_saturated", "top ceiling"))
def _saturation(spark, sf):
    ev = table(spark, sf, "events").select(F.col("event_type").alias("channel"), "value")
    caps = sized(qu.saturation_ceiling(ev, "value"), "ceilings")
    hits = ev.join(caps, "channel").groupBy("channel", "n", "top", "ceiling").agg(
        F.count(F.when(qu.saturated("value", "ceiling", "n"), 1)).alias("n_saturated"))
    return present(hits)


@query("excess_snr", final(
    """SELECT day, bin, e AS excess, greatest(e, 0) AS excess_pos, CASE WHEN sd > 0 THEN e / sd END AS snr, CASE WHEN sd > 0 AND e / sd > 5 AND click IS NULL THEN greatest(flag, 6) ELSE flag END AS anomaly FROM (
  SELECT *, CASE WHEN flag = 0 THEN view - bg END AS e FROM ms)""",
    "day, bin, " + big("anomaly"), "excess excess_pos snr",
    FLAGS + f""", m0 AS (SELECT *, quantile_cont(coalesce(view, 0), 0.5) {frame(24, 'day')} AS bg, coalesce(view, 0) AS vv FROM fl), {mad('vv', 'm0', 'ms', 'day')}"""))
def _excess(spark, sf):
    f = flagged(spark, sf).withColumn("vv", F.coalesce("view", F.lit(0.0)))
    f = ro.rolling_quantile(f, "vv", 0.5, 24, "bg", ("day",))
    f = ro.mad_sigma(f, "vv", "sigma", ("day",))
    e = qu.excess(f, "view")
    strange = F.coalesce((F.col("snr") > 5) & F.col("click").isNull(), F.lit(False))
    return present(e.select("day", "bin", "excess", "excess_pos", "snr", qu.escalate("flag", strange, 6).alias("anomaly")))


@query("cross_calibration", final(
    """SELECT day, n, CASE WHEN n >= 20 THEN s ELSE md END AS slope, CASE WHEN n >= 20 THEN i ELSE 0.0 END AS intercept, CASE WHEN n >= 20 THEN r2 END AS r2 FROM (
  SELECT day, count(y) AS n, regr_slope(y, x) AS s, regr_intercept(y, x) AS i, regr_r2(y, x) AS r2, quantile_cont(CASE WHEN x > 0 THEN y / x END, 0.5) AS md FROM (
  SELECT day, CASE WHEN view > 1 AND view < 80 AND click IS NOT NULL THEN view END AS y, CASE WHEN view > 1 AND view < 80 THEN click END AS x FROM wide) GROUP BY day)""",
    "day, n", "slope intercept r2", WIDE))
def _xcal(spark, sf):
    return present(qu.cross_calibration(wide(spark, sf), "click", "view", 1, 80, 20, ("day",)))
