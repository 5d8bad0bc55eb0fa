"""Queries: sources, sinks and end-to-end pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions.output import present
from ..operators import catalog as cg
from ..operators import matching as ma
from ..operators import quality as qu
from ..operators import rolling as ro
from ..operators import spectra as sp
from ..operators import windows as wi
from ..session import run_dir
from ..sources import catalogs as ct
from ..sources import sinks as sk
from ..sources import tables as tb
from ..sources.lightcurve import band_order, linear_energy
from .features import causal_families, feature_matrix
from .fixtures import BINS, CADENCE, CHANNELS, LC, WIDE, big, final, lc, wide
from .nowcast import nowcast
from .q_detect import grade, grade_sql
from .q_match import BOTH, EV, FLAGS, GTI, TRUTH, _grad_sql, flagged, good_times, truth
from .q_rolling import TEM, temps
from .q_scalar import SPEC, spec
from .q_spectra import CUTS
from .q_timed import photons
from .q_windows import BANDED, BANDS, LAGS, LOOK, SCALES, STEP, banded
from .registry import query
from .stage import assemble, missing_by_column


@query("day_listing", final("SELECT DISTINCT CAST(ts AS DATE) AS day FROM events", "day"))
def _days(spark, sf):
    return present(tb.days_of(tb.table(spark, sf, "events").select(F.to_date("ts").alias("day"))))


@query("day_range_scan", final("SELECT event_type AS channel, count(*) AS n, sum(value) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' GROUP BY 1", "channel, n", "total", digits=3))
def _range(spark, sf):
    ev = tb.between_days(tb.table(spark, sf, "events"), "2024-01-05", "2024-01-11")
    return present(ev.groupBy(F.col("event_type").alias("channel")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 3)


@query("column_projection", final("SELECT p_partkey, p_size, p_retailprice FROM part", "p_partkey, " + big("p_size"), "p_retailprice"))
def _columns(spark, sf):
    return present(tb.columns_like(tb.table(spark, sf, "part"), ["size", "price"], ["p_partkey"]))


@query("band_truncation", final(
    "SELECT day, channel, pos, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY day, channel ORDER BY sec) AS pos FROM cells) JOIN (SELECT day, min(n) AS shortest FROM (SELECT day, channel, count(*) AS n FROM cells GROUP BY ALL) GROUP BY day) USING (day) WHERE pos <= shortest",
    "day, channel, pos, event_id", "value", EV + ", cells AS (SELECT day, channel, t AS sec, min(event_id) AS event_id, max(value) AS value FROM ev GROUP BY ALL)"))
def _truncate(spark, sf):
    ev = tb.table(spark, sf, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("channel"), sc.epoch_seconds("ts").alias("sec"), "event_id", "value")
    cells = ev.groupBy("day", "channel", "sec").agg(F.min("event_id").alias("event_id"), F.max("value").alias("value"))
    return present(band_order(cells, ["day"], "channel", "sec").select("day", "channel", "pos", "event_id", "value"))


@query("peak_near", final(
    f"SELECT t.event_id, arg_max(s.t, s.v * 1e6 - (s.t - t.t) / 1e4) AS max_t, max(s.v) AS max_value FROM ev t LEFT JOIN (SELECT t, max(value) AS v FROM ev WHERE channel = 'view' GROUP BY t) s ON s.t >= t.t - 1800 AND s.t < t.t + 1800 WHERE t.channel = 'error' AND t.value >= {TRUTH} GROUP BY t.event_id",
    "event_id, max_t", "max_value", EV))
def _near(spark, sf):
    view = tb.table(spark, sf, "events").where(F.col("event_type") == "view").select(sc.epoch_seconds("ts").alias("t"), F.col("value").alias("v"))
    fl = truth(spark, sf).select("event_id", F.col("t").alias("peak_t"))
    return present(ma.peak_in_window(fl, view, 1800, fid="event_id").select("event_id", "max_t", "max_value"))


@query("archive_roundtrip", final("SELECT channel, count(*) AS n, sum(coalesce(v, 0)) AS total, count(DISTINCT day) AS days FROM lc WHERE day BETWEEN DATE '2024-01-03' AND DATE '2024-01-09' GROUP BY channel", "channel, n, days", "total", LC, digits=3))
def _archive(spark, sf):
    path = run_dir(spark, "archive")
    sk.archive(lc(spark, sf), path)
    back = tb.partitioned_days(spark, path, "2024-01-03", "2024-01-09")
    return present(back.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.countDistinct("day").alias("days")), 3)


@query("orbit_merge", final("SELECT day, count(*) AS rows, count(DISTINCT hour // 8) - 1 AS extra_orbits FROM (SELECT CAST(ts AS DATE) AS day, CAST(hour(ts) AS BIGINT) AS hour FROM events) GROUP BY day", "day, rows, extra_orbits"))
def _orbits(spark, sf):
    path = run_dir(spark, "orbits")
    ev = tb.table(spark, sf, "events").select("event_id", "ts", "value", F.date_format("ts", "yyyyMMdd").alias("d"), F.floor(F.hour("ts") / F.lit(8)).cast("string").alias("h"))
    ev.withColumn("orbit", F.concat_ws("_", "d", "h", F.lit("V1"))).drop("d", "h").write.partitionBy("orbit").parquet(path)
    merged = tb.merge_orbits(spark, path, r"orbit=(\d{8})_(\d)_(V\d)", "ts")
    extra = tb.unmerged_orbits(merged)
    return present(merged.groupBy("day").agg(F.count(F.lit(1)).alias("rows")).join(extra, "day"))


@query("catalog_sources", final(
    f"""SELECT CAST(day AS VARCHAR) AS date, peak_t, goes_class, peak_flux * 1e6 AS micro FROM (SELECT day, t AS peak_t, goes_class, min(flux) AS peak_flux FROM (SELECT day, t, value * 2.5e-8 AS flux, CASE WHEN value * 2.5e-8 >= 1e-5 THEN 'M' WHEN value * 2.5e-8 >= 1e-6 THEN 'C' ELSE 'B' END AS goes_class FROM ev WHERE channel = 'error' AND value >= 150
  UNION ALL SELECT day, t, value * 2.5e-8, CASE WHEN value * 2.5e-8 >= 1e-5 THEN 'M' WHEN value * 2.5e-8 >= 1e-6 THEN 'C' ELSE 'B' END FROM ev WHERE channel = 'click' AND value >= 150 AND day NOT IN (SELECT day FROM ev WHERE channel = 'error' AND value >= 150)) GROUP BY day, t, goes_class) WHERE day BETWEEN DATE '2024-01-02' AND DATE '2024-01-28'""",
    "date, peak_t, goes_class", "micro", EV))
def _catalogs(spark, sf):
    path = run_dir(spark, "catalogs")
    ev = tb.table(spark, sf, "events").where(F.col("value") >= TRUTH).withColumn("ts", F.date_trunc("second", F.col("ts").cast("timestamp")))
    flux = sc.counts_to_irradiance("value")
    csv = ev.where(F.col("event_type") == "error").select(
        F.to_date("ts").alias("date"), F.col("ts").alias("begin_time"), F.col("ts").alias("peak_time"), F.col("ts").alias("end_time"),
        sc.class_letter(flux).alias("goes_class"), flux.alias("peak_flux"), F.lit(None).cast("int").alias("active_region"))
    sk.write_csv(csv, f"{path}/csv")
    letter = sc.class_letter(flux)
    base = sc.choose([(letter == k, v) for k, v in sc.CLASS_BASE.items()])
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    ev.where(F.col("event_type") == "click").select(stamp.alias("begin"), stamp.alias("peak"), stamp.alias("end"), letter.alias("class_type"), (flux / base).alias("class_value"), F.lit(1).alias("active_region_num")).write.json(f"{path}/json")
    primary, second = ct.read_csv(spark, f"{path}/csv"), ct.read_json(spark, f"{path}/json").withColumn("goes_class", F.substring("goes_class", 1, 1))
    both = ct.in_range(ct.prefer(primary, second), "2024-01-02", "2024-01-28")
    return present(both.select(F.date_format("date", "yyyy-MM-dd").alias("date"), F.unix_seconds("peak_time").alias("peak_t"), "goes_class", (F.col("peak_flux") * 1e6).alias("micro")))


@query("incremental_days", final("SELECT channel, day, count(*) AS rows, max(v) AS top FROM lc GROUP BY channel, day", "channel, day, rows", "top", LC))
def _increment(spark, sf):
    path = run_dir(spark, "increment")
    series = lc(spark, sf)
    job = lambda part: part.groupBy("channel", "day").agg(F.count(F.lit(1)).alias("rows"), F.max("v").alias("top"))
    sk.run_increment(spark, series.where(F.col("day") < F.lit("2024-01-12").cast("date")), job, path)
    sk.run_increment(spark, series, job, path)
    return present(spark.read.parquet(path).select("channel", F.col("day").cast("date").alias("day"), "rows", "top"))


# -- pipelines -------------------------------------------------------------------------------------------------------
_LEVEL = {"click": 15.0, "purchase": 12.0}
_Z = "z AS (SELECT channel, day, bin, t, coalesce(v, 0.0) AS v FROM lc)"
_MASKED = f"""gi AS (SELECT lc.*, EXISTS (SELECT 1 FROM gti WHERE lc.t BETWEEN gti.start AND gti.stop) AS inside FROM lc),
ff AS (SELECT channel, day, bin, t, coalesce(last_value(CASE WHEN inside THEN v END IGNORE NULLS) OVER (PARTITION BY channel, day ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  quantile_cont(CASE WHEN inside THEN v END, 0.5) OVER (PARTITION BY channel, day), 0) AS m FROM gi WHERE channel = 'view'),
z AS (SELECT channel, day, bin, t, list_reduce(list_prepend(m, [0.0 FOR _ IN range(40)]), lambda n, x: m * exp(n * 1e-5)) AS v FROM ff)"""
_RATES = f"h_z AS (SELECT channel, day, bin, t, CASE WHEN inside THEN greatest(coalesce(v, 0) - CASE channel WHEN 'click' THEN {_LEVEL['click']} ELSE {_LEVEL['purchase']} END, 0) ELSE 0 END AS v FROM gi WHERE channel IN ('click', 'purchase'))"


def _nowcast_sql() -> str:
    base = BOTH[: BOTH.index("so AS (SELECT day")]
    base = base.replace("h_" + _Z, _RATES).replace(_Z, _MASKED).replace("ev AS (SELECT channel, day, start_bin, peak_bin", "evs AS (SELECT channel, day, start_bin, peak_bin").replace("FROM ev WHERE end_bin", "FROM evs WHERE end_bin")
    at = base.index("gi AS (SELECT")
    e = "CAST(epoch(day) AS BIGINT)"
    tail = f"""so AS (SELECT day, {e} + peak_bin * {CADENCE} AS lt, peak_flux, {grade_sql('peak_flux')} AS class FROM swpc),
ho AS (SELECT day, channel || '-' || ({e} + peak_bin * {CADENCE}) AS rid, {e} + peak_bin * {CADENCE} AS rt, peak_flux FROM burst),
lo AS (SELECT day, lt, row_number() OVER (ORDER BY lt) AS k FROM so),
gm AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS lt, CAST(NULL AS VARCHAR) AS rid, CAST([] AS VARCHAR[]) AS used
  UNION ALL SELECT l.k, l.lt, min({{'d': abs(r.rt - l.lt), 't': r.rt, 'r': r.rid}}).r, CASE WHEN count(r.rid) = 0 THEN any_value(gm.used) ELSE list_append(any_value(gm.used), min({{'d': abs(r.rt - l.lt), 't': r.rt, 'r': r.rid}}).r) END
  FROM gm JOIN lo l ON l.k = gm.k + 1 LEFT JOIN ho r ON abs(r.rt - l.lt) <= 1800 AND NOT list_contains(gm.used, r.rid) GROUP BY l.k, l.lt),
greedy AS (SELECT lt, rid FROM gm WHERE rid IS NOT NULL)"""
    body = """SELECT so.day, so.lt AS peak_t, so.peak_flux, class, CASE WHEN m.rid IS NULL THEN 0 ELSE 1 END AS has_hxr, coalesce(ho.peak_flux, 0) AS hxr_peak_flux, ho.rt AS hxr_peak_t, 'swpc_peak' AS method
  FROM so LEFT JOIN greedy m ON m.lt = so.lt LEFT JOIN ho ON ho.rid = m.rid WHERE m.rid IS NOT NULL OR class IN ('C', 'M', 'X')
  UNION ALL SELECT day, rt, peak_flux, 'HXR', 1, peak_flux, rt, 'hxr_only' FROM ho WHERE peak_flux > 0 AND rid NOT IN (SELECT rid FROM greedy)"""
    sql = final(body, "day, peak_t, class, method, hxr_peak_t, " + big("has_hxr"), "peak_flux hxr_peak_flux", base[:at] + GTI + ",\n" + base[at:] + tail)
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("nowcast_pipeline", _nowcast_sql())
def _nowcast(spark, sf):
    out = nowcast(lc(spark, sf), good_times(spark, sf).drop("day"), "view", {"click": 15.0, "purchase": 12.0}, CADENCE, 1800, factor=1.0, tau=1e-5,
                  burst=dict(sigma=3.0, min_duration=1, window=12), classify=grade, threshold=50.0, window=24, min_run=1, min_duration=3, short_duration=2, merge_gap=2)
    return present(out)


def day_spectra(spark, sf):
    """Spectra spread over the observed month: the stand-in for time-tagged exposures."""
    s = spec(spark, sf).withColumn("energy", linear_energy("ch", 1.0, 0.5)).withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("id", F.lit(30)).cast("int")))
    return s.groupBy("day", "ch", "energy").agg(F.sum("counts").alias("counts"))


def day_tables(spark, sf, grid):
    s = day_spectra(spark, sf)
    cuts = [10.0, 12.0, 15.0, 18.0, 22.0]
    split = sp.thermal_split(s, ["day"], cuts)
    iso = sp.isothermal_fit(s, ["day"])
    fits = split.select("day", F.col("gamma").alias("nonthermal_gamma"), F.col("ec").alias("nonthermal_ec"), F.col("n_nth").alias("nonthermal_n_nth"), "thermal_fraction")
    iso = iso.select("day", F.col("temp_mk").alias("sxr_temperature_mk"), F.col("em").alias("sxr_emission_measure"), F.col("chi2_red").alias("sxr_chi2_red"))
    part = lambda lo, hi, name: sp.spectral_index("energy", F.when(F.col("energy").between(lo, hi), F.col("counts")), lo=None).alias(name)
    gam = s.groupBy("day").agg(part(1, 33, "hxr_spectral_index_gamma"), part(5, 33, "hxr_gamma_czt2"), part(8, 33, "hxr_gamma_cdte1"), part(10, 33, "hxr_gamma_cdte2"))
    hk = wi.housekeeping(tb.table(spark, sf, "supplier").withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("s_suppkey", F.lit(30)).cast("int"))),
                         {n: "s_acctbal" for n in ("hk_czt1temp", "hk_czt2temp", "hk_cdte1temp", "hk_cdte2temp")} | {n: "s_nationkey" for n in ("hk_czthvmon", "hk_cdtehvmon")},
                         {"hk_czt1satctr": "s_suppkey", "hk_cdte1pilectr": "s_suppkey"})
    totals = wi.band_totals(grid, {"czt2": "b4", "cdte2": "b9"})
    goes = wi.reference_flux(grid, "xb", "xa", first_rows=36)
    corr = grid.select("day", *wi.background_share("b4")).groupBy("day").agg((100.0 * F.avg(F.col("below").cast("double"))).alias("bg_fraction_pct"))
    causal = causal_families(grid, {"SXR": "soft", "HXR": "b0", "B1": "b1", "B2": "b2", "B3": "b3"}, "SXR", "HXR", "B1", max_lag=6, granger_lags=(1, 3, 5), granger_max=20)
    dead = good_times(spark, sf).distinct()
    from ..operators.intervals import merge_intervals

    dead = merge_intervals(dead, ["day"]).groupBy("day").agg(sc.clip(100 * (1 - F.sum(F.col("stop") - F.col("start")) / 86400.0), 0.0, 100.0).alias("deadtime_max_pct"))
    return [fits, iso, gam, hk, totals, goes, corr, dead, causal]


LOOKBACK, HOP = 60, 12


def window_tables(spark, sf):
    """Spectral features of every window, from spectra summed over it."""
    s = photons(spark, sf).where(F.col("channel").isin("view", "click", "purchase"))
    summed = sp.hopping_spectra(s, ["channel", "day"], BINS, LOOKBACK, HOP)
    return [sp.window_spectral(summed, ["day", "win"], "view", "click", "purchase", CUTS)]


def matrix(spark, sf):
    from ..session import cut_lineage

    grid = cut_lineage(banded(spark, sf), "grid")
    ev = truth(spark, sf).select(F.col("t").alias("te"))
    return feature_matrix(grid, BANDS, ev, day_tables(spark, sf, grid), BINS, CADENCE, LOOKBACK, HOP, window_tables=window_tables(spark, sf), horizon=7200, scales=SCALES, lags=LAGS, short=6, long=18, coupling=(18, 6),
                          max_lag=12, periods=(3.0, 12.0), period_bands={"10_30s": (4, 6), "30_60s": (6, 8), "60_120s": (8, 12), "120_300s": (12, 18), "300_600s": (18, 32)}, cross=(6, 12))


@query("feature_matrix")
def _matrix(spark, sf):
    return present(matrix(spark, sf))


@query("feature_groups")
def _groups(spark, sf):
    """Activity of the feature families in the representative window of each day."""
    m = wi.representative(matrix(spark, sf).withColumn("in_event", F.col("label")))
    fam = spark.createDataFrame([(n, g) for g, names in wi.FAMILIES.items() for n in names], "feature string, grp string")
    long = m.unpivot(["day"], wi.FEATURE_NAMES, "feature", "x")
    g = cg.group_activity(long, fam, ["day"])
    return present(g.withColumn("details", F.concat_ws(",", "details")))


_PH = FLAGS + f""", tem0 AS (SELECT * FROM (SELECT day, bin, temp, em FROM tem)), gr AS (SELECT day, bin, {_grad_sql('s')} AS ds FROM (SELECT day, bin, coalesce(view, 0) AS s FROM wide)),
am AS (SELECT fl.day, fl.bin, flag, CASE WHEN flag = 0 THEN view END AS flux, CASE WHEN flag = 0 THEN click END AS hard, CASE WHEN flag = 0 THEN ds END AS ds, CASE WHEN flag = 0 THEN temp END AS temp, CASE WHEN flag = 0 THEN fl.view * 2 END AS thermal_flux FROM fl JOIN gr USING (day, bin) JOIN tem0 USING (day, bin))"""
_TEMONLY = TEM[len(WIDE) + 2:]
_PH = _PH.replace(FLAGS + ", tem0", FLAGS + ", " + _TEMONLY + ", tem0")


def phases(spark, sf):
    f = flagged(spark, sf)
    direct = f.select("day", "bin", F.col("view").alias("flux"), F.col("click").alias("hard"))
    slopes = f.select("day", "bin", F.coalesce("view", F.lit(0.0)).alias("s")).select("day", "bin", ro.gradient("s", ("day",)).alias("ds"))
    thermal = temps(spark, sf).select("day", "bin", "temp").join(f.select("day", "bin", (F.col("view") * 2).alias("flux")), ["day", "bin"])
    return assemble(f, {"direct": direct, "slopes": slopes, "thermal": thermal})


@query("assemble_phases", final("SELECT * FROM am", "day, bin, " + big("flag"), "flux hard ds temp thermal_flux", _PH))
def _assemble(spark, sf):
    return present(phases(spark, sf))


@query("missing_by_column", final(
    "SELECT name, count(*) AS rows, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0 END) AS missing, avg(CASE WHEN coalesce(value, 0) <> 0 THEN 1.0 ELSE 0 END) AS nonzero, CASE WHEN max(abs(coalesce(value, 0))) = 0 THEN 1 ELSE 0 END AS all_zero FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS name, {c} AS value FROM am" for c in ("flux", "hard", "ds", "temp", "thermal_flux")) + ") GROUP BY name",
    "name, rows, " + big("all_zero"), "missing nonzero", _PH))
def _missing(spark, sf):
    return present(missing_by_column(phases(spark, sf)))
