"""Queries: spectra with a time, made from the photon list; compressed responses."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.output import present
from ..operators import spectra as sp
from ..sources.lightcurve import grid_time, photon_spectra
from ..sources.tables import table
from .fixtures import BINS, CADENCE, LC, big, final
from .q_detect import swpc, swpc_sql
from .q_rolling import TEM, temps
from .q_scalar import SPEC, spec
from .q_spectra import CUTS, RESP, area_curve
from .q_windows import LOOK, STEP, TOP
from .registry import query

#: Pulse heights in steps of 4 are 64 channels of half a keV from 1 keV on.
WIDTH, CHANNELS, E0, DE = 4.0, 64, 1.0, 0.5


def photons(spark, sf):
    ev = table(spark, sf, "events").select("ts", "event_type", "value")
    s = photon_spectra(ev, CADENCE, WIDTH, CHANNELS)
    return s.withColumn("energy", F.lit(E0) + F.col("ch") * F.lit(DE))


PH = f"""ph AS (SELECT event_type AS channel, CAST(ts AS DATE) AS day, CAST(floor((CAST(floor(epoch(ts)) AS BIGINT) % 86400) / {CADENCE}) AS BIGINT) AS bin,
  CAST(floor(value / {WIDTH}) AS BIGINT) AS ch, CAST(count(*) AS DOUBLE) AS counts FROM events WHERE value >= 0 AND value < {WIDTH * CHANNELS} GROUP BY ALL)"""


@query("photon_spectra", final(f"SELECT channel, day, bin, ch, {E0} + ch * {DE} AS energy, counts FROM ph", "channel, day, bin, ch", "energy counts", PH))
def _photons(spark, sf):
    return present(photons(spark, sf))


_WS = PH + f""",
ws AS (SELECT channel, day, win, ch, {E0} + ch * {DE} AS energy, sum(counts) AS counts FROM ph JOIN (SELECT CAST(range AS BIGINT) AS win FROM range({TOP + 1})) ON bin >= win * {STEP} AND bin < win * {STEP} + {LOOK} WHERE channel IN ('view', 'click', 'purchase') GROUP BY ALL)"""


def window_spectra(spark, sf):
    s = photons(spark, sf).where(F.col("channel").isin("view", "click", "purchase"))
    return sp.hopping_spectra(s, ["channel", "day"], BINS, LOOK, STEP)


@query("hopping_spectra", final("SELECT * FROM ws", "channel, day, win, ch", "energy counts", _WS))
def _hopping(spark, sf):
    return present(window_spectra(spark, sf))


def window_spectral(spark, sf):
    return sp.window_spectral(window_spectra(spark, sf), ["day", "win"], "view", "click", "purchase", CUTS)


_WG = _WS + """,
wg AS (SELECT channel, day, win, CASE WHEN count(*) >= 3 AND g BETWEEN 1.5 AND 10 THEN g ELSE 0 END AS g FROM (
  SELECT channel, day, win, -regr_slope(ln(counts), ln(energy)) OVER (PARTITION BY channel, day, win) AS g FROM ws) GROUP BY channel, day, win, g),
wf AS (SELECT channel, day, win, regr_slope(ln(counts * energy), energy) AS s, regr_intercept(ln(counts * energy), energy) AS i FROM ws WHERE energy BETWEEN 2 AND 10 GROUP BY channel, day, win HAVING count(*) >= 3),
wi AS (SELECT channel, day, win, least(greatest(CASE WHEN s < 0 THEN -1.0 / (s * 0.08617) ELSE 100.0 END, 1.0), 100.0) AS temp_mk, least(greatest(exp(i), 1e-10), 1e10) AS em FROM wf),
wt AS (SELECT channel, day, win, temp_mk, em, coalesce(sum(least(em / energy * exp(-energy / (0.08617 * temp_mk)), counts)) FILTER (energy BETWEEN 5 AND 20) / sum(counts) FILTER (energy BETWEEN 5 AND 20), 0) AS tf
  FROM wi JOIN ws USING (channel, day, win) GROUP BY channel, day, win, temp_mk, em),
wp AS (SELECT day, win, coalesce(max(g) FILTER (channel = 'view'), 0) AS sxr_gamma_window, coalesce(max(g) FILTER (channel = 'click'), 0) AS hxr_gamma_window_czt1, coalesce(max(g) FILTER (channel = 'purchase'), 0) AS hxr_gamma_window_cdte1 FROM wg GROUP BY day, win),
wc AS (SELECT *, CASE WHEN hxr_gamma_window_czt1 > 0 THEN hxr_gamma_window_czt1 WHEN hxr_gamma_window_cdte1 > 0 THEN hxr_gamma_window_cdte1 ELSE sxr_gamma_window END AS gamma FROM wp),
wd AS (SELECT *, coalesce(gamma - lag(gamma) OVER (PARTITION BY day ORDER BY win), 0) AS shs_index FROM wc)"""


@query("window_spectral", final(
    """SELECT wd.*, -shs_index / 900 * 1000 AS milli_rate, coalesce(v.temp_mk, 0) AS sxr_temp_window, coalesce(v.em, 0) AS sxr_em_window, coalesce(least(greatest(1 - coalesce(c.tf, v.tf), 0), 1), 0) AS nonthermal_fraction_window
  FROM wd LEFT JOIN wt v ON v.channel = 'view' AND v.day = wd.day AND v.win = wd.win LEFT JOIN wt c ON c.channel = 'click' AND c.day = wd.day AND c.win = wd.win""",
    "day, win", "sxr_temp_window sxr_em_window sxr_gamma_window hxr_gamma_window_czt1 hxr_gamma_window_cdte1 shs_index milli_rate nonthermal_fraction_window", _WG, digits=5))
def _window_spectral(spark, sf):
    f = window_spectral(spark, sf)
    return present(f.withColumn("milli_rate", F.col("spectral_hardening_rate") * 1000).drop("spectral_hardening_rate"), 5)


# -- per-flare fits ----------------------------------------------------------------------------------------
def soft_flares(spark, sf):
    return swpc(spark, sf, only="view").select("day", "start_t", "end_t")


def channel_table(spark, sf):
    """Channel energies with the effective area interpolated at them."""
    curve = area_curve(spark, sf).select(F.col("e").cast("double").alias("ex"), "area")
    return sp.area_lookup(sp.channel_energies(spark, CHANNELS, E0, DE), curve)


def flare_fits(spark, sf):
    s = photons(spark, sf).where(F.col("channel") == "view").withColumn("t", grid_time(CADENCE))
    accumulated = sp.flare_spectra(s, soft_flares(spark, sf), width=14400, cadence=CADENCE)
    return sp.flare_temperatures(accumulated, channel_table(spark, sf), ["day", "start_t", "end_t"], least_bins=3, least=5)


_E = "CAST(epoch(day) AS BIGINT)"
_FS = swpc_sql() + ", " + PH + f""", {RESP[len(SPEC) + 2:]},
fw AS (SELECT day, {_E} + start_bin * {CADENCE} AS start_t, {_E} + end_bin * {CADENCE} AS end_t FROM swpc WHERE channel = 'view'),
fi AS (SELECT fw.day, start_t, end_t, bin, ch, counts FROM fw JOIN ph ON ph.channel = 'view' AND ph.day = fw.day AND {_E.replace('day', 'ph.day')} + bin * {CADENCE} BETWEEN start_t AND end_t),
fb AS (SELECT day, start_t, end_t, count(DISTINCT bin) AS time_bins, sum(counts) AS total FROM fi GROUP BY ALL),
fc AS (SELECT day, start_t, end_t, ch, sum(counts) AS counts FROM fi GROUP BY ALL),
ca AS (SELECT ch, e, coalesce((SELECT a.area + (b.area - a.area) * (p.e - a.e) / (b.e - a.e) FROM arf a JOIN arf b ON b.e = a.e + 1 WHERE p.e >= a.e AND (p.e < b.e OR (p.e = b.e AND b.e = 24)) LIMIT 1), 0) AS area FROM (SELECT CAST(range AS BIGINT) AS ch, {E0} + range * {DE} AS e FROM range({CHANNELS})) p),
fr AS (SELECT fc.*, e, counts / (area * {DE}) AS rate FROM fc JOIN fb USING (day, start_t, end_t) JOIN ca USING (ch) WHERE area > 1e-6 AND time_bins >= 3),
fg AS (SELECT day, start_t, end_t, regr_slope(ln(rate) + 0.5 * ln(e), e) AS s, regr_intercept(ln(rate) + 0.5 * ln(e), e) AS i, count(*) AS channels FROM fr GROUP BY ALL HAVING count(*) >= 5),
fh AS (SELECT *, least(greatest(CASE WHEN s < 0 THEN -1.0 / (s * 0.08617) ELSE 100.0 END, 1.0), 100.0) AS temp_mk, least(greatest(exp(i), 1e-10), 1e10) AS em FROM fg),
ff AS (SELECT day, start_t, end_t, channels, temp_mk, log10(em * {4 * math.pi * sp.DISTANCE_CM**2 * sp.EM_SCALE!r} + 1e-10) AS log_em, sum(pow(rate - em / sqrt(e) * exp(-e / (0.08617 * temp_mk)), 2) / greatest(rate, 1)) / greatest(channels - 2, 1) AS chi2_red,
  time_bins, total, time_bins * {CADENCE} AS exposure FROM fh JOIN fr USING (day, start_t, end_t) JOIN fb USING (day, start_t, end_t) GROUP BY day, start_t, end_t, channels, temp_mk, em, time_bins, total)"""
_FS = _FS.replace("z AS (SELECT channel", "zq AS (SELECT channel").replace("FROM z)", "FROM zq)")


@query("flare_temperature", final("SELECT * FROM ff", "day, start_t, end_t, channels, time_bins", "temp_mk log_em chi2_red exposure total", _FS, digits=5))
def _flare_temperature(spark, sf):
    return present(flare_fits(spark, sf), 5)


_TD = _FS + ", " + TEM[len(LC) + 2:]


@query("flare_temp_difference", final(
    "SELECT tem.day, bin, temp_mk AS flare_temp_mk, log_em AS flare_log_em, temp - temp_mk AS temp_diff FROM tem LEFT JOIN ff ON ff.day = tem.day AND tem.t BETWEEN start_t AND end_t",
    "day, bin", "flare_temp_mk flare_log_em temp_diff", _TD, digits=5))
def _flare_difference(spark, sf):
    d = sp.temperature_difference(temps(spark, sf), flare_fits(spark, sf), width=14400)
    return present(d.select("day", "bin", "flare_temp_mk", "flare_log_em", "temp_diff"), 5)


# -- compressed responses -------------------------------------------------------------------------------------
#: Below this a redistribution value is noise.
SMALLEST = 0.1


def response(spark, sf):
    s = spec(spark, sf)
    return sp.compress_response(s.select(F.col("id").alias("ch"), F.col("ch").alias("e"), (F.col("counts") / 100).alias("value")), SMALLEST)


_RM = RESP + f", rk AS (SELECT ch, e, value, ch - row_number() OVER (PARTITION BY e ORDER BY ch) AS run FROM rm WHERE value > {SMALLEST})"


@query("response_rows", final(
    "SELECT e, count(DISTINCT run) AS runs, count(*) AS filled, min(ch) AS first_channel, max(n) AS longest, sum(value) AS total FROM (SELECT *, count(*) OVER (PARTITION BY e, run) AS n FROM rk) GROUP BY e",
    "e, runs, filled, first_channel, longest", "total", _RM))
def _response_rows(spark, sf):
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
    r = response(spark, sf)
    return present(r.select("e", F.size("first").alias("runs"), F.size("values").alias("filled"), F.element_at("first", 1).alias("first_channel"), F.array_max("length").alias("longest"), total.alias("total")))


@query("response_unfold", final("SELECT ch, e, value FROM rk", "ch, e", "value", _RM))
def _unfold(spark, sf):
    return present(sp.expand_response(response(spark, sf)).select("ch", "e", "value"))


@query("response_fold_sparse", final("SELECT label, rk.ch, sum(value * flux * area) AS counts FROM rk JOIN fx ON fx.e = rk.e JOIN arf ON arf.e = rk.e GROUP BY label, rk.ch", "ch, " + big("label"), "counts", _RM))
def _fold_sparse(spark, sf):
    flux = spec(spark, sf).groupBy("label", F.col("ch").alias("e")).agg(F.avg("counts").alias("flux"))
    return present(sp.fold_compressed(response(spark, sf), area_curve(spark, sf), flux, ["label"]))


@query("channel_energies", final(f"SELECT CAST(range AS BIGINT) AS ch, {E0} + range * {DE} - {DE / 2} AS emin, {E0} + range * {DE} + {DE / 2} AS emax, {E0} + range * {DE} AS energy, n FROM range({CHANNELS}) LEFT JOIN (SELECT ch AS c, sum(counts) AS n FROM ph GROUP BY ch) ON c = range", "ch", "emin emax energy n", PH))
def _channel_energies(spark, sf):
    """The channel table, with the photons seen in each channel."""
    seen = photons(spark, sf).groupBy("ch").agg(F.sum("counts").alias("n"))
    return present(sp.channel_energies(spark, CHANNELS, E0, DE).drop("de").join(seen, "ch", "left"))
