"""Queries: spectra, response folding, wavelets, periodograms."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.output import present
from ..operators import periodicity as pe
from ..operators import rolling as ro
from ..operators import spectra as sp
from ..operators import windows as wi
from ..operators.islands import detect_wavelet
from ..sources.lightcurve import linear_energy
from ..sources.tables import table
from .fixtures import BINS, CADENCE, LC, WIDE, big, final, frame, lc, wide
from .q_detect import swpc, swpc_sql
from .q_match import FLAGS, flagged
from .q_rolling import WZ, soft_hard
from .q_scalar import SPEC, spec
from .q_windows import BANDED, LOOK, STEP, banded
from .registry import query

E0, DE = 1.0, 0.5
SPECE = SPEC + f", se AS (SELECT *, {E0} + ch * {DE} AS energy FROM spec)"


def energetic(spark, sf):
    return spec(spark, sf).withColumn("energy", linear_energy("ch", E0, DE))


@query("sum_spectrum", final("SELECT label, ch, sum(counts) AS counts, count(*) AS n_spectra FROM spec GROUP BY label, ch", big("label") + ", ch, n_spectra", "counts", SPEC))
def _sum(spark, sf):
    return present(sp.sum_spectrum(spec(spark, sf), ["label"]))


@query("rebin4", final("SELECT id, least(ch // 16, 3) AS part, sum(counts) AS counts FROM spec GROUP BY ALL", "id, CAST(part AS BIGINT) AS part", "counts", SPEC))
def _rebin(spark, sf):
    return present(sp.rebin(spec(spark, sf), ["id"], 4, 64))


_GAMMA = "-regr_slope(CASE WHEN counts > 0 THEN ln(counts) END, CASE WHEN counts > 0 THEN ln(energy) END)"


@query("power_law_gamma", final(
    f"SELECT id, label, CASE WHEN n >= 3 AND g BETWEEN 1.5 AND 10 THEN g ELSE 0 END AS gamma, CASE WHEN n >= 3 THEN g END AS free FROM (SELECT id, label, {_GAMMA} AS g, count(*) FILTER (counts > 0) AS n FROM se GROUP BY id, label)",
    "id, " + big("label"), "gamma free", SPECE))
def _gamma(spark, sf):
    s = energetic(spark, sf)
    return present(s.groupBy("id", "label").agg(sp.spectral_index("energy", "counts").alias("gamma"),
                                                sp.spectral_index("energy", "counts", lo=None, default=None).alias("free")))


@query("gamma_summary", final(
    f"SELECT label, count(*) AS n, avg(g) AS mean, stddev_pop(g) AS std, min(g) AS lo, max(g) AS hi FROM (SELECT id, label, {_GAMMA} AS g FROM se WHERE energy BETWEEN 10 AND 30 GROUP BY id, label HAVING count(*) FILTER (counts > 0) >= 5) GROUP BY label",
    "n, " + big("label"), "mean std lo hi", SPECE))
def _gamma_summary(spark, sf):
    s = energetic(spark, sf).where(F.col("energy").between(10, 30))
    g = s.groupBy("id", "label").agg(sp.spectral_index("energy", "counts", least=5, lo=None, default=None).alias("g")).where(F.col("g").isNotNull())
    return present(g.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("g").alias("mean"), F.stddev_pop("g").alias("std"), F.min("g").alias("lo"), F.max("g").alias("hi")))


_ISO = SPECE + """,
sm AS (SELECT label, ch, energy, sum(counts) AS counts FROM se GROUP BY ALL),
f1 AS (SELECT label, regr_slope(ln(counts * energy), energy) AS s, regr_intercept(ln(counts * energy), energy) AS i, count(*) AS bins FROM sm WHERE energy BETWEEN 2 AND 10 AND counts > 0 GROUP BY label HAVING count(*) >= 3),
iso AS (SELECT label, bins, least(greatest(CASE WHEN s < 0 THEN -1.0 / (s * 0.08617) ELSE 100.0 END, 1.0), 100.0) AS temp_mk, least(greatest(exp(i), 1e-10), 1e10) AS em FROM f1)"""


def label_spectra(spark, sf):
    return energetic(spark, sf).groupBy("label", "ch", "energy").agg(F.sum("counts").alias("counts"))


@query("isothermal_fit", final(
    "SELECT iso.label, bins, temp_mk, em, sum(pow(counts - em / energy * exp(-energy / (0.08617 * temp_mk)), 2) / greatest(counts, 1)) / greatest(bins - 2, 1) AS chi2_red FROM iso JOIN sm ON sm.label = iso.label AND energy BETWEEN 2 AND 10 AND counts > 0 GROUP BY iso.label, bins, temp_mk, em",
    "bins, " + big("label"), "temp_mk em chi2_red", _ISO))
def _iso(spark, sf):
    return present(sp.isothermal_fit(label_spectra(spark, sf), ["label"]))


CUTS = [10.0, 12.0, 15.0, 18.0, 22.0]


def logged(fit):
    """Normalisations span many decades, so the report carries their logarithms."""
    out = fit.withColumn("log_norm", F.log10("norm"))
    return out.withColumn("log_nth", F.when(F.col("n_nth").isNotNull(), F.log10(F.greatest("n_nth", F.lit(1e-30))))).drop("norm", "n_nth")


def _nth(src, least=5, name="nt"):
    return f"""{name}_p AS (SELECT label, ec, count(*) AS n, regr_slope(y, x) AS s, regr_intercept(y, x) AS i, (regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x)) / count(*) AS mse
  FROM (SELECT label, ln(counts) AS y, ln(energy) AS x, ec FROM {src}, (SELECT unnest([{', '.join(map(str, CUTS))}]) AS ec) WHERE counts > 0 AND energy >= ec) GROUP BY label, ec HAVING count(*) >= {least}),
{name} AS (SELECT label, ec, -s AS gamma, exp(i) AS norm, n AS bins, 1 - s AS delta, CASE WHEN -s > 0 THEN exp(i) * pow(ec, s) / -s ELSE 0 END AS n_nth FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY mse, ec) AS rn FROM {name}_p) WHERE rn = 1)"""


@query("nonthermal_fit", final("SELECT label, bins, ec, gamma, delta, log10(norm) AS log_norm, log10(greatest(n_nth, 1e-30)) AS log_nth FROM nt", "bins, " + big("label"), "ec gamma log_norm delta log_nth", _ISO + ", " + _nth("sm")))
def _nonthermal(spark, sf):
    return present(logged(sp.non_thermal_fit(label_spectra(spark, sf), ["label"], CUTS)))


@query("thermal_split", final(
    """SELECT a.label, temp_mk, em, thermal_fraction, ec, gamma, log10(norm) AS log_norm, delta, log10(greatest(n_nth, 1e-30)) AS log_nth, bins FROM (SELECT iso.label, temp_mk, em, sum(least(em / energy * exp(-energy / (0.08617 * temp_mk)), counts)) FILTER (energy BETWEEN 5 AND 20) / sum(counts) FILTER (energy BETWEEN 5 AND 20) AS thermal_fraction
  FROM iso JOIN sm ON sm.label = iso.label GROUP BY iso.label, temp_mk, em) a LEFT JOIN nt ON nt.label = a.label""",
    "bins, " + big("label"), "temp_mk em thermal_fraction ec gamma log_norm delta log_nth",
    _ISO + ", rs AS (SELECT sm.label, energy, greatest(counts - em / energy * exp(-energy / (0.08617 * temp_mk)), 0) AS counts FROM sm JOIN iso ON iso.label = sm.label WHERE energy > 10), " + _nth("rs", 3)))
def _split(spark, sf):
    return present(logged(sp.thermal_split(label_spectra(spark, sf), ["label"], CUTS)))


@query("hardening_track", final(
    """SELECT label, ord, gamma, coalesce(gamma - lag(gamma) OVER w, 0) AS shs, coalesce(-(gamma - lag(gamma) OVER w) / 900, 0) * 1000 AS milli_rate FROM (
  SELECT label, id // 50 AS ord, CASE WHEN count(*) FILTER (counts > 0) >= 3 AND g BETWEEN 1.5 AND 10 THEN g ELSE 0 END AS gamma FROM (SELECT label, id, counts, """ + _GAMMA.replace("regr_slope(", "regr_slope(").replace("-regr", "-regr") + """ OVER (PARTITION BY label, id // 50) AS g FROM sx) GROUP BY label, id // 50, g) WINDOW w AS (PARTITION BY label ORDER BY ord)""",
    big("label", "ord"), "gamma shs milli_rate",
    SPECE + ", sx AS (SELECT label, id // 50 * 50 AS id, energy, sum(counts) / 10 AS counts FROM se GROUP BY ALL)"))
def _track(spark, sf):
    s = energetic(spark, sf).withColumn("ord", F.floor(F.col("id") / F.lit(50)).cast("bigint"))
    s = s.groupBy("label", "ord", "energy").agg((F.sum("counts") / 10).alias("counts"))
    g = s.groupBy("label", "ord").agg(sp.spectral_index("energy", "counts").alias("gamma"))
    t = sp.index_track(g, ["label"], "ord")
    return present(t.select("label", "ord", "gamma", "shs", (F.col("hardening_rate") * 1000).alias("milli_rate")))


RESP = SPEC + """,
arf AS (SELECT CAST(c_nationkey AS BIGINT) AS e, avg(c_acctbal) / 1000 AS area FROM customer GROUP BY 1),
fx AS (SELECT label, ch AS e, avg(counts) AS flux FROM spec GROUP BY label, ch), rm AS (SELECT id AS ch, ch AS e, counts / 100 AS value FROM spec)"""


def area_curve(spark, sf):
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("bigint").alias("e")).agg((F.avg("c_acctbal") / 1000).alias("area"))


@query("response_fold", final("SELECT label, rm.ch, sum(value * flux * area) AS counts FROM rm JOIN fx ON fx.e = rm.e JOIN arf ON arf.e = rm.e GROUP BY label, rm.ch", "ch, " + big("label"), "counts", RESP))
def _fold(spark, sf):
    s = spec(spark, sf)
    flux = s.groupBy("label", F.col("ch").alias("e")).agg(F.avg("counts").alias("flux"))
    matrix = s.select(F.col("id").alias("ch"), F.col("ch").alias("e"), (F.col("counts") / 100).alias("value"))
    return present(sp.fold_response(matrix, area_curve(spark, sf), flux, ["label"]))


@query("area_lookup", final(
    """SELECT p.p_partkey, coalesce((SELECT a.area + (b.area - a.area) * (p.energy - a.e) / (b.e - a.e) FROM arf a JOIN arf b ON b.e = a.e + 1 WHERE p.energy >= a.e AND (p.energy < b.e OR (p.energy = b.e AND b.e = 24)) LIMIT 1), 0) AS area
  FROM (SELECT p_partkey, p_size * 0.75 - 1 AS energy FROM part) p""", "p_partkey", "area", RESP))
def _lookup(spark, sf):
    pts = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 0.75 - 1).alias("energy"))
    curve = area_curve(spark, sf).select(F.col("e").cast("double").alias("ex"), "area")
    return present(sp.area_lookup(pts, curve).select("p_partkey", "area"))


@query("energy_flux", final(
    """SELECT id, coalesce(sum((e2 - energy) * (y2 + y) / 2), 0) * 1.602e-9 * 1e6 AS micro FROM (SELECT id, energy, energy * counts AS y, lead(energy) OVER w AS e2, lead(energy * counts) OVER w AS y2 FROM se WHERE energy BETWEEN 3 AND 20 WINDOW w AS (PARTITION BY id ORDER BY energy)) GROUP BY id""",
    "id", "micro", SPECE))
def _flux(spark, sf):
    f = sp.energy_flux(energetic(spark, sf), ["id"], 3, 20, photons="counts")
    return present(f.select("id", (F.col("flux") * 1e6).alias("micro")))


@query("index_interp", final(
    """SELECT ch, coalesce(g, pg + (ng - pg) * (ch - pc) / (nc - pc)) AS gamma FROM (SELECT *, last_value(g IGNORE NULLS) OVER a AS pg, last_value(CASE WHEN g IS NOT NULL THEN ch END IGNORE NULLS) OVER a AS pc, first_value(g IGNORE NULLS) OVER b AS ng, first_value(CASE WHEN g IS NOT NULL THEN ch END IGNORE NULLS) OVER b AS nc FROM (
  SELECT ch, CASE WHEN avg(counts) >= 10 THEN avg(counts) END AS g FROM spec GROUP BY ch) WINDOW a AS (ORDER BY ch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (ORDER BY ch ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
    "ch", "gamma", SPEC))
def _index_interp(spark, sf):
    """Only strong channels carry a value; the weak ones are interpolated."""
    g = spec(spark, sf).groupBy(F.lit("all").alias("series"), F.col("ch").alias("bin")).agg(F.when(F.avg("counts") >= 10, F.avg("counts")).alias("g"))
    return present(ro.linear_fill(g, "g", "gamma", ("series",)).select(F.col("bin").alias("ch"), "gamma"))


# -- wavelets ---------------------------------------------------------------------------------------------------
SCALE_LIST = pe.scale_grid(2.0, 12.0, 0.5)
WPERIODS = [4 * math.pi * s / 6.0 for s in SCALE_LIST]
WBANDS = {"short": (3, 6), "mid": (6, 12), "long": (12, 24)}


def soft_arrays(spark, sf):
    return pe.arrays_of(wide(spark, sf), ["day"], ["view", "click"])


def power(spark, sf):
    return pe.wavelet_power(soft_arrays(spark, sf), ["day"], ["view", "click"], 1.0, SCALE_LIST)


def samples(spark, sf, hard=None):
    return pe.per_sample(soft_arrays(spark, sf), ["day"], "view", hard, 1.0, SCALE_LIST, (4, 12))


CWT = WIDE + f""",
sc AS (SELECT unnest(range({len(SCALE_LIST)})) AS sn, unnest([{', '.join(map(repr, SCALE_LIST))}]) AS s),
cz AS (SELECT day, bin, coalesce(view, 0) AS a, coalesce(click, 0) AS b FROM wide),
cn AS (SELECT day, bin, (a - avg(a) OVER d) / stddev_pop(a) OVER d AS a, (b - avg(b) OVER d) / stddev_pop(b) OVER d AS b FROM cz WINDOW d AS (PARTITION BY day)),
kn AS (SELECT sn, s, lag, pow(pi(), -0.25) / sqrt(s) * cos(6.0 * lag / s) * exp(-0.5 * pow(lag / s, 2)) AS w FROM sc, (SELECT CAST(range AS BIGINT) - {BINS // 2} AS lag FROM range({BINS}))),
cw AS (SELECT c.day, kn.sn, 4 * pi() * kn.s / 6.0 AS period, c.bin AS bin, pow(sum(x.a * w), 2) AS pa, pow(sum(x.b * w), 2) AS pb
  FROM cn c JOIN kn ON true JOIN cn x ON x.day = c.day AND x.bin = c.bin + kn.lag GROUP BY c.day, kn.sn, kn.s, c.bin)"""


@query("wavelet_detect", final(
    """SELECT day, min(bin) AS start_bin, arg_max(bin, round(p, 9) - bin / 1e12) AS peak_bin, max(bin) AS end_bin, max(p) AS peak_power, count(*) AS rows FROM
  (SELECT *, bin - row_number() OVER (PARTITION BY day ORDER BY bin) AS run FROM (SELECT *, quantile_cont(p, 0.5) OVER (PARTITION BY day) + 1.5 * stddev_pop(p) OVER (PARTITION BY day) AS lim
   FROM (SELECT day, bin, max(pa) AS p FROM cw GROUP BY day, bin)) WHERE p > lim) GROUP BY day, run HAVING count(*) >= 2""",
    "day, start_bin, peak_bin, end_bin, rows", "peak_power", CWT, digits=4))
def _wavelet_detect(spark, sf):
    return present(detect_wavelet(samples(spark, sf), 1.5, 2, ["day"]), 4)


@query("wavelet_bands", final(
    """SELECT day, e_short, e_mid, e_long, peak_period, mx / (md + 1e-10) AS significance, entropy, hard_energy, cross_power FROM
  (SELECT day, sum(pa) FILTER (period BETWEEN 3 AND 6) AS e_short, sum(pa) FILTER (period BETWEEN 6 AND 12) AS e_mid, sum(pa) FILTER (period BETWEEN 12 AND 24) AS e_long, max(pa) AS mx, quantile_cont(pa, 0.5) AS md,
   sum(pb) FILTER (period BETWEEN 4 AND 12) AS hard_energy, sum(pa * pb) FILTER (period BETWEEN 4 AND 12) AS cross_power FROM cw GROUP BY day)
  JOIN (SELECT day, arg_max(period, g) AS peak_period, -sum(g / t * ln(g / t)) AS entropy FROM (SELECT *, sum(g) OVER (PARTITION BY day) AS t FROM (SELECT day, sn, period, avg(pa) AS g FROM cw GROUP BY day, sn, period)) GROUP BY day) USING (day)""",
    "day", "e_short e_mid e_long peak_period significance entropy hard_energy cross_power", CWT, digits=4))
def _bands(spark, sf):
    f = pe.window_band_features(soft_arrays(spark, sf), ["day"], "view", "click", 1.0, SCALE_LIST, WBANDS, (4, 12))
    ren = {"wavelet_energy_short": "e_short", "wavelet_energy_mid": "e_mid", "wavelet_energy_long": "e_long", "wavelet_peak_period": "peak_period",
           "wavelet_peak_significance": "significance", "wavelet_spectral_entropy": "entropy", "wavelet_hxr_energy_30_120s": "hard_energy", "wavelet_cross_power_sxr_hxr": "cross_power"}
    return present(f.select("day", *[F.col(a).alias(b) for a, b in ren.items()]), 4)


@query("wavelet_samples", final(
    """SELECT day, bin, avg(pa) FILTER (period BETWEEN 4 AND 12) AS band_power, arg_max(period, pa) AS ridge_period, max(pa) AS peak_power, max(pa / ma) AS lim_max, avg(pa / ma) AS lim_mean, CASE WHEN max(pa / ma) > 3 THEN 1 ELSE 0 END AS lim_flag,
  avg(sqrt(pa * pb)) AS cross_power, avg(least(pa / ma, pb / mb)) AS coherence, max(sqrt(pa * pb) / mc) AS cross_lim_max
  FROM (SELECT *, avg(pa) OVER s + 1e-30 AS ma, avg(pb) OVER s + 1e-30 AS mb, avg(sqrt(pa * pb)) OVER s + 1e-30 AS mc FROM cw WINDOW s AS (PARTITION BY day, sn)) GROUP BY day, bin""",
    "day, bin, " + big("lim_flag"), "band_power ridge_period peak_power lim_max lim_mean cross_power coherence cross_lim_max", CWT, digits=4))
def _samples(spark, sf):
    return present(samples(spark, sf, "click").drop("mean_power"), 4)


@query("ridge_chirp", final(
    f"""SELECT day, bin, CASE WHEN bin = 0 THEN lead(l) OVER w - l WHEN bin = {BINS - 1} THEN l - lag(l) OVER w ELSE (lead(l) OVER w - lag(l) OVER w) / 2 END AS chirp_rate
  FROM (SELECT day, bin, ln(greatest(arg_max(period, pa), 10)) AS l FROM cw GROUP BY day, bin) WINDOW w AS (PARTITION BY day ORDER BY bin)""", "day, bin", "chirp_rate", CWT))
def _chirp(spark, sf):
    s = samples(spark, sf)
    return present(pe.ridge_chirp(s, ["day"]).select("day", "bin", "chirp_rate"))


@query("scalegram_slope", final(
    """SELECT day, CASE WHEN count(*) FILTER (period BETWEEN 4 AND 24) > 3 THEN regr_slope(log10(e), log10(period)) FILTER (period BETWEEN 4 AND 24) END AS beta, arg_max(period, e) AS t_min FROM (SELECT day, sn, period, sum(pa) AS e FROM cw GROUP BY day, sn, period) GROUP BY day""",
    "day", "beta t_min", CWT, digits=5))
def _scalegram(spark, sf):
    return present(pe.scalegram(power(spark, sf), ["day"], "view", (4, 24)), 5)


MPER = [6.0, 10.0, 16.0]


@query("complex_wavelet", final(
    """SELECT day, period, sum(p) AS total, max(p) AS top FROM (SELECT c.day, k.period, c.bin, pow(sum(x.v * exp(-u * u / 1.5) * cos(2 * pi() * u)) , 2) / (pi() * 1.5 * k.period) + pow(sum(x.v * exp(-u * u / 1.5) * sin(2 * pi() * u)), 2) / (pi() * 1.5 * k.period) AS p
  FROM z1 c JOIN k ON true JOIN z1 x ON x.day = c.day AND x.bin = c.bin + k.lag GROUP BY c.day, k.period, c.bin) GROUP BY day, period""", "day", "period total top",
    WIDE + f", z1 AS (SELECT day, bin, coalesce(view, 0) AS v FROM wide), k AS (SELECT period, lag, lag / period AS u FROM (SELECT unnest([{', '.join(map(str, MPER))}]) AS period), (SELECT CAST(range AS BIGINT) - {BINS // 2} AS lag FROM range({BINS})))", digits=4))
def _complex(spark, sf):
    p = pe.wavelet_power(soft_arrays(spark, sf), ["day"], ["view"], 1.0, MPER, kind="complex")
    return present(p.select("day", "period", F.aggregate("p_view", F.lit(0.0), lambda a, x: a + x).alias("total"), F.array_max("p_view").alias("top")), 4)


@query("flare_phase_power", final(
    f"""SELECT day, start_t, peak_t, end_t, CASE WHEN count(*) FILTER (t >= start_t - 14400 AND t < start_t) >= 3 THEN avg(bp) FILTER (t >= start_t - 14400 AND t < start_t) END AS power_pre,
  CASE WHEN count(*) FILTER (t >= start_t AND t < start_t + 3600) >= 3 THEN avg(bp) FILTER (t >= start_t AND t < start_t + 3600) END AS power_onset, CASE WHEN count(*) FILTER (t >= peak_t AND t < end_t) >= 3 THEN avg(bp) FILTER (t >= peak_t AND t < end_t) END AS power_decay
  FROM (SELECT day, CAST(epoch(day) AS BIGINT) + bin * {CADENCE} AS t, avg(pa) FILTER (period BETWEEN 4 AND 12) AS bp FROM cw GROUP BY day, bin) JOIN (SELECT day, CAST(epoch(day) AS BIGINT) + start_bin * {CADENCE} AS start_t, CAST(epoch(day) AS BIGINT) + peak_bin * {CADENCE} AS peak_t, CAST(epoch(day) AS BIGINT) + end_bin * {CADENCE} AS end_t FROM swpc WHERE channel = 'view') USING (day)
  GROUP BY day, start_t, peak_t, end_t HAVING count(*) FILTER (t >= start_t - 14400 AND t < greatest(end_t, start_t + 3600)) > 0""",
    "day, start_t, peak_t, end_t", "power_pre power_onset power_decay", CWT + ", " + swpc_sql()[len(LC) + 2:].replace("z AS (SELECT channel", "zq AS (SELECT channel").replace("FROM z)", "FROM zq)"), digits=4))
def _phases(spark, sf):
    from ..sources.lightcurve import grid_time

    s = samples(spark, sf).withColumn("t", grid_time(CADENCE))
    fl = swpc(spark, sf, only="view").select("day", "start_t", "peak_t", "end_t")
    return present(pe.phase_power(s, fl, ["day"], 14400, 3600, least=3), 4)


# -- periodograms, PSD, ACF --------------------------------------------------------------------------------------
@query("red_noise", final(
    """SELECT day, n, r1, 1.0 / (1 + r1 * r1 - 2 * r1 * cos(2 * pi() * 0.1)) AS p10 FROM (SELECT day, count(*) AS n, least(greatest(sum(c * l) / sum(c * c), 0), 0.99) AS r1 FROM (
  SELECT *, lag(c) OVER (PARTITION BY day ORDER BY bin) AS l FROM (SELECT day, bin, view - avg(view) OVER (PARTITION BY day) AS c FROM wide WHERE view IS NOT NULL)) GROUP BY day)""", "day, n", "r1 p10", WIDE))
def _red(spark, sf):
    r = pe.red_noise(wide(spark, sf), ["day"], "view")
    return present(r.withColumn("p10", pe.red_noise_power("r1", F.lit(0.1))))


_R1 = """, rn AS (SELECT day, least(greatest(sum(c * l) / sum(c * c), 0), 0.99) AS r1 FROM (
  SELECT *, lag(c) OVER (PARTITION BY day ORDER BY bin) AS l FROM (SELECT day, bin, view - avg(view) OVER (PARTITION BY day) AS c FROM wide WHERE view IS NOT NULL)) GROUP BY day),
rs AS (SELECT rn.day, sn, period, r1, 1.0 / (1 + r1 * r1 - 2 * r1 * cos(2 * pi() / period)) AS level FROM rn, (SELECT DISTINCT sn, period FROM cw))"""


@query("scale_significance", final(
    "SELECT day, scale_no, period, r1, s AS significance, CASE WHEN s > 1.0 THEN 1 ELSE 0 END AS significant FROM (SELECT cw.day, cw.sn AS scale_no, cw.period, r1, avg(pa) / (level + 1e-30) AS s FROM cw JOIN rs ON rs.day = cw.day AND rs.sn = cw.sn GROUP BY ALL, level)".replace("GROUP BY ALL, level", "GROUP BY cw.day, cw.sn, cw.period, r1, level"),
    "day, " + big("scale_no", "significant"), "period r1 significance", CWT + _R1, digits=5))
def _scale_significance(spark, sf):
    """The limit is the instrument's 3 scaled to the shorter scale grid."""
    noise = pe.red_noise(wide(spark, sf), ["day"], "view")
    return present(pe.scale_significance(power(spark, sf), noise, ["day"], "view", limit=1.0), 5)


@query("sample_significance", final(
    "SELECT day, bin, r1, score AS qpp_sig_score, CASE WHEN score > 3 THEN 1 ELSE 0 END AS qpp_significant FROM (SELECT cw.day, bin, r1, avg(pa) / (avg(level) + 1e-30) AS score FROM cw JOIN rs ON rs.day = cw.day AND rs.sn = cw.sn GROUP BY cw.day, bin, r1)",
    "day, bin, " + big("qpp_significant"), "r1 qpp_sig_score", CWT + _R1, digits=5))
def _sample_significance(spark, sf):
    noise = pe.red_noise(wide(spark, sf), ["day"], "view")
    found = pe.sample_significance(samples(spark, sf), noise, ["day"], WPERIODS)
    return present(found.select("day", "bin", "r1", "qpp_sig_score", "qpp_significant"), 5)


@query("oscillation_cycles", final(
    f"""SELECT day, start_t, end_t, samples, CASE WHEN samples >= 6 THEN least(turns // 2, 20) ELSE 0 END AS cycles, CASE WHEN samples >= 6 AND least(turns // 2, 20) >= 3 THEN 0 ELSE 1 END AS is_localized FROM (
  SELECT day, start_t, end_t, count(*) AS samples, count(*) FILTER (inside <> before) AS turns FROM (SELECT fw.day, start_t, end_t, inside, lag(inside) OVER (PARTITION BY fw.day, start_t ORDER BY t) AS before
   FROM (SELECT day, CAST(epoch(day) AS BIGINT) + start_bin * {CADENCE} AS start_t, CAST(epoch(day) AS BIGINT) + end_bin * {CADENCE} AS end_t FROM swpc WHERE channel = 'view') fw
   JOIN (SELECT day, CAST(epoch(day) AS BIGINT) + bin * {CADENCE} AS t, arg_max(period, pa) BETWEEN 4 AND 12 AS inside FROM cw GROUP BY day, bin) rp ON rp.day = fw.day AND t BETWEEN start_t AND end_t) GROUP BY day, start_t, end_t)""",
    "day, start_t, end_t, samples, " + big("cycles", "is_localized"), "", CWT + ", " + swpc_sql()[len(LC) + 2:].replace("z AS (SELECT channel", "zq AS (SELECT channel").replace("FROM z)", "FROM zq)")))
def _cycles(spark, sf):
    from ..sources.lightcurve import grid_time

    s = samples(spark, sf).withColumn("t", grid_time(CADENCE))
    fl = swpc(spark, sf, only="view").select("day", "start_t", "end_t")
    return present(pe.oscillation_cycles(s, fl, ["day"], band=(4, 12), least=6, width=14400))


FREQS = pe.frequency_grid(1 / 48, 1 / 3, 40)


_LS = """SELECT day, f_no, freq, CASE WHEN yy > 1e-12 THEN (CASE WHEN a * a * cc + 2 * a * b * cs + b * b * ss > 1e-12 THEN pow(a * yc + b * ys, 2) / (a * a * cc + 2 * a * b * cs + b * b * ss) ELSE 0 END + CASE WHEN a * a * ss - 2 * a * b * cs + b * b * cc > 1e-12 THEN pow(a * ys - b * yc, 2) / (a * a * ss - 2 * a * b * cs + b * b * cc) ELSE 0 END) / yy ELSE 0 END AS power FROM (
  SELECT *, cos(0.5 * atan2(2 * cs, cc - ss)) AS a, sin(0.5 * atan2(2 * cs, cc - ss)) AS b FROM (
  SELECT day, f_no, freq, sum(y * cos(2 * pi() * freq * bin)) AS yc, sum(y * sin(2 * pi() * freq * bin)) AS ys, sum(pow(cos(2 * pi() * freq * bin), 2)) AS cc, sum(pow(sin(2 * pi() * freq * bin), 2)) AS ss, sum(cos(2 * pi() * freq * bin) * sin(2 * pi() * freq * bin)) AS cs, sum(y * y) AS yy
  FROM (SELECT day, bin, view - avg(view) OVER (PARTITION BY day) AS y FROM wide WHERE view IS NOT NULL), fg GROUP BY day, f_no, freq))"""
_LSC = WIDE + f", fg AS (SELECT unnest(range({len(FREQS)})) AS f_no, unnest([{', '.join(map(repr, FREQS))}]) AS freq)"


@query("lomb_scargle", final(_LS, "day, f_no", "freq power", _LSC))
def _ls(spark, sf):
    return present(pe.lomb_scargle(wide(spark, sf), ["day"], "view", "bin", FREQS))


@query("top_periods", final(f"SELECT day, rank, 1.0 / freq AS period, power FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY power DESC, f_no) AS rank FROM ({_LS})) WHERE rank <= 3", "day, rank", "period power", _LSC))
def _top(spark, sf):
    return present(pe.top_periods(pe.lomb_scargle(wide(spark, sf), ["day"], "view", "bin", FREQS), ["day"]))


def pulsation_sql(src: str, keys: str, longest: float, shortest: float, n_freqs: int, least: int, size: int) -> str:
    """CTEs up to ``qp`` (keys, detected, period, amplitude, significance, n_periods) over ``src`` (keys, bin, v); ``size`` bounds the rows of a key."""
    grid = pe.frequency_grid(1 / longest, 1 / shortest, n_freqs)
    scales = pe.scale_grid(shortest / 4, longest)
    width = max(2, int(3 * longest))
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    k = lambda a: ", ".join(f"{a}.{c}" for c in keys.split(", "))
    return f"""qn AS (SELECT *, count(*) OVER (PARTITION BY {keys}) AS n FROM {src}),
qx AS (SELECT {keys}, bin, v, v - avg(v) OVER (PARTITION BY {keys} ORDER BY bin ROWS BETWEEN {width // 2} PRECEDING AND {width - width // 2 - 1} FOLLOWING) AS x FROM qn WHERE n >= {least}),
qy AS (SELECT {keys}, bin, v, x, x - avg(x) OVER w AS y, CASE WHEN stddev_pop(x) OVER w < 1e-10 THEN 0 ELSE (x - avg(x) OVER w) / stddev_pop(x) OVER w END AS z FROM qx WINDOW w AS (PARTITION BY {keys})),
qf AS (SELECT unnest(range({n_freqs})) AS f_no, unnest([{', '.join(map(repr, grid))}]) AS freq),
qt AS (SELECT {keys}, f_no, freq, sum(y * cos(2 * pi() * freq * bin)) AS yc, sum(y * sin(2 * pi() * freq * bin)) AS ys, sum(pow(cos(2 * pi() * freq * bin), 2)) AS cc, sum(pow(sin(2 * pi() * freq * bin), 2)) AS ss,
  sum(cos(2 * pi() * freq * bin) * sin(2 * pi() * freq * bin)) AS cs, sum(y * y) AS yy FROM qy, qf GROUP BY {keys}, f_no, freq),
qa AS (SELECT *, cos(0.5 * atan2(2 * cs, cc - ss)) AS a, sin(0.5 * atan2(2 * cs, cc - ss)) AS b FROM qt),
ql AS (SELECT {keys}, f_no, freq, CASE WHEN yy > 1e-12 THEN (CASE WHEN a * a * cc + 2 * a * b * cs + b * b * ss > 1e-12 THEN pow(a * yc + b * ys, 2) / (a * a * cc + 2 * a * b * cs + b * b * ss) ELSE 0 END
  + CASE WHEN a * a * ss - 2 * a * b * cs + b * b * cc > 1e-12 THEN pow(a * ys - b * yc, 2) / (a * a * ss - 2 * a * b * cs + b * b * cc) ELSE 0 END) / yy ELSE 0 END AS p FROM qa),
qk AS (SELECT *, coalesce(p > lag(p) OVER w AND p > lead(p) OVER w AND p >= 0.285, false) AS peak, row_number() OVER (PARTITION BY {keys} ORDER BY p DESC, f_no) AS place FROM ql WINDOW w AS (PARTITION BY {keys} ORDER BY f_no)),
qm AS (SELECT *, bool_or(peak) OVER (PARTITION BY {keys}) AS found FROM qk),
qs AS (SELECT {keys}, max(p) AS ls_max, list_sort(coalesce(list(1.0 / freq) FILTER (peak OR (NOT found AND place = 1 AND p > 0.285)), [])) AS ls FROM qm GROUP BY {keys}),
qc AS (SELECT unnest(range({len(scales)})) AS sn, unnest([{', '.join(map(repr, scales))}]) AS s),
qw AS (SELECT sn, s, lag, pow(pi(), -0.25) / sqrt(s) * cos(6.0 * lag / s) * exp(-0.5 * pow(lag / s, 2)) AS w FROM qc, (SELECT CAST(range AS BIGINT) - {size // 2} AS lag FROM range({size}))),
qo AS (SELECT {k('c')}, sn, s, c.bin, pow(sum(x.z * w), 2) AS pw FROM qy c JOIN qw ON true JOIN qy x ON {on('x', 'c')} AND x.bin = c.bin + qw.lag GROUP BY {k('c')}, sn, s, c.bin),
qg AS (SELECT {keys}, sn, 4 * pi() * s / 6.0 AS period, avg(pw) AS g FROM qo GROUP BY {keys}, sn, s),
qh AS (SELECT *, coalesce(g > lag(g) OVER w AND g > lead(g) OVER w AND g >= 0.3 * max(g) OVER (PARTITION BY {keys}), false) AS peak FROM qg WINDOW w AS (PARTITION BY {keys} ORDER BY sn)),
qv AS (SELECT {keys}, list_sort(coalesce(list(period) FILTER (peak), [])) AS wv, arg_max(period, g) FILTER (period BETWEEN {shortest} AND {longest}) AS best FROM qh GROUP BY {keys}),
qb AS (SELECT {k('qs')}, ls_max, best, list_sort(list_transform(ls, lambda l: coalesce((l + list_filter(wv, lambda q: abs(l - q) / greatest(l, q) < 0.2)[1]) / 2, l))) AS every FROM qs JOIN qv ON {on('qs', 'qv')}),
qu AS (SELECT *, list_filter(list_reduce(list_prepend([]::DOUBLE[], list_transform(every, lambda q: [q])), lambda acc, q: CASE WHEN len(acc) = 0 OR abs(q[1] - acc[-1]) / q[1] > 0.1 THEN list_concat(acc, q) ELSE acc END), lambda q: q <= 0.9 * {longest}) AS periods FROM qb),
qd AS (SELECT *, coalesce(periods[1], best, 0) AS period FROM qu),
qr AS (SELECT {k('qy')}, CAST(floor((bin - period * floor(bin / period)) / period * 20) AS BIGINT) % 20 AS ph, avg(x) AS f, sum(v) AS sv, count(*) AS c FROM qy JOIN qd ON {on('qy', 'qd')} WHERE period > 0 GROUP BY {k('qy')}, ph),
qe AS (SELECT {keys}, ((CASE WHEN count(*) < 20 THEN greatest(max(f), 0) ELSE max(f) END) - (CASE WHEN count(*) < 20 THEN least(min(f), 0) ELSE min(f) END)) / greatest(sum(sv) / sum(c), 1e-10) AS amp FROM qr GROUP BY {keys}),
qp AS (SELECT {k('qd')}, CASE WHEN len(periods) > 0 THEN 1 ELSE 0 END AS detected, period, greatest(coalesce(amp, 0), 0) AS amplitude, ls_max AS significance, len(periods) AS n_periods FROM qd LEFT JOIN qe ON {on('qd', 'qe')}
  UNION ALL SELECT DISTINCT {keys}, 0, 0, 0, 0, 0 FROM qn WHERE n < {least})"""


_QV = ", qv0 AS (SELECT day, bin, coalesce(view, 0) AS v FROM wide), "


@query("pulsations_day", final("SELECT * FROM qp", "day, " + big("detected", "n_periods"), "period amplitude significance", WIDE + _QV + pulsation_sql("qv0", "day", 24.0, 3.0, 80, 50, BINS), digits=5))
def _qpp_day(spark, sf):
    w = wide(spark, sf).withColumn("pos", F.col("bin"))
    return present(pe.detect_pulsations(w, ["day"], "view", 1.0, 3.0, 24.0, n_freqs=80), 5)


@query("pulsations_window", final(
    "SELECT * FROM qp", "day, win, " + big("detected", "n_periods"), "period amplitude significance",
    WIDE + ", qv0 AS (SELECT day, win, bin - win * 24 AS bin, coalesce(view, 0) AS v FROM wide JOIN (SELECT CAST(range AS BIGINT) AS win FROM range(4)) ON bin >= win * 24 AND bin < win * 24 + 60), " + pulsation_sql("qv0", "day, win", 12.0, 3.0, 40, 50, 60), digits=5))
def _qpp_window(spark, sf):
    rows = wi.hop(wide(spark, sf), BINS, 60, 24)
    return present(pe.detect_pulsations(rows, ["day", "win"], "view", 1.0, 3.0, 12.0, n_freqs=40), 5)


@query("pulsations_flare")
def _qpp_flare(spark, sf):
    from ..operators.intervals import range_join
    from pyspark.sql.window import Window

    fl = swpc(spark, sf, only="view").select("day", F.col("start_t").alias("flare"), (F.col("start_t") - 18000).alias("a"), (F.col("end_t") + 18000).alias("b"))
    rows = range_join(wide(spark, sf).select("day", "t", "view"), fl, "t", "a", "b", 43200, on=("day",))
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("day", "flare").orderBy("t")) - 1)
    found = pe.detect_pulsations(rows, ["day", "flare"], "view", 1.0, 3.0, 12.0, n_freqs=40, least=30)
    series = wide(spark, sf)
    whole = pe.detect_pulsations(series.withColumn("pos", F.col("bin")), ["day"], "view", 1.0, 3.0, 12.0, n_freqs=40)
    return present(pe.with_fallback(pe.best_per_group(found.drop("flare"), ["day"]), whole, ["day"]))


def _welch_sql(n: int, cap: int) -> str:
    m = min(cap, n // 2)
    hopn = m - m // 2
    segs = (n - m) // hopn + 1
    return f"""sg AS (SELECT day, win, g.seg, pos - g.seg * {hopn} AS j, v FROM ws JOIN (SELECT CAST(range AS BIGINT) AS seg FROM range({segs})) g ON pos >= g.seg * {hopn} AND pos < g.seg * {hopn} + {m}),
sd AS (SELECT day, win, seg, j, (v - avg(v) OVER (PARTITION BY day, win, seg)) * (0.5 - 0.5 * cos(2 * pi() * j / {m}.0)) AS x FROM sg),
ft AS (SELECT day, win, seg, k, pow(sum(x * cos(2 * pi() * k * j / {m}.0)), 2) + pow(sum(x * sin(2 * pi() * k * j / {m}.0)), 2) AS p FROM sd, (SELECT CAST(range AS BIGINT) AS k FROM range({m // 2 + 1})) GROUP BY ALL),
ps AS (SELECT day, win, k, avg(p) * CASE WHEN k = 0 OR 2 * k = {m} THEN 1 ELSE 2 END / (SELECT sum(pow(0.5 - 0.5 * cos(2 * pi() * r / {m}.0), 2)) FROM (SELECT range AS r FROM range({m}))) AS psd FROM ft GROUP BY day, win, k)"""


@query("welch_entropy", final(
    f"SELECT day, win, -sum(q * ln(q + 1e-30)) AS entropy, arg_max(k, psd) / ({LOOK // 4 + 1} + 1e-10) AS peak_freq FROM (SELECT *, psd / (sum(psd) OVER (PARTITION BY day, win) + 1e-10) AS q FROM ps) GROUP BY day, win",
    "day, win", "entropy peak_freq", BANDED + ", ws AS (SELECT day, win, pos, coalesce(soft, 0) AS v FROM hp), " + _welch_sql(LOOK, 256), digits=5))
def _welch(spark, sf):
    rows = wi.hop(banded(spark, sf).select("day", "bin", "soft"), BINS, LOOK, STEP)
    arr = pe.arrays_of(rows, ["day", "win"], ["soft"], "pos")
    return present(arr.withColumn("w", pe.welch_shape("soft", F.lit(256))).select("day", "win", "w.entropy", "w.peak_freq"), 5)


@query("acf_period", final(
    """SELECT day, CAST(greatest(coalesce(min(lag) FILTER (lag >= 1 AND lag <= half - 2 AND a < pa AND a < na AND a <= 0.5), min(lag) FILTER (lag >= 1 AND a * pa <= 0), 100), 2) AS BIGINT) AS period FROM (
  SELECT day, lag, n // 2 AS half, a, lag(a) OVER w AS pa, lead(a) OVER w AS na FROM (SELECT x.day, l.lag, max(x.n) AS n, coalesce(sum(x.c * y.c), 0) / max(x.t) AS a FROM (SELECT *, sum(c * c) OVER (PARTITION BY day) AS t, count(*) OVER (PARTITION BY day) AS n, row_number() OVER (PARTITION BY day ORDER BY bin) AS k FROM ac) x
   JOIN (SELECT CAST(range AS BIGINT) AS lag FROM range(144)) l ON l.lag < x.n LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY day ORDER BY bin) AS k FROM ac) y ON y.day = x.day AND y.k = x.k + l.lag WHERE x.n >= 20 GROUP BY x.day, l.lag) WINDOW w AS (PARTITION BY day ORDER BY lag)) GROUP BY day""",
    "day, period", "", WIDE + ", ac AS (SELECT day, bin, view - avg(view) OVER (PARTITION BY day) AS c FROM wide WHERE view IS NOT NULL)"))
def _acf(spark, sf):
    return present(pe.acf_period(wide(spark, sf), ["day"], "view", least=20, floor=2))
