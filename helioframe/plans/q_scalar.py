"""Queries: clocks, corrections, classes, temperature, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions.output import present
from ..sources.lightcurve import bin_samples, linear_energy, spectra
from ..sources.tables import table
from .fixtures import CADENCE, LC, WIDE, big, final, wide
from .registry import query

SPEC = """spec AS (SELECT vec_id AS id, label, CAST(i - 1 AS BIGINT) AS ch, round(abs(CAST(embedding[i] AS DOUBLE)) * 100.0, 2) AS counts
  FROM embeddings, (SELECT CAST(range AS BIGINT) + 1 AS i FROM range(64)) g WHERE i <= len(embedding))"""


def spec(spark, sf):
    """Spectra as the stand-in instrument reads them out, in steps of 0.01."""
    counts = spectra(table(spark, sf, "embeddings"))
    return counts.withColumn("counts", F.round("counts", 2)).withColumn("label", F.col("label").cast("bigint"))


@query("met_mjd_unix", final(
    "SELECT event_id, floor(epoch(ts)) AS s, 40587 + (floor(epoch(ts)) - 0.0) / 86400.0 AS mjd FROM events",
    "event_id, CAST(round((mjd - 40587) * 86400.0) AS BIGINT) AS unix_back", "mjd"))
def _clock(spark, sf):
    ev = table(spark, sf, "events").select("event_id", sc.met_to_mjd(sc.epoch_seconds("ts")).alias("mjd"))
    return present(ev.withColumn("unix_back", F.round(sc.mjd_to_unix("mjd")).cast("bigint")))


TAU = 1e-3
_NEWTON = f"""list_reduce(list_prepend(least(value * 1.5, {0.99 / TAU}), [0.0 FOR _ IN range(50)]),
  lambda n, z: least(greatest(n - CASE WHEN abs(exp(-n * {TAU}) * (1 - n * {TAU})) > 1e-12
    THEN (n * exp(-n * {TAU}) - value) / (exp(-n * {TAU}) * (1 - n * {TAU})) ELSE 0 END, value), {0.999 / TAU}))"""


@query("deadtime", final(
    f"SELECT event_id, CASE WHEN value <= 0 THEN 0.0 WHEN value > {1 / (2.718281828459045 * TAU)} THEN NULL ELSE {_NEWTON} END AS true_rate, CASE WHEN value > {1 / (2.718281828459045 * TAU)} THEN 1 ELSE 0 END AS saturated FROM events",
    "event_id, CAST(saturated AS BIGINT) AS saturated", "true_rate"))
def _deadtime(spark, sf):
    ev = table(spark, sf, "events")
    return present(ev.select("event_id", sc.deadtime_true_rate("value", TAU).alias("true_rate"),
                             sc.deadtime_saturated("value", TAU).cast("bigint").alias("saturated")))


# detector/band roles: supplier nation -> band, region parity -> detector
@query("correction_stats", final(
    f"""SELECT event_type AS channel, max(pct) AS max_pct, avg(pct) AS mean_pct, 100 * sum(least(value, bg)) / sum(value) AS bg_pct, avg(net) AS mean_net, count(*) AS n FROM (
  SELECT *, value - greatest(value - bg, 0) AS taken, greatest(value - bg, 0) AS net, CASE WHEN value > 0 THEN (tr / value - 1) * 100 ELSE 0 END AS pct FROM (
  SELECT event_type, value, CASE event_type WHEN 'click' THEN 15.0 WHEN 'purchase' THEN 12.0 WHEN 'signup' THEN 8.0 WHEN 'error' THEN 5.0 ELSE 0.15 END AS bg,
    {_NEWTON.replace(str(TAU), '0.0001').replace(str(0.99 / TAU), str(0.99 / 1e-4)).replace(str(0.999 / TAU), str(0.999 / 1e-4))} AS tr FROM events)) GROUP BY 1""",
    "channel, n", "max_pct mean_pct bg_pct mean_net"))
def _corrections(spark, sf):
    levels = dict(zip(["click", "purchase", "signup", "error"], sc.HARD_BACKGROUND["czt"]))
    bg = sc.choose([(F.col("event_type") == k, v) for k, v in levels.items()], sc.HARD_BACKGROUND["cdte"][0])
    ev = table(spark, sf, "events").select(F.col("event_type").alias("channel"), "value", bg.alias("bg"),
                                           sc.deadtime_true_rate("value", 1e-4).alias("tr"))
    pct = F.when(F.col("value") > 0, (F.col("tr") / F.col("value") - 1) * 100).otherwise(0.0)
    net = sc.subtract_floor("value", F.col("bg"))
    return present(ev.groupBy("channel").agg(
        F.max(pct).alias("max_pct"), F.avg(pct).alias("mean_pct"),
        (100 * F.sum(F.least("value", "bg")) / F.sum("value")).alias("bg_pct"), F.avg(net).alias("mean_net"),
        F.count(F.lit(1)).alias("n")))


@query("background_floor", final(
    "SELECT event_id, greatest(value - 50.0, 0) AS soft_net, greatest(value - CASE event_type WHEN 'click' THEN 15.0 WHEN 'purchase' THEN 12.0 WHEN 'signup' THEN 8.0 WHEN 'error' THEN 5.0 ELSE 70.0 END, 0) AS hard_net FROM events",
    "event_id", "soft_net hard_net"))
def _floor(spark, sf):
    levels = dict(zip(["click", "purchase", "signup", "error", "view"], sc.HARD_BACKGROUND["czt"]))
    bg = sc.choose([(F.col("event_type") == k, v) for k, v in levels.items()])
    return present(table(spark, sf, "events").select(
        "event_id", sc.subtract_floor("value", 50.0).alias("soft_net"), sc.subtract_floor("value", bg).alias("hard_net")))


_CLS = "CASE WHEN {x} >= 1e-4 THEN 'X' WHEN {x} >= 1e-5 THEN 'M' WHEN {x} >= 1e-6 THEN 'C' WHEN {x} >= 1e-7 THEN 'B' ELSE 'A' END"


@query("irradiance_class", final(
    f"SELECT event_id, value * 2.5e-8 * 1e6 AS micro_flux, {_CLS.format(x='(value * 2.5e-8)')} AS class FROM events", "event_id, class", "micro_flux"))
def _irradiance(spark, sf):
    return present(table(spark, sf, "events").select(
        "event_id", (sc.counts_to_irradiance("value") * 1e6).alias("micro_flux"), sc.event_class("value").alias("class")))


_BASE = "CASE {c} WHEN 'X' THEN 1e-4 WHEN 'M' THEN 1e-5 WHEN 'C' THEN 1e-6 WHEN 'B' THEN 1e-7 ELSE 1e-8 END"


@query("class_text", final(
    f"""SELECT event_id, label, x / base AS level, base * CAST(substr(label, 2) AS DOUBLE) * 1e6 AS parsed, (base + base * CAST(substr(label, 2) AS DOUBLE)) * 1e6 AS legacy,
  CASE letter WHEN 'X' THEN 100.0 WHEN 'M' THEN 10.0 WHEN 'C' THEN 1.0 WHEN 'B' THEN 0.1 ELSE 0.001 END * CAST(substr(label, 2) AS DOUBLE) AS number FROM (
  SELECT event_id, x, letter, base, letter || printf('%.2f', x / base) AS label FROM (
  SELECT *, {_BASE.format(c='letter')} AS base FROM (SELECT event_id, value * 2.7182818e-8 AS x, {_CLS.format(x='(value * 2.7182818e-8)')} AS letter FROM events)))""",
    "event_id, label", "parsed legacy number"))
def _class_text(spark, sf):
    ev = table(spark, sf, "events").select("event_id", sc.class_label(sc.counts_to_irradiance("value", 2.7182818e-8), 2).alias("label"))
    return present(ev.select("event_id", "label", (sc.parse_class("label") * 1e6).alias("parsed"),
                             (sc.parse_class("label", standard=False) * 1e6).alias("legacy"), sc.class_number("label").alias("number")))


_RT = """SELECT *, CASE WHEN fa IS NULL OR fb IS NULL OR fa < 5e-8 OR fb < 1e-7 THEN NULL ELSE least(greatest(pow(10.0, 0.051 + 0.979 * w + 0.184 * w * w - 0.010 * w * w * w), 3.0), 50.0) END AS temp FROM (
  SELECT *, log10(least(greatest(greatest(fb, 5e-8) / greatest(fa, 2e-8), 1.05), 35.0)) AS w FROM (
  SELECT day, bin, click * 1e-8 AS fa, view * 1e-7 AS fb FROM wide))"""


@query("tem_from_ratio", final(
    f"SELECT day, bin, temp, least(greatest(greatest(fb, 5e-8) * 1e5 * sqrt(temp) * exp(17.0 / temp), 0.001), 1e4) + temp * 0 AS em FROM ({_RT})",
    "day, bin", "temp em", WIDE))
def _tem(spark, sf):
    w = wide(spark, sf).select("day", "bin", (F.col("click") * 1e-8).alias("fa"), (F.col("view") * 1e-7).alias("fb"))
    return present(w.select("day", "bin", sc.ratio_temperature("fa", "fb").alias("temp"), sc.ratio_emission_measure("fa", "fb").alias("em")))


@query("hardness_ratios", final(
    """SELECT day, bin, CASE WHEN view > 0 THEN click / view ELSE 0.0 END AS plain,
  CASE WHEN purchase > 0 AND error >= 0 THEN least(greatest(error / purchase, 1e-3), 1e3) END AS hr_41,
  CASE WHEN signup > 0 AND error >= 0 THEN least(greatest(error / signup, 1e-3), 1e3) END AS hr_42,
  CASE WHEN purchase > 0 AND signup >= 0 THEN least(greatest(signup / purchase, 1e-3), 1e3) END AS hr_21,
  coalesce(click, 0) + coalesce(purchase, 0) + coalesce(signup, 0) + coalesce(error, 0) AS full_band FROM wide""",
    "day, bin", "plain hr_41 hr_42 hr_21 full_band", WIDE))
def _hardness(spark, sf):
    w = wide(spark, sf)
    z = [F.coalesce(F.col(c), F.lit(0.0)) for c in ("click", "purchase", "signup", "error")]
    return present(w.select(
        "day", "bin", sc.ratio("click", "view", 0.0).alias("plain"), sc.clipped_ratio("error", "purchase").alias("hr_41"),
        sc.clipped_ratio("error", "signup").alias("hr_42"), sc.clipped_ratio("signup", "purchase").alias("hr_21"),
        (z[0] + z[1] + z[2] + z[3]).alias("full_band")))


@query("alert_level", final(
    """SELECT channel, alert, count(*) AS n FROM (SELECT event_type AS channel, CASE WHEN value > 300 THEN 'FLARE NOW' WHEN value / 200.0 > 0.9 THEN 'RED' WHEN value / 200.0 > 0.7 THEN 'ORANGE'
  WHEN value / 100.0 > 0.6 THEN 'YELLOW' ELSE 'GREEN' END AS alert FROM events) GROUP BY ALL""", "channel, alert, n"))
def _alert(spark, sf):
    ev = table(spark, sf, "events").select(
        F.col("event_type").alias("channel"),
        sc.alert_level(F.col("value") / 200.0, F.col("value") / 100.0, F.col("value") > 300).alias("alert"))
    return present(ev.groupBy("channel", "alert").agg(F.count(F.lit(1)).alias("n")))


@query("day_irradiance", final(
    """SELECT id, label, sum(CASE WHEN 1.0 + ch * 0.25 BETWEEN 1.55 * 0.95 AND 12.4 * 1.05 THEN counts ELSE 0 END) * 2.5e-8 * 1e6 AS micro_flux FROM spec GROUP BY id, label""",
    "id, " + big("label"), "micro_flux", SPEC))
def _pi_flux(spark, sf):
    e = linear_energy("ch", 1.0, 0.25)
    inside = e.between(1.55 * 0.95, 12.4 * 1.05)
    s = spec(spark, sf).groupBy("id", "label").agg(
        (sc.counts_to_irradiance(F.sum(F.when(inside, F.col("counts")).otherwise(0.0))) * 1e6).alias("micro_flux"))
    return present(s)


@query("photon_models", final(
    """SELECT label, ch, avg(counts) AS mean_counts, avg((label + 1) / e * exp(-e / (0.08617 * (10 + label)))) AS thermal, avg(2.0 * pow(e, -3.0)) AS power,
  avg(CASE WHEN e >= 8.0 THEN pow(e, -3.0) ELSE pow(8.0, -3.0) * exp(-(8.0 - e) / 8.0) END) AS thick, avg(100 * pow(5.0, -(2.0 + label)) / (2.0 + label)) AS electrons
  FROM (SELECT *, 1.0 + ch * 0.25 AS e FROM spec) GROUP BY label, ch""", big("label") + ", ch", "mean_counts thermal power thick electrons", SPEC))
def _models(spark, sf):
    s = spec(spark, sf).withColumn("e", linear_energy("ch", 1.0, 0.25))
    label = F.col("label")
    return present(s.groupBy("label", "ch").agg(
        F.avg("counts").alias("mean_counts"),
        F.avg(sc.isothermal_photons("e", label + 1, label + 10)).alias("thermal"),
        F.avg(sc.power_law_photons("e", F.lit(2.0), F.lit(3.0))).alias("power"),
        F.avg(sc.thick_target_photons("e", F.lit(1.0), F.lit(3.0), F.lit(8.0))).alias("thick"),
        F.avg(sc.electron_column(F.lit(100.0), label + 3, F.lit(5.0))).alias("electrons")))


@query("sample_binning", final("SELECT * FROM binned", "channel, day, bin, n", "v lo hi", LC))
def _binning(spark, sf):
    return present(bin_samples(table(spark, sf, "events"), CADENCE), 3)


@query("common_grid", final("SELECT * FROM wide", "day, bin, t", "view click purchase signup error", WIDE))
def _grid(spark, sf):
    return present(wide(spark, sf))
