"""Queries: reference flux, channel layout, dead time per detector, version and band consistency, windowed information."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions.output import present
from ..operators import information as inf
from ..operators import periodicity as pe
from ..operators import quality as qu
from ..operators import windows as wi
from ..sources import reference as rf
from ..sources.tables import table
from .fixtures import BINS, CADENCE, CHANNELS, WIDE, big, final, wide
from .q_match import EV
from .q_windows import BANDED, LOOK, STEP, banded
from .registry import query

#: The stand-in series counts seconds from its own epoch, 2000-01-01 12:00, and dips below zero.
EPOCH_UNIX = 946728000
DIP = 20.0


def flux(spark, sf):
    ev = table(spark, sf, "events").where(F.col("event_type").isin("purchase", "signup"))
    raw = lambda c: F.when(F.col("event_type") == c, (F.col("value") - DIP) * 1e-8)
    return rf.reference_flux(ev.select((sc.epoch_seconds("ts") - EPOCH_UNIX).alias("time"), raw("purchase").alias("xrsb_flux"), raw("signup").alias("xrsa_flux")))


_RFX = f"""rx AS (SELECT CAST(ts AS DATE) AS day, CAST(floor(epoch(ts)) AS BIGINT) AS t, CASE WHEN event_type = 'purchase' AND value >= {DIP} THEN (value - {DIP}) * 1e-8 END AS xrsb, CASE WHEN event_type = 'signup' AND value >= {DIP} THEN (value - {DIP}) * 1e-8 END AS xrsa
  FROM events WHERE event_type IN ('purchase', 'signup'))"""


@query("reference_source", final(
    "SELECT day, count(*) AS rows, count(xrsb) AS known_b, count(xrsa) AS known_a, min(t) AS first_t, max(t) AS last_t, min(t) / 86400.0 + 40587 AS first_mjd, sum(xrsb) * 1e6 AS micro_b, sum(xrsa) * 1e6 AS micro_a FROM rx GROUP BY day",
    "day, rows, known_b, known_a, first_t, last_t", "first_mjd micro_b micro_a", _RFX))
def _source(spark, sf):
    f = flux(spark, sf).groupBy("day").agg(
        F.count(F.lit(1)).alias("rows"), F.count("xrsb").alias("known_b"), F.count("xrsa").alias("known_a"), F.min("t").alias("first_t"), F.max("t").alias("last_t"),
        F.min("mjd").alias("first_mjd"), (F.sum("xrsb") * 1e6).alias("micro_b"), (F.sum("xrsa") * 1e6).alias("micro_a"))
    return present(f)


def _filled(c: str, scale: str) -> str:
    """Gaps of a grid column by the line between the known neighbours, 0 outside."""
    return f"coalesce({c}, {c}p + ({c}n - {c}p) * (bin - {c}pb) / ({c}nb - {c}pb), 0){scale}"


def _around(c: str) -> str:
    return (f"last_value({c} IGNORE NULLS) OVER a AS {c}p, last_value(CASE WHEN {c} IS NOT NULL THEN bin END IGNORE NULLS) OVER a AS {c}pb, "
            f"first_value({c} IGNORE NULLS) OVER z AS {c}n, first_value(CASE WHEN {c} IS NOT NULL THEN bin END IGNORE NULLS) OVER z AS {c}nb")


_RG = _RFX + f""",
rb AS (SELECT day, (t % 86400) // {CADENCE} AS bin, avg(xrsb) AS b, avg(xrsa) AS a FROM rx GROUP BY ALL),
rs AS (SELECT g.day, g.bin, b, a FROM (SELECT * FROM (SELECT DISTINCT day FROM rx), (SELECT CAST(range AS BIGINT) AS bin FROM range({BINS}))) g LEFT JOIN rb ON rb.day = g.day AND rb.bin = g.bin),
rn AS (SELECT *, {_around('b')}, {_around('a')} FROM rs WINDOW a AS (PARTITION BY day ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY day ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
rg AS (SELECT day, bin, {_filled('b', '')} AS xrsb, {_filled('a', '')} AS xrsa FROM rn)"""


@query("reference_grid", final("SELECT day, bin, xrsb * 1e8 AS b, xrsa * 1e8 AS a FROM rg", "day, bin", "b a", _RG))
def _grid(spark, sf):
    g = rf.on_grid(flux(spark, sf), CADENCE)
    return present(g.select("day", "bin", (F.col("xrsb") * 1e8).alias("b"), (F.col("xrsa") * 1e8).alias("a")))


CZT, CDTE = ["b0", "b1", "b2", "b3", "b4"], ["b5", "b6", "b7"]


@query("channel_layout", final(
    "SELECT bd.day, bd.bin, coalesce(soft, 0) AS ch0, " + ", ".join(f"greatest(coalesce({c}, 0) - {level}, 0) AS ch{k}" for c, level, k in zip(CZT, sc.HARD_BACKGROUND["czt"], (1, 2, 3, 4, 8)))
    + ", " + ", ".join(f"greatest(coalesce({c}, 0) - {level}, 0) AS ch{k}" for c, level, k in zip(CDTE, sc.HARD_BACKGROUND["cdte"], (5, 6, 7)))
    + ", coalesce(xrsb, 0) * 1e8 AS ch9, coalesce(xrsa, 0) * 1e8 AS ch10, coalesce(coalesce(soft, 0) - lag(coalesce(soft, 0)) OVER (PARTITION BY bd.day ORDER BY bd.bin), 0) AS ch11 FROM bd LEFT JOIN rg ON rg.day = bd.day AND rg.bin = bd.bin",
    "day, bin", " ".join(f"ch{k}" for k in range(12)), BANDED + ", " + _RG))
def _layout(spark, sf):
    """Soft band, background-corrected hard bands and the reference flux in their twelve places."""
    grid = banded(spark, sf)
    rows = [("sxr", 0, F.col("soft"))]
    for det, names in (("czt", CZT), ("cdte", CDTE)):
        rows += [(det, k, sc.subtract_floor(c, level)) for k, (c, level) in enumerate(zip(names, sc.HARD_BACKGROUND[det]))]
    parts = F.inline(F.array(*[F.struct(F.lit(d).alias("detector"), F.lit(k).alias("band"), v.cast("double").alias("v")) for d, k, v in rows]))
    ref = F.inline(F.array(*[F.struct(F.lit(c).alias("detector"), F.lit(0).alias("band"), (F.col(c) * 1e8).alias("v")) for c in ("xrsb", "xrsa")]))
    long = grid.select("day", "bin", parts).unionByName(rf.on_grid(flux(spark, sf), CADENCE).select("day", "bin", ref))
    days = grid.select("day").distinct()
    return present(rf.channel_layout(long.join(days, "day", "left_semi")))


# -- corrections per detector ------------------------------------------------------------------------------------
TAUS = {"view": 13.65e-6, "click": sc.DEADTIME_CZT, "purchase": sc.DEADTIME_CDTE}
_TAU = "CASE event_type " + " ".join(f"WHEN '{c}' THEN {t!r}" for c, t in TAUS.items()) + " END"


@query("deadtime_by_detector", final(
    f"""SELECT detector, count(*) AS n, sum(saturated) AS saturated, max(pct) AS max_pct, avg(pct) AS mean_pct FROM (SELECT event_type AS detector, CASE WHEN rate > 1 / (exp(1) * tau) THEN 1 ELSE 0 END AS saturated,
  (list_reduce(list_prepend(rate, [0.0 FOR _ IN range(60)]), lambda n, z: rate * exp(n * tau)) / rate - 1) * 100 AS pct FROM (SELECT event_type, value * 20 AS rate, {_TAU} AS tau FROM events WHERE event_type IN ('view', 'click', 'purchase') AND value > 0)) GROUP BY detector""",
    "detector, n, " + big("saturated"), "max_pct mean_pct"))
def _taus(spark, sf):
    """Every detector has its own dead time; rates are twenty times the stored values."""
    ev = table(spark, sf, "events").where(F.col("event_type").isin(*TAUS) & (F.col("value") > 0)).select(F.col("event_type").alias("detector"), (F.col("value") * 20).alias("rate"))
    parts = [(tau, F.col("detector") == c) for c, tau in TAUS.items()]
    true = F.coalesce(*[F.when(is_it, sc.deadtime_true_rate("rate", tau)) for tau, is_it in parts])
    full = F.coalesce(*[F.when(is_it, sc.deadtime_saturated("rate", tau)) for tau, is_it in parts])
    d = ev.withColumn("pct", (true / F.col("rate") - 1) * 100).withColumn("saturated", full.cast("bigint"))
    return present(d.groupBy("detector").agg(F.count(F.lit(1)).alias("n"), F.sum("saturated").alias("saturated"), F.max("pct").alias("max_pct"), F.avg("pct").alias("mean_pct")))


@query("dual_channel", final(
    "SELECT day, quantile_cont(view, 0.5) AS median_a, quantile_cont(click, 0.5) AS median_b, avg(view) AS mean_a, avg(click) AS mean_b, avg(view / greatest(click, 1e-6)) AS mean_ratio, max(view) AS top_a, max(click) AS top_b FROM wide GROUP BY day",
    "day", "median_a median_b mean_a mean_b mean_ratio top_a top_b", WIDE))
def _dual(spark, sf):
    mid = lambda c: F.percentile(c, F.lit(0.5))  # noqa: E731 - a day's bins
    return present(wide(spark, sf).groupBy("day").agg(
        mid("view").alias("median_a"), mid("click").alias("median_b"), F.avg("view").alias("mean_a"), F.avg("click").alias("mean_b"),
        F.avg(F.col("view") / F.greatest("click", F.lit(1e-6))).alias("mean_ratio"), F.max("view").alias("top_a"), F.max("click").alias("top_b")))


# -- files and versions ---------------------------------------------------------------------------------------------
#: The second delivery of a day is clipped at this value.
CLIP = 190.0


def deliveries(spark, sf):
    ev = table(spark, sf, "events").where(F.col("event_type") == "view").select("event_id", F.to_date("ts").alias("day"), sc.epoch_seconds("ts").alias("t"), F.round(F.col("value") * 100).cast("bigint").alias("centi"))
    first = ev.withColumn("version", F.lit("V1"))
    return first.unionByName(ev.withColumn("version", F.lit("V2")).withColumn("centi", F.least("centi", F.lit(int(CLIP * 100)).cast("bigint"))))


_DV = f"""dv AS (SELECT event_id, day, t, CAST(round(value * 100) AS BIGINT) AS centi, 'V1' AS version FROM ev WHERE channel = 'view' UNION ALL SELECT event_id, day, t, least(CAST(round(value * 100) AS BIGINT), {int(CLIP * 100)}), 'V2' FROM ev WHERE channel = 'view'),
dh AS (SELECT day, version, md5(concat_ws('|', event_id, t, centi)) AS m FROM dv),
ck AS (SELECT day, version, count(*) AS rows, bit_xor(CAST('0x' || substr(m, 1, 15) AS BIGINT)) AS checksum, CAST(sum(CAST('0x' || substr(m, 16, 8) AS BIGINT)) AS BIGINT) AS total FROM dh GROUP BY day, version)"""


@query("content_checksums", final("SELECT * FROM ck", "day, version, rows, checksum, total", "", EV + ", " + _DV))
def _checksums(spark, sf):
    return present(qu.content_checksums(deliveries(spark, sf), ["day", "version"], ["event_id", "t", "centi"]))


@query("version_consistency", final(
    "SELECT day, count(DISTINCT version) AS versions, min(rows) AS fewest, max(rows) AS most, count(DISTINCT {'a': rows, 'b': checksum, 'c': total}) AS contents, CASE WHEN count(DISTINCT {'a': rows, 'b': checksum, 'c': total}) = 1 THEN 1 ELSE 0 END AS consistent FROM ck GROUP BY day",
    "day, versions, fewest, most, contents, " + big("consistent"), "", EV + ", " + _DV))
def _versions(spark, sf):
    found = qu.content_checksums(deliveries(spark, sf), ["day", "version"], ["event_id", "t", "centi"])
    return present(qu.version_consistency(found, ["day"]))


@query("version_summary", final(
    "SELECT version, count(DISTINCT day) AS days, count(*) AS rows, count(*) FILTER (centi IS NULL) AS missing, max(centi) AS top, quantile_cont(centi, 0.5) AS median FROM dv GROUP BY version",
    "version, days, rows, missing, top", "median", EV + ", " + _DV))
def _version_summary(spark, sf):
    return present(qu.version_summary(deliveries(spark, sf), "centi").withColumn("median", F.col("median").cast("double")))


_COUNTS = [f"count({c})" for c in CHANNELS]


@query("band_mismatch", final(
    f"""SELECT day, cov AS coverage_h, fewest, most, most - fewest AS difference, CASE WHEN most <> fewest THEN 1 ELSE 0 END AS mismatch, CASE WHEN cov < 2 THEN 1 ELSE 0 END AS is_short, CASE WHEN cov > 20 THEN 1 ELSE 0 END AS is_long FROM (
  SELECT day, (max(t) FILTER (coalesce({', '.join(CHANNELS)}) IS NOT NULL) - min(t) FILTER (coalesce({', '.join(CHANNELS)}) IS NOT NULL)) / 3600.0 AS cov, least({', '.join(_COUNTS)}) AS fewest, greatest({', '.join(_COUNTS)}) AS most FROM wide GROUP BY day)""",
    "day, fewest, most, difference, " + big("mismatch", "is_short", "is_long"), "coverage_h", WIDE))
def _mismatch(spark, sf):
    return present(qu.band_mismatch(wide(spark, sf), CHANNELS))
