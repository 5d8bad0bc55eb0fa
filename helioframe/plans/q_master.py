"""Queries: the master table of a day's windows, and the variant with the window that ends with the day."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.output import present
from ..functions.scalars import tidy
from ..operators.intervals import flag_upcoming
from ..operators import windows as wi
from ..operators.catalog import group_activity
from ..operators.windows import representative, window_features
from ..session import cut_lineage
from . import q_windows as qw
from .features import master_columns
from .fixtures import CADENCE, BINS, LC
from .q_detect import described_sql, swpc, swpc_sql
from .q_match import EV, TRUTH, truth
from .q_timed import window_spectral
from .q_windows import BANDED, BANDS, LOOK, STEP, TOP, banded
from .registry import ORACLES, query

#: family -> digits that its own query rounds to
FAMILIES = {"window_stats": 6, "window_rates": 6, "window_hard_rates": 6, "band_stats": 6, "band_ratios": 6, "multiscale": 5, "window_acf": 6}
SPECTRAL = ["sxr_temp_window", "sxr_em_window", "sxr_gamma_window", "hxr_gamma_window_czt1", "hxr_gamma_window_cdte1", "shs_index", "nonthermal_fraction_window"]
RAW = {"sxr_counts_raw": "soft", "hxr_czt1_full": "b4", "hxr_cdte1_full": "b9"}
HORIZON = 7200
NAMES = {"window_stats": qw._STATS.split(), "window_rates": qw._RATES.split(), "window_hard_rates": "dhxr_dt_mean dhxr_dt_std dhxr_dt_max dhr_dt_mean dhr_dt_max dsxr_dhxr_ratio_mean".split(),
         "band_stats": qw._BANDCOLS.split(), "band_ratios": qw._RATIOS.split(), "multiscale": qw._MULTI if isinstance(qw._MULTI, list) else qw._MULTI.split(), "window_acf": [f"sxr_acf_{k}s" for k in qw.LAGS]}

_E = "CAST(epoch(f.day) AS BIGINT)"
_AT = f"f.win * {STEP} + {LOOK}"
_TRUE = "list_reduce(list_prepend(coalesce(soft, 0.0), [0.0 FOR _ IN range(30)]), lambda n, z: coalesce(soft, 0.0) * exp(n * 13.65e-6))"
_MASTER = f"""WITH {BANDED}, {swpc_sql()[len(LC) + 2:].replace("ev AS (SELECT channel", "evs AS (SELECT channel").replace("FROM ev WHERE", "FROM evs WHERE")}, {EV},
fl AS ({described_sql('swpc')} WHERE channel = 'view'),
mw AS (SELECT day, win FROM ve GROUP BY day, win HAVING count(*) >= 5)
SELECT CAST(f.day AS VARCHAR) AS day, f.win, {_E} + ({_AT}) * {CADENCE} AS t, strftime(to_timestamp({_E} + ({_AT}) * {CADENCE}) AT TIME ZONE 'UTC', '%H:%M:%S') AS time_utc,
  coalesce(bd.soft, 0) AS sxr_counts_raw, {_TRUE} AS sxr_counts_corrected, coalesce(b4, 0) AS hxr_czt1_full, coalesce(b9, 0) AS hxr_cdte1_full, lv.peak AS day_sxr_peak, lv.mean AS day_sxr_mean,
  coalesce((SELECT class FROM fl WHERE fl.day = f.day AND {_AT} BETWEEN fl.start_bin AND fl.end_bin ORDER BY fl.start_bin LIMIT 1), 'none') AS flare_class,
  CAST(EXISTS (SELECT 1 FROM ev e WHERE e.channel = 'error' AND e.value >= {TRUTH} AND e.t > {_E} + ({_AT}) * {CADENCE} AND e.t <= {_E} + ({_AT}) * {CADENCE} + {HORIZON}) AS BIGINT) AS label
FROM mw f LEFT JOIN bd ON bd.day = f.day AND bd.bin = {_AT} JOIN (SELECT day, max(soft) AS peak, avg(soft) AS mean FROM bd GROUP BY day) lv ON lv.day = f.day"""


def _sql() -> str:
    rounded = ", ".join(f"round({c} + 1e-9, 5) + 0.0 AS {c}" for c in ("sxr_counts_raw", "sxr_counts_corrected", "hxr_czt1_full", "hxr_cdte1_full", "day_sxr_peak", "day_sxr_mean"))
    families = ", ".join(f"{name}.{c}" for name, cols in NAMES.items() for c in cols)
    spectral = ", ".join(f"coalesce(sp.{c}, 0) AS {c}" for c in SPECTRAL)
    joins = " ".join(f"JOIN ({ORACLES[name]}) AS {name} ON {name}.day = m.day AND {name}.win = m.win" for name in NAMES)
    return f"""SELECT m.day, m.win, m.t, m.time_utc, m.flare_class, CAST(m.flare_class <> 'none' AS BIGINT) AS in_flare, m.label, {rounded}, {families}, {spectral}
FROM ({_MASTER}) AS m {joins} LEFT JOIN ({ORACLES['window_spectral']}) AS sp ON sp.day = m.day AND sp.win = m.win"""


def master(spark, sf):
    """Statistical and spectral features, samples, flare and day columns and the label of every window."""
    grid = cut_lineage(banded(spark, sf), "grid")
    f = window_features(grid, "soft", BANDS, rows_per_day=BINS, lookback=LOOK, step=STEP, acf_lags=qw.LAGS, scales=qw.SCALES, short=6, long=18)
    f = f.join(window_spectral(spark, sf).select("day", "win", *SPECTRAL), ["day", "win"], "left").fillna(0.0, SPECTRAL)
    flares = swpc(spark, sf, only="view").select("day", "start_t", "end_t", "class")
    f = master_columns(f, grid, flares, CADENCE, LOOK, STEP, RAW)
    return flag_upcoming(f, truth(spark, sf).select(F.col("t").alias("te")), horizon=HORIZON)


@query("master_table", _sql())
def _master(spark, sf):
    digits = {c: d for name, d in FAMILIES.items() for c in NAMES[name]} | dict.fromkeys([*RAW, "sxr_counts_corrected", "day_sxr_peak", "day_sxr_mean", *SPECTRAL], 5)
    m = master(spark, sf)
    numbers = [tidy(c, d).alias(c) for c, d in digits.items()]
    return m.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "win", "t", "time_utc", "flare_class", "in_flare", F.col("label").cast("bigint").alias("label"), *numbers)


@query("window_stats_all", ORACLES["window_stats"].replace(f"range({TOP + 1})", f"range({TOP + 2})"))
def _all(spark, sf):
    """One window more: the one that ends with the day's last row."""
    return present(qw.features(spark, sf, include_last=True).select("day", "win", *NAMES["window_stats"]))


# -- representative windows and feature groups -------------------------------------------------------------------
_REP = f"""WITH mt AS ({ORACLES['master_table']}),
rp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY win) AS rn, count(*) OVER (PARTITION BY day) AS n, max(in_flare) OVER (PARTITION BY day) AS any_flare,
  row_number() OVER (PARTITION BY day ORDER BY in_flare DESC, sxr_max DESC, win) AS best FROM mt) WHERE CASE WHEN any_flare = 1 THEN best = 1 ELSE rn = n // 2 + 1 END)"""


def representatives(spark, sf):
    """The row of each day that stands for it: the flare window with the highest peak, else the middle one."""
    return representative(_master(spark, sf), flag="in_flare")


@query("representative_row", _REP + " SELECT day, win, t, in_flare, flare_class, label, sxr_max, sxr_mean, sxr_temp_window FROM rp")
def _representative(spark, sf):
    return representatives(spark, sf).select("day", "win", "t", "in_flare", "flare_class", "label", "sxr_max", "sxr_mean", "sxr_temp_window")


MEASURED = [c for cols in NAMES.values() for c in cols] + SPECTRAL
GROUPS = [(n, g) for g, names in wi.FAMILIES.items() for n in names if n in MEASURED]


@query("group_activity", _REP + f""", gr AS (SELECT unnest([{', '.join(repr(n) for n, _ in GROUPS)}]) AS feature, unnest([{', '.join(repr(g) for _, g in GROUPS)}]) AS grp),
ul AS (SELECT day, feature, x FROM (UNPIVOT (SELECT day, {', '.join(n for n, _ in GROUPS)} FROM rp) ON {', '.join(n for n, _ in GROUPS)} INTO NAME feature VALUE x))
SELECT day, grp, available, nonzero, details, CASE WHEN nonzero / available > 0.8 THEN 'active' WHEN nonzero / available > 0.3 THEN 'partial' ELSE 'inactive' END AS activity FROM (
  SELECT day, grp, count(*) AS available, count(*) FILTER (abs(x) > 1e-10) AS nonzero, array_to_string(list_slice(list_sort(list(feature)), 1, 5), ',') AS details FROM ul JOIN gr USING (feature) GROUP BY day, grp)""")
def _activity(spark, sf):
    """Which feature families say something in the representative window of each day."""
    rows = cut_lineage(representatives(spark, sf), "representatives")
    families = spark.createDataFrame(GROUPS, "feature string, grp string")
    long = rows.unpivot(["day"], [n for n, _ in GROUPS], "feature", "x")
    out = group_activity(long, families, ["day"])
    return out.withColumn("details", F.concat_ws(",", "details")).select("day", "grp", "available", "nonzero", "details", "activity")
