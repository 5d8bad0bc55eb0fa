"""Queries: event detection and merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.output import present
from ..operators import islands as isl
from ..operators import rolling as ro
from .fixtures import BINS, CADENCE, CHANNELS, LC, big, final, frame, lc, mad
from .registry import query

THR = 50.0
BG = 24
GRADE = [(200.0, "X"), (150.0, "M"), (100.0, "C"), (75.0, "B")]


def grade(flux):
    out = None
    for floor, name in GRADE:
        out = F.when(flux >= floor, name) if out is None else out.when(flux >= floor, name)
    return out.otherwise("A")


def grade_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {f} THEN '{n}'" for f, n in GRADE) + " ELSE 'A' END"


def swpc(spark, sf, only=None, **kw):
    opts = dict(cadence=CADENCE, threshold=THR, window=BG, min_run=1, min_duration=3, short_duration=2,
                merge_gap=2, classify=grade)
    opts.update(kw)
    series = lc(spark, sf)
    return isl.detect_swpc(series if only is None else series.where(F.col("channel") == only), **opts)


def swpc_sql(bg_factor=1.5, min_run=1, min_dur=3, short=2, gap=2, thr=THR, name="swpc") -> str:
    need = f"CASE WHEN peak_flux >= {10 * thr} THEN {short} ELSE {min_dur} END" if short is not None else str(min_dur)
    return f"""{LC},
z AS (SELECT channel, day, bin, t, coalesce(v, 0.0) AS v FROM lc),
b AS (SELECT *, quantile_cont(v, 0.1) {frame(BG)} AS bg FROM z),
f AS (SELECT *, v > greatest({bg_factor} * bg, {0.1 * thr}) AS fl FROM b),
g AS (SELECT *, bin - row_number() OVER (PARTITION BY channel, day ORDER BY bin) AS run FROM f WHERE fl),
pk AS (SELECT channel, day, run, min(bin) AS a, max(bin) AS z, max(v) AS peak_flux FROM g GROUP BY ALL),
p2 AS (SELECT pk.*, (SELECT min(bin) FROM g WHERE g.channel = pk.channel AND g.day = pk.day AND g.run = pk.run AND g.v = pk.peak_flux) AS peak_bin
  FROM pk WHERE z - a >= {min_run} AND peak_flux >= {thr}),
p3 AS (SELECT p2.channel, p2.day, p2.run, a, z, peak_flux, peak_bin,
    coalesce(min(CASE WHEN g.bin <= peak_bin AND g.v > g.bg + {0.05 * thr} THEN g.bin END), a) AS start_bin
  FROM p2 JOIN g ON g.channel = p2.channel AND g.day = p2.day AND g.run = p2.run GROUP BY p2.channel, p2.day, p2.run, a, z, peak_flux, peak_bin),
p4 AS (SELECT p3.channel, p3.day, p3.run, z, peak_flux, peak_bin, start_bin,
    greatest(max(CASE WHEN g.bin = start_bin THEN g.bg END), min(CASE WHEN g.bin BETWEEN start_bin AND peak_bin THEN g.v END)) AS pre
  FROM p3 JOIN g ON g.channel = p3.channel AND g.day = p3.day AND g.run = p3.run GROUP BY p3.channel, p3.day, p3.run, z, peak_flux, peak_bin, start_bin),
p5 AS (SELECT p4.channel, p4.day, p4.run, z, peak_flux, peak_bin, start_bin, pre,
    min(CASE WHEN g.bin > peak_bin AND g.v < pre + (peak_flux - pre) * 0.5 THEN g.bin END) AS dropped
  FROM p4 JOIN g ON g.channel = p4.channel AND g.day = p4.day AND g.run = p4.run GROUP BY p4.channel, p4.day, p4.run, z, peak_flux, peak_bin, start_bin, pre),
ev AS (SELECT channel, day, start_bin, peak_bin, peak_flux, pre,
    greatest(peak_bin, least(z, {BINS - 2}, coalesce(dropped - 1, z))) AS end_bin FROM p5),
ok AS (SELECT * FROM ev WHERE end_bin - start_bin + 1 >= {need}),
r AS (SELECT *, max(end_bin) OVER (PARTITION BY channel, day ORDER BY start_bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ok),
m AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_bin > reach + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY channel, day ORDER BY start_bin) AS grp FROM r),
{name} AS (SELECT channel, day, min(start_bin) AS start_bin,
    arg_max(peak_bin, peak_flux * 100000 - peak_bin) AS peak_bin, max(end_bin) AS end_bin, max(peak_flux) AS peak_flux,
    arg_min(pre, start_bin) AS background, count(*) AS parts FROM m GROUP BY channel, day, grp)"""


def described_sql(src: str) -> str:
    e = "CAST(epoch(day) AS BIGINT)"
    return f"""SELECT *, {e} + start_bin * {CADENCE} AS start_t, {e} + peak_bin * {CADENCE} AS peak_t, {e} + end_bin * {CADENCE} AS end_t,
      (end_bin - start_bin + 1) * {CADENCE} AS duration, {grade_sql('peak_flux')} AS class FROM {src}"""


EVENT_KEYS = "channel, day, class, start_bin, peak_bin, end_bin, start_t, peak_t, end_t, duration, parts"


@query("swpc_detect", final(described_sql("swpc"), EVENT_KEYS, "peak_flux background", swpc_sql()))
def _swpc(spark, sf):
    return present(swpc(spark, sf))


@query("goes_style_detect", final(described_sql("swpc"), EVENT_KEYS, "peak_flux background", swpc_sql(1.3, 1, 3, None, 2)))
def _goes(spark, sf):
    return present(swpc(spark, sf, bg_factor=1.3, min_run=1, min_duration=3, short_duration=None))


_RUNS = f"""{LC},
f AS (SELECT channel, day, bin, t, coalesce(v, 0.0) > {THR} AS fl FROM lc),
g AS (SELECT *, bin - row_number() OVER (PARTITION BY channel, day ORDER BY bin) AS run FROM f WHERE fl)"""


@query("run_lengths", final(
    f"SELECT channel, day, min(bin) AS start_bin, max(bin) AS end_bin, min(t) AS start_t, max(t) AS end_t, count(*) AS rows FROM g GROUP BY channel, day, run",
    "channel, day, start_bin, end_bin, start_t, end_t, rows", "", _RUNS))
def _runs(spark, sf):
    return present(isl.runs(lc(spark, sf), F.col("v") > THR))


@query("flare_windows", final(
    "SELECT channel, day, row_number() OVER (PARTITION BY channel, day ORDER BY min(bin)) AS flare_id, min(bin) AS start_bin, max(bin) AS end_bin FROM g GROUP BY channel, day, run",
    "channel, day, flare_id, start_bin, end_bin", "", _RUNS))
def _windows(spark, sf):
    found = isl.runs(lc(spark, sf), F.col("v") > THR)
    number = F.row_number().over(ro.Window.partitionBy("channel", "day").orderBy("start_bin"))
    return present(found.select("channel", "day", number.alias("flare_id"), "start_bin", "end_bin"))


def _burst_sql(sigma, rows, win):
    return f"""{LC},
z AS (SELECT channel, day, bin, t, coalesce(v, 0.0) AS v FROM lc),
r AS (SELECT *, v - quantile_cont(v, 0.5) {frame(win)} AS residual FROM z),
{mad('residual', 'r', 's')},
g AS (SELECT *, bin - row_number() OVER (PARTITION BY channel, day ORDER BY bin) AS run FROM s WHERE residual > {sigma} * sd AND sd >= 1.4826e-10),
p AS (SELECT channel, day, run, min(bin) AS start_bin, least(max(bin) + 1, {BINS - 1}) AS end_bin, max(v) AS peak_flux,
      arg_max(bin, v * 100000 - bin) AS peak_bin FROM g GROUP BY channel, day, run),
burst AS (SELECT *, end_bin - start_bin AS rows FROM p WHERE end_bin - start_bin >= {rows})"""


@query("hxr_threshold", final(
    f"SELECT *, CAST(epoch(day) AS BIGINT) + start_bin * {CADENCE} AS start_t, CAST(epoch(day) AS BIGINT) + peak_bin * {CADENCE} AS peak_t, CAST(epoch(day) AS BIGINT) + end_bin * {CADENCE} AS end_t FROM burst",
    "channel, day, start_bin, peak_bin, end_bin, start_t, peak_t, end_t, rows", "peak_flux", _burst_sql(3.0, 1, 12)))
def _burst(spark, sf):
    return present(isl.detect_burst(lc(spark, sf), sigma=3.0, min_duration=1, window=12, cadence=CADENCE))


@query("global_threshold", final(
    "SELECT channel, day, min(bin) AS start_bin, max(bin) AS end_bin, max(v) AS peak_flux, arg_max(bin, v * 100000 - bin) AS peak_bin, count(*) AS rows FROM g GROUP BY channel, day, run HAVING count(*) >= 2",
    "channel, day, start_bin, peak_bin, end_bin, rows", "peak_flux",
    f"""{LC}, z AS (SELECT channel, day, bin, coalesce(v, 0.0) AS v FROM lc), {mad('v', 'z', 's')},
g AS (SELECT *, bin - row_number() OVER (PARTITION BY channel, day ORDER BY bin) AS run FROM s WHERE v > 2.0 * sd)"""))
def _global(spark, sf):
    return present(isl.detect_threshold(lc(spark, sf), sigma=2.0, min_duration=2))


_GRADES = ((200.0, "X-equiv"), (100.0, "M-equiv"), (50.0, "C-equiv"))


@query("adaptive_detect", final(
    f"""SELECT channel, day, start_bin, peak_bin, end_bin, peak_flux,
  CASE WHEN peak_flux > 200 THEN 'X-equiv' WHEN peak_flux > 100 THEN 'M-equiv' WHEN peak_flux > 50 THEN 'C-equiv' ELSE 'B-equiv' END AS class,
  coalesce((SELECT avg(d) FROM dd WHERE dd.channel = p.channel AND dd.day = p.day AND dd.bin > start_bin AND dd.bin <= peak_bin), 0) AS rise_rate,
  coalesce((SELECT avg(d) FROM dd WHERE dd.channel = p.channel AND dd.day = p.day AND dd.bin > peak_bin AND dd.bin <= end_bin), 0) AS fall_rate
  FROM p WHERE end_bin - start_bin >= 1 AND peak_flux >= 40""",
    "channel, day, class, start_bin, peak_bin, end_bin", "peak_flux rise_rate fall_rate",
    f"""{LC}, z AS (SELECT channel, day, bin, coalesce(v, 0.0) AS v FROM lc),
r AS (SELECT *, v - quantile_cont(v, 0.5) {frame(24)} AS residual FROM z), {mad('residual', 'r', 's')},
g AS (SELECT *, bin - row_number() OVER (PARTITION BY channel, day ORDER BY bin) AS run FROM s WHERE residual > 1.5 * sd),
dd AS (SELECT channel, day, bin, v - lag(v) OVER (PARTITION BY channel, day ORDER BY bin) AS d FROM z),
p AS (SELECT channel, day, min(bin) AS start_bin, max(bin) AS end_bin, max(v) AS peak_flux, arg_max(bin, v * 100000 - bin) AS peak_bin FROM g GROUP BY channel, day, run)"""))
def _adaptive(spark, sf):
    return present(isl.detect_adaptive(lc(spark, sf), sigma=1.5, min_duration=1, min_peak=40.0, window=24, grades=_GRADES))


@query("prominent_peaks", final(
    """SELECT channel, day, bin, peak_flux, prominence, row_number() OVER (PARTITION BY channel, day ORDER BY bin) AS flare_id
  FROM pr WHERE prominence >= 60 AND NOT EXISTS (SELECT 1 FROM pr q WHERE q.prominence >= 60 AND q.channel = pr.channel AND q.day = pr.day
    AND q.bin <> pr.bin AND abs(q.bin - pr.bin) <= 5 AND (q.peak_flux > pr.peak_flux OR (q.peak_flux = pr.peak_flux AND q.bin < pr.bin)))""",
    "channel, day, bin, flare_id", "peak_flux prominence",
    f"""{LC}, z AS (SELECT channel, day, bin, coalesce(v, 0.0) AS v FROM lc),
n AS (SELECT *, lag(v) OVER w AS u, lead(v) OVER w AS d FROM z WINDOW w AS (PARTITION BY channel, day ORDER BY bin)),
mx AS (SELECT channel, day, bin, v FROM n WHERE v > u AND v > d),
hb AS (SELECT mx.channel, mx.day, mx.bin, mx.v, max(CASE WHEN z.bin < mx.bin THEN z.bin END) AS hl, min(CASE WHEN z.bin > mx.bin THEN z.bin END) AS hr
  FROM mx LEFT JOIN z ON z.channel = mx.channel AND z.day = mx.day AND z.v > mx.v GROUP BY ALL),
pr AS (SELECT hb.channel, hb.day, hb.bin, hb.v AS peak_flux,
  hb.v - greatest(min(CASE WHEN z.bin <= hb.bin AND z.bin > coalesce(hl, -1) THEN z.v END), min(CASE WHEN z.bin >= hb.bin AND z.bin < coalesce(hr, 99999) THEN z.v END)) AS prominence
  FROM hb JOIN z ON z.channel = hb.channel AND z.day = hb.day GROUP BY hb.channel, hb.day, hb.bin, hb.v)"""))
def _prominent(spark, sf):
    return present(isl.prominent_peaks(lc(spark, sf), 60.0, 6))


# Blocks: edges where the hourly block of the row changes (any edge table works).
@query("block_events", final(
    """SELECT channel, day, block, mean, start_bin, end_bin, z, end_bin - start_bin + 1 AS rows FROM (
  SELECT *, (mean - quantile_cont(mean, 0.5) OVER (PARTITION BY channel, day)) / stddev_pop(mean) OVER (PARTITION BY channel, day) AS z FROM bl)
  WHERE z > 1.0 AND end_bin - start_bin + 1 >= 2""",
    "channel, day, CAST(block AS BIGINT) AS block, start_bin, end_bin, rows", "mean z",
    f"""{LC}, e AS (SELECT channel, day, bin, coalesce(v, 0.0) AS v, CASE WHEN v > 60 AND bin > 0 THEN 1 WHEN bin = 0 THEN 1 ELSE 0 END AS edge FROM lc),
bb AS (SELECT *, sum(edge) OVER (PARTITION BY channel, day ORDER BY bin) AS block FROM e),
bl AS (SELECT channel, day, block, avg(v) AS mean, min(bin) AS start_bin, max(bin) AS end_bin FROM bb GROUP BY ALL)"""))
def _blocks(spark, sf):
    series = lc(spark, sf)
    edges = series.where((F.col("v") > 60) | (F.col("bin") == 0)).select("channel", "day", "bin")
    return present(isl.block_events(series, edges, sigma=1.0, min_duration=2))


@query("block_counts", final(
    "SELECT channel, day, bin, max(block) OVER w - min(block) OVER w + 1 AS blocks FROM bb WINDOW w AS (PARTITION BY channel, day ORDER BY t RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)",
    "channel, day, bin, CAST(blocks AS BIGINT) AS blocks", "",
    f"""{LC}, e AS (SELECT channel, day, bin, t, CASE WHEN v > 60 AND bin > 0 THEN 1 WHEN bin = 0 THEN 1 ELSE 0 END AS edge FROM lc),
bb AS (SELECT *, sum(edge) OVER (PARTITION BY channel, day ORDER BY bin) AS block FROM e)"""))
def _block_counts(spark, sf):
    series = lc(spark, sf)
    edges = series.where((F.col("v") > 60) | (F.col("bin") == 0)).select("channel", "day", "bin")
    marked = isl.assign_blocks(series, edges)
    return present(marked.select("channel", "day", "bin", ro.distinct_blocks("block", 3600).alias("blocks")))
