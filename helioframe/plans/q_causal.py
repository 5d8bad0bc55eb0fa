"""Queries: information theory, lag structure, causal networks, nonlinear measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.output import present
from ..operators import causal as ca
from ..operators import information as inf
from ..operators import nonlinear as nl
from ..operators import periodicity as pe
from ..operators import windows as wi
from .fixtures import BINS, CHANNELS, WIDE, big, final, wide
from .registry import ORACLES, query

D = ["day"]
WB = ", ".join(f"coalesce({c}, 0) AS {c}" for c in CHANNELS)
FILLED = WIDE + f", wf AS (SELECT day, bin, {WB} FROM wide)"


def filled(spark, sf):
    w = wide(spark, sf)
    return w.select("day", "bin", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in CHANNELS])


def _disc(x, part, bins=8):
    return f"CAST(least(greatest(floor(CASE WHEN max({x}) OVER ({part}) > min({x}) OVER ({part}) THEN ({x} - min({x}) OVER ({part})) / (max({x}) OVER ({part}) - min({x}) OVER ({part})) * {bins} ELSE {x} END), 0), {bins - 1}) AS BIGINT)"


_P = "PARTITION BY day"


@query("mutual_information", final(
    "SELECT day, CASE WHEN max(n) >= 10 THEN sum(c / n * log2(c * n / (ci * cj))) ELSE 0 END AS mi FROM (SELECT *, CAST(sum(c) OVER (PARTITION BY day) AS DOUBLE) AS n, CAST(sum(c) OVER (PARTITION BY day, i) AS DOUBLE) AS ci, CAST(sum(c) OVER (PARTITION BY day, j) AS DOUBLE) AS cj FROM (SELECT day, i, j, count(*) AS c FROM md GROUP BY ALL)) GROUP BY day",
    "day", "mi", FILLED + f", md AS (SELECT day, {_disc('view', _P)} AS i, {_disc('click', _P)} AS j FROM wf)"))
def _mi(spark, sf):
    return present(inf.mutual_information(filled(spark, sf), D, "view", "click", bins=8))


@query("transfer_entropy", final(
    "SELECT day, CASE WHEN max(n) >= 10 THEN sum(c / n * log2((c / st) / (tu / t))) ELSE 0 END AS te FROM (SELECT *, CAST(sum(c) OVER (PARTITION BY day) AS DOUBLE) AS n, CAST(sum(c) OVER (PARTITION BY day, s, t1) AS DOUBLE) AS st, CAST(sum(c) OVER (PARTITION BY day, t1, u) AS DOUBLE) AS tu, CAST(sum(c) OVER (PARTITION BY day, t1) AS DOUBLE) AS t FROM (SELECT day, s, t1, u, count(*) AS c FROM td GROUP BY ALL)) GROUP BY day",
    "day", "te", FILLED + f", tn AS (SELECT * FROM (SELECT *, lead(view) OVER (PARTITION BY day ORDER BY bin) AS nx FROM wf) WHERE nx IS NOT NULL), td AS (SELECT day, {_disc('click', _P)} AS s, {_disc('view', _P)} AS t1, {_disc('nx', _P)} AS u FROM tn)"))
def _te(spark, sf):
    return present(inf.transfer_entropy(filled(spark, sf), D, "click", "view", bins=8))


@query("sample_entropy", final(
    """SELECT day, CASE WHEN b > 0 AND a > 0 AND r >= 1e-10 THEN -ln(a / CAST(b AS DOUBLE)) ELSE 0 END AS sampen FROM (
  SELECT x.day, max(x.r) AS r, count(*) FILTER (greatest(abs(x.v - y.v), abs(x.v1 - y.v1)) < x.r AND x.v1 IS NOT NULL AND y.v1 IS NOT NULL AND y.bin < 142 AND x.bin < 142) AS b, count(*) FILTER (greatest(abs(x.v - y.v), abs(x.v1 - y.v1), abs(x.v2 - y.v2)) < x.r AND x.bin < 141 AND y.bin < 141) AS a
  FROM se x JOIN se y ON x.day = y.day AND x.bin < y.bin GROUP BY x.day)""", "day", "sampen",
    FILLED + ", se AS (SELECT day, bin, view AS v, lead(view) OVER w AS v1, lead(view, 2) OVER w AS v2, 0.2 * stddev_pop(view) OVER (PARTITION BY day) AS r FROM wf WINDOW w AS (PARTITION BY day ORDER BY bin))"))
def _sampen(spark, sf):
    arr = pe.arrays_of(filled(spark, sf), D, ["view"])
    return present(arr.select("day", inf.sample_entropy("view", F.lit(2), F.lit(0.2)).alias("sampen")))


LAGGED = FILLED + """, zs AS (SELECT day, bin, (view - avg(view) OVER d) / (stddev_pop(view) OVER d + 1e-10) AS x, (click - avg(click) OVER d) / (stddev_pop(click) OVER d + 1e-10) AS y FROM wf WINDOW d AS (PARTITION BY day)),
lg AS (SELECT CAST(range AS BIGINT) - 20 AS lag FROM range(41)), lc2 AS (SELECT a.day, lag, sum(a.x * b.y) / 144 AS r FROM zs a JOIN lg ON true JOIN zs b ON b.day = a.day AND b.bin = a.bin - lag GROUP BY a.day, lag)"""


@query("lag_corr", final("SELECT day, arg_max(r, abs(r)) AS r, arg_max(lag, abs(r)) AS lag FROM lc2 GROUP BY day", "day, lag", "r", LAGGED))
def _lag(spark, sf):
    arr = pe.arrays_of(filled(spark, sf), D, ["view", "click"])
    return present(arr.withColumn("s", inf.lag_scan("view", "click", F.lit(20))).select("day", "s.r", "s.lag"))


@query("lag_table", final(
    "SELECT a.day, lag, corr(a.view, b.click) AS r, count(*) AS n FROM wide a JOIN (SELECT CAST(range AS BIGINT) - 6 AS lag FROM range(13)) ON true JOIN wide b ON b.day = a.day AND b.bin = a.bin + lag WHERE a.view IS NOT NULL AND b.click IS NOT NULL GROUP BY a.day, lag", "day, lag, n", "r", WIDE))
def _lag_table(spark, sf):
    return present(inf.lag_table(wide(spark, sf), D, "view", "click", range(-6, 7)))


@query("cross_instrument_lag", final(
    "SELECT avg(lag) AS mean_lag, stddev_pop(lag) AS std_lag, count(*) AS n FROM (SELECT day, arg_max(lag, abs(r) - lag / 1e9) AS lag FROM (SELECT a.day, lag, corr(a.view, b.click) AS r FROM wf a JOIN (SELECT CAST(range AS BIGINT) - 6 AS lag FROM range(13)) ON true JOIN wf b ON b.day = a.day AND b.bin = a.bin + lag GROUP BY a.day, lag) WHERE r IS NOT NULL AND NOT isnan(r) GROUP BY day)", "n", "mean_lag std_lag", FILLED))
def _instrument(spark, sf):
    best = inf.strongest_lag(inf.lag_table(filled(spark, sf), D, "view", "click", range(-6, 7)), D)
    return present(best.agg(F.avg("lag").alias("mean_lag"), F.stddev_pop("lag").alias("std_lag"), F.count(F.lit(1)).alias("n")))


@query("rolling_lag", final(
    """SELECT wf.day, wf.bin, xcorr, xcorr_lag FROM wf LEFT JOIN (SELECT day, bin, arg_max(r, r - lag / 1e9) AS xcorr, arg_max(lag, r - lag / 1e9) AS xcorr_lag FROM (SELECT c.day, c.bin, k.lag, sum((a.view - c.mx) * (b.click - c.my)) / (c.sx * c.sy * 25 + 1e-30) AS r
  FROM (SELECT day, bin, avg(view) OVER w AS mx, avg(click) OVER w AS my, stddev_pop(view) OVER w AS sx, stddev_pop(click) OVER w AS sy, count(*) OVER w AS n FROM wf WINDOW w AS (PARTITION BY day ORDER BY bin ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)) c JOIN (SELECT CAST(range AS BIGINT) - 4 AS lag FROM range(9)) k ON c.n = 25
  JOIN wf a ON a.day = c.day AND a.bin BETWEEN c.bin - 12 AND c.bin + 12 JOIN wf b ON b.day = a.day AND b.bin = a.bin - k.lag AND b.bin BETWEEN c.bin - 12 AND c.bin + 12 WHERE c.sx > 1e-9 AND c.sy > 1e-9 GROUP BY c.day, c.bin, k.lag, c.sx, c.sy) GROUP BY day, bin) best ON best.day = wf.day AND best.bin = wf.bin""", "day, bin, xcorr_lag", "xcorr", FILLED, digits=5))
def _rolling_lag(spark, sf):
    return present(inf.rolling_lag(filled(spark, sf), "view", "click", 12, 4), 5)


def _edges_sql(lags=12):
    return f"""bl AS (SELECT day, bin, band, v FROM (UNPIVOT wf ON {', '.join(CHANNELS)} INTO NAME band VALUE v)),
lr AS (SELECT a.day, a.band AS src, b.band AS dst, k.lag, corr(a.v, b.v) AS r FROM bl a JOIN (SELECT CAST(range AS BIGINT) + 1 AS lag FROM range({lags})) k ON true JOIN bl b ON b.day = a.day AND b.bin = a.bin + k.lag AND b.band <> a.band GROUP BY ALL),
ed AS (SELECT day, src, dst, r, lag FROM (SELECT *, row_number() OVER (PARTITION BY day, src, dst ORDER BY round(abs(r), 11) DESC, lag) AS rn FROM lr WHERE NOT isnan(r)) WHERE rn = 1 AND abs(r) > 0.1)"""


EDGES = FILLED + ", " + _edges_sql()


def edges(spark, sf):
    return ca.lag_edges(filled(spark, sf), D, CHANNELS, 12)


@query("lag_edges", final("SELECT * FROM ed", "day, src, dst, lag", "r", EDGES))
def _edges(spark, sf):
    return present(edges(spark, sf))


@query("network_degrees", final(
    f"SELECT day, band, (SELECT count(*) FROM ed WHERE ed.day = d.day AND dst = band) AS in_degree, (SELECT count(*) FROM ed WHERE ed.day = d.day AND src = band) AS out_degree, (SELECT count(*) FROM ed WHERE ed.day = d.day AND (src = band OR dst = band)) / 4.0 AS centrality FROM (SELECT DISTINCT day FROM ed) d, (SELECT unnest({CHANNELS!r}) AS band)",
    "day, band, in_degree, out_degree", "centrality", EDGES))
def _degrees(spark, sf):
    return present(ca.degrees(edges(spark, sf), D, CHANNELS))


@query("feedback_loops", final(
    "SELECT f.day, f.src AS a, f.dst AS b, abs(f.r) AS forward_strength, abs(g.r) AS backward_strength, f.lag AS forward_lag, g.lag AS backward_lag FROM ed f JOIN ed g ON g.day = f.day AND g.src = f.dst AND g.dst = f.src AND f.src < f.dst",
    "day, a, b, forward_lag, backward_lag", "forward_strength backward_strength", EDGES))
def _loops(spark, sf):
    return present(ca.feedback_loops(edges(spark, sf), D))


@query("network_features", final(
    """SELECT day, count(*) / 20.0 AS causal_network_density, count(*) / 5.0 AS avg_in_degree, count(*) / 5.0 AS avg_out_degree, 2 * count(*) / 20.0 AS avg_centrality, count(*) - count(DISTINCT [least(src, dst), greatest(src, dst)]) AS n_feedback_loops,
  CASE WHEN count(*) > count(DISTINCT [least(src, dst), greatest(src, dst)]) THEN 1 ELSE 0 END AS cycle_detected, coalesce(max(lag) FILTER (src = 'click' AND dst = 'view'), 0) AS hxr_to_sxr_lag, coalesce(max(abs(r)) FILTER (src = 'click' AND dst = 'view'), 0) AS hxr_to_sxr_strength,
  coalesce(max(lag) FILTER (src = 'view' AND dst = 'click'), 0) AS sxr_to_hxr_lag, coalesce(max(abs(r)) FILTER (src = 'view' AND dst = 'click'), 0) AS sxr_to_hxr_strength FROM ed GROUP BY day""",
    "day", "causal_network_density avg_in_degree avg_out_degree avg_centrality n_feedback_loops cycle_detected hxr_to_sxr_lag hxr_to_sxr_strength sxr_to_hxr_lag sxr_to_hxr_strength", EDGES))
def _network(spark, sf):
    return present(ca.network_features(edges(spark, sf), D, CHANNELS, "view", "click"))


@query("mediation", final(
    """SELECT day, n, total, path_a, path_b, direct, path_a * path_b AS indirect, CASE WHEN abs(total) > 1e-6 THEN least(abs(path_a * path_b / total), 1) ELSE 0 END AS mediation_proportion FROM (
  SELECT *, (mo - path_a * total) / sqrt((1 - path_a * path_a) * (1 - total * total)) AS path_b, (total - path_a * mo) / sqrt((1 - path_a * path_a) * (1 - mo * mo)) AS direct FROM (SELECT day, count(*) AS n, corr(click, view) AS total, corr(click, purchase) AS path_a, corr(purchase, view) AS mo FROM wf GROUP BY day))""",
    "day, n", "total path_a path_b direct indirect mediation_proportion", FILLED))
def _mediation(spark, sf):
    return present(ca.mediation(filled(spark, sf), D, "click", "purchase", "view"))


@query("granger_ridge")
def _granger(spark, sf):
    return present(ca.granger(filled(spark, sf), D, "click", "view", lags=(1, 3, 5, 10), max_lag=20))


@query("hurst", final(
    """SELECT day, win * 12 + 24 AS bin, ln((max(c) - min(c)) / max(s)) / ln(24.0) AS hurst FROM (SELECT *, sum(v - m) OVER (PARTITION BY day, win ORDER BY bin) AS c FROM (
  SELECT day, win, bin, view AS v, avg(view) OVER p AS m, stddev_samp(view) OVER p AS s, count(*) OVER p AS n FROM wide JOIN (SELECT CAST(range AS BIGINT) AS win FROM range(8)) ON bin >= win * 12 AND bin < win * 12 + 48 WHERE view IS NOT NULL WINDOW p AS (PARTITION BY day, win)) WHERE n >= 10 AND s > 0) GROUP BY day, win""",
    "day, bin", "hurst", WIDE))
def _hurst(spark, sf):
    return present(nl.hurst(wide(spark, sf), D, "view", 48, 12, 10, BINS))


@query("hurst_filled", final(
    """SELECT day, g.b AS bin, arg_max(hurst, h.bin) AS hurst FROM (SELECT day, win * 12 + 24 AS bin, ln((max(c) - min(c)) / max(s)) / ln(24.0) AS hurst FROM (SELECT *, sum(v - m) OVER (PARTITION BY day, win ORDER BY bin) AS c FROM (
  SELECT day, win, bin, view AS v, avg(view) OVER p AS m, stddev_samp(view) OVER p AS s, count(*) OVER p AS n FROM wide JOIN (SELECT CAST(range AS BIGINT) AS win FROM range(8)) ON bin >= win * 12 AND bin < win * 12 + 48 WHERE view IS NOT NULL WINDOW p AS (PARTITION BY day, win)) WHERE n >= 10 AND s > 0) GROUP BY day, win) h
  JOIN (SELECT CAST(range AS BIGINT) AS b FROM range(144)) g ON g.b >= h.bin - 12 AND g.b < h.bin + 12 GROUP BY day, g.b""",
    "day, bin", "hurst", WIDE))
def _hurst_filled(spark, sf):
    return present(nl.hurst(wide(spark, sf), D, "view", 48, 12, 10, BINS, spread=True))


REC = FILLED + """, r0 AS (SELECT day, win, bin - win * 24 AS pos, view / 50 AS x, click / 50 AS y FROM wf JOIN (SELECT CAST(range AS BIGINT) AS win FROM range(4)) ON bin >= win * 24 AND bin < win * 24 + 60),
r1 AS (SELECT day, win, pos, [x, lead(x, 2) OVER w, lead(x, 4) OVER w] AS a, [y, lead(y, 2) OVER w, lead(y, 4) OVER w] AS b FROM r0 WINDOW w AS (PARTITION BY day, win ORDER BY pos)), r2 AS (SELECT * FROM r1 WHERE pos < 56),
rm AS (SELECT i.day, i.win, i.pos AS i, j.pos AS j, sqrt(pow(i.a[1] - j.b[1], 2) + pow(i.a[2] - j.b[2], 2) + pow(i.a[3] - j.b[3], 2)) < 0.8 AS hit FROM r2 i JOIN r2 j ON i.day = j.day AND i.win = j.win),
rh AS (SELECT * FROM rm WHERE hit)"""


@query("recurrence", final(
    """SELECT g.day, g.win, count(h.i) / (56.0 * 56.0) AS rate, CASE WHEN count(h.i) > 0 THEN count(h.i) FILTER (u.i IS NOT NULL OR d.i IS NOT NULL) / CAST(count(h.i) AS DOUBLE) ELSE 0 END AS determinism FROM (SELECT DISTINCT day, win FROM r0) g LEFT JOIN rh h ON h.day = g.day AND h.win = g.win
  LEFT JOIN rh u ON u.day = h.day AND u.win = h.win AND u.i = h.i - 1 AND u.j = h.j - 1 LEFT JOIN rh d ON d.day = h.day AND d.win = h.win AND d.i = h.i + 1 AND d.j = h.j + 1 GROUP BY g.day, g.win""", "day, win", "rate determinism", REC))
def _recurrence(spark, sf):
    f = filled(spark, sf)
    rows = wi.hop(f.select("day", "bin", (F.col("view") / 50).alias("x"), (F.col("click") / 50).alias("y")), BINS, 60, 24)
    return present(nl.cross_recurrence(rows, ["day", "win"], "x", "y", 3, 2, 0.8, least=30))


@query("window_information", final(
    "SELECT day, win, sum(c / n * log2(c * n / (ci * cj))) AS mi FROM (SELECT *, CAST(sum(c) OVER (PARTITION BY day, win) AS DOUBLE) AS n, CAST(sum(c) OVER (PARTITION BY day, win, i) AS DOUBLE) AS ci, CAST(sum(c) OVER (PARTITION BY day, win, j) AS DOUBLE) AS cj FROM (SELECT day, win, i, j, count(*) AS c FROM md GROUP BY ALL)) GROUP BY day, win",
    "day, win", "mi", FILLED + f", wx AS (SELECT wf.*, win FROM wf JOIN (SELECT CAST(range AS BIGINT) AS win FROM range(4)) ON bin >= win * 24 AND bin < win * 24 + 60), md AS (SELECT day, win, {_disc('view', 'PARTITION BY day, win')} AS i, {_disc('click', 'PARTITION BY day, win')} AS j FROM wx)"))
def _window_mi(spark, sf):
    return present(inf.mutual_information(wi.hop(filled(spark, sf), BINS, 60, 24), ["day", "win"], "view", "click", bins=8))


_WX = FILLED + ", wx AS (SELECT wf.*, win, bin - win * 24 AS pos FROM wf JOIN (SELECT CAST(range AS BIGINT) AS win FROM range(4)) ON bin >= win * 24 AND bin < win * 24 + 60)"
_PW = "PARTITION BY day, win"


@query("window_transfer", final(
    "SELECT day, win, sum(c / n * log2((c / st) / (tu / t))) AS te FROM (SELECT *, CAST(sum(c) OVER (PARTITION BY day, win) AS DOUBLE) AS n, CAST(sum(c) OVER (PARTITION BY day, win, s, t1) AS DOUBLE) AS st, CAST(sum(c) OVER (PARTITION BY day, win, t1, u) AS DOUBLE) AS tu, CAST(sum(c) OVER (PARTITION BY day, win, t1) AS DOUBLE) AS t FROM (SELECT day, win, s, t1, u, count(*) AS c FROM td GROUP BY ALL)) GROUP BY day, win",
    "day, win", "te", _WX + f", tn AS (SELECT * FROM (SELECT *, lead(view) OVER (PARTITION BY day, win ORDER BY bin) AS nx FROM wx) WHERE nx IS NOT NULL), td AS (SELECT day, win, {_disc('click', _PW)} AS s, {_disc('view', _PW)} AS t1, {_disc('nx', _PW)} AS u FROM tn)"))
def _window_te(spark, sf):
    rows = wi.hop(filled(spark, sf), BINS, 60, 24)
    return present(inf.transfer_entropy(rows, ["day", "win"], "click", "view", bins=8, order="pos"))


@query("window_complexity", final(
    """SELECT e.day, e.win, sampen, arg_max(r, abs(r)) AS r, arg_max(lag, abs(r)) AS lag FROM (SELECT day, win, CASE WHEN b > 0 AND a > 0 AND r >= 1e-10 THEN -ln(a / CAST(b AS DOUBLE)) ELSE 0 END AS sampen FROM (
  SELECT x.day, x.win, max(x.r) AS r, count(*) FILTER (greatest(abs(x.v - y.v), abs(x.v1 - y.v1)) < x.r AND y.pos < 58 AND x.pos < 58) AS b, count(*) FILTER (greatest(abs(x.v - y.v), abs(x.v1 - y.v1), abs(x.v2 - y.v2)) < x.r AND x.pos < 57 AND y.pos < 57) AS a
  FROM se x JOIN se y ON x.day = y.day AND x.win = y.win AND x.pos < y.pos GROUP BY x.day, x.win)) e
  JOIN (SELECT a.day, a.win, lag, sum(a.x * b.y) / 60 AS r FROM zs a JOIN (SELECT CAST(range AS BIGINT) - 12 AS lag FROM range(25)) ON true JOIN zs b ON b.day = a.day AND b.win = a.win AND b.pos = a.pos - lag GROUP BY a.day, a.win, lag) l USING (day, win) GROUP BY e.day, e.win, sampen""",
    "day, win, lag", "sampen r",
    _WX + """, se AS (SELECT day, win, pos, view AS v, lead(view) OVER w AS v1, lead(view, 2) OVER w AS v2, 0.2 * stddev_pop(view) OVER (PARTITION BY day, win) AS r FROM wx WINDOW w AS (PARTITION BY day, win ORDER BY pos)),
zs AS (SELECT day, win, pos, (view - avg(view) OVER d) / (stddev_pop(view) OVER d + 1e-10) AS x, (click - avg(click) OVER d) / (stddev_pop(click) OVER d + 1e-10) AS y FROM wx WINDOW d AS (PARTITION BY day, win))"""))
def _window_complexity(spark, sf):
    """Sample entropy and strongest lag of every window, one array per window."""
    arr = pe.arrays_of(wi.hop(filled(spark, sf), BINS, 60, 24), ["day", "win"], ["view", "click"], "pos")
    out = arr.select("day", "win", inf.sample_entropy("view", F.lit(2), F.lit(0.2)).alias("sampen"), inf.lag_scan("view", "click", F.lit(12)).alias("s"))
    return present(out.select("day", "win", "sampen", "s.r", "s.lag"))


@query("information_over_days", "SELECT count(*) AS days, " + ", ".join(f"round(avg({c}) + 1e-9, 4) AS mean_{c}, round(stddev_pop({c}) + 1e-9, 4) AS std_{c}" for c in ("mi", "te", "sampen", "r")) +
       f", CAST(quantile_disc(lag, 0.5) AS BIGINT) AS middle_lag FROM ({ORACLES['mutual_information']}) JOIN ({ORACLES['transfer_entropy']}) USING (day) JOIN ({ORACLES['sample_entropy']}) USING (day) JOIN ({ORACLES['lag_corr']}) USING (day)")
def _over_days(spark, sf):
    """The four measures of every day, averaged over the days."""
    days = filled(spark, sf)
    arr = pe.arrays_of(days, D, ["view", "click"])
    own = arr.select("day", inf.sample_entropy("view", F.lit(2), F.lit(0.2)).alias("sampen"), inf.lag_scan("view", "click", F.lit(20)).alias("s")).select("day", "sampen", "s.r", "s.lag")
    every = inf.mutual_information(days, D, "view", "click", bins=8).join(inf.transfer_entropy(days, D, "click", "view", bins=8), "day").join(own, "day")
    return inf.over_days(every, ["mi", "te", "sampen", "r"], "lag")
