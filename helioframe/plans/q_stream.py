"""Queries: streaming operators drained over the stored events, checked against batch SQL.

Append mode reports a window once the watermark has passed its end, so the SQL sides keep the windows
that end by (newest sample - allowed lateness).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.output import present
from ..streaming import streams as st
from .fixtures import final
from .registry import query

EV = "e AS (SELECT event_id, event_type AS channel, epoch_us(ts) AS us, value FROM events), wm AS (SELECT max(us) // 1000 * 1000 AS top FROM e)"


@query("stream_tumbling", final(
    "SELECT channel, us // 600000000 * 600 AS start, count(*) AS n, avg(value) AS mean, max(value) AS top FROM e, wm GROUP BY channel, us // 600000000, wm.top HAVING (us // 600000000 + 1) * 600000000 <= wm.top - 120000000",
    "channel, CAST(start AS BIGINT) AS start, n", "mean top", EV))
def _tumbling(spark, sf):
    return present(st.run_to_table(st.tumbling(st.live_samples(spark, sf), "10 minutes"), "tumbling"))


@query("stream_hopping", final(
    """SELECT channel, CAST(w * 1800 AS BIGINT) AS start, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS lo, max(value) AS hi FROM (SELECT e.*, us // 1800000000 - k AS w, top FROM e, wm, (SELECT range AS k FROM range(6))) GROUP BY channel, w, top HAVING w * 1800000000 + 10800000000 <= top - 600000000""",
    "channel, start, n", "mean std lo hi", EV))
def _hopping(spark, sf):
    return present(st.run_to_table(st.hopping(st.live_samples(spark, sf), "3 hours", "30 minutes"), "hopping"))


@query("stream_sessions", final(
    """SELECT channel, min(us) // 1000000 AS start, (max(us) + 1800000000) // 1000000 AS stop, count(*) AS n, max(value) AS peak, arg_max(us, value) // 1000000 AS peak_t FROM (SELECT *, sum(f) OVER (PARTITION BY channel ORDER BY us, event_id) AS s FROM (
  SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY channel ORDER BY us, event_id) < 1800000000 THEN 0 ELSE 1 END AS f FROM e WHERE value > 60)), (SELECT max(us) // 1000 * 1000 AS top FROM e WHERE value > 60) GROUP BY channel, s, top HAVING max(us) + 1800000000 <= top - 600000000""",
    "channel, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, n, CAST(peak_t AS BIGINT) AS peak_t", "peak", EV))
def _sessions(spark, sf):
    return present(st.run_to_table(st.flare_sessions(st.live_samples(spark, sf), 60.0, "30 minutes"), "sessions"))


_PEAKS = "p AS (SELECT channel, us // 600000000 * 600 AS start, max(value) AS peak FROM e, (SELECT min(m) AS top FROM (SELECT max(us) // 1000 * 1000 AS m FROM e WHERE channel IN ('view', 'click') GROUP BY channel)) wm WHERE channel IN ('view', 'click') GROUP BY channel, us // 600000000, wm.top HAVING (us // 600000000 + 1) * 600000000 <= wm.top - 600000000 AND max(value) > 80)"


@query("stream_coincidence", final(
    "SELECT s.start AS st, h.start AS ht, s.peak AS sv, h.peak AS hv FROM p s JOIN p h ON s.channel = 'view' AND h.channel = 'click' AND abs(s.start - h.start) <= 1800",
    "CAST(st AS BIGINT) AS st, CAST(ht AS BIGINT) AS ht", "sv hv", EV + ", " + _PEAKS))
def _coincidence(spark, sf):
    peaks = lambda c: st.window_peaks(st.live_samples(spark, sf).where(F.col("channel") == c), 80.0, "10 minutes")
    return present(st.run_to_table(st.coincidences(peaks("view"), peaks("click"), 1800), "coincidence"))


@query("stream_dedup", final("SELECT channel, count(*) AS n, sum(value) AS total FROM e GROUP BY channel", "channel, n", "total", EV, digits=3))
def _dedup(spark, sf):
    live = st.live_samples(spark, sf)
    doubled = live.unionByName(live)
    once = st.run_to_table(st.without_duplicates(doubled), "dedup")
    return present(once.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 3)


_LEVEL = "CASE WHEN top > 300 THEN 'FLARE NOW' WHEN top / 150.0 > 0.9 THEN 'RED' WHEN top / 150.0 > 0.7 THEN 'ORANGE' WHEN top / 150.0 > 0.6 THEN 'YELLOW' ELSE 'GREEN' END"
def _changes(closed: str) -> str:
    steps = f"SELECT channel, us // 60000000 * 60 AS t, max(value) AS top FROM e, wm GROUP BY channel, us // 60000000, wm.top {closed}"
    return f"SELECT channel, t, previous, alert FROM (SELECT *, coalesce(lag(alert) OVER (PARTITION BY channel ORDER BY t), 'GREEN') AS previous FROM (SELECT *, {_LEVEL} AS alert FROM ({steps}))) WHERE alert <> previous"


@query("stream_alerts", final(_changes("HAVING (us // 60000000 + 1) * 60000000 <= wm.top - 600000000"), "channel, CAST(t AS BIGINT) AS t, previous, alert", "", EV))
def _alerts(spark, sf):
    return present(st.run_to_table(st.alert_changes(st.live_samples(spark, sf), 150.0, 300.0), "alerts"))


@query("alert_changes", final(_changes(""), "channel, CAST(t AS BIGINT) AS t, previous, alert", "", EV))
def _alerts_batch(spark, sf):
    from ..sources.tables import table

    ev = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("channel"), "value")
    return present(st.alert_changes_batch(ev, 150.0, 300.0))
