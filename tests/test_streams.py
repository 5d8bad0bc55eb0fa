"""Live alerts: order inside a long backlog, and going on after a stop."""

import datetime
import random

from helioframe.streaming import streams as st

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, event_type string, value double"


def level(top):
    return "FLARE NOW" if top > 300 else "RED" if top / 150 > 0.9 else "ORANGE" if top / 150 > 0.7 else "YELLOW" if top / 150 > 0.6 else "GREEN"


def changes(rows, closed):
    """(channel, minute, previous, alert) of all steps that end by minute ``closed``."""
    tops = {}
    for _, ts, channel, value in rows:
        key = (channel, int((ts - T0).total_seconds()) // 60)
        tops[key] = max(tops.get(key, value), value)
    out, before = [], {}
    for channel, minute in sorted(tops):
        if minute + 1 <= closed:
            alert, previous = level(tops[channel, minute]), before.get(channel, "GREEN")
            if alert != previous:
                out.append((channel, minute, previous, alert))
            before[channel] = alert
    return sorted(out)


def found(df):
    return sorted((r.channel, int((r.t - T0).total_seconds()) // 60, r.previous, r.alert) for r in df.collect())


def write(spark, folder, rows, name):
    """One file, rows in no order."""
    rows = list(rows)
    random.Random(4).shuffle(rows)
    path = f"{folder}/{name}"
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_alerts_of_a_long_backlog_and_after_a_restart(spark, tmp_path):
    rng = random.Random(9)
    rows = [(k, T0 + datetime.timedelta(seconds=60 * m + rng.randrange(60)), c, rng.expovariate(1 / 70)) for k, (m, c) in enumerate((m, c) for m in range(10_000) for c in ("a", "b"))]
    first = [r for r in rows if r[1] < T0 + datetime.timedelta(minutes=7000)]
    folder, base = f"{tmp_path}/in/events.parquet", f"{tmp_path}/run"
    write(spark, folder, first, "")
    stream = lambda: st.alert_changes(st.live_samples(spark, folder, "*.parquet", schema=spark.createDataFrame([], SCHEMA).schema), 150.0, 300.0)
    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    got = found(st.run_to_table(stream(), "alerts", base))
    newest = lambda some: int((max(r[1] for r in some) - T0).total_seconds() // 60) - 10
    assert got == changes(first, newest(first)) and len(got) > 3000
    write(spark, folder, [r for r in rows if r not in set(first)], "")
    got = found(st.run_to_table(stream(), "alerts", base))
    assert got == changes(rows, newest(rows))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == store
