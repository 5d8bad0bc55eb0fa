import datetime
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helioframe.operators import intervals as iv
from helioframe.operators import islands as isl
from helioframe.operators import matching as ma
from helioframe.operators import rolling as ro
from helioframe.sources.lightcurve import bin_samples, fill_grid

DAY = datetime.date(2024, 1, 1)


def values(df, col, order="bin"):
    return [r[col] for r in df.orderBy(order).collect()]


def test_grid_has_every_bin_once(spark):
    rows = [("a", datetime.datetime(2024, 1, 1, 0, 10, 5), 2.0), ("a", datetime.datetime(2024, 1, 1, 0, 10, 50), 4.0), ("a", datetime.datetime(2024, 1, 1, 12), 7.0)]
    df = spark.createDataFrame(rows, "event_type string, ts timestamp, value double")
    grid = fill_grid(bin_samples(df, 600), 600)
    assert values(grid, "bin") == list(range(144))
    got = values(grid, "v")
    assert got[1] == 3.0 and got[72] == 7.0 and sum(v is not None for v in got) == 2


def test_interval_mask(spark):
    pts = spark.createDataFrame([(i,) for i in range(1, 8)], "t bigint")
    gti = spark.createDataFrame([(2, 2), (6, 6), (2, 3)], "start bigint, stop bigint")
    hit = iv.covered(pts, gti, width=4)
    assert [r["t"] for r in hit.where("inside").orderBy("t").collect()] == [2, 3, 6]
    assert hit.count() == 7


def test_range_join_matches_brute_force(spark):
    rnd = random.Random(3)
    pts = [(i, rnd.randrange(0, 5000)) for i in range(400)]
    spans = [(k, a, a + rnd.randrange(0, 700)) for k, a in enumerate(rnd.randrange(0, 5000) for _ in range(60))]
    got = iv.range_join(spark.createDataFrame(pts, "i int, t bigint"), spark.createDataFrame(spans, "k int, a bigint, b bigint"), "t", "a", "b", 100)
    want = {(i, k) for i, t in pts for k, a, b in spans if a <= t <= b}
    pairs = [(r["i"], r["k"]) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_label_bounds(spark):
    rows = spark.createDataFrame([(0,), (100,), (1700,), (1800,)], "t bigint")
    ev = spark.createDataFrame([(1800,)], "te bigint")
    lab = lambda b: [r["label"] for r in iv.flag_upcoming(rows, ev, horizon=1800, bounds=b).orderBy("t").collect()]
    assert lab("(0,H]") == [1, 1, 1, 0]
    assert lab("[0,H)") == [0, 1, 1, 1]


def test_median_background_of_a_box(curve):
    v = [10.0] * 1000
    v[500:521] = [100.0] * 21
    r = values(ro.median_residual(curve(v), size=100), "residual")
    assert np.median(r) < 5 and r[510] > 20


@pytest.mark.parametrize("q,size", [(0.5, 7), (0.1, 20), (0.5, 140), (0.1, 600)])
def test_rolling_quantile_equals_plain_frames(curve, q, size):
    rnd = random.Random(1)
    v = [None if rnd.random() < 0.2 else rnd.random() for _ in range(800)]
    frames = [[x for x in v[max(0, i - size // 2): i + size - size // 2] if x is not None] for i in range(len(v))]
    want = [float(np.quantile(f, q)) if f else None for f in frames]
    assert values(ro.rolling_quantile(curve(v), "v", q, size, "o"), "o") == pytest.approx(want)


def test_small_fluxes_survive_binning(spark):
    from helioframe.sources.lightcurve import bin_samples

    rows = spark.sql("SELECT timestamp_seconds(1704067200 + id) AS ts, 'soft' AS event_type, (3 + 2 * (id % 2)) * 1e-8 AS value FROM range(2)")
    assert bin_samples(rows, 60).first().v == pytest.approx(4e-8, rel=1e-12)


def test_interpolation_and_fill(curve):
    assert values(ro.linear_fill(curve([None, 10, None, None, 40, None])), "filled") == [None, 10, 20, 30, 40, None]
    assert values(ro.forward_fill(curve([None, 10, None, 40, None])), "filled") == [25, 10, 10, 40, 40]
    assert values(ro.forward_fill(curve([None, None])), "filled") == [0, 0]
    assert values(curve([1, 4, 9]).withColumn("g", ro.gradient("v")), "g") == [3, 4, 5]


def test_box_flare_is_found(curve):
    rnd = np.random.default_rng(42)
    v = rnd.normal(0, 1, 4000)
    v[2000:2061] += 50
    ev = isl.detect_threshold(curve(v), sigma=5.0, min_duration=30).collect()
    assert len(ev) == 1 and ev[0]["peak_flux"] > 30


def swpc_reference(v, n_day, thr, win, factor, min_run, min_dur, short, gap):
    """Direct sequential statement of the rules, for one short series."""
    n = len(v)
    bg = [float(np.percentile(v[max(0, i - win // 2): i + win - win // 2], 10)) for i in range(n)]
    flag = [v[i] > max(factor * bg[i], 0.1 * thr) for i in range(n)]
    found, i = [], 0
    while i < n:
        j = i
        while j < n and flag[j]:
            j += 1
        if j - 1 - i >= min_run and j > i:
            seg = v[i:j]
            p = i + int(np.argmax(seg))
            if v[p] >= thr:
                s = next((k for k in range(i, p + 1) if v[k] > bg[k] + 0.05 * thr), i)
                pre = max(bg[s], min(v[s: p + 1]))
                half, e = pre + (v[p] - pre) / 2, p
                while e < min(j - 1, n_day - 2) and v[e + 1] >= half:
                    e += 1
                if e - s + 1 >= (short if v[p] >= 10 * thr else min_dur):
                    found.append([s, p, e])
        i = max(j, i + 1)
    out = []
    for s, p, e in found:
        if out and s <= out[-1][2] + gap:
            if v[p] > v[out[-1][1]]:
                out[-1][1] = p
            out[-1][2] = max(out[-1][2], e)
        else:
            out.append([s, p, e])
    return out


def test_swpc_against_sequential_rules(spark, curve):
    rnd = np.random.default_rng(7)
    v = rnd.exponential(1.0, 1440)
    for c in (200, 600, 640, 1000, 1425):
        v[c: c + 30] += 40 * np.exp(-np.abs(np.arange(len(v[c: c + 30])) - 8) / 4)
    v = [round(float(x), 3) for x in v]
    got = isl.detect_swpc(curve(v), cadence=60, threshold=8.0, window=60, min_run=2, min_duration=4, short_duration=2, merge_gap=5)
    rows = [[r["start_bin"], r["peak_bin"], r["end_bin"]] for r in got.orderBy("start_bin").collect()]
    assert rows == swpc_reference(v, 1440, 8.0, 60, 1.5, 2, 4, 2, 5) and len(rows) >= 4


def test_prominence(curve):
    got = isl.prominent_peaks(curve([0, 5, 1, 9, 8, 8.5, 2, 3, 0]), 1.0, 1).orderBy("bin").collect()
    assert [(r["bin"], r["prominence"]) for r in got] == [(1, 4.0), (3, 9.0), (7, 1.0)]


def test_greedy_and_mutual_matching(spark):
    left = spark.createDataFrame([(DAY, "a", 100), (DAY, "b", 130)], "day date, lid string, lt bigint")
    right = spark.createDataFrame([(DAY, "x", 120), (DAY, "y", 300)], "day date, rid string, rt bigint")
    assert [(r["lid"], r["rid"]) for r in ma.greedy_pairs(left, right, 60).collect()] == [("a", "x")]
    assert [(r["lid"], r["rid"]) for r in ma.mutual_nearest(left, right, 60, on=("day",)).collect()] == [("b", "x")]
    score = ma.score_matches(left, right, ma.greedy_pairs(left, right, 60)).first()
    assert (score["tp"], score["fp"], score["fn"]) == (1, 1, 1)


def test_pixel_coincidence_brute_force(spark):
    rnd = random.Random(5)
    ph = [(DAY, rnd.randrange(3), rnd.randrange(0, 200_000_000)) for _ in range(60)]
    got = {r["second"] for r in ma.coincident_seconds(spark.createDataFrame(ph, "day date, pix int, us bigint"), 2.0).collect()}
    want = set()
    for pix in range(3):
        us = sorted(u for _, p, u in ph if p == pix)
        want |= {math.floor((b + 500000) / 1e6) for a, b in zip(us, us[1:]) if b - a < 2_000_000}
    assert got == want


def test_keep_first_is_ordered(spark):
    df = spark.createDataFrame([("k", 2, "late"), ("k", 1, "early"), ("q", 5, "only")], "k string, o int, x string")
    assert sorted((r["k"], r["x"]) for r in ma.keep_first(df, ["k"], ["o"]).collect()) == [("k", "early"), ("q", "only")]


def test_rolling_spearman_constant_is_missing(curve):
    df = curve([1, 2, 3, 4, 5, 6, 7, 8]).withColumn("w", F.col("v") * -2)
    got = values(ro.rolling_spearman(df, "v", "w", 4, keys=("channel", "day")), "rho")
    assert got[:4] == [None] * 4 and got[4:] == pytest.approx([-1.0] * 4)


def test_rolling_spearman_with_ties_and_gaps():
    rnd = np.random.default_rng(6)
    x, y = rnd.integers(0, 5, 200).astype(float), rnd.integers(0, 9, 200).astype(float)
    x[40:46] = y[40:46] = np.nan  # rows that are not in the table
    got = ro._sliding_spearman(x, y, 30, chunk=17)
    assert np.isnan(got[:30]).all()
    for e in range(30, 200):
        a, b = pd.Series(x[e - 30 : e]).dropna(), pd.Series(y[e - 30 : e]).dropna()
        assert got[e] == pytest.approx(np.corrcoef(a.rank(), b.rank())[0, 1], abs=1e-12)
