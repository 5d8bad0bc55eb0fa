import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helioframe.operators import causal as ca
from helioframe.operators import information as inf
from helioframe.operators import learning as le
from helioframe.operators import nonlinear as nl
from helioframe.operators import periodicity as pe
from helioframe.operators import ranking as rk
from helioframe.operators import spectra as sp
from helioframe.operators import windows as wi

DAY = datetime.date(2024, 1, 1)


def test_feature_schema():
    assert len(wi.FEATURE_NAMES) == 179 == len(set(wi.FEATURE_NAMES))


@pytest.mark.parametrize("include,count", [(False, 276), (True, 277)])
def test_windows_per_day(spark, include, count):
    df = spark.range(86400).select(F.lit(DAY).alias("day"), F.col("id").alias("bin"))
    got = wi.hop(df, 86400, include_last=include).groupBy("win").count().collect()
    assert len(got) == count and {r["count"] for r in got} == {3600}


def test_window_features_match_numpy(spark):
    rnd = np.random.default_rng(18)
    v = rnd.poisson(20, 600).astype(float)
    b = rnd.poisson(5, (600, 10)).astype(float)
    rows = [(DAY, i, float(v[i]), *map(float, b[i])) for i in range(600)]
    df = spark.createDataFrame(rows, "day date, bin bigint, soft double, " + ", ".join(f"b{i} double" for i in range(10)))
    f = wi.window_features(df, "soft", [f"b{i}" for i in range(10)], 1440, 300, 300, scales={"5m": 30, "15m": 90, "30m": 180})
    r = f.where("win = 1").first()
    x = v[300:600]
    c = x - x.mean()
    assert r["sxr_mean"] == pytest.approx(x.mean()) and r["sxr_std"] == pytest.approx(x.std())
    assert r["sxr_p95"] == pytest.approx(np.percentile(x, 95)) and r["sxr_kurtosis"] == pytest.approx((c**4).mean() / x.var() ** 2 - 3)
    assert r["sxr_acf_5s"] == pytest.approx((c[:-5] * c[5:]).sum() / (c * c).sum())
    assert r["sxr_15m_slope"] == pytest.approx(np.polyfit(np.arange(90), x[-90:], 1)[0])
    assert r["d2sxr_dt2_std"] == pytest.approx(np.diff(x, 2).std())
    full = wi.canonical(f, ["day", "win"])
    assert len(full.columns) == 181 and all(x is not None and math.isfinite(x) for x in full.first()[2:])


def test_too_few_samples_give_no_window(spark):
    df = spark.createDataFrame([(DAY, i, float(i) if i < 4 else None, 1.0, 1.0) for i in range(40)], "day date, bin bigint, soft double, b0 double, b1 double")
    assert wi.window_features(df, "soft", ["b0", "b1"], 1440, 40, 40, scales={"5m": 5, "15m": 10, "30m": 20}).count() == 0


def test_power_law_and_isothermal_recovered(spark):
    e = np.linspace(2, 60, 100)
    rows = [("k", float(x), float(3e4 * x**-3.2)) for x in e]
    df = spark.createDataFrame(rows, "k string, energy double, counts double")
    assert df.groupBy("k").agg(sp.spectral_index("energy", "counts").alias("g")).first()["g"] == pytest.approx(3.2)
    fit = sp.non_thermal_fit(df, ["k"], [10.0, 20.0]).first()
    assert fit["gamma"] == pytest.approx(3.2) and fit["delta"] == pytest.approx(4.2) and fit["norm"] == pytest.approx(3e4, rel=1e-6)
    hot = [("k", float(x), float(500 / x * math.exp(-x / (0.08617 * 12)))) for x in np.linspace(2, 10, 40)]
    iso = sp.isothermal_fit(spark.createDataFrame(hot, df.schema), ["k"]).first()
    assert iso["temp_mk"] == pytest.approx(12) and iso["em"] == pytest.approx(500) and iso["chi2_red"] == pytest.approx(0, abs=1e-12)


def test_response_folding(spark):
    m = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.5), (1, 1, 2.0)], "ch int, e int, value double")
    a = spark.createDataFrame([(0, 10.0), (1, 20.0)], "e int, area double")
    f = spark.createDataFrame([(0, 1.0), (1, 3.0)], "e int, flux double")
    assert {r["ch"]: r["counts"] for r in sp.fold_response(m, a, f).collect()} == {0: 40.0, 1: 120.0}


def test_pulsation_found_in_noise(spark):
    rnd = np.random.default_rng(3)
    n = 1200
    v = 100 + 20 * np.sin(2 * np.pi * np.arange(n) / 60) + 5 * rnd.normal(size=n)
    rows = [("k", i, float(x)) for i, x in enumerate(v)] + [("short", i, 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, pos bigint, v double")
    out = {r["k"]: r for r in pe.detect_pulsations(df, ["k"], "v", 1.0, 10, 300, n_freqs=400).collect()}
    assert tuple(out["short"])[1:] == (0, 0.0, 0.0, 0.0, 0)
    r = out["k"]
    assert r["detected"] == 1 and r["period"] == pytest.approx(60, rel=0.1) and r["amplitude"] > 0.2


def test_wavelet_peak_period(spark):
    v = [math.sin(2 * math.pi * i / 40) for i in range(512)]
    arr = spark.createDataFrame([("k", v)], "k string, x array<double>")
    f = pe.band_features(pe.wavelet_power(arr, ["k"], ["x"], 1.0, pe.scale_grid(2, 100)), ["k"], "x").first()
    # the period axis 4*pi*s/6 reads twice the oscillation period for this kernel
    assert f["wavelet_peak_period"] == pytest.approx(80, rel=0.1)


def test_lag_sign_and_edges(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=400)
    y = np.concatenate([np.zeros(4), x[:-4]]) + 0.1 * rnd.normal(size=400)
    df = spark.createDataFrame([(DAY, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "day date, bin bigint, x double, y double")
    arr = pe.arrays_of(df, ["day"], ["x", "y"]).withColumn("s", inf.lag_scan("y", "x", F.lit(20))).first()["s"]
    assert arr["lag"] == 4 and arr["r"] > 0.9
    edges = {(r["src"], r["dst"]): r["lag"] for r in ca.lag_edges(df, ["day"], ["x", "y"], 10).collect()}
    assert edges[("x", "y")] == 4
    g = ca.granger(df, ["day"], "x", "y", lags=(1, 5), max_lag=20).first()
    assert g["is_causal"] == 1 and g["best_lag"] == 5


def test_sample_entropy_brute_force(spark):
    rnd = random.Random(2)
    v = [rnd.random() for _ in range(60)]
    got = spark.createDataFrame([(v,)], "x array<double>").select(inf.sample_entropy("x", F.lit(2), F.lit(0.5)).alias("s")).first()["s"]
    r, n = 0.5 * np.std(v), len(v)

    def count(m):
        return sum(max(abs(v[i + k] - v[j + k]) for k in range(m)) < r for i in range(n - m) for j in range(i + 1, n - m))

    assert got == pytest.approx(-math.log(count(3) / count(2)))


def test_recurrence_brute_force(spark):
    rnd = np.random.default_rng(4)
    x, y = rnd.random(300), rnd.random(300)
    r = spark.createDataFrame([(x.tolist(), y.tolist())], "x array<double>, y array<double>").select(nl.recurrence("x", "y", F.lit(3), F.lit(2), F.lit(0.3)).alias("r")).first()["r"]
    u = np.array([x[i: i + 5: 2] for i in range(296)])
    w = np.array([y[i: i + 5: 2] for i in range(296)])
    near = np.sqrt(((u[:, None] - w[None]) ** 2).sum(-1)) < 0.3
    lined = sum(near[i, j] and ((i and j and near[i - 1, j - 1]) or (i < 295 and j < 295 and near[i + 1, j + 1])) for i in range(296) for j in range(296))
    assert r["rate"] == pytest.approx(near.mean()) and r["determinism"] == pytest.approx(lined / near.sum())


def test_ranks_and_quantiles_are_exact(spark):
    rnd = random.Random(9)
    v = [round(rnd.expovariate(0.1), 1) for _ in range(3000)] + [7.7] * 1500  # one value holds a third
    df = spark.createDataFrame([("g", x) for x in v], "g string, v double")
    ranks = {r["v"]: r["rank"] for r in rk.average_rank(df, ["g"], "v").collect()}
    order = np.sort(v)
    for x in (7.7, order[0], order[-1]):
        at = np.nonzero(order == x)[0]
        assert ranks[x] == at.mean() + 1
    q = {r["q"]: r["quantile"] for r in rk.exact_quantiles(df, ["g"], "v", [0.0, 0.1, 0.5, 0.999, 1.0]).collect()}
    assert all(q[p] == pytest.approx(np.quantile(v, p)) for p in q)


def test_auc_and_sweep_brute_force(spark):
    rnd = random.Random(4)
    rows = [(round(rnd.random(), 2), int(rnd.random() < 0.4)) for _ in range(300)]
    df = spark.createDataFrame(rows, "score double, label int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert le.area_scores(df, "score", "label").first()["auc_roc"] == pytest.approx(want)
    for r in le.confusion_sweep(df, "score", "label").where("threshold in (0.01, 0.5, 0.99)").collect():
        assert r["tp"] == sum(s >= r["threshold"] for s in pos) and r["fp"] == sum(s >= r["threshold"] for s in neg)


def test_spearman_with_ties(spark):
    rnd = random.Random(8)
    rows = [(rnd.randrange(5), rnd.randrange(7)) for _ in range(200)]
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in rows], "g string, x double, y double")
    rank = lambda v: np.array([(np.sum(np.array(v) < x) + (np.sum(np.array(v) == x) + 1) / 2) for x in v])
    want = np.corrcoef(rank([a for a, _ in rows]), rank([b for _, b in rows]))[0, 1]
    assert rk.spearman(df, ["g"], "x", "y").first()["rho"] == pytest.approx(want)
