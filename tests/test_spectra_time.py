"""Time-tagged spectra, responses, entropy and matching on small made-up tables with known answers."""

import datetime
import math
import random
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import TABLES, rows_of
from helioframe.functions.scalars import BOLTZMANN_KEV_PER_MK
from helioframe.operators import information as inf
from helioframe.operators import matching as ma
from helioframe.operators import periodicity as pe
from helioframe.operators import quality as qu
from helioframe.operators import spectra as sp
from helioframe.sources import reference as rf

SF = "/root/testdata/sf0.001"
DAY = datetime.date(2024, 1, 1)
T0 = 1704067200


@pytest.mark.parametrize("name", ["window_spectral", "flare_temperature", "response_fold_sparse", "scale_significance", "oscillation_cycles", "channel_layout", "version_consistency",
                                  "coincidence_mutual", "validate_greedy", "hurst_filled", "wavelet_samples"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


# -- matching -------------------------------------------------------------------------------------------------
def brute_greedy(left, right, tol, rule):
    free, out = list(right), []
    for lid, t in sorted(left, key=lambda x: (x[1], x[0])):
        near = [r for r in free if abs(r[1] - t) <= tol]
        if near:
            pick = min(near, key=lambda r: ((abs(r[1] - t) if rule == "nearest" else 0), r[1], r[0]))
            free.remove(pick)
            out.append((lid, pick[0]))
    return sorted(out)


@pytest.mark.parametrize("rule", ["nearest", "first"])
@pytest.mark.parametrize("n_right", [40, 3000])
def test_greedy_matching_is_exact_and_bounded(spark, rule, n_right):
    rng = random.Random(n_right)
    span = 2 * 86400
    left = [(i, T0 + rng.randrange(span)) for i in range(60)] + [(100 + i, T0 + 86400 + 5 * (i // 2)) for i in range(8)]
    right = [(1000 + i, T0 + rng.choice([rng.randrange(span), 86400 + rng.randrange(-20, 20)])) for i in range(n_right)]
    day = lambda t: DAY + datetime.timedelta((t - T0) // 86400)
    l = spark.createDataFrame([(a, t, day(t)) for a, t in left], "lid long, lt long, day date")
    r = spark.createDataFrame([(a, t, day(t)) for a, t in right], "rid long, rt long, day date")
    got = sorted((x.lid, x.rid) for x in ma.greedy_pairs(l, r, 1800, rule).collect())
    assert got == brute_greedy(left, right, 1800, rule)
    # what reaches a group: at most one candidate more than the left events whose windows overlap before it
    kept = ma.reachable(l, r, 1800, rule).groupBy("lid").count().toPandas().set_index("lid")["count"]
    for lid, t in left:
        before = sum((abs(u - t) <= 3600) and (u, o) <= (t, lid) for o, u in left)
        assert kept.get(lid, 0) <= before


def test_mutual_matching_crosses_midnight(spark):
    l = spark.createDataFrame([(1, T0 + 86400 - 300, DAY)], "lid long, lt long, day date")
    r = spark.createDataFrame([(2, T0 + 86400 + 300)], "rid long, rt long")
    assert [(x.lid, x.rid) for x in ma.mutual_nearest(l, r, 3600).collect()] == [(1, 2)]


# -- entropy ----------------------------------------------------------------------------------------------------
def pairs_by_hand(points, r):
    return sum(int((np.abs(points[i + 1 :] - points[i]).max(axis=1) < r).sum()) for i in range(len(points)))


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_close_pairs(dims):
    rng = np.random.default_rng(dims)
    for points in (rng.normal(0, 1, (400, dims)), rng.integers(0, 5, (300, dims)) * 0.1, np.zeros((50, dims)), np.vstack([rng.normal(0, 1, (80, dims)), [[1e9] * dims, [-1e9] * dims]])):
        for r in (0.1, 0.3, 2.0):
            assert inf.close_pairs(points.astype(float), r) == pairs_by_hand(points, r)


def test_entropy_of_a_day_in_seconds(spark):
    x = np.random.default_rng(1).normal(0, 1, 86400)
    began = time.time()
    a, b = (inf.close_pairs(np.lib.stride_tricks.sliding_window_view(x, k)[: len(x) - k], 0.2) for k in (3, 2))
    assert time.time() - began < 30
    assert 2.0 < -math.log(a / b) < 2.4  # white noise


# -- spectra ------------------------------------------------------------------------------------------------------
def test_flare_temperature_recovers_the_model(spark):
    """Counts of a 20 MK plasma seen through a known area, split over the bins of a flare."""
    hot, norm, area = 20.0, 1e6, 3.0
    rows = []
    for b in range(40):
        for ch in range(30):
            e = 2.0 + 0.5 * ch
            rate = norm * math.exp(-e / (BOLTZMANN_KEV_PER_MK * hot)) / math.sqrt(e)
            rows.append((DAY, T0 + 60 * b, ch, rate * area * 0.5 / 10 if 10 <= b < 20 else 7.0 * ch))
    spectra = spark.createDataFrame(rows, "day date, t long, ch long, counts double")
    flares = spark.createDataFrame([(DAY, T0 + 600, T0 + 1199), (DAY, T0 + 1500, T0 + 1600)], "day date, start_t long, end_t long")
    channels = sp.channel_energies(spark, 30, 2.0, 0.5).withColumn("area", F.lit(area))
    accumulated = sp.flare_spectra(spectra, flares, cadence=60)
    fit = sp.flare_temperatures(accumulated, channels, ["day", "start_t", "end_t"], least_bins=5).collect()
    assert [(r.start_t, r.time_bins, r.exposure) for r in fit] == [(T0 + 600, 10, 600.0)]
    assert fit[0].temp_mk == pytest.approx(hot, rel=1e-9)
    assert fit[0].log_em == pytest.approx(math.log10(norm * 4 * math.pi * sp.DISTANCE_CM**2 * sp.EM_SCALE), rel=1e-12)
    samples = spark.createDataFrame([(DAY, T0 + 700, 25.0), (DAY, T0 + 2000, 25.0)], "day date, t long, temp double")
    found = sp.temperature_difference(samples, sp.flare_temperatures(accumulated, channels, ["day", "start_t", "end_t"]))
    diff = {r.t: r.temp_diff for r in found.collect()}
    assert diff[T0 + 700] == pytest.approx(5.0) and diff[T0 + 2000] is None


def test_windows_differ_within_a_day(spark):
    """A spectrum that hardens from bin to bin hardens from window to window."""
    rows = [("hard", DAY, b, ch, 2.0 + ch, 1e6 * (2.0 + ch) ** -(6.0 - b / 30)) for b in range(48) for ch in range(30)]
    spectra = spark.createDataFrame(rows, "channel string, day date, bin long, ch long, energy double, counts double")
    hop = sp.hopping_spectra(spectra, ["channel", "day"], 48, 12, 6)
    by_hand = spectra.where("bin between 6 and 17 and ch = 3").agg(F.sum("counts")).first()[0]
    assert hop.where("win = 1 and ch = 3").first().counts == pytest.approx(by_hand)
    f = sp.window_spectral(hop, ["day", "win"], "soft", "hard", "second", [10.0, 15.0]).orderBy("win").toPandas()
    assert list(f["win"]) == [0, 1, 2, 3, 4, 5]
    gamma = f["hxr_gamma_window_czt1"].to_numpy()
    assert (np.diff(gamma) < -0.05).all() and (f["shs_index"].to_numpy()[1:] < 0).all() and (f["spectral_hardening_rate"].to_numpy()[1:] > 0).all()
    assert (f["sxr_temp_window"] == 0).all() and f["nonthermal_fraction_window"].between(0, 1).all()


def test_compressed_response(spark):
    rng = random.Random(2)
    rows = [(ch, e, rng.random()) for e in range(6) for ch in range(40) if rng.random() < 0.6] + [(0, 9, 0.0)]
    dense = spark.createDataFrame(rows, "ch long, e long, value double")
    packed = sp.compress_response(dense)
    assert sorted(map(tuple, sp.expand_response(packed).select("ch", "e", "value").collect())) == sorted(r for r in rows if r[2] > 0)
    one = packed.where("e = 3").first()
    assert sum(one.length) == len(one["values"]) and all(a + n < b for a, n, b in zip(one.first, one.length, one.first[1:]))
    area = spark.range(10).select(F.col("id").alias("e"), (F.col("id") + 1.0).alias("area"))
    flux = spark.createDataFrame([(k, e, float(k + e)) for k in range(2) for e in range(10)], "label long, e long, flux double")
    want = {(r.label, r.ch): r.counts for r in sp.fold_response(dense.where("value > 0"), area, flux, ["label"]).collect()}
    got = {(r.label, r.ch): r.counts for r in sp.fold_compressed(packed, area, flux, ["label"]).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


# -- reference flux, versions, pulsations ----------------------------------------------------------------------------
def test_reference_flux(spark):
    rows = [(0.0, 1e-6, -1e-9), (1.0, float("nan"), 2e-8), (2.0, float("inf"), None)]
    got = rf.reference_flux(spark.createDataFrame(rows, "time double, xrsb_flux double, xrsa_flux double")).orderBy("t").collect()
    assert [(r.t, r.xrsb, r.xrsa) for r in got] == [(946728000, 1e-6, None), (946728001, None, 2e-8), (946728002, None, None)]
    assert str(got[0].day) == "2000-01-01" and got[0].mjd == 51544.5


def test_channel_layout(spark):
    rows = [(DAY, 0, "sxr", 0, 5.0), (DAY, 1, "sxr", 0, 8.0), (DAY, 0, "czt", 4, 3.0), (DAY, 0, "cdte", 2, -1.0), (DAY, 1, "xrsa", 0, 2.0), (DAY, 1, "none", 0, 9.0), (DAY, 2, "xrsb", 0, None)]
    got = {r.bin: r for r in rf.channel_layout(spark.createDataFrame(rows, "day date, bin long, detector string, band int, v double")).collect()}
    assert [got[0][f"ch{k}"] for k in range(12)] == [5.0, 0, 0, 0, 0, 0, 0, 0, 3.0, 0, 0, 0]
    assert got[1]["ch11"] == 3.0 and got[1]["ch10"] == 2.0 and got[2]["ch9"] == 0.0 and got[2]["ch11"] == -8.0


def test_checksums_see_order_never_but_repeats(spark):
    rows = [(1, "a", k, None if k == 3 else f"x{k}") for k in range(20)]
    make = lambda r: spark.createDataFrame(r, "day int, version string, k long, s string")
    other = [(1, "b", *r[2:]) for r in reversed(rows)]
    of = lambda r: qu.version_consistency(qu.content_checksums(make(r), ["day", "version"], ["k", "s"]), ["day"]).first()
    assert of(rows + other).consistent == 1
    assert of(rows + other[1:] + [(1, "b", 99, "y")]).consistent == 0
    assert of(rows + other + other[:2]).consistent == 0


def test_pulsation_fallback(spark):
    cols = "day int, detected long, period double, amplitude double, significance double, n_periods long"
    best = spark.createDataFrame([(1, 1, 5.0, 1.0, 0.2, 1), (2, 0, 4.0, 1.0, 0.5, 0), (3, 0, 4.0, 1.0, 0.1, 0)], cols)
    whole = spark.createDataFrame([(d, 1, 9.0, 1.0, 0.3, 1) for d in (1, 2, 3, 4)], cols)
    got = {r.day: (r.period, r.from_series) for r in pe.with_fallback(best, whole, ["day"]).collect()}
    assert got == {1: (5.0, 0), 2: (4.0, 0), 3: (9.0, 1), 4: (9.0, 1)}


def test_red_noise_significance(spark):
    """Against the AR(1) formula; a strong oscillation stands out at its period only."""
    rng = np.random.default_rng(5)
    x = 0.3 * rng.normal(0, 1, 512) + 3 * np.sin(2 * np.pi * np.arange(512) / 32)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "bin": np.arange(512), "v": x}))
    scales = pe.scale_grid(2.0, 60.0, 0.25)
    arrays = pe.arrays_of(df, ["k"], ["v"])
    noise = pe.red_noise(df, ["k"], "v")
    found = pe.scale_significance(pe.wavelet_power(arrays, ["k"], ["v"], 1.0, scales), noise, ["k"], "v").toPandas().sort_values("scale_no")
    r1 = found["r1"].iloc[0]
    power = pe._power(x, 1.0, scales, "real").mean(1)
    want = power / (1 / (1 + r1 * r1 - 2 * r1 * np.cos(2 * np.pi / found["period"].to_numpy())))
    assert np.allclose(found["significance"], want)
    samples = pe.sample_significance(pe.per_sample(arrays, ["k"], "v", None, 1.0, scales, (20, 50)), noise, ["k"], [4 * math.pi * s / 6 for s in scales])
    # the period axis is 4 * pi * s / 6: an oscillation over 32 samples lies near 64
    assert samples.count() == 512 and samples.select(F.avg((F.col("ridge_period").between(55, 75)).cast("int"))).first()[0] > 0.9


def test_cycles(spark):
    rows = [(DAY, T0 + i, 50.0 if (i // 5) % 2 else 500.0) for i in range(100)]
    samples = spark.createDataFrame(rows, "day date, t long, ridge_period double")
    flares = spark.createDataFrame([(DAY, T0, T0 + 99), (DAY, T0 + 40, T0 + 49), (DAY, T0 + 500, T0 + 600)], "day date, start_t long, end_t long")
    got = {r.start_t - T0: (r.samples, r.cycles, r.is_localized) for r in pe.oscillation_cycles(samples, flares, ["day"]).collect()}
    assert got == {0: (100, 9, 0), 40: (10, 0, 1), 500: (0, 0, 1)}
