"""Models on tables with a known answer, Granger against refits one by one, pulsations planted in windows."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helioframe.operators import causal as ca
from helioframe.operators import learning as le
from helioframe.operators import periodicity as pe


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (1500, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)  # no single feature tells
    frame = pd.DataFrame(x, columns=list("abcd")).assign(label=y, part=np.where(np.arange(1500) < 1000, "train", "test"))
    return spark.createDataFrame(frame)


@pytest.mark.parametrize("kind, params", [("gbt", {"maxIter": 15, "maxDepth": 4}), ("rf", {"numTrees": 30, "maxDepth": 8})])
def test_trees_separate(spark, separable, kind, params):
    model = le.train_classifier(separable.where("part = 'train'"), list("abcd"), "label", kind, **params)
    auc = le.area_scores(le.score(model, separable.where("part = 'test'")).select("score", "label"), "score", "label").first()["auc_roc"]
    assert auc > 0.93
    rank = [r.feature for r in le.importances(model, list("abcd"), spark).orderBy(F.desc("importance")).collect()]
    assert set(rank[:2]) == {"a", "b"}


@pytest.mark.parametrize("label, want", [(1, (None, 1.0)), (0, (None, None))])
def test_areas_of_one_class(spark, label, want):
    """Without the other class a group has no ROC area; without positives no precision either."""
    rows = [("one", i / 10, label) for i in range(5)] + [("both", i / 10, i % 2) for i in range(6)]
    got = {r.part: r for r in le.area_scores(spark.createDataFrame(rows, "part string, score double, label bigint"), "score", "label", ("part",)).collect()}
    assert (got["one"].positives, got["one"].negatives) == (5 * label, 5 - 5 * label)
    assert (got["one"].auc_roc, got["one"].auc_pr) == want
    assert got["both"].auc_roc == pytest.approx(6 / 9)


@pytest.mark.parametrize("label", [0, 1])
def test_forest_of_one_class(spark, label):
    """A fold may train on one class alone, and its test part may hold one alone: scores and areas are still there."""
    fold = spark.createDataFrame([(float(i % 7), float(i % 5), label) for i in range(40)], "a double, b double, label bigint")
    model = le.train_classifier(fold, ["a", "b"], "label", "rf", numTrees=3, maxDepth=2)
    other = spark.createDataFrame([(1.0, 2.0, 0), (3.0, 1.0, 1)], "a double, b double, label bigint")
    scored = le.score(model, other).select("score", "label")
    assert [r.score for r in scored.collect()] == [float(label)] * 2
    mixed, alone = (le.area_scores(d, "score", "label").first() for d in (scored, scored.where(F.col("label") == label)))
    assert (mixed.auc_roc, mixed.auc_pr) == (0.5, 0.5)
    assert (alone.positives, alone.negatives, alone.auc_roc) == (label, 1 - label, None)


def ridge_score(x, y, split, stop):
    """R2 behind ``split`` of the ridge whose leave-one-out error, by refitting without each row, is least."""
    def fit(x, y, alpha):
        mx, my = x.mean(0), y.mean()
        beta = np.linalg.solve((x - mx).T @ (x - mx) + alpha * np.eye(x.shape[1]), (x - mx).T @ (y - my))
        return lambda z: my + (z - mx) @ beta

    past, target, rows = x[:split], y[:split], np.arange(split)

    def left_out(alpha):
        # with the mean of all rows kept, as the closed form does
        mx, my = past.mean(0), target.mean()
        z, t = past - mx, target - my
        h = np.einsum("ij,ij->i", z @ np.linalg.inv(z.T @ z + alpha * np.eye(z.shape[1])), z) + 1 / split
        resid = target - fit(past, target, alpha)(past)
        return np.mean((resid / (1 - h)) ** 2)

    best = min(ca.RIDGE_ALPHAS, key=left_out)
    test = y[split:stop]
    error = test - fit(past, target, best)(x[split:stop])
    return 1 - (error**2).sum() / ((test - test.mean()) ** 2).sum()


def test_granger_against_normal_equations(spark):
    rng = np.random.default_rng(4)
    n, lag, most = 240, 3, 20
    c = rng.normal(0, 1, n)
    e = np.zeros(n)
    for k in range(2, n):
        e[k] = 0.4 * e[k - 1] + 0.8 * c[k - 2] + 0.3 * rng.normal()
    df = spark.createDataFrame(pd.DataFrame({"day": 1, "bin": np.arange(n), "c": c, "e": e}))
    got = ca.granger(df, ["day"], "c", "e", lags=(lag,), max_lag=most, folds=4).first()
    past = lambda s: np.column_stack([s[lag - j - 1 : n - j - 1] for j in range(lag)])
    y, own, both = e[lag:], past(e), np.column_stack([past(e), past(c)])
    size = len(y) // 5
    cuts = [len(y) - size * k for k in (4, 3, 2, 1)]
    r2 = [np.mean([ridge_score(x, y, k, k + size) for k in cuts]) for x in (own, both)]
    assert got.is_causal == 1 and got.best_lag == lag
    assert got.r2_restricted == pytest.approx(r2[0], abs=1e-9) and got.r2_full == pytest.approx(r2[1], abs=1e-9)


def test_pulsations_planted_in_windows(spark):
    """Every window has its own period; one is flat, one is a straight line."""
    rows, n = [], 400
    t = np.arange(n)
    rng = np.random.default_rng(2)
    planted = {1: 20.0, 2: 33.0, 3: 50.0}
    for win, period in planted.items():
        rows += [(win, int(k), float(v)) for k, v in enumerate(100 + 10 * np.sin(2 * math.pi * t / period) + rng.normal(0, 0.5, n))]
    rows += [(4, int(k), 5.0) for k in t] + [(5, int(k), 0.0) for k in range(20)]
    found = {r.win: r for r in pe.detect_pulsations(spark.createDataFrame(rows, "win int, pos long, v double"), ["win"], "v", 1.0, 10.0, 80.0, n_freqs=400).collect()}
    assert sorted(found) == [1, 2, 3, 4, 5]
    for win, period in planted.items():
        r = found[win]
        assert r.detected == 1 and abs(r.period - period) / period < 0.2 and r.significance > 0.5 and r.amplitude == pytest.approx(0.2, abs=0.06)
    assert found[4].detected == 0 and found[5].detected == 0 and found[5].significance == 0


def test_window_wavelets_equal_scale_rows(spark):
    """The kernel against the same sums over one row per scale."""
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"k": np.repeat([1, 2, 3], 64), "bin": np.tile(np.arange(64), 3), "s": rng.normal(0, 1, 192), "h": rng.normal(3, 1, 192)})
    frame.loc[frame.k == 3, "s"] = 7.0
    arrays = pe.arrays_of(spark.createDataFrame(frame), ["k"], ["s", "h"])
    scales, bands = pe.scale_grid(2.0, 16.0), {"x": (4, 9), "y": (9, 20)}
    want = pe.band_features(pe.wavelet_power(arrays, ["k"], ["s", "h"], 1.0, scales), ["k"], "s", "h", bands, (6, 12)).toPandas().sort_values("k")
    got = pe.window_band_features(arrays, ["k"], "s", "h", 1.0, scales, bands, (6, 12)).toPandas().sort_values("k")
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:
        assert np.allclose(got[c].astype(float), want[c].astype(float)), c
