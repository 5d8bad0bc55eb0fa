"""Lagged causal networks, mediation, Granger gain."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import corr
from .periodicity import arrays_of

# Fixed values
GRANGER_LAGS = (1, 3, 5, 10, 20, 30, 60)
RIDGE_ALPHAS = (0.1, 1.0, 10.0)


@F.pandas_udf(T.StructType([T.StructField("r", T.DoubleType()), T.StructField("lag", T.LongType())]))
def _lead_scan(x: pd.Series, y: pd.Series, limit: pd.Series) -> pd.DataFrame:
    """Strongest Pearson correlation of x(t) with y(t+lag), lag = 1..limit (first one on a tie); NULL for series under 2 * limit."""
    out = []
    for a, b, m in zip(x, y, limit):
        a, b, best = np.asarray(a, dtype=float), np.asarray(b, dtype=float), (0.0, 0)
        n = min(len(a), len(b))
        if n < 2 * int(m):
            out.append((None, None))
            continue
        for k in range(1, int(m) + 1):
            u, v = a[: n - k] - a[: n - k].mean(), b[k:n] - b[k:n].mean()
            scale = np.sqrt((u @ u) * (v @ v))
            r = float(u @ v / scale) if scale > 1e-12 else 0.0
            if abs(r) > abs(best[0]) + 1e-12:
                best = (r, k)
        out.append(best)
    return pd.DataFrame(out, columns=["r", "lag"]).astype({"r": "Float64", "lag": "Int64"})


def lag_edges(df: DataFrame, keys, bands: list[str], max_lag=30, threshold=0.1, order="bin") -> DataFrame:
    """Directed edges (keys, src, dst, r, lag) with |r| over the threshold.

    Bands are columns, so the ordered band pairs are a constant list; each day's bounded arrays are
    scanned in Arrow batches.
    """
    arr = arrays_of(df, keys, bands, order)
    pairs = [(a, b) for a in bands for b in bands if a != b]
    options = F.array(*[F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs])
    rows = arr.select(*keys, F.inline(options))
    rows = rows.withColumn("_e", _lead_scan("x", "y", F.lit(max_lag)))
    return rows.select(*keys, "src", "dst", F.col("_e.r").alias("r"), F.col("_e.lag").alias("lag")).where((F.abs("r") > threshold) & (F.col("lag") > 0))


def degrees(edges: DataFrame, keys, bands: list[str]) -> DataFrame:
    """In-/out-degree and centrality of every band, bands without edges included."""
    ends = edges.select(*keys, F.explode(F.array(F.struct(F.col("src").alias("band"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                                                 F.struct(F.col("dst").alias("band"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select(*keys, "e.*")
    zero = edges.select(*keys).distinct().select(*keys, F.explode(F.array(*[F.lit(b) for b in bands])).alias("band"), F.lit(0).alias("o"), F.lit(0).alias("i"))
    d = ends.unionByName(zero).groupBy(*keys, "band").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return d.withColumn("centrality", (F.col("in_degree") + F.col("out_degree")) / F.lit(max(len(bands) - 1, 1)))


def feedback_loops(edges: DataFrame, keys) -> DataFrame:
    """Pairs of bands with edges in both directions: grouped by the unordered pair, no self-join."""
    forward = F.col("src") < F.col("dst")
    pair = edges.withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst"))
    out = pair.groupBy(*keys, "a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(forward, F.abs("r"))).alias("forward_strength"), F.max(F.when(~forward, F.abs("r"))).alias("backward_strength"),
        F.max(F.when(forward, F.col("lag"))).alias("forward_lag"), F.max(F.when(~forward, F.col("lag"))).alias("backward_lag"))
    return out.where(F.col("n") == 2).drop("n")


def network_features(edges: DataFrame, keys, bands: list[str], soft: str, hard: str) -> DataFrame:
    """Density, mean degrees, loops and the soft/hard edges per key."""
    n = len(bands)
    pairs = edges.withColumn("_p", F.struct(F.least("src", "dst"), F.greatest("src", "dst")))
    pick = lambda s, d, c: F.coalesce(F.max(F.when((F.col("src") == s) & (F.col("dst") == d), c)), F.lit(0.0))
    out = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_e"), F.countDistinct("_p").alias("_u"),
        pick(hard, soft, F.col("lag").cast("double")).alias("hxr_to_sxr_lag"), pick(hard, soft, F.abs("r")).alias("hxr_to_sxr_strength"),
        pick(soft, hard, F.col("lag").cast("double")).alias("sxr_to_hxr_lag"), pick(soft, hard, F.abs("r")).alias("sxr_to_hxr_strength"))
    e = F.col("_e")
    loops = e - F.col("_u")
    return out.withColumn("causal_network_density", e / (n * (n - 1))).withColumn("avg_in_degree", e / n).withColumn("avg_out_degree", e / n).withColumn(
        "avg_centrality", 2 * e / (n * max(n - 1, 1))).withColumn("n_feedback_loops", loops.cast("double")).withColumn("cycle_detected", (loops > 0).cast("double")).drop("_e", "_u")


def mediation(df: DataFrame, keys, treatment: str, mediator: str, outcome: str, least=30) -> DataFrame:
    """Total, direct and indirect effect from three pairwise correlations (partial correlations in
    closed form); NULL effects where a series is constant."""
    full = F.col(treatment).isNotNull() & F.col(mediator).isNotNull() & F.col(outcome).isNotNull()
    d = df.where(full).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), corr(treatment, outcome).alias("total"), corr(treatment, mediator).alias("path_a"), corr(mediator, outcome).alias("_mo"))
    d = d.where(F.col("n") >= least)
    c, a, b = F.col("total"), F.col("path_a"), F.col("_mo")
    partial = lambda r, u, v: F.when((1 - u * u) * (1 - v * v) > 0, (r - u * v) / F.sqrt((1 - u * u) * (1 - v * v)))
    d = d.withColumn("path_b", partial(b, a, c)).withColumn("direct", partial(c, a, b))
    d = d.withColumn("indirect", a * F.col("path_b"))
    share = F.when(F.abs(c) > 1e-6, F.least(F.abs(F.col("indirect") / c), F.lit(1.0))).otherwise(0.0)
    return d.withColumn("mediation_proportion", share).drop("_mo")


def granger(df: DataFrame, keys, cause: str, effect: str, order="bin", lags=GRANGER_LAGS, max_lag=60, folds=5, gain=0.03) -> DataFrame:
    """First lag at which adding the cause's history lifts the time-ordered cross-validated R2 of a
    ridge autoregression by more than ``gain``.

    One bounded series per key; the ridge problems have at most 2*60 columns.
    """
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("is_causal", T.LongType()), T.StructField("best_lag", T.LongType()),
                          T.StructField("improvement", T.DoubleType()), T.StructField("r2_full", T.DoubleType()), T.StructField("r2_restricted", T.DoubleType())])
    keys = list(keys)
    d = df.where(F.col(cause).isNotNull() & F.col(effect).isNotNull()).select(*keys, order, F.col(cause).alias("c"), F.col(effect).alias("e"))

    def per_key(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        c, e, n = pdf["c"].to_numpy(float), pdf["e"].to_numpy(float), len(pdf)
        found = (0, 0, 0.0, 0.0, 0.0) if n >= max_lag * 3 else (None,) * 5  # too short to tell
        for lag in [k for k in lags if found[0] is not None and k <= n // 4 and n - k >= 2 * k]:
            past = lambda s: np.column_stack([s[lag - j - 1: n - j - 1] for j in range(lag)])
            y, own, with_cause = e[lag:], past(e), np.column_stack([past(e), past(c)])
            size = len(y) // (min(folds, n // max_lag) + 1)
            cuts = [len(y) - size * k for k in range(min(folds, n // max_lag), 0, -1)]
            if size < 5:
                continue
            restricted = np.mean([_ridge_r2(own, y, k, k + size) for k in cuts])
            full = np.mean([_ridge_r2(with_cause, y, k, k + size) for k in cuts])
            if full - restricted > gain:
                found = (1, lag, float(full - restricted), float(full), float(restricted))
                break
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), *found]], columns=[f.name for f in schema.fields])

    return d.groupBy(*keys).applyInPandas(per_key, schema)


def _ridge_r2(x: np.ndarray, y: np.ndarray, split: int, stop: int) -> float:
    """R2 on rows split..stop of a ridge fit on the rows before, penalty by leave-one-out error."""
    mx, my = x[:split].mean(axis=0), y[:split].mean()
    u, s, vt = np.linalg.svd(x[:split] - mx, full_matrices=False)
    target = u.T @ (y[:split] - my)

    def fit(alpha):
        shrink = s * s / (s * s + alpha)
        resid = (y[:split] - my) - u @ (shrink * target)
        lever = (u * u) @ shrink + 1.0 / split
        return float(np.mean((resid / np.maximum(1 - lever, 1e-9)) ** 2)), vt.T @ (s / (s * s + alpha) * target)

    _, beta = min((fit(a) for a in RIDGE_ALPHAS), key=lambda r: r[0])
    test = y[split:stop]
    rest = test - my - (x[split:stop] - mx) @ beta
    total = ((test - test.mean()) ** 2).sum()
    return float(1 - (rest**2).sum() / total) if total > 0 else 0.0
