"""Rescaled range, cross recurrence and block segmentation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .periodicity import arrays_of


def hurst(df: DataFrame, keys, value: str, window=3600, step=60, least=100, keys_size: int = 86400, spread=False) -> DataFrame:
    """Rescaled-range exponent ln(R/S)/ln(window/2) per hopping centred window with at least ``least`` values that differ.

    With ``spread`` every row within ``step`` of a centre has a value, that of the last such centre (the row ``step`` after a
    centre excluded).  Every key, a day whose rows the cadence bounds, is one Arrow group; its windows are slices of one sorted array.
    """
    half = window // 2
    starts = np.arange(0, (keys_size - half - 1 - half) // step + 1) * step
    d = df.where(F.col(value).isNotNull()).select(*keys, "bin", F.col(value).cast("double").alias("_v"))
    schema = T.StructType([*[d.schema[k] for k in keys], T.StructField("bin", T.LongType()), T.StructField("hurst", T.DoubleType())])

    def per_day(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin", kind="stable")
        bins, v, out = pdf["bin"].to_numpy(), pdf["_v"].to_numpy(), []
        first, stop = np.searchsorted(bins, starts), np.searchsorted(bins, starts + window)
        for k in np.flatnonzero(stop - first >= least):
            x = v[first[k] : stop[k]]
            if x.max() > x.min():
                run = np.cumsum(x - x.mean())
                out.append((*(pdf[c].iloc[0] for c in keys), starts[k] + half, np.log((run.max() - run.min()) / x.std(ddof=1)) / math.log(window / 2.0)))
        if spread and out:
            filled = np.full(keys_size, np.nan)
            for *_, centre, h in out:
                filled[max(0, centre - step) : centre + step] = h
            at = np.flatnonzero(~np.isnan(filled))
            return pd.DataFrame({c: [pdf[c].iloc[0]] * len(at) for c in keys} | {"bin": at, "hurst": filled[at]})
        return pd.DataFrame(out, columns=schema.names)

    return d.groupBy(*keys).applyInPandas(per_day, schema)


@F.pandas_udf(T.StructType([T.StructField("rate", T.DoubleType()), T.StructField("determinism", T.DoubleType())]))
def recurrence(x: pd.Series, y: pd.Series, dim: pd.Series, tau: pd.Series, eps: pd.Series) -> pd.DataFrame:
    """Cross-recurrence rate of two delay-embedded series and the share of recurrent points on
    diagonal lines of length >= 2.  Distances are formed in row blocks and only counted."""
    out = []
    for a, b, d, lag, radius in zip(x, y, dim, tau, eps):
        a, b, d, lag = np.asarray(a, dtype=float), np.asarray(b, dtype=float), int(d), int(lag)
        span = d * lag
        if min(len(a), len(b)) < span + 10:
            out.append((None, None))
            continue
        embed = lambda z: np.lib.stride_tricks.sliding_window_view(z[: len(z) - len(z) % span], (d - 1) * lag + 1)[:, ::lag]
        u, v = embed(a), embed(b)
        k = min(len(u), len(v))
        u, v = u[:k], v[:k]
        hits = lined = 0
        before = None  # previous row of the recurrence matrix
        for lo in range(0, k, 256):
            block = u[lo: lo + 257]
            near = np.sqrt(((block[:, None, :] - v[None, :, :]) ** 2).sum(axis=2)) < radius
            rows = near[:256]
            up = np.vstack([before if before is not None else np.zeros((1, k), bool), rows[:-1]])
            down = np.zeros_like(rows)
            down[: len(near) - 1] = near[1: len(rows) + 1] if len(near) > 1 else False
            diag = np.zeros_like(rows)
            diag[:, 1:] |= up[:, :-1]
            diag[:, :-1] |= down[:, 1:]
            hits += int(rows.sum())
            lined += int((rows & diag).sum())
            before = rows[-1:]
        out.append((hits / (k * k), lined / hits if hits else 0.0))
    return pd.DataFrame(out, columns=["rate", "determinism"])


def cross_recurrence(df: DataFrame, keys, x: str, y: str, dim=3, tau=10, eps=0.5, order="pos", least=100) -> DataFrame:
    arr = arrays_of(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), keys, [x, y], order).where(F.size(x) >= least)
    r = recurrence(x, y, F.lit(dim), F.lit(tau), F.lit(eps))
    return arr.withColumn("_r", r).select(*keys, F.col("_r.rate").alias("rate"), F.col("_r.determinism").alias("determinism"))
